"""Queries of the training-data operators: digests of their results, with SQL twins where SQL can say them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleyspark.llm import adaptive_rules, balance, class_lm, cover_tree, filter_audit, hash_tree, line_runs, order_minhash, ordinal, packing, semicrf, simhash, turn_repair
from parleyspark.llm.common import keep
from parleyspark.session import table

#: The ranks of the vocabulary of byte_bpe_50k.json, whose ids are packed.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: The vocabulary itself, for texts that the quick form cannot take.
WHOLE = "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


@query("op1_class_bigrams")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of four fifths of them."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    return class_lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), fold == 1)


@query("op2_entropy_balance")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = balance.mix(docs)
    taken = (F.col("mix_size") * F.col("mix_copies")).cast("long")
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        taken.alias("taken"), "source", F.col("mix_copies").alias("copies"),
    )


@query("op3_segment_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _adaptive_sql() -> str:
    """The rules over plain groupings: buckets, running counts and fences as in adaptive_rules, windows of words by unnesting."""
    rules = adaptive_rules.Rules()
    scale = repr(1 / math.log(rules.gamma))
    rates = [
        f"SELECT doc_id, lang, source, greatest({b}, 1) AS units, '{r}' AS rule, {a} / greatest({b}, 1) AS x, {slack}::DOUBLE AS slack,"
        f" {clump or 'NULL'}::DOUBLE AS clump, {str(low).lower()} AS low FROM b WHERE NOT base_failed"
        for r, (a, b, slack, clump, low) in adaptive_rules.RATES.items()
    ]
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i : i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_full_lines
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
x AS ({" UNION ALL ".join(rates)}),
k AS (SELECT *, CASE WHEN x > 0 THEN ceil(round(ln(x) * {scale}, 6))::INT ELSE {adaptive_rules.ZERO} END AS bucket FROM x),
l AS (SELECT 0 AS level, lang, source, rule, slack, clump, bucket FROM k UNION ALL SELECT 1, lang, NULL, rule, slack, clump, bucket FROM k UNION ALL SELECT 2, NULL, NULL, rule, slack, clump, bucket FROM k),
h AS (SELECT level, lang, source, rule, slack, clump, bucket, count(*) AS n FROM l GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (q ORDER BY bucket) AS upto, sum(n) OVER q AS total,
             CASE WHEN bucket = {adaptive_rules.ZERO} THEN 0 ELSE 2 * pow({rules.gamma!r}, bucket) / ({rules.gamma!r} + 1) END AS v
      FROM h WINDOW q AS (PARTITION BY level, lang, source, rule)),
q AS (SELECT level, lang, source, rule, max(total) AS total, min(v) FILTER (upto >= {1 - rules.outer} * total) AS lo,
             min(v) FILTER (upto >= 0.5 * total) AS mid, min(v) FILTER (upto >= {rules.outer} * total) AS hi FROM u GROUP BY ALL),
e AS (SELECT u.*, lo, mid, hi, hi + {rules.reach} * greatest(abs(hi - mid), slack) AS first_, lo - {rules.reach} * greatest(abs(mid - lo), slack) AS floor_
      FROM u JOIN q ON u.level = q.level AND u.rule = q.rule AND u.lang IS NOT DISTINCT FROM q.lang AND u.source IS NOT DISTINCT FROM q.source),
i AS (SELECT *, max(upto) FILTER (v <= first_) OVER (PARTITION BY level, lang, source, rule) AS inside FROM e),
t AS (SELECT level, lang, source, rule, slack, clump, total, mid, hi, first_, floor_, min(v) FILTER (upto >= {rules.tail} * inside) AS tail,
             round(sum(v * n) FILTER (v <= first_) / max(inside), 9) AS mean FROM i GROUP BY ALL),
f AS (SELECT *, CASE WHEN clump IS NOT NULL AND hi - mid < slack THEN greatest(first_, tail + {rules.reach} * slack) ELSE first_ END AS high,
             coalesce({rules.errors} * sqrt(greatest(mean, slack) * clump), {rules.noise} * slack) AS room FROM t),
o AS (SELECT g.lang, g.source, f.rule, arg_min(high, level) AS high, arg_min(floor_, level) AS floor_, arg_min(room, level) AS room
      FROM (SELECT DISTINCT lang, source FROM x) g JOIN f ON (f.total >= {rules.least} OR level = 2) AND (level > 1 OR f.lang IS NOT DISTINCT FROM g.lang) AND (level > 0 OR f.source IS NOT DISTINCT FROM g.source)
      GROUP BY ALL),
v AS (SELECT x.doc_id, bool_or(x > high + room / sqrt(units) OR (low AND x < floor_ - room / sqrt(units))) AS out
      FROM x JOIN o ON x.rule = o.rule AND x.lang IS NOT DISTINCT FROM o.lang AND x.source IS NOT DISTINCT FROM o.source GROUP BY x.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(out, false) AS kept
FROM b LEFT JOIN v USING (doc_id)
"""


@query("op4_adaptive_rules", _adaptive_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of adaptive thresholds on every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = keep(adaptive_rules.measure(docs).drop("text"))
    judged = adaptive_rules.adaptive_rules(docs, measured=measured)
    return judged.select("doc_id", *adaptive_rules.MEASURES[:5], "base_failed", "kept")


@query("op5_ordinal_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document by a model of a sample of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return ordinal.severity(docs, model)


@query("op6_hash_tree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards in a tree of four regions and three racks each, and with one more shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = hash_tree.shard_documents(docs, hash_tree.tree(24), hash_tree.tree(25))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return out.select("doc_id", "size", crc, F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


_TOP = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
) WHERE rank <= 5
"""


@query("op7_cover_tree", _TOP)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best scores of every 50th vector."""
    return cover_tree.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


#: The twin reads the lines of all documents and finds shared keys by plain grouping.
_LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.line, k.i, (s.owner IS NOT NULL AND s.owner <> k.doc_id) AS gone FROM k LEFT JOIN s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op8_line_runs", _LINES)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after dropping shared ones."""
    out = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_count").alias("n_lines"), F.col("dropped_count").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


def tokenizer(name: str = TOKENIZER) -> packing.Tokens:
    import public_tokenizers

    return packing.Tokens(public_tokenizers.path(name), public_tokenizers.PATTERN, whole=public_tokenizers.path(WHOLE))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op10_semi_markov_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: pattern spans, and those that the field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = semicrf.find(docs, semicrf.train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in semicrf.KINDS],
        F.sha2(line(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added"),
    )


@query("op11_order_minhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the next one's beginning at its end."""
    made = order_minhash.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


#: The twin takes CRC-32 over the digits of the key by a table it makes, and finds the least (cost, audit) of each state row by row.
_REPAIR = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, (SELECT unnest([1, 2]) AS copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text)) AS i FROM d
), f AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, substr(role, 1, 1) AS c FROM n
), o AS (
  SELECT *, blank OR again AS doomed, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM f
), ins(state, k, mid, lines) AS (
  VALUES ('0', 0, '0', []::VARCHAR[]), ('0', 1, 'u', ['user:']), ('0', 2, 'a', ['user:', 'assistant:']), ('s', 0, 's', []), ('s', 1, 'u', ['user:']), ('s', 2, 'a', ['user:', 'assistant:']),
    ('u', 0, 'u', []), ('u', 1, 'a', ['assistant:']), ('u', 2, 'u', ['assistant:', 'user:']), ('a', 0, 'a', []), ('a', 1, 'u', ['user:']), ('a', 2, 'a', ['user:', 'assistant:'])
), p(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '0', {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} FROM o
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT p.conv_id, o.i, CASE act WHEN 'D' THEN mid WHEN 'K' THEN c WHEN 'R' THEN CASE mid WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
      {'cost': best.cost + 3 * k + CASE act WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN act <> 'D' AND cut THEN 3 ELSE 0 END, 'audit': best.audit || repeat('I', k) || act,
       'lines': best.lines || ins.lines || CASE act WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE mid WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text] END} AS best
    FROM p JOIN o ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND o.i = p.i + 1 JOIN ins ON ins.state = p.state, (SELECT unnest(['D', 'K', 'R']) AS act)
    WHERE act = 'D' OR NOT doomed AND (act = 'R' OR mid || c IN ('0s', '0u', 'su', 'au', 'ua'))
  ) GROUP BY conv_id, i, state
), z AS (
  SELECT p.conv_id, min({'cost': best.cost + 3 * k, 'audit': best.audit || repeat('I', k), 'lines': best.lines || ins.lines}) AS best
  FROM p JOIN ins ON ins.state = p.state AND mid IN ('0', 'a') JOIN (SELECT conv_id, max(i) AS i FROM o GROUP BY conv_id) e ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.i = e.i
  GROUP BY p.conv_id
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT doomed) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id
"""


def damaged(turns: DataFrame) -> DataFrame:
    """One in twenty rows each dropped, emptied, without sentence ends, repeated, and given the role user, by the CRC-32 of their key."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    rows = turns.withColumn("_fault", F.crc32(key.cast("binary")) % 20).where("_fault <> 0")
    changed = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.coalesce("role", space))
    copies = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), copies.alias("_copy")).drop("_copy")


@query("op12_turn_repair", _REPAIR)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and the cheapest edits that mend its turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows, counts = turn_repair.repair(damaged(turns))
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = turns.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in counted]).distinct()
    some = every.unionByName(counts).unionByName(turn_repair.digests(rows), allowMissingColumns=True)
    some = some.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*counted, "audit", "repaired_sha256"]])
    return some.withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


#: The twin unrolls all orders over counts by part and failed filters; a step removes what fails its letter and no earlier one.
_AUDIT = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id
), h AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), c AS (SELECT unnest(string_split('ABCDE', '')) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c a, c b, c c, c d, c e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), r AS (
  SELECT part, filter_order, fails, n, good, bad, list_min(list_transform(string_split(fails, ''), lambda x: strpos(filter_order, x))) AS gone FROM h, o WHERE fails <> ''
  UNION ALL SELECT part, filter_order, fails, n, good, bad, 99 FROM h, o WHERE fails = ''
), s AS (
  SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS letter,
    coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone < step AND contains(fails, substr(filter_order, step, 1))), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = substr(filter_order, step, 1)), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM r, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM s
"""


@query("op13_filter_audit", _AUDIT)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove by language, order and step."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filter_audit.audit(filter_audit.failures(docs), labels)
