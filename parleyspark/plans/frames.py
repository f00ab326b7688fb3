"""Input frames the named queries share, built from the supplied tables.

The corpora and the scorer of the original work are not part of the tables, so
labels, splits, scores and replies are stated as rules over them. The score is
``hash_unit``: a stand-in column, not a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions.hashing import hash_unit, split_name, stable_int
from parleyspark.session import spread, table


# --- Spark side -------------------------------------------------------------------
def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled texts: 0 abusive, 1 not; h and g are the two stand-in scores."""
    key = F.col("doc_id").cast("string")
    labels = table(spark, sf, "labels").select("doc_id", (1 - F.col("toxic")).cast("bigint").alias("label"))
    return (
        documents(spark, sf)
        .join(labels, "doc_id")
        .withColumns({"split": split_name(key), "h": hash_unit(F.lit("src"), key), "g": hash_unit(F.lit("out"), key)})
    )


def label_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``labelled`` without texts; the document scan reads three narrow columns."""
    key = F.col("doc_id").cast("string")
    labels = table(spark, sf, "labels").select("doc_id", (1 - F.col("toxic")).cast("bigint").alias("label"))
    return (
        table(spark, sf, "documents")
        .select("doc_id", "lang", "source")
        .join(labels, "doc_id")
        .withColumns({"split": split_name(key), "h": hash_unit(F.lit("src"), key), "g": hash_unit(F.lit("out"), key)})
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Three replies per labelled text, with the usual defects."""
    base = labelled(spark, sf)
    key = F.col("doc_id").cast("string")
    one_line = F.regexp_replace("text", r"[\r\n]+", " ")
    attempts = base.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
    kind = stable_int(F.lit("reply"), key, F.col("attempt").cast("string")) % 8
    raw = (
        F.when(kind == 0, "")
        .when(kind == 1, F.concat(F.lit("I cannot help with this. "), one_line))
        .when(kind == 2, F.left("text", F.lit(24)))
        .when(kind == 3, F.concat(F.lit("Output: "), F.regexp_replace(one_line, "clown|trash|loser|worthless|pathetic", "xx")))
        .otherwise(F.concat(F.lit('Hinglish: "'), one_line, F.lit('"')))
    )
    return attempts.select(
        "doc_id", "split", "label", "lang", "attempt", "h",
        F.col("text").alias("source"),
        raw.alias("raw"),
        hash_unit(F.lit("out"), key, F.col("attempt").cast("string")).alias("g"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as threads with a stated class, script and cell number."""
    from parleyspark.operators.threads import threads_from_turns

    base = threads_from_turns(turns(spark, sf), "conv_id", "turn", "text")
    base = base.withColumn("thread_id", F.col("conv_id").cast("string"))
    names = F.array(*[F.lit(c) for c in C.THREAD_CLASSES])
    scripts = F.array(F.lit("english"), F.lit("hinglish"), F.lit("hindi_devanagari"))
    label_id = stable_int(F.lit("label"), F.col("thread_id")) % 5
    base = base.withColumns(
        {
            "label_id": label_id,
            "script": F.get(scripts, (stable_int(F.lit("script"), F.col("thread_id")) % 3).cast("int")),
            "n": stable_int(F.lit("n"), F.col("thread_id")) % 1000,
            "subtype": F.concat(F.lit("sub"), (stable_int(F.lit("subtype"), F.col("thread_id")) % 4).cast("string")),
        }
    )
    base = base.withColumn("label", F.get(names, F.col("label_id").cast("int")))
    paired = F.col("label").isin("friendly_sarcasm", "hostile_abuse") & (F.col("n") % 2 == 0)
    pair_index = (F.floor(F.col("n") / 2) % 12).cast("string")
    pair_id = F.when(paired, F.concat_ws("|", F.col("script"), pair_index)).otherwise("")
    base = base.withColumn("pair_id", pair_id)
    from parleyspark.functions.hashing import paired_split_name

    split = F.when(
        F.col("pair_id") != "", paired_split_name(F.element_at(F.split("pair_id", r"\|"), -1).cast("int"))
    ).otherwise(split_name(F.col("thread_id")))
    return base.withColumn("split", split)


# --- SQL side ----------------------------------------------------------------------
def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(lit(w) for w in items) + "]"


def numbers(items) -> str:
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in items) + "]"


def s_int(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 12))::BIGINT)"


def s_unit(expr: str) -> str:
    return f"(({s_int(expr)} % 10000)::DOUBLE / 10000.0::DOUBLE)"


def s_split(key: str) -> str:
    h = f"({s_int(f"'split|' || {key}")} % 100)"
    return f"CASE WHEN {h} < 80 THEN 'train' WHEN {h} < 90 THEN 'val' ELSE 'test' END"


def s_norm(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), {lit(C.SPACE_RUN)}, ' ', 'g'), ' ')"


def s_strip(t: str) -> str:
    return f"trim({t}, {lit(C.STRIP_CHARS)})"


def s_count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {lit(pattern)}))"


def s_fold(t: str) -> str:
    return f"regexp_replace(lower({t}), {lit(C.OBFUSCATION_MARKS)}, '', 'g')"


def s_div(a: str, b: str, empty: str = "0.0::DOUBLE") -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE {empty} END"


ENGLISH_ONLY = sorted(set(C.ENGLISH_WORDS) - set(C.BASE_WORDS))


def s_tags(t: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({t}, {lit(C.TOKEN)}), lambda t: "
        f"CASE WHEN regexp_matches(t, {lit(C.LANGUAGE_FREE)}) THEN 'u' "
        f"WHEN list_contains({words(ENGLISH_ONLY)}, lower(t)) THEN 'e' ELSE 'h' END), '')"
    )


def s_content(t: str) -> str:
    return (
        f"list_transform(list_filter(regexp_extract_all({t}, {lit(C.TOKEN)}), "
        f"lambda t: NOT regexp_matches(t, {lit(C.LANGUAGE_FREE)})), lambda t: lower(t))"
    )


def s_content_count(t: str) -> str:
    return f"greatest(len({s_content(t)}), CASE WHEN {s_strip(t)} <> '' THEN 1 ELSE 0 END)"


def s_mixing(cte: str, name: str = "mixed") -> str:
    """CTEs adding the mixing columns to a CTE that has ``text``."""
    return f"""{name}_t AS (SELECT *, {s_tags('text')} AS tags FROM {cte}),
    {name}_c AS (SELECT *, length(tags) AS n_tokens, length(tags) - length(replace(tags, 'u', '')) AS n_univ,
        length(tags) - length(replace(tags, 'e', '')) AS n_en, length(tags) - length(replace(tags, 'h', '')) AS n_hi,
        replace(tags, 'u', '') AS lang_tags FROM {name}_t),
    {name}_s AS (SELECT *, greatest(length(regexp_replace(regexp_replace(lang_tags, 'h+', 'h', 'g'), 'e+', 'e', 'g')) - 1, 0) AS switches,
        CASE WHEN n_hi + n_en > 0 THEN n_hi::DOUBLE / (n_hi + n_en)::DOUBLE ELSE 0.0::DOUBLE END AS hi_frac,
        CASE WHEN n_hi + n_en > 0 THEN n_en::DOUBLE / (n_hi + n_en)::DOUBLE ELSE 0.0::DOUBLE END AS en_frac FROM {name}_c),
    {name} AS (SELECT *,
        CASE WHEN n_hi > 0 AND n_en > 0 THEN 100.0::DOUBLE * (1.0::DOUBLE - greatest(n_hi, n_en)::DOUBLE / (n_hi + n_en)::DOUBLE) ELSE 0.0::DOUBLE END AS cmi,
        CASE WHEN n_hi + n_en > 0 THEN (1.0::DOUBLE - (hi_frac * hi_frac + (1.0::DOUBLE - hi_frac) * (1.0::DOUBLE - hi_frac)))
             / (hi_frac * hi_frac + (1.0::DOUBLE - hi_frac) * (1.0::DOUBLE - hi_frac)) ELSE 0.0::DOUBLE END AS m_index,
        CASE WHEN n_hi + n_en >= 2 THEN switches::DOUBLE / (n_hi + n_en - 1)::DOUBLE ELSE 0.0::DOUBLE END AS i_index
        FROM {name}_s)"""


def s_bucket(x: str) -> str:
    b = C.CMI_BUCKETS
    return (
        f"CASE WHEN {x} <= 1e-9 THEN '{b[0]}' WHEN {x} < 10 THEN '{b[1]}' WHEN {x} < 20 THEN '{b[2]}' "
        f"WHEN {x} < 30 THEN '{b[3]}' ELSE '{b[4]}' END"
    )


LABELLED = f"""lab AS (SELECT d.doc_id, d.text, d.lang, d.source, (1 - l.toxic)::BIGINT AS label,
    {s_split('d.doc_id')} AS split, {s_unit("'src|' || d.doc_id")} AS h, {s_unit("'out|' || d.doc_id")} AS g
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

_ONE_LINE = r"regexp_replace(text, '[\r\n]+', ' ', 'g')"
REPLIES = f"""{LABELLED},
rep AS (SELECT doc_id, split, label, lang, attempt, h, text AS source,
    CASE k WHEN 0 THEN '' WHEN 1 THEN 'I cannot help with this. ' || {_ONE_LINE} WHEN 2 THEN left(text, 24)
           WHEN 3 THEN 'Output: ' || regexp_replace({_ONE_LINE}, 'clown|trash|loser|worthless|pathetic', 'xx', 'g')
           ELSE 'Hinglish: "' || {_ONE_LINE} || '"' END AS raw,
    {s_unit("'out|' || doc_id || '|' || attempt")} AS g
    FROM (SELECT *, {s_int("'reply|' || doc_id || '|' || attempt")} % 8 AS k FROM lab, (SELECT unnest([0, 1, 2]) AS attempt)))"""


def s_clean(raw: str) -> str:
    text = s_strip(f"coalesce({raw}, '')")
    for prefix in C.REPLY_PREFIXES:
        text = s_strip(f"regexp_replace({text}, '(?i)^{prefix}', '')")
    lines = (
        f"list_filter(list_transform(string_split_regex({text}, '\\r\\n|\\n|\\r'), "
        f"lambda x: trim(trim({s_strip('x')}, '\"'), '''')), lambda x: x <> '')"
    )
    return f"coalesce({lines}[1], '')"


def s_has_stem(src: str) -> str:
    return "(" + " OR ".join(f"contains({src}, {lit(m.stem)})" for m in C.MARKERS) + ")"


def s_preserved(src: str, out: str, folded_only: bool = False) -> str:
    parts = []
    for m in C.MARKERS:
        hits = []
        for s in m.surfaces:
            folded = s
            for mark in ".-_*@":
                folded = folded.replace(mark, "")
            hits.append(f"contains({s_fold(out)}, {lit(s)})" if folded_only else f"contains(lower({out}), {lit(s)})")
            hits.append(f"contains({s_fold(out)}, {lit(folded)})")
        parts.append(f"(contains({src}, {lit(m.stem)}) AND ({' OR '.join(hits)}))")
    return f"(NOT {s_has_stem(src)} OR {' OR '.join(parts)})"


def s_dev_share(t: str) -> str:
    return f"({s_count(t, C.DEVANAGARI)}::DOUBLE / greatest(length({t}), 1)::DOUBLE)"


def s_hard(src: str, out: str, with_lexicon: bool = True) -> str:
    lexicon = f"WHEN NOT {s_preserved(src, out)} THEN 'abuse_lexicon_missing'" if with_lexicon else ""
    return f"""CASE WHEN {out} = '' THEN 'empty' WHEN regexp_matches({out}, {lit(C.REFUSAL)}) THEN 'refusal'
        WHEN {s_dev_share(out)} > 0.05 THEN 'devanagari_remaining'
        WHEN {s_count(out, C.WORD)} < greatest(2, floor(0.35::DOUBLE * greatest({s_count(src, C.WORD)}, 1)::DOUBLE)) THEN 'collapsed_length'
        {lexicon} ELSE 'ok' END"""


def s_score_gate(label: str, h: str, g: str, delta: float = C.SCORE_DELTA) -> str:
    d = f"{delta!r}::DOUBLE"
    return f"""CASE WHEN {label} = 0 AND NOT ({g} >= {h} - {d}) THEN 'abuse_score_drop'
        WHEN {label} <> 0 AND {g} >= 0.5 AND {g} > {h} + {d} THEN 'abuse_score_spike' ELSE 'ok' END"""


GATED = f"""{REPLIES},
cleaned AS (SELECT *, {s_clean('raw')} AS reply FROM rep),
hard AS (SELECT *, {s_hard('source', 'reply')} AS hard FROM cleaned),
gated AS (SELECT *, CASE WHEN hard <> 'ok' THEN hard ELSE {s_score_gate('label', 'h', 'g')} END AS reason FROM hard)"""

RESOLVED = f"""{GATED},
grouped AS (SELECT doc_id, any_value(split) AS split, any_value(label) AS label, any_value(h) AS h,
    min(attempt) FILTER (WHERE reason = 'ok') AS first_ok, max(attempt) AS last_attempt,
    arg_max(reason, attempt) AS last_reason, arg_min(reply, attempt) FILTER (WHERE reason = 'ok') AS ok_reply,
    arg_max(reply, attempt) AS last_output, arg_min(g, attempt) FILTER (WHERE reason = 'ok') AS ok_g, arg_max(g, attempt) AS last_g
    FROM gated GROUP BY doc_id),
outcome AS (SELECT doc_id, split, label, h, CASE WHEN first_ok IS NOT NULL THEN 'accepted' ELSE 'quarantined' END AS status,
    CASE WHEN first_ok IS NOT NULL THEN 'ok' ELSE last_reason END AS fail_reason,
    (coalesce(first_ok, last_attempt) + 1)::BIGINT AS attempts,
    CASE WHEN first_ok IS NOT NULL THEN ok_reply ELSE '' END AS text, last_output,
    coalesce(ok_g, last_g) AS g, h - coalesce(ok_g, last_g) AS score_delta FROM grouped)"""

_CLASSES = words(C.THREAD_CLASSES)
THREADS = f"""th0 AS (SELECT conv_id, conv_id::VARCHAR AS thread_id, list(text ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
th1 AS (SELECT *, len(turns) AS length, {s_int("'label|' || thread_id")} % 5 AS label_id,
    (['english', 'hinglish', 'hindi_devanagari'])[{s_int("'script|' || thread_id")} % 3 + 1] AS script,
    {s_int("'n|' || thread_id")} % 1000 AS n, 'sub' || ({s_int("'subtype|' || thread_id")} % 4) AS subtype FROM th0),
th2 AS (SELECT *, ({_CLASSES})[label_id + 1] AS label FROM th1),
th3 AS (SELECT *, CASE WHEN label IN ('friendly_sarcasm', 'hostile_abuse') AND n % 2 = 0
    THEN script || '|' || ((n // 2) % 12) ELSE '' END AS pair_id FROM th2),
th AS (SELECT *, CASE WHEN pair_id <> '' THEN (CASE split_part(pair_id, '|', 2)::INT % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END)
    ELSE {s_split('thread_id')} END AS split FROM th3)"""
