"""Tokens, languages, mixing indices and text predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import similarity as S
from parleyspark.functions import text as T
from parleyspark.functions.hashing import stable_int
from parleyspark.operators import lexicon as X
from parleyspark.operators import metrics as M
from parleyspark.operators import ranks as R
from parleyspark.plans import frames as B
from parleyspark.plans.registry import query
from parleyspark.session import computed_once, cut_lineage, spread, table


@query(
    "tokenize_counts",
    f"""SELECT doc_id, len(toks)::BIGINT AS n_tokens,
        len(list_filter(toks, lambda t: regexp_matches(t, '^[A-Za-z]')))::BIGINT AS n_latin,
        len(list_filter(toks, lambda t: regexp_matches(t, '^\\p{{Nd}}')))::BIGINT AS n_digits,
        md5(array_to_string(toks, ' ')) AS token_hash, ({B.s_content_count('text')})::BIGINT AS n_content
        FROM (SELECT doc_id, text, regexp_extract_all(text, {B.lit(C.TOKEN)}) AS toks FROM documents)""",
)
def tokenize_counts(spark, sf):
    d = B.documents(spark, sf).withColumn("toks", T.tokens(F.col("text")))
    n = lambda p: F.size(F.filter("toks", lambda t: t.rlike(p))).cast("bigint")
    content = F.size(F.filter("toks", lambda t: ~T.is_language_free(t)))
    return d.select(
        "doc_id",
        F.size("toks").cast("bigint").alias("n_tokens"),
        n("^[A-Za-z]").alias("n_latin"),
        n(r"^\p{Nd}").alias("n_digits"),
        F.md5(F.array_join("toks", " ")).alias("token_hash"),
        F.greatest(content, F.when(T.strip(F.col("text")) != "", 1).otherwise(0)).cast("bigint").alias("n_content"),
    )


_MIXED = f"WITH {B.s_mixing('documents', 'mixed')}"


@query(
    "language_tags",
    f"{_MIXED} SELECT doc_id, n_tokens::BIGINT AS n_tokens, n_univ::BIGINT AS n_univ, n_en::BIGINT AS n_en, n_hi::BIGINT AS n_hi, md5(tags) AS tag_hash FROM mixed",
)
def language_tags(spark, sf):
    d = T.with_mixing(B.documents(spark, sf))
    return d.select("doc_id", "n_tokens", "n_univ", "n_en", "n_hi", F.md5("tags").alias("tag_hash"))


@query(
    "mixing_indices",
    f"{_MIXED} SELECT doc_id, cmi, m_index, i_index, en_frac, hi_frac, switches::BIGINT AS switches, NOT (n_en > 0 AND n_hi > 0) AS monolingual FROM mixed",
)
def mixing_indices(spark, sf):
    d = T.with_mixing(B.documents(spark, sf))
    mono = ~((F.col("n_en") > 0) & (F.col("n_hi") > 0))
    return d.select("doc_id", "cmi", "m_index", "i_index", "en_frac", "hi_frac", "switches", mono.alias("monolingual"))


def mix_summary(df, keys):
    """n, mean, exact median and p90, shares and means of the mixing index.

    Texts are tokenised once; everything else reads the counts per distinct value.
    """
    values = cut_lineage(
        T.with_mixing(df)
        .groupBy(*keys, "cmi")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("en_frac").alias("en"), F.sum("switches").alias("sw"))
    )
    n = F.sum("n")
    share = lambda c: M.ratio(F.sum(F.when(c, F.col("n")).otherwise(0)), n) * 100.0
    mean = lambda c: F.round(F.sum(c).cast("double") / n.cast("double"), 6)
    sums = values.groupBy(*keys).agg(
        n.alias("n"),
        mean(F.col("cmi") * F.col("n")).alias("mean_cmi"),
        F.round(share(F.col("cmi") <= 1e-9), 6).alias("pct_cmi_eq_0"),
        F.round(share(F.col("cmi") < 10), 6).alias("pct_cmi_lt_10"),
        F.round(share(F.col("cmi") >= 20), 6).alias("pct_cmi_ge_20"),
        mean(F.col("en")).alias("mean_en_frac"),
        mean(F.col("sw")).alias("mean_switches"),
    )
    q = R.quantiles(values, keys, "cmi", {"median_cmi": 0.5, "p90_cmi": 0.9}, weight="n")
    q = q.select(*keys, F.round("median_cmi", 6).alias("median_cmi"), F.round("p90_cmi", 6).alias("p90_cmi"))
    return sums.join(q, keys)


def s_mix_summary(keys: str, cte: str) -> str:
    pct = lambda c: f"round(count(*) FILTER ({c})::DOUBLE / count(*)::DOUBLE * 100.0, 6)"
    return f"""SELECT {keys}, count(*)::BIGINT AS n, round(avg(cmi), 6) AS mean_cmi,
        {pct('cmi <= 1e-9')} AS pct_cmi_eq_0, {pct('cmi < 10')} AS pct_cmi_lt_10, {pct('cmi >= 20')} AS pct_cmi_ge_20,
        round(avg(en_frac), 6) AS mean_en_frac, round(avg(switches::DOUBLE), 6) AS mean_switches,
        round(median(cmi), 6) AS median_cmi, round(quantile_cont(cmi, 0.9), 6) AS p90_cmi FROM {cte} GROUP BY {keys}"""


@query("cmi_by_lang", f"{_MIXED} {s_mix_summary('lang', 'mixed')}")
def cmi_by_lang(spark, sf):
    return mix_summary(B.documents(spark, sf), ["lang"])


@query(
    "cmi_extremes",
    f"""{_MIXED}, r AS (SELECT doc_id, cmi, en_frac, row_number() OVER (ORDER BY cmi, -en_frac, doc_id) AS lo,
        row_number() OVER (ORDER BY -cmi, -en_frac, doc_id) AS hi FROM mixed)
        SELECT 'low' AS side, doc_id, cmi, en_frac FROM r WHERE lo <= 8 UNION ALL SELECT 'high', doc_id, cmi, en_frac FROM r WHERE hi <= 8""",
)
def cmi_extremes(spark, sf):
    d = cut_lineage(T.with_mixing(B.documents(spark, sf)).select("doc_id", "cmi", "en_frac"))
    side = lambda name, key: d.orderBy(key, F.desc("en_frac"), "doc_id").limit(8).select(F.lit(name).alias("side"), "*")
    return side("low", F.asc("cmi")).unionByName(side("high", F.desc("cmi")))


@query(
    "paper_filter",
    f"""{_MIXED} SELECT lang, count(*)::BIGINT AS n, round(avg(m_index), 6) AS mean_m, round(avg(i_index), 6) AS mean_i,
        (count(*) FILTER (m_index >= 0.1 AND i_index >= 0.1))::BIGINT AS kept,
        round(100.0 * count(*) FILTER (m_index >= 0.1 AND i_index >= 0.1) / greatest(count(*), 1), 6) AS pct_kept FROM mixed GROUP BY lang""",
)
def paper_filter(spark, sf):
    d = T.with_mixing(B.documents(spark, sf))
    kept = F.count_if((F.col("m_index") >= 0.1) & (F.col("i_index") >= 0.1))
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("m_index"), 6).alias("mean_m"),
        F.round(F.avg("i_index"), 6).alias("mean_i"),
        kept.alias("kept"),
        F.round(F.lit(100.0) * kept / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("pct_kept"),
    )


@query(
    "normalised_text",
    f"""SELECT doc_id, md5({B.s_norm('text')}) AS norm_hash, md5({B.s_fold('text')}) AS fold_hash,
        md5(array_to_string(regexp_extract_all(lower(text), {B.lit(C.WORD)}), ' ')) AS word_hash,
        '[redacted:' || length(text) || ' chars]' AS redacted, left(text, 160) AS preview FROM documents""",
)
def normalised_text(spark, sf):
    t = F.col("text")
    return B.documents(spark, sf).select(
        "doc_id",
        F.md5(T.normalise(t)).alias("norm_hash"),
        F.md5(T.fold_obfuscation(t)).alias("fold_hash"),
        F.md5(F.array_join(T.word_list(t), " ")).alias("word_hash"),
        T.redacted(t).alias("redacted"),
        F.left(t, F.lit(160)).alias("preview"),
    )


def s_positions(t: str, surfaces) -> str:
    long = [s for s in surfaces if len(s) >= 5]
    starts = " OR ".join(f"starts_with(x, {B.lit(s)})" for s in long)
    parts = f"list_filter(string_split_regex({t}, {B.lit(C.SPACE_RUN)}), lambda x: x <> '')"
    clean = f"list_transform({parts}, lambda x: regexp_replace(regexp_replace(lower(x), {B.lit(C.OBFUSCATION_MARKS)}, '', 'g'), {B.lit(C.NOT_WORD_CHAR)}, '', 'g'))"
    flagged = f"list_transform({clean}, lambda x, i: CASE WHEN list_contains({B.words(surfaces)}, x) OR {starts} THEN i - 1 END)"
    return f"list_filter({flagged}, lambda i: i IS NOT NULL)"


@query(
    "marker_hits",
    f"""SELECT doc_id, len(hits)::BIGINT AS n_hits, hits[1]::BIGINT AS first_hit FROM
        (SELECT doc_id, {s_positions('text', C.MARKER_SURFACES)} AS hits FROM documents) WHERE len(hits) > 0""",
)
def marker_hits(spark, sf):
    d = computed_once(B.documents(spark, sf), may=T.may_have_marker(F.col("text"), C.MARKER_SURFACES)).filter("may")
    d = computed_once(d.select("doc_id", "text"), hits=T.marker_positions(F.col("text"), C.MARKER_SURFACES))
    return d.filter(F.size("hits") > 0).select(
        "doc_id", F.size("hits").cast("bigint").alias("n_hits"), F.get("hits", F.lit(0)).cast("bigint").alias("first_hit")
    )


STEMS = ("clown", "trash", "loser", "tion", "the")


@query(
    "stem_hits",
    "WITH p AS (SELECT doc_id, ' ' || array_to_string(" + B.s_content("text") + ", ' ') || ' ' AS pad FROM documents) "
    "SELECT doc_id, "
    + ", ".join(
        f"regexp_matches(pad, ' {s}{'[^ ]{0,2}' if len(s) >= 4 else ''} ') AS hit_{s}" for s in STEMS
    )
    + " FROM p",
)
def stem_hits(spark, sf):
    d = B.documents(spark, sf).withColumn("pad", T.padded_content(F.col("text")))
    return d.select("doc_id", *[T.stem_hit(F.col("pad"), s).alias(f"hit_{s}") for s in STEMS])


@query(
    "lexicon_stems",
    f"""WITH s AS (SELECT DISTINCT unnest({B.s_content('text')}) AS stem FROM benchmark),
        t AS (SELECT doc_id, unnest(list_distinct({B.s_content('text')})) AS token FROM documents),
        k AS (SELECT doc_id, token AS entry FROM t UNION ALL SELECT doc_id, substr(token, 1, length(token) - 1) FROM t WHERE length(token) >= 5
              UNION ALL SELECT doc_id, substr(token, 1, length(token) - 2) FROM t WHERE length(token) >= 6)
        SELECT doc_id, count(DISTINCT stem) AS n_stems, sum(length(stem))::BIGINT AS letters FROM (SELECT DISTINCT doc_id, stem FROM k JOIN s ON entry = stem) GROUP BY doc_id""",
)
def lexicon_stems(spark, sf):
    """Stems of a large lexicon, all content tokens of the benchmark, that each document holds."""
    content = T.content_tokens(T.tokens(F.col("text")))
    stems = spread(table(spark, sf, "benchmark")).select(F.explode(content).alias("stem")).distinct()
    found = X.stem_matches(spread(B.documents(spark, sf)), "doc_id", "text", stems)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_stems"), F.sum(F.length("stem")).alias("letters"))


@query(
    "english_heavy",
    f"""WITH w AS (SELECT doc_id, lang, text, regexp_extract_all(text, {B.lit(C.LATIN_WORD)}) AS ws FROM documents),
        e AS (SELECT *, len(ws) >= 4 AND len(list_filter(ws, lambda x: list_contains({B.words(C.ENGLISH_FUNCTION_WORDS)}, lower(x))))::DOUBLE
          / greatest(len(ws), 1)::DOUBLE >= 0.35::DOUBLE AS heavy, {B.s_dev_share('text')} AS dev,
          {B.s_count('text', C.LATIN)} AS latin FROM w)
        SELECT lang, count(*)::BIGINT AS n, (count(*) FILTER (heavy))::BIGINT AS n_heavy, sum(latin)::BIGINT AS latin_chars,
          (count(*) FILTER (dev > 0.05))::BIGINT AS n_devanagari FROM e GROUP BY lang""",
)
def english_heavy(spark, sf):
    t = F.col("text")
    d = B.documents(spark, sf).select(
        "lang", T.english_heavy(t).alias("heavy"), T.devanagari_share(t).alias("dev"), T.count(t, C.LATIN).alias("latin")
    )
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("heavy").alias("n_heavy"),
        F.sum("latin").alias("latin_chars"),
        F.count_if(F.col("dev") > 0.05).alias("n_devanagari"),
    )


def _s_piece(i: int) -> str:
    start = f"{i} * (n // 4) + least({i}, n % 4) + 1"
    size = f"(n // 4) + CASE WHEN {i} < n % 4 THEN 1 ELSE 0 END"
    return f"array_to_string(toks[{start} : {start} + {size} - 1], ' ')"


@query(
    "four_way_split",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, {B.lit(C.TOKEN)}) AS toks FROM documents),
        s AS (SELECT doc_id, toks, len(toks) AS n FROM t)
        SELECT doc_id, {", ".join(f"CASE WHEN n >= 8 THEN md5({_s_piece(i)}) END AS part_{i}" for i in range(4))} FROM s""",
)
def four_way_split(spark, sf):
    d = B.documents(spark, sf).withColumn("toks", T.tokens(F.col("text"))).withColumn("parts", T.four_way_split(F.col("toks")))
    return d.select("doc_id", *[F.md5(F.get("parts", F.lit(i))).alias(f"part_{i}") for i in range(4)])


# --- corruption variants of texts with exactly one marker ---------------------------
VARIANTS = ("original", "inject_english", "drop_slur", "swap_benign")


def corruption_variants_of(df, key: str, text: str, source: str):
    """Four graded variants per abusive row that carries exactly one hard marker.

    The marker must be aligned to a stem of the source; every variant is checked
    again after editing.
    """
    seed = F.col(key).cast("string")
    pick = lambda tag, n: (stable_int(F.lit(tag), seed) % n).cast("int")
    swap = F.get(F.array(*[F.lit(w) for w in C.BENIGN_SWAPS]), pick("swap", len(C.BENIGN_SWAPS)))
    injected = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for w, p in C.INJECTED_WORDS])
    first, second = (F.get(injected, pick(t, len(C.INJECTED_WORDS))) for t in ("inject1", "inject2"))
    d = computed_once(df, _may=T.may_have_marker(F.col(text), C.MARKER_SURFACES)).filter("_may")
    d = computed_once(
        d,
        _toks=F.filter(F.split(text, C.SPACE_RUN), lambda t: t != ""),
        _hits=T.marker_positions(F.col(text), C.MARKER_SURFACES),
    ).filter(F.size("_hits") == 1)
    d = d.withColumn("_i", F.get("_hits", F.lit(0)))
    d = computed_once(d, _token=F.get("_toks", F.col("_i")))
    token = F.col("_token")
    aligned = F.lit(False)
    for m in C.MARKERS:
        if m.tier == "hard":
            aligned = aligned | (F.contains(F.col(source), F.lit(m.stem)) & T.token_matches(token, m.surfaces))
    d = d.filter(aligned).withColumn("slur", token)
    i, toks, n = F.col("_i"), F.col("_toks"), F.size("_toks")
    before, after = F.slice(toks, F.lit(1), i), F.slice(toks, i + 2, n)
    join = lambda a: F.array_join(a, " ")
    at = F.least(first["p"], n)
    inject = F.concat(F.slice(toks, F.lit(1), at), F.array(first["w"]), F.slice(toks, at + 1, n), F.array(second["w"]))
    made = {
        "original": F.col(text),
        "inject_english": join(inject),
        "drop_slur": join(F.concat(before, after)),
        "swap_benign": join(F.concat(before, F.array(swap), after)),
    }
    truth = lambda v: "preserved" if v in VARIANTS[:2] else "removed"
    arms = F.array(*[F.struct(F.lit(v).alias("variant"), made[v].alias("text"), F.lit(truth(v)).alias("truth")) for v in VARIANTS])
    d = computed_once(d.filter(n >= 3), _arms=arms)
    # every variant is searched again: one marker where it must stay, none where it must be gone
    left = lambda a: F.size(T.marker_positions(a["text"], C.MARKER_SURFACES))
    d = d.filter(F.forall("_arms", lambda a: left(a) == F.when(a["truth"] == "preserved", 1).otherwise(0)))
    base = [c for c in df.columns if c != text]
    return d.withColumn("_v", F.explode("_arms")).select(*base, "slur", "_v.variant", F.col("_v.text").alias(text), "_v.truth")


def _s_pick(tag, n):
    return f"({B.s_int(f"'{tag}|' || doc_id")} % {n} + 1)"


_INJ = B.words([w for w, _ in C.INJECTED_WORDS])
_POS = "[" + ", ".join(str(p) for _, p in C.INJECTED_WORDS) + "]"
_HARD_ALIGNED = " OR ".join(
    f"(contains(text, {B.lit(m.stem)}) AND len({s_positions('tok', m.surfaces)}) = 1)" for m in C.MARKERS if m.tier == "hard"
)
CORRUPTED = f"""{B.LABELLED},
v1 AS (SELECT doc_id, label, split, h, g, text, list_filter(string_split_regex(text, {B.lit(C.SPACE_RUN)}), lambda x: x <> '') AS toks,
    {s_positions('text', C.MARKER_SURFACES)} AS hits FROM lab WHERE label = 0),
v2 AS (SELECT *, hits[1] AS i, toks[hits[1] + 1] AS tok, len(toks) AS n, ({_INJ})[{_s_pick('inject1', len(C.INJECTED_WORDS))}] AS w1,
    least(({_POS})[{_s_pick('inject1', len(C.INJECTED_WORDS))}], len(toks)) AS p1,
    ({_INJ})[{_s_pick('inject2', len(C.INJECTED_WORDS))}] AS w2,
    ({B.words(C.BENIGN_SWAPS)})[{_s_pick('swap', len(C.BENIGN_SWAPS))}] AS sw FROM v1 WHERE len(hits) = 1),
v3 AS (SELECT *, array_to_string(list_concat(toks[1:i], toks[i + 2:]), ' ') AS drop_slur,
    array_to_string(list_concat(list_append(toks[1:i], sw), toks[i + 2:]), ' ') AS swap_benign,
    array_to_string(list_append(list_concat(list_append(toks[1:p1], w1), toks[p1 + 1:]), w2), ' ') AS inject_english
    FROM v2 WHERE {_HARD_ALIGNED}),
v4 AS (SELECT * FROM v3 WHERE n >= 3 AND len({s_positions('drop_slur', C.MARKER_SURFACES)}) = 0
    AND len({s_positions('swap_benign', C.MARKER_SURFACES)}) = 0 AND len({s_positions('inject_english', C.MARKER_SURFACES)}) = 1),
bench AS (SELECT doc_id, label, split, h, g, text AS src, tok AS slur, 'original' AS variant, text, 'preserved' AS truth FROM v4
    UNION ALL SELECT doc_id, label, split, h, g, text, tok, 'inject_english', inject_english, 'preserved' FROM v4
    UNION ALL SELECT doc_id, label, split, h, g, text, tok, 'drop_slur', drop_slur, 'removed' FROM v4
    UNION ALL SELECT doc_id, label, split, h, g, text, tok, 'swap_benign', swap_benign, 'removed' FROM v4)"""


def corrupted(spark, sf):
    base = B.labelled(spark, sf).filter("label = 0").select("doc_id", "label", "split", "h", "g", "text", F.col("text").alias("src"))
    return corruption_variants_of(base, "doc_id", "text", "src")


@query("corruption_variants", f"WITH {CORRUPTED} SELECT doc_id, variant, truth, slur, md5(text) AS text_hash FROM bench")
def corruption_variants(spark, sf):
    return corrupted(spark, sf).select("doc_id", "variant", "truth", "slur", F.md5("text").alias("text_hash"))


_SCRUB = (
    "trim(regexp_replace(regexp_replace(regexp_replace(replace(html, '[linebreak]', ' '), '<span[^>]*>.*?</span>', ' ', 'g'), "
    f"'https?://[^\\s\\p{{Z}}]+', ' ', 'g'), {B.lit(C.SPACE_RUN)}, ' ', 'g'), ' ')"
)


@query(
    "scrub_html_text",
    f"SELECT page_id, length(c)::BIGINT AS n_chars, md5(c) AS text_hash FROM (SELECT page_id, {_SCRUB} AS c FROM pages) WHERE length(c) >= 3",
)
def scrub_html_text(spark, sf):
    d = table(spark, sf, "pages").select("page_id", T.scrub(F.col("html")).alias("c"))
    return d.filter(F.length("c") >= 3).select("page_id", F.length("c").cast("bigint").alias("n_chars"), F.md5("c").alias("text_hash"))


# --- similarity ----------------------------------------------------------------------
HALVES = "SELECT doc_id, lang, substr(text, 1, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM documents"


def halves(spark, sf):
    """First and second half of each text: two aligned texts per row."""
    half = F.floor(F.length("text") / 2).cast("int")
    return B.documents(spark, sf).select(
        "doc_id", "lang", F.substr("text", F.lit(1), half).alias("a"), F.substr(F.col("text"), half + 1).alias("b")
    )


def _s_grams(c: str) -> str:
    p = f"(' ' || lower({c}) || ' ')"
    return f"list_transform(range(1, length({p}) - 1), lambda i: substr({p}, i, 3))"


@query(
    "ngram_cosine",
    f"""WITH h AS ({HALVES}), g AS (SELECT doc_id, unnest({_s_grams('a')}) AS gram, 1 AS l FROM h
        UNION ALL SELECT doc_id, unnest({_s_grams('b')}), 0 FROM h),
        c AS (SELECT doc_id, gram, sum(l) AS ca, sum(1 - l) AS cb FROM g GROUP BY ALL),
        s AS (SELECT doc_id, sum(ca * cb)::DOUBLE AS dot, sqrt(sum(ca * ca)::DOUBLE) * sqrt(sum(cb * cb)::DOUBLE) AS norm FROM c GROUP BY doc_id)
        SELECT h.doc_id, round(coalesce(CASE WHEN norm > 0 THEN dot / norm ELSE 0.0 END, 0.0), 9) AS cosine FROM h LEFT JOIN s ON h.doc_id = s.doc_id""",
)
def ngram_cosine(spark, sf):
    return halves(spark, sf).select("doc_id", F.round(S.ngram_cosine(F.col("a"), F.col("b")), 9).alias("cosine"))


@query(
    "token_jaccard",
    f"""WITH h AS ({HALVES}), w AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(a), {B.lit(C.WORD)})) AS x,
        list_distinct(regexp_extract_all(lower(b), {B.lit(C.WORD)})) AS y FROM h),
        j AS (SELECT *, len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS u FROM w)
        SELECT doc_id, CASE WHEN u > 0 THEN i::DOUBLE / u::DOUBLE ELSE 1.0::DOUBLE END AS jaccard FROM j""",
)
def token_jaccard(spark, sf):
    h = halves(spark, sf)
    return h.select("doc_id", S.jaccard(T.word_list(F.col("a")), T.word_list(F.col("b"))).alias("jaccard"))


@query(
    "embedding_cosine",
    """WITH c AS (SELECT label, list(m ORDER BY pos) AS centre FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM
        (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)
        SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], centre)
          / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(centre, centre))), 6) AS cosine
        FROM embeddings e JOIN c ON e.label = c.label""",
)
def embedding_cosine(spark, sf):
    """Each vector against the mean-pooled vector of its class."""
    e = table(spark, sf, "embeddings")
    pooled = (
        e.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_p"))
        .select("label", F.col("_p.m").alias("centre"))
    )
    return e.join(pooled, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


@query("wer_pairs")
def wer_pairs(spark, sf):
    """Word error rate of the second half against the first, whole texts."""
    h = halves(spark, sf).select("doc_id", T.word_list(F.col("a")).alias("r"), T.word_list(F.col("b")).alias("y"))
    return h.select("doc_id", S.word_error_rate(F.col("r"), F.col("y")).alias("wer"))


_BLEU_TOK = [
    (r"<skipped>", ""), (r"-\n", ""), (r"\n", " "), (r"&quot;", '"'), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"),
]
_BLEU_TOK2 = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
]


def _s_bleu_tokens(c: str) -> str:
    for p, r in _BLEU_TOK:
        c = f"regexp_replace({c}, {B.lit(p)}, {B.lit(r)}, 'g')"
    c = f"(' ' || {c} || ' ')"
    for p, r in _BLEU_TOK2:
        c = f"regexp_replace({c}, {B.lit(p)}, {B.lit(r)}, 'g')"
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '')"


def _s_bleu() -> str:
    grams = lambda c, flag: " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, unnest(list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n} - 1], ' '))) AS gram, {flag} AS l FROM t"
        for n in range(1, 5)
    )
    picks = ", ".join(f"max(m) FILTER (n = {n})::DOUBLE AS m{n}, max(t) FILTER (n = {n})::DOUBLE AS t{n}" for n in range(1, 5))
    return f"""WITH h AS ({HALVES}), t AS (SELECT doc_id, {_s_bleu_tokens('b')} AS y, {_s_bleu_tokens('a')} AS r FROM h),
        g AS ({grams('y', 1)} UNION ALL {grams('r', 0)}),
        c AS (SELECT doc_id, n, gram, sum(l) AS ch, sum(1 - l) AS cr FROM g GROUP BY ALL),
        p AS (SELECT n, sum(least(ch, cr)) AS m, sum(ch) AS t FROM c GROUP BY n),
        w AS (SELECT {picks} FROM p), s AS (SELECT sum(len(y)) AS hl, sum(len(r)) AS rl FROM t)
        SELECT hl::BIGINT AS hyp_len, rl::BIGINT AS ref_len,
        round((CASE WHEN hl >= rl THEN 1.0 ELSE exp(1 - rl::DOUBLE / hl::DOUBLE) END) * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4), 6) AS bleu FROM w, s"""


@query("bleu_halves", _s_bleu())
def bleu_halves(spark, sf):
    h = halves(spark, sf).withColumn("refs", F.array("a"))
    return S.corpus_bleu(h, "doc_id", "b", "refs").withColumn("bleu", F.round("bleu", 6))


def _s_sentence_bleu() -> str:
    base = _s_bleu().split("p AS (SELECT n,")[0]
    zeros = lambda n: " + ".join(f"(m{k} = 0)::INT" for k in range(1, n + 1))
    logs = " + ".join(f"CASE WHEN t{n} > 0 THEN ln(CASE WHEN m{n} > 0 THEN m{n} / t{n} ELSE 1.0 / (pow(2, {zeros(n)}) * t{n}) END) ELSE 0 END" for n in range(1, 5))
    order = " + ".join(f"(t{n} > 0)::INT" for n in range(1, 5))
    picks = ", ".join(f"coalesce(max(m) FILTER (n = {n}), 0)::DOUBLE AS m{n}, coalesce(max(t) FILTER (n = {n}), 0)::DOUBLE AS t{n}" for n in range(1, 5))
    return f"""{base}p AS (SELECT doc_id, n, sum(least(ch, cr)) AS m, sum(ch) AS t FROM c GROUP BY doc_id, n), w AS (SELECT doc_id, {picks} FROM p GROUP BY doc_id)
        SELECT t.doc_id, round(CASE WHEN coalesce(m1, 0) = 0 THEN 0.0 ELSE (CASE WHEN len(y) >= len(r) THEN 1.0 ELSE exp(1 - len(r)::DOUBLE / len(y)::DOUBLE) END) * exp(({logs}) / ({order})) END, 6) AS bleu
        FROM t LEFT JOIN w USING (doc_id)"""


@query("sentence_bleu_halves", _s_sentence_bleu())
def sentence_bleu_halves(spark, sf):
    h = halves(spark, sf).withColumn("refs", S.reference_streams(F.array("a"), 2))
    return S.sentence_bleu(h, "doc_id", "b", "refs").withColumn("bleu", F.round("bleu", 6))


@query("chrf_halves")
def chrf_halves(spark, sf):
    """All character n-grams to order 6 of whole texts; too many rows for a SQL twin."""
    return S.corpus_chrf(halves(spark, sf), "b", "a").withColumn("chrf", F.round("chrf", 6))
