"""Generation and conversation evaluations composed from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleyspark.functions import edit_rate as E
from parleyspark.functions import similarity as S
from parleyspark.functions import text as T
from parleyspark.functions.hashing import hash_unit
from parleyspark.operators import metrics as M
from parleyspark.operators import scoring as Sc
from parleyspark.plans import frames as B
from parleyspark.plans import text_queries as Q
from parleyspark.plans import thread_queries as Th
from parleyspark.plans.registry import query
from parleyspark.session import spread, table, written


@query("generation_eval")
def generation_eval(spark, sf):
    """Rewrites against the romanised source: error rate, overlap, kept shares, correlation."""
    half = F.floor(F.length("text") / 2).cast("int")
    d = B.labelled(spark, sf).select(
        "split", "label", "h", "g",
        T.word_list(T.romanise(F.substr("text", F.lit(1), half))).alias("src"),
        T.word_list(F.substr(F.col("text"), half + 1)).alias("out"),
    )
    d = d.withColumns({"wer": S.word_error_rate(F.col("src"), F.col("out")), "overlap": S.jaccard(F.array_distinct("src"), F.array_distinct("out"))})
    abusive = F.col("label") == 0
    return d.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("wer"), 6).alias("mean_translit_wer"),
        F.round(F.avg("overlap"), 6).alias("mean_token_jaccard"),
        (M.ratio(F.count_if(abusive & (F.col("g") >= 0.5)), F.count_if(abusive)) * 100.0).alias("abuse_kept_pct"),
        (M.ratio(F.count_if(~abusive & (F.col("g") < 0.5)), F.count_if(~abusive)) * 100.0).alias("nonabuse_kept_pct"),
        F.round(F.avg(F.col("h") - F.col("g")), 6).alias("mean_score_delta"),
        F.round(M.guarded_corr("h", "g"), 6).alias("pearson_scores"),
    )


@query("nist_halves")
def nist_halves(spark, sf):
    h = Q.halves(spark, sf).select("doc_id", T.word_list(F.col("a")).alias("r"), T.word_list(F.col("b")).alias("y"))
    return S.corpus_nist(h, "doc_id", "y", "r").withColumn("nist", F.round("nist", 6))


def thirds(spark, sf):
    """Each text in three parts: the middle one is held against the two around it."""
    third = F.floor(F.length("text") / 3).cast("int")
    part = lambda k: F.substr("text", third * k + 1, third)
    return spread(B.documents(spark, sf)).select("doc_id", part(1).alias("hyp"), F.array(part(0), part(2)).alias("refs"))


@query("chrf_thirds")
def chrf_thirds(spark, sf):
    """Character F-score against the better of two references; all n-grams of whole texts, so no SQL twin."""
    return S.corpus_chrf_refs(thirds(spark, sf), "hyp", "refs").withColumn("chrf", F.round("chrf", 6))


@query("nist_thirds")
def nist_thirds(spark, sf):
    """NIST against two references."""
    t = thirds(spark, sf).select("doc_id", T.word_list(F.col("hyp")).alias("h"), F.transform("refs", T.word_list).alias("r"))
    return S.corpus_nist_refs(t, "doc_id", "h", "r").withColumn("nist", F.round("nist", 6))


@query("ter_halves")
def ter_halves(spark, sf):
    """Translation edit rate of second halves against the first, with references padded to two; whole texts, so no SQL twin."""
    h = spread(Q.halves(spark, sf)).withColumn("refs", S.reference_streams(F.array("a"), 2))
    return E.corpus_ter(h, "b", "refs").withColumn("ter", F.round("ter", 9))


@query("ter_by_row")
def ter_by_row(spark, sf):
    """Edits of each middle third to the nearer of the thirds around it, and their rate."""
    d = thirds(spark, sf).select("doc_id", E.edit_counts(F.col("hyp"), F.col("refs")).alias("c"))
    return d.select("doc_id", "c.edits", F.round("c.length", 9).alias("ref_length"), F.round(E.edit_rate(F.col("c.edits"), F.col("c.length")), 9).alias("ter"))


@query("rating_correlation")
def rating_correlation(spark, sf):
    """Best-of-references error rate per row against a stand-in rating."""
    h = Q.halves(spark, sf).select(
        "doc_id", "lang", T.word_list(F.col("a")).alias("r1"), T.word_list(F.lower("a")).alias("r2"), T.word_list(F.col("b")).alias("y")
    )
    best = F.least(S.word_error_rate(F.col("r1"), F.col("y")), S.word_error_rate(F.reverse("r2"), F.col("y")))
    rating = hash_unit(F.lit("rating"), F.col("doc_id").cast("string"))
    d = h.select("lang", best.alias("wer"), rating.alias("rating"))
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("wer"), 6).alias("mean_wer"), F.round(M.guarded_corr("rating", "wer"), 6).alias("pearson_wer")
    )


@query(
    "unique_text_scores",
    f"SELECT doc_id, {B.s_unit("'m|' || text")} AS score FROM documents",
)
def unique_text_scores(spark, sf):
    d = B.documents(spark, sf).select("doc_id", "text")
    return Sc.score_unique(d, "text", lambda t: hash_unit(F.lit("m"), t)).drop("text")


_ARMS = f"""{Th._FUSED}, ar AS (SELECT kind_id, ({B.s_int("'y|' || conv_id")} % 2) AS y, unnest([{{'arm': 'isolated', 's': current}}, {{'arm': 'window', 's': win}},
    {{'arm': 'gated', 's': CASE WHEN use_window THEN greatest(current, win) ELSE current END}}]) AS x FROM fl),
    ag AS (SELECT x.arm AS arm, kind_id, y, CASE WHEN x.s >= 0.5 THEN 1 ELSE 0 END AS pred FROM ar)"""


@query(
    "expansion_scores",
    f"""WITH {_ARMS}, c AS (SELECT arm, kind_id, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp,
        count(*) FILTER (pred = 0 AND y = 1) AS fn, count(*) FILTER (pred = 0 AND y = 0) AS tn FROM ag GROUP BY arm, kind_id)
        SELECT arm, kind_id, tp + fp + fn + tn AS n, tp + fn AS positives, {B.s_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
        {B.s_div('tp', 'tp + fp')} AS precision, {B.s_div('tp', 'tp + fn')} AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) ELSE 0.0::DOUBLE END AS f1,
        {B.s_div('fp', 'tn + fp', '1.0::DOUBLE')} AS fpr FROM c""",
)
def expansion_scores(spark, sf):
    """Isolated, joined-window and gated scoring of the same chats, per kind."""
    from parleyspark.functions.hashing import stable_int

    d = Th.fused(spark, sf)
    gated = F.when(F.col("use_window"), F.greatest("current", "win")).otherwise(F.col("current"))
    arms = F.array(
        F.struct(F.lit("isolated").alias("arm"), F.col("current").alias("s")),
        F.struct(F.lit("window").alias("arm"), F.col("win").alias("s")),
        F.struct(F.lit("gated").alias("arm"), gated.alias("s")),
    )
    y = stable_int(F.lit("y"), F.col("conv_id").cast("string")) % 2
    d = d.select((F.col("conv_id") % 4).alias("kind_id"), y.alias("y"), F.inline(arms))
    c = M.confusion(d, ["arm", "kind_id"], F.col("y"), F.when(F.col("s") >= 0.5, 1).otherwise(0))
    return M.binary_metrics(c, ["arm", "kind_id"], 1.0).withColumn("f1", F.round("f1", 9))


@query("corpus_mix", """WITH u AS (SELECT 'documents' AS source, text, 1.0::DOUBLE AS weight FROM documents UNION ALL SELECT 'conversations', text, 0.5::DOUBLE FROM conversations)
    SELECT source, count(*) AS n, sum(weight) AS weight, min(length(text))::BIGINT AS shortest FROM u GROUP BY source""")
def corpus_mix(spark, sf):
    """Corpora of several origins in one frame with a weight per source."""
    take = lambda name, w: table(spark, sf, name).select(F.lit(name).alias("source"), "text", F.lit(w).alias("weight"))
    both = take("documents", 1.0).unionByName(take("conversations", 0.5))
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.min(F.length("text")).cast("bigint").alias("shortest")
    )


@query(
    "recode_labels",
    """SELECT CASE WHEN label IN (0, 1) THEN 0 ELSE 1 END::BIGINT AS label, 0.5::DOUBLE AS weight, count(*) AS n FROM embeddings GROUP BY 1""",
)
def recode_labels(spark, sf):
    """Two of several classes become the abusive class; one weight per source."""
    e = table(spark, sf, "embeddings").select(F.when(F.col("label").isin(0, 1), 0).otherwise(1).cast("bigint").alias("label"), F.lit(0.5).alias("weight"))
    return e.groupBy("label", "weight").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_list_scores",
    """SELECT event_id, CASE event_type WHEN 'click' THEN (event_id % 100)::DOUBLE / 100.0::DOUBLE WHEN 'view' THEN (event_id % 100)::DOUBLE / 100.0::DOUBLE
        WHEN 'error' THEN 1 - (event_id % 100)::DOUBLE / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events""",
)
def label_list_scores(spark, sf):
    """Abusive probability from whichever class the scorer listed."""
    from parleyspark.operators import gates as G

    e = table(spark, sf, "events").select("event_id", "event_type")
    name = F.when(F.col("event_type") == "click", "ABUSIVE").when(F.col("event_type") == "view", "label_0").when(F.col("event_type") == "error", "Label_1").otherwise("other")
    p = (F.col("event_id") % 100).cast("double") / 100.0
    return e.select("event_id", G.abusive_score(F.array(F.struct(name.alias("label"), p.alias("score")))).alias("score"))


@query(
    "standardised_scores",
    """WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type)
        SELECT event_id, round((value - m) / greatest(CASE WHEN sd < 1e-6 THEN 1.0 ELSE sd END, 1e-6), 6) AS z FROM events JOIN s USING (event_type)""",
)
def standardised_scores(spark, sf):
    """Population z-scores; the per-group moments are a tiny table."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    sd = F.greatest(F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd")), F.lit(1e-6))
    return e.join(s, "event_type").select("event_id", F.round((F.col("value") - F.col("m")) / sd, 6).alias("z"))


@query(
    "vocabulary_difference",
    f"""WITH w AS (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), {B.lit(Q.C.LATIN_WORD)}))) AS word FROM documents),
        d AS (SELECT word FROM w WHERE lang = 'en' EXCEPT SELECT word FROM w WHERE lang = 'fr') SELECT length(word) AS n_letters, count(*) AS n FROM d GROUP BY 1""",
)
def vocabulary_difference(spark, sf):
    """Words of one corpus that another does not have."""
    words = F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(Q.C.LATIN_WORD), F.lit(0)))).alias("word")
    w = B.documents(spark, sf).filter("lang IN ('en', 'fr')").select("lang", words)
    flags = w.filter("word IS NOT NULL").groupBy("word").agg(F.max(F.col("lang") == "en").alias("mine"), F.max(F.col("lang") == "fr").alias("theirs"))
    only = flags.filter(F.col("mine") & ~F.col("theirs"))
    return only.groupBy(F.length("word").cast("bigint").alias("n_letters")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "redelivery_results",
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS first_id, arg_min(value, event_id) AS stored FROM events GROUP BY ALL)
        SELECT e.event_id, f.first_id, f.stored FROM events e JOIN f ON e.user_id = f.user_id AND e.event_type = f.event_type WHERE e.event_id <> f.first_id""",
)
def redelivery_results(spark, sf):
    """A message seen before takes its stored result instead of a new score. First results are written before the join, so a hot user can be split."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    keys = ["user_id", "event_type"]
    first = written(e.groupBy(*keys).agg(F.min("event_id").alias("first_id"), F.min_by("value", "event_id").alias("stored")))
    return e.join(first, keys).filter("event_id <> first_id").select("event_id", "first_id", "stored")
