"""Lexicon mining from document presence counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import text as T
from parleyspark.operators.sampling import top_per_group
from parleyspark.session import cut_lineage


def presence_counts(df: DataFrame, words: Column, in_first: Column) -> DataFrame:
    """Documents per word and side. Words are distinct per document and the
    counts combine on the map side, so a frequent word is never one big group."""
    # the outer form keeps the optimiser from testing the word array a second time
    exploded = df.select(in_first.alias("_a"), F.explode_outer(F.array_distinct(words)).alias("token"))
    return exploded.filter("token IS NOT NULL").groupBy("token").agg(F.count_if("_a").alias("a"), F.count_if(~F.col("_a")).alias("b"))


def _side_totals(df: DataFrame, *cols: Column) -> list[float]:
    """A few numbers that every row of the next step needs."""
    return [float(v or 0) for v in df.agg(*cols).first()]


def log_odds_stems(df: DataFrame, text: str, in_first: Column, min_docs: int = 20, per_side=C.MINED_PER_SIDE) -> DataFrame:
    """Top stems of either side by smoothed presence log-odds."""
    keep = lambda t: (F.length(t) >= 4) & ~t.isin(C.ENGLISH_WORDS)
    counts = presence_counts(df, F.filter(T.content_tokens(T.tokens(F.col(text))), keep), in_first)
    counts = cut_lineage(counts.filter(F.col("a") + F.col("b") >= min_docs))
    n_a, n_b = _side_totals(df, F.count_if(in_first), F.count_if(~in_first))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    common = (a / F.lit(max(n_a, 1.0)) > 0.35) & (b / F.lit(max(n_b, 1.0)) > 0.35)
    lo = F.log((a + 0.5) / F.lit(n_a + 0.5)) - F.log((b + 0.5) / F.lit(n_b + 0.5))
    scored = counts.filter(~common).withColumn("log_odds", lo)
    first = scored.filter("log_odds > 0").orderBy(F.desc(F.round("log_odds", 9)), F.desc("token")).limit(per_side[0])
    second = scored.filter("log_odds < 0").orderBy(F.asc(F.round("log_odds", 9)), F.asc("token")).limit(per_side[1])
    return first.withColumn("side", F.lit("abuse")).unionByName(second.withColumn("side", F.lit("benign")))


def dirichlet_terms(df: DataFrame, words: Column, in_first: Column, min_count=12, top_k=250, prior=C.DIRICHLET_PRIOR) -> DataFrame:
    """Top terms by z of log-odds with an informative Dirichlet prior."""
    vocab = cut_lineage(presence_counts(df, words, in_first).filter(F.col("a") + F.col("b") >= min_count))
    n0, n1 = _side_totals(vocab, F.sum("a"), F.sum("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    a0 = F.lit(float(prior))
    prior_w = a0 * (a + b) / F.lit(n0 + n1)
    y0, y1 = a + prior_w, b + prior_w
    delta = F.log(y0 / (F.lit(n0) + a0 - y0)) - F.log(y1 / (F.lit(n1) + a0 - y1))
    z = delta / F.sqrt(F.lit(1.0) / y0 + F.lit(1.0) / y1)
    return vocab.withColumn("z", z).orderBy(F.desc(F.round("z", 9)), F.asc("token")).limit(top_k)


def align_terms(pairs: DataFrame, source: str, target: str, terms: list[str], top_m=6, min_docs=5, min_hits=3) -> DataFrame:
    """Target words over-represented where the source contains a term.

    One pass over the texts: each row emits its words under every term it
    contains and under the empty term, which stands for the whole corpus. The
    empty word counts rows. All ratios come from that one table of counts.
    """
    stop = sorted(set(C.BASE_WORDS) | set(C.ENGLISH_WORDS))
    words = F.regexp_extract_all(F.lower(F.col(target)), F.lit(C.LATIN_WORD), F.lit(0))
    words = F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))
    here = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col(source), t))
    blank = F.array(F.lit(""))
    rows = pairs.select(F.concat(blank, words).alias("words"), F.concat(blank, here).alias("terms"))
    exploded = rows.select("words", F.explode_outer("terms").alias("term")).select("term", F.explode_outer("words").alias("word"))
    counts = cut_lineage(exploded.groupBy("term", "word").agg(F.count(F.lit(1)).alias("k")))
    (n_docs,) = _side_totals(counts.filter("term = '' AND word = ''"), F.max("k"))
    docs = counts.filter("term <> '' AND word = ''").select("term", F.col("k").alias("docs")).filter(F.col("docs") >= min_docs)
    background = counts.filter("term = '' AND word <> ''").select("word", F.col("k").alias("bg"))
    hits = counts.filter("term <> '' AND word <> ''").filter(F.col("k") >= min_hits).filter(~F.col("word").isin(stop))
    joined = hits.join(docs, "term").join(background, "word")
    p_sub = F.col("k").cast("double") / F.col("docs").cast("double")
    p_bg = F.col("bg").cast("double") / F.lit(n_docs)
    scored = joined.filter(p_sub > p_bg * 3).withColumn(
        "weight", F.log(p_sub / p_bg) * F.log1p(F.col("k").cast("double"))
    )
    return top_per_group(scored, ["term"], [F.desc(F.round("weight", 9)), F.desc("word")], top_m)
