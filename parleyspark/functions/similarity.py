"""Similarity and generation metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from parleyspark.functions import grams as N
from parleyspark.functions import text as T
from parleyspark.session import cut_lineage, written


# --- character n-grams --------------------------------------------------------------
def _gram_ids(codes: np.ndarray, orders: int):
    """Dense ids of the n-grams of a code point array, for n = 1 .. orders."""
    ids = None
    for n in range(1, orders + 1):
        if len(codes) < n:
            yield n, np.empty(0, dtype=np.int64)
            continue
        ids = codes.astype(np.int64) if n == 1 else ids[: len(codes) - n + 1] * (1 << 21) + codes[n - 1 :]
        _, ids = np.unique(ids, return_inverse=True)
        yield n, ids


def gram_overlap(a: str, b: str, orders: int) -> list[tuple[int, int, int, int, int, int]]:
    """Per order: clipped matches, grams of a, grams of b, dot and both squared norms."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (a, b))
    # one separator outside Unicode keeps grams of the two texts apart
    joined = np.concatenate([x, np.array([0x110000], dtype=np.uint32), y])
    out = []
    for n, ids in _gram_ids(joined, orders):
        n_ids = int(ids.max()) + 1 if len(ids) else 1
        ca = np.bincount(ids[: max(len(x) - n + 1, 0)], minlength=n_ids)
        cb = np.bincount(ids[len(x) + 1 :][: max(len(y) - n + 1, 0)], minlength=n_ids)
        out.append((int(np.minimum(ca, cb).sum()), int(ca.sum()), int(cb.sum()), int(ca @ cb), int(ca @ ca), int(cb @ cb)))
    return out


OVERLAP = ST.ArrayType(ST.ArrayType(ST.LongType()))


def overlap_udf(orders: int):
    """Arrow UDF: n-gram overlap counts of two text columns, one pair per row."""

    @F.pandas_udf(OVERLAP)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[list(t) for t in gram_overlap(x, y, orders)] for x, y in zip(a, b)])

    return run


def ngram_cosine(a: Column, b: Column, n: int = 3) -> Column:
    """Cosine of the n-gram count vectors of two texts, padded by a space."""
    pad = lambda c: F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    counts = F.element_at(overlap_udf(n)(pad(a), pad(b)), -1)
    at = lambda i: F.get(counts, F.lit(i)).cast("double")
    norm = F.sqrt(at(4)) * F.sqrt(at(5))
    return F.when(norm > 0, at(3) / norm).otherwise(0.0)


# --- vectors -----------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


# --- token sets and edit distance ----------------------------------------------------
def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(union > 0, shared / union.cast("double")).otherwise(1.0)


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Token Levenshtein by bit vectors: one integer holds a whole column of the table as differences of one.

    Work is len(b) steps on integers of len(a) bits, so two texts of 10,000 words take hundredths of a second.
    """
    if len(a) == 0 or len(b) == 0:
        return max(len(a), len(b))
    places: dict = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)  # where the column rises by one, where it falls
    for t in b:
        same = places.get(t, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = (down | ~(across | up)) & full, up & across
        distance += 1 if rise & last else -1 if fall & last else 0
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        kept = same | down
        up, down = (fall | ~(kept | rise)) & full, rise & kept
    return distance


@F.pandas_udf(ST.LongType())
def token_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], dtype="int64")


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Distance over reference length for word arrays; blank reference 0 or 1."""
    n = F.size(ref)
    blank = F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)
    return F.when(n > 0, token_edit_distance(ref, hyp).cast("double") / n.cast("double")).otherwise(blank)


# --- corpus n-gram metrics -----------------------------------------------------------
def bleu_tokens(text: Column) -> Column:
    """mteval-13a tokenisation."""
    out = text
    for pattern, repl in (
        (r"<skipped>", ""), (r"-\n", ""), (r"\n", " "),
        (r"&quot;", "\""), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"),
    ):
        out = F.regexp_replace(out, pattern, repl)
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, repl in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "),
        (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
    ):
        out = F.regexp_replace(out, pattern, repl)
    return F.filter(F.split(out, r"\s+"), lambda t: t != "")


def word_grams(words: Column, n: int) -> Column:
    last = F.size(words) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def reference_streams(refs: Column, width: int) -> Column:
    """References padded to one width with the first one."""
    first = F.coalesce(F.get(refs, F.lit(0)), F.lit(""))
    return F.array(*[F.coalesce(F.get(refs, F.lit(k)), first) for k in range(width)])


def clipped_counts(df: DataFrame, key: str, hyp: Column, refs: Column, grams, by: Sequence[str] = ()) -> DataFrame:
    """Matched and total hypothesis n-grams per order (and ``by`` columns), clipped by the best reference.

    ``hyp`` is a word array, ``refs`` an array of them; ``grams`` maps a word
    array column to array<struct<n, gram>>. Hypothesis (k = -1) and references
    leave a row in one explode, so most counts combine before the shuffle.
    """
    sides = F.concat(F.array(F.struct(F.lit(-1).alias("k"), hyp.alias("w"))), F.transform(refs, lambda r, k: F.struct(k.alias("k"), r.alias("w"))))
    rows = df.select(key, F.explode_outer(sides).alias("s")).select(key, "s.k", "s.w").select(key, "k", F.explode_outer(grams(F.col("w"))).alias("g")).filter("g IS NOT NULL")
    counts = rows.groupBy(key, "g", "k").agg(F.count(F.lit(1)).alias("c"))
    per_gram = counts.groupBy(key, "g").agg(
        F.max(F.when(F.col("k") < 0, F.col("c"))).alias("ch"), F.max(F.when(F.col("k") >= 0, F.col("c"))).alias("cr")
    )
    zero = F.lit(0)
    return per_gram.groupBy(*by, F.col("g.n").alias("n")).agg(
        F.sum(F.least(F.coalesce("ch", zero), F.coalesce("cr", zero))).alias("m"), F.sum(F.coalesce("ch", zero)).alias("t")
    )


def apart(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key no other row has, rows whose key is null or stands in several rows)."""
    again = written(df.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 OR _again IS NULL").select("_again"))
    same = df[key].eqNullSafe(again["_again"])
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def bleu_parts(df: DataFrame, key: str, hyp: str, refs: str, max_n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, _h, _r) as words of rows with a key of their own and of the others; (key, n, m, t) counted over rows of one key.

    Rows with a key of their own are counted where they lie, so none of their n-grams is shuffled.
    """
    words = lambda d: d.select(key, bleu_tokens(F.col(hyp)).alias("_h"), F.transform(refs, bleu_tokens).alias("_r"))
    once, again = map(words, apart(df.select(key, hyp, refs), key))
    tagged = lambda w, n: F.transform(word_grams(w, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    grams = lambda w: F.flatten(F.array(*[tagged(w, n) for n in range(1, max_n + 1)]))
    return once, again, clipped_counts(again, key, F.col("_h"), F.col("_r"), grams, [key])


def _sizes() -> tuple[Column, Column]:
    """Words of the hypothesis and of the reference closest to it in length."""
    closest = F.array_min(F.transform("_r", lambda r: F.struct(F.abs(F.size(r) - F.size("_h")).alias("d"), F.size(r).alias("l"))))["l"]
    return F.size("_h").alias("h"), closest.alias("r")


def corpus_bleu(df: DataFrame, key: str, hyp: str, refs: str, max_n: int = 4) -> DataFrame:
    """BLEU in [0, 1] with exponential smoothing and closest reference length."""
    once, again, shared = bleu_parts(df, key, hyp, refs, max_n)
    names = [f"{c}{n}" for n in range(1, max_n + 1) for c in "mt"]
    counted = once.select(*_sizes(), N.clipped(F.col("_h"), F.col("_r"), max_n).alias("c"))
    own = counted.select("h", "r", *[F.get("c", F.lit(i)).alias(c) for i, c in enumerate(names)])
    lengths = again.select(*_sizes(), *[F.lit(0).cast("bigint").alias(c) for c in names])
    pick = lambda c, n: F.when(F.col("n") == n, F.col(c)).otherwise(0).alias(f"{c}{n}")
    none = F.lit(None).cast("int")
    merged = shared.select(none.alias("h"), none.alias("r"), *[pick(c, n) for n in range(1, max_n + 1) for c in "mt"])
    wide = own.unionByName(lengths).unionByName(merged).agg(
        F.sum("h").cast("double").alias("h"), F.sum("r").cast("double").alias("r"), *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in names]
    )
    smooth, log_sum, usable = F.lit(1.0), F.lit(0.0), F.lit(True)
    for n in range(1, max_n + 1):
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        smooth = F.when(m == 0, smooth * 2).otherwise(smooth)
        p = F.when(m == 0, F.try_divide(F.lit(1.0), smooth * t)).otherwise(F.try_divide(m, t))
        log_sum = log_sum + F.log(p)
        usable = usable & (t > 0)
    brevity = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("r"), F.col("h"))))
    score = F.when(usable & (F.col("m1") > 0), brevity * F.exp(log_sum / max_n)).otherwise(0.0)
    return wide.select(F.col("h").cast("bigint").alias("hyp_len"), F.col("r").cast("bigint").alias("ref_len"), score.alias("bleu"))


def sentence_bleu(df: DataFrame, key: str, hyp: str, refs: str, max_n: int = 4) -> DataFrame:
    """(key, bleu) of each row: BLEU in [0, 1] over the orders that the hypothesis is long enough for.

    Exponential smoothing and the closest reference length; zero without any match. ``key`` is unique.
    """
    once, again, shared = bleu_parts(df, key, hyp, refs, max_n)
    names = [f"{c}{n}" for n in range(1, max_n + 1) for c in "mt"]
    pick = lambda c, n: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}")
    wide = shared.groupBy(key).agg(*[pick(c, n) for n in range(1, max_n + 1) for c in "mt"])
    counted = once.select(key, *_sizes(), N.clipped(F.col("_h"), F.col("_r"), max_n).alias("c"))
    own = counted.select(key, "h", "r", *[F.get("c", F.lit(i)).alias(c) for i, c in enumerate(names)])
    others = again.select(key, *_sizes()).join(wide, key, "left")
    d = own.unionByName(others).select(key, *[F.col(c).cast("double").alias(c) for c in ("h", "r", *names)])
    smooth, log_sum, order = F.lit(1.0), F.lit(0.0), F.lit(0)
    for n in range(1, max_n + 1):
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        smooth = F.when(m == 0, smooth * 2).otherwise(smooth)
        p = F.when(m == 0, F.try_divide(F.lit(1.0), smooth * t)).otherwise(F.try_divide(m, t))
        log_sum = log_sum + F.when(t > 0, F.log(p)).otherwise(0.0)
        order = order + F.when(t > 0, 1).otherwise(0)
    brevity = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("r"), F.col("h"))))
    score = F.when(F.coalesce(F.col("m1"), F.lit(0.0)) > 0, brevity * F.exp(log_sum / order)).otherwise(0.0)
    return d.select(key, score.alias("bleu"))


def gram_counts(rows: DataFrame, refs: Column, met: DataFrame, max_n: int) -> DataFrame:
    """(n, gram, c): how often all references hold each n-gram of met (n, gram); others stay in their rows."""
    needed = met.select("n", "gram").distinct()
    found = N.masked_rows(rows, refs, max_n, N.mask(needed, "gram"))
    return found.groupBy("n", "gram").agg(F.sum("cr").alias("c")).join(needed, ["n", "gram"], "left_semi")


def gram_information(counted: DataFrame, words: Column) -> DataFrame:
    """(n, gram, info): log2 of the count of the n-gram without its last word (all words for n = 1) over its own."""
    parent = counted.select((F.col("n") + 1).alias("n"), F.col("gram").alias("_p"), F.col("c").alias("_pc"))
    joined = counted.withColumn("_p", F.regexp_replace("gram", " [^ ]*$", "")).join(parent, ["n", "_p"], "left")
    upper = F.when(F.col("n") == 1, words).otherwise(F.col("_pc").cast("double"))
    return joined.select("n", "gram", F.log2(upper / F.col("c").cast("double")).alias("info"))


def corpus_nist(df: DataFrame, key: str, hyp: str, ref: str, max_n: int = 5) -> DataFrame:
    """NIST score: information-weighted matches with the length penalty.

    ``hyp`` and ``ref`` are word arrays. Information of an n-gram is the log2
    ratio of its prefix count to its own count over all references. Rows with a key
    of their own are matched where they lie; only n-grams that match anywhere, and their
    counts, are shuffled.
    """
    tagged = lambda w, n: F.transform(
        word_grams(w, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))
    )
    grams = lambda c: F.flatten(F.array(*[tagged(F.col(c), n) for n in range(1, max_n + 1)]))

    def side(c, flag):
        return F.transform(grams(c), lambda g: F.struct(g.alias("g"), F.lit(flag).alias("l")))

    both = df.filter(F.col(hyp).isNotNull() & F.col(ref).isNotNull())
    once, again = apart(both.select(key, hyp, ref), key)
    rows = again.select(key, F.explode_outer(F.concat(side(hyp, 1), side(ref, 0))).alias("x")).filter("x IS NOT NULL").select(key, "x.g", "x.l")
    counts = rows.groupBy(key, "g").agg(F.sum("l").alias("ch"), F.sum(1 - F.col("l")).alias("cr"))
    own = N.match_rows(once, key, F.col(hyp), F.array(ref), max_n)
    pairs = own.select("n", "gram", "ch", "cr").unionByName(counts.filter("ch > 0 and cr > 0").select("g.n", "g.gram", "ch", "cr"))
    met = cut_lineage(pairs.groupBy("n", "gram").agg(F.sum(F.least("ch", "cr")).alias("m")))
    words = df.agg(F.sum(F.size(ref))).scalar().cast("double")
    info = gram_information(cut_lineage(gram_counts(both, F.array(ref), met, max_n)), words)
    gain = met.join(info, ["n", "gram"]).groupBy("n").agg(F.sum(F.col("m") * F.col("info")).alias("gain"))
    size = both.agg(F.array(*[F.sum(F.greatest(F.size(hyp) - n + 1, F.lit(0))).cast("double") for n in range(1, max_n + 1)]).alias("t"))
    size = size.select(F.posexplode("t").alias("n", "total")).withColumn("n", F.col("n") + 1)
    mean = size.join(gain, "n", "left").select(F.try_divide(F.coalesce("gain", F.lit(0.0)), F.col("total")).alias("p"))
    hyp_words = df.agg(F.sum(F.size(hyp))).scalar().cast("double")
    ratio = hyp_words / words
    beta = math.log(0.5) / math.log(1.5) ** 2
    penalty = F.when(ratio > 0, F.exp(F.lit(beta) * F.pow(F.log(F.least(ratio, F.lit(1.0))), F.lit(2.0)))).otherwise(0.0)
    return mean.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("s")).select((F.col("s") * penalty).alias("nist"))


def corpus_chrf(df: DataFrame, hyp: str, ref: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """Character F-score in [0, 100] against one reference per row.

    Each row returns its counts per order; the sums are an ordinary aggregate.
    """
    squeeze = lambda c: F.regexp_replace(F.col(c), r"[\s\p{Z}]+", "")
    rows = df.select(F.posexplode_outer(overlap_udf(order)(squeeze(hyp), squeeze(ref))).alias("n", "c"))
    at = lambda i: F.sum(F.get("c", F.lit(i))).cast("double")
    per_n = rows.groupBy("n").agg(at(0).alias("m"), at(1).alias("h"), at(2).alias("r")).filter("h > 0 and r > 0")
    means = per_n.agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("q"))
    f = beta * beta
    score = F.try_divide(F.lit(1 + f) * F.col("p") * F.col("q"), F.lit(f) * F.col("p") + F.col("q"))
    return means.select((F.coalesce(score, F.lit(0.0)) * 100).alias("chrf"))


def corpus_nist_refs(df: DataFrame, key: str, hyp: str, refs: str, max_n: int = 5) -> DataFrame:
    """NIST score against several references per row: for each order the reference with the highest gain counts.

    ``hyp`` is a word array, ``refs`` an array of them; ``key`` is unique. Of equal gains the longest reference
    counts, and the length of the one that counts enters the penalty, once for each order.
    """
    tagged = lambda w, n: F.transform(word_grams(w, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    grams = lambda w: F.flatten(F.array(*[tagged(w, n) for n in range(1, max_n + 1)]))
    listed = F.when(F.size(refs) > 0, F.col(refs)).otherwise(F.array(F.array().cast("array<string>")))
    rows = df.select(F.col(key).alias("_key"), F.col(hyp).alias("h"), listed.alias("r"))
    once, again = apart(rows, "_key")
    sides = F.concat(F.array(F.struct(F.lit(-1).alias("k"), F.col("h").alias("w"))), F.transform("r", lambda w, k: F.struct(k.alias("k"), w.alias("w"))))
    each = again.filter("_key IS NOT NULL").select("_key", F.explode(sides).alias("s")).select("_key", "s.k", F.explode(grams(F.col("s.w"))).alias("g"))
    counts = each.groupBy("_key", "g", "k").agg(F.count(F.lit(1)).alias("c"))
    shared = counts.filter("k >= 0").join(counts.filter("k < 0").select("_key", "g", F.col("c").alias("ch")), ["_key", "g"])
    own = N.match_rows(once, "_key", F.col("h"), F.col("r"), max_n)
    met = own.select("_key", "n", "k", "gram", F.least("ch", "cr").alias("m"))
    met = cut_lineage(met.unionByName(shared.select("_key", "g.n", "k", "g.gram", F.least("c", "ch").alias("m"))))
    all_words = rows.agg(F.sum(F.aggregate("r", F.lit(0).cast("bigint"), lambda a, w: a + F.size(w)))).scalar().cast("double")
    info = gram_information(cut_lineage(gram_counts(rows, F.col("r"), met, max_n)), all_words)
    gained = met.join(info, ["n", "gram"]).groupBy("_key", "n", "k").agg(F.sum(F.col("m") * F.col("info")).alias("gain"))
    base = rows.select("_key", F.size("h").alias("hl"), F.posexplode(F.transform("r", lambda w: F.size(w))).alias("k", "rl"))
    base = base.select("*", F.explode(F.array(*[F.lit(n) for n in range(1, max_n + 1)])).alias("n"))
    base = base.join(gained, ["_key", "n", "k"], "left").withColumns({"gain": F.coalesce("gain", F.lit(0.0)), "den": F.greatest(F.col("hl") - F.col("n") + 1, F.lit(0))})
    # gains that differ by rounding alone are equal
    best = base.groupBy("_key", "n").agg(F.max(F.struct(F.round(F.coalesce(F.try_divide("gain", F.col("den").cast("double")), F.lit(0.0)), 12), "rl", "gain", "den")).alias("b"), F.max("hl").alias("hl"))
    per_n = best.groupBy("n").agg(F.sum("b.gain").alias("gain"), F.sum("b.den").cast("double").alias("den"), F.sum("b.rl").alias("rl"), F.sum("hl").alias("hl"))
    whole = per_n.agg(F.coalesce(F.sum(F.try_divide("gain", "den")), F.lit(0.0)).alias("s"), F.sum("rl").cast("double").alias("rl"), F.sum("hl").cast("double").alias("hl"))
    ratio, beta = F.try_divide("hl", "rl"), math.log(0.5) / math.log(1.5) ** 2
    penalty = F.when(ratio > 0, F.exp(F.lit(beta) * F.pow(F.log(F.least(ratio, F.lit(1.0))), F.lit(2.0)))).otherwise(0.0)
    return whole.select(F.coalesce(F.col("s") * penalty, F.lit(0.0)).alias("nist"))


def best_overlap_udf(orders: int, beta: float):
    """Arrow UDF: per order [matches, grams of the text, grams of the reference] against the reference with the best F-score."""

    def counts(text: str, ref: str) -> list[list[int]]:
        return [[m, h if r else 0, r] for m, h, r, *_ in gram_overlap(text, ref, orders)]

    @F.pandas_udf(OVERLAP)
    def run(text: pd.Series, refs: pd.Series) -> pd.Series:
        out = []
        for t, others in zip(text, refs, strict=True):
            made = [counts(t or "", r or "") for r in others] if others is not None and len(others) else [counts(t or "", "")]
            out.append(max(made, key=lambda c: f_score(c, beta)))  # of equal ones the first
        return pd.Series(out)

    return run


def f_score(counts: Sequence[Sequence[float]], beta: float) -> float:
    """F-score of mean precision and recall over the orders that both sides have."""
    both = [(m / h, m / r) for m, h, r in counts if h and r]
    if not both:
        return 0.0
    p, q = (sum(x) / len(both) for x in zip(*both, strict=True))
    return (1 + beta * beta) * p * q / (beta * beta * p + q) if p + q else 0.0


def corpus_chrf_refs(df: DataFrame, hyp: str, refs: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """Character F-score in [0, 100] against an array of references per row, of which the best one counts.

    Null texts are empty; a row without references counts for nothing but its own letters' orders.
    """
    squeeze = lambda c: F.regexp_replace(c, r"[\s\p{Z}]+", "")
    rows = df.select(F.posexplode(best_overlap_udf(order, beta)(squeeze(F.col(hyp)), F.transform(refs, squeeze))).alias("n", "c"))
    at = lambda i: F.sum(F.get("c", F.lit(i))).cast("double")
    per_n = rows.groupBy("n").agg(at(0).alias("m"), at(1).alias("h"), at(2).alias("r")).filter("h > 0 and r > 0")
    means = per_n.agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("q"))
    f = beta * beta
    score = F.try_divide(F.lit(1 + f) * F.col("p") * F.col("q"), F.lit(f) * F.col("p") + F.col("q"))
    return means.select((F.coalesce(score, F.lit(0.0)) * 100).alias("chrf"))


def parse_references(raw: Column) -> Column:
    """List literal in a text cell, else the cell as one reference."""
    body = T.strip(F.coalesce(raw, F.lit("")))
    as_json = F.from_json(body, "array<string>")
    as_single_quoted = F.from_json(body, "array<string>", {"allowSingleQuotes": "true"})
    parsed = F.coalesce(as_json, as_single_quoted)
    trimmed = F.filter(F.transform(parsed, T.strip), lambda x: x != "")
    is_list = body.startswith("[") & parsed.isNotNull()
    return F.when(body == "", F.array().cast("array<string>")).when(is_list, trimmed).otherwise(F.array(body))
