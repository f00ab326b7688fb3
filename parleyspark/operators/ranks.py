"""Order statistics without a global sort in one task.

Rows are first collapsed to one row per distinct value. These are dealt by range
of value into blocks, as many as shuffle partitions, and written once with their
block. Running totals are then built in two levels: totals of the blocks, which
alone meet in one window, and a window inside each block. Blocks are even however
the values crowd, as they split the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parleyspark.session import written


def running_before(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add ``<c>_before``, the total of c over strictly smaller values of the key,
    and ``<c>_total``, the total over the key.

    ``df`` holds at most one row per (keys, value). A block is a range of (keys,
    value), so a key with most of the values lies in many of them; by default
    there are as many as shuffle partitions, fewer if they would be small.
    """
    keys = list(keys)
    number = [] if buckets is None else [buckets]
    ranged = df.repartitionByRange(*number, *keys, value).withColumn("_b", F.spark_partition_id())
    bucketed = written(ranged)
    totals = bucketed.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    across = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_t_{c}").over(across), F.lit(0)).alias(f"_base_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(W.partitionBy(*keys)).alias(f"{c}_total") for c in sums],
    )
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    joined = bucketed.join(base, [*keys, "_b"])
    for c in sums:
        joined = joined.withColumn(
            f"{c}_before", F.col(f"_base_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
        )
    return joined.drop("_b", *[f"_base_{c}" for c in sums])


def auc(df: DataFrame, keys: Sequence[str], positive: Column, score: str) -> DataFrame:
    """Midrank AUC per key; NULL with one class. NULL scores are ignored."""
    scored = df.filter(F.col(score).isNotNull()).withColumn("_pos", positive)
    values = scored.groupBy(*keys, score).agg(
        F.count_if("_pos").alias("pos"), F.count_if(~F.col("_pos")).alias("neg")
    )
    ranked = running_before(values, keys, score, ["neg"])
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before").cast("double") + F.col("neg").cast("double") / 2))
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.try_divide(wins, total).alias("auc")
    )


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Share of rows at or below each distinct value."""
    values = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_before(values, [], value, ["n"])
    upto = (F.col("n_before") + F.col("n")).cast("double")
    return ranked.select(value, (upto / F.col("n_total").cast("double")).alias("ecdf"))


def ecdf_at(sample: DataFrame, value: str, points: DataFrame, point: str, out: str) -> DataFrame:
    """Evaluate the sample's step function at foreign points.

    Sample and point values share one ordered list of distinct values, so the
    lookup is a running count joined back by equality, not a range join.
    """
    ours = sample.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.lit(1).alias("_n"))
    theirs = points.filter(F.col(point).isNotNull()).select(F.col(point).alias("_v"), F.lit(0).alias("_n"))
    values = ours.union(theirs).groupBy("_v").agg(F.sum("_n").alias("n"))
    steps = running_before(values, [], "_v", ["n"]).select(
        "_v", ((F.col("n_before") + F.col("n")).cast("double") / F.col("n_total").cast("double")).alias(out)
    )
    return points.join(steps, points[point] == steps["_v"], "left").drop("_v")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per key; ``weight`` holds row counts."""
    keys = list(keys)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    values = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    ranked = running_before(values, keys, value, ["n"])
    lo, hi = F.col("n_before"), F.col("n_before") + F.col("n")
    aggs = []
    for name, p in probs.items():
        k = (F.col("n_total") - 1).cast("double") * F.lit(p)
        below, above = F.floor(k), F.ceil(k)
        pick = lambda r: F.max(F.when((lo <= r) & (r < hi), F.col(value)))
        aggs += [pick(below).alias(f"_l_{name}"), pick(above).alias(f"_h_{name}"), F.max(k - below).alias(f"_f_{name}")]
    out = ranked.groupBy(*keys).agg(*aggs)
    lerp = [
        (F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs
    ]
    return out.select(*keys, *lerp)


def midranks(values: DataFrame, value: str, n: str, out: str) -> DataFrame:
    """Average rank of each distinct value given its multiplicity."""
    ranked = running_before(values, [], value, [n])
    rank = F.col(f"{n}_before") + (F.col(n) + 1) / 2
    return ranked.select(value, rank.alias(out), F.col(f"{n}_total").alias("_total"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation from pair counts; hot values collapse before any join."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    rx = midranks(pairs.groupBy(x).agg(F.sum("n").alias("m")), x, "m", "rx")
    ry = midranks(pairs.groupBy(y).agg(F.sum("n").alias("m")), y, "m", "ry").drop("_total")
    joined = pairs.join(rx, x).join(ry, y)
    mean = (F.col("_total").cast("double") + 1) / 2
    dx, dy, n = F.col("rx") - mean, F.col("ry") - mean, F.col("n").cast("double")
    sxy, sxx, syy = F.sum(n * dx * dy), F.sum(n * dx * dx), F.sum(n * dy * dy)
    return joined.agg(F.sum("n").alias("n"), F.try_divide(sxy, F.sqrt(sxx * syy)).alias("rho"))


def mann_whitney(df: DataFrame, in_first: Column, value: str) -> DataFrame:
    """U of the first sample with the tie-corrected normal z (upper tail)."""
    values = (
        df.filter(F.col(value).isNotNull())
        .withColumn("_a", in_first)
        .groupBy(value)
        .agg(F.count_if("_a").alias("a"), F.count_if(~F.col("_a")).alias("b"))
    )
    ranked = running_before(values, [], value, ["b"])
    t = (F.col("a") + F.col("b")).cast("double")
    stats = ranked.agg(
        F.sum("a").alias("n_first"),
        F.sum("b").alias("n_second"),
        F.sum(F.col("a").cast("double") * (F.col("b_before").cast("double") + F.col("b").cast("double") / 2)).alias("u"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1)))
    z = F.try_divide(F.col("u") - n1 * n2 / 2 - 0.5, F.sqrt(var))
    return stats.select("n_first", "n_second", "u", z.alias("z"))
