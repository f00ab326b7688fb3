"""Classification metrics, sweeps and gate tables over one counting pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty=0.0) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(empty))


def f1(precision: Column, recall: Column) -> Column:
    s = precision + recall
    return F.when(s > 0, F.lit(2.0) * precision * recall / s).otherwise(F.lit(0.0))


def confusion(df: DataFrame, keys: Sequence[str], y: Column, pred: Column) -> DataFrame:
    """tp, fp, fn, tn for 0/1 columns."""
    return df.groupBy(*keys).agg(
        F.count_if((pred == 1) & (y == 1)).alias("tp"),
        F.count_if((pred == 1) & (y == 0)).alias("fp"),
        F.count_if((pred == 0) & (y == 1)).alias("fn"),
        F.count_if((pred == 0) & (y == 0)).alias("tn"),
    )


def binary_metrics(counts: DataFrame, keys: Sequence[str], fpr_when_empty=None) -> DataFrame:
    """Metrics from a confusion table; F1 parts are zero when undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        *keys,
        (tp + fp + fn + tn).alias("n"),
        (tp + fn).alias("positives"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1(precision, recall).alias("f1"),
        ratio(fp, tn + fp, fpr_when_empty).alias("fpr"),
    )


def class_counts(df: DataFrame, keys: Sequence[str], y: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """tp, fp, fn per class in one pass; every listed class gets a row."""
    n_classes = len(classes)
    aggs = []
    for c in classes:
        aggs += [
            F.count_if((F.col(pred) == c) & (F.col(y) == c)).alias(f"tp{c}"),
            F.count_if((F.col(pred) == c) & (F.col(y) != c)).alias(f"fp{c}"),
            F.count_if((F.col(pred) != c) & (F.col(y) == c)).alias(f"fn{c}"),
        ]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == F.col(pred)).alias("hit"), *aggs)
    stacked = ", ".join(f"{c}, tp{c}, fp{c}, fn{c}" for c in classes)
    return wide.select(*keys, "n", "hit", F.expr(f"stack({n_classes}, {stacked}) as (class_id, tp, fp, fn)"))


def class_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
    )


def macro_scores(counts: DataFrame, keys: Sequence[str], n_classes: int) -> DataFrame:
    """Macro averages over the fixed class list; an absent class counts zero."""
    k = F.lit(float(n_classes))
    return class_scores(counts).groupBy(*keys).agg(
        F.max("n").alias("n"),
        ratio(F.max("hit"), F.max("n")).alias("accuracy"),
        (F.sum("f1") / k).alias("macro_f1"),
        (F.sum("precision") / k).alias("macro_precision"),
        (F.sum("recall") / k).alias("macro_recall"),
    )


def linspace(start: float, stop: float, n: int) -> list[float]:
    step = (stop - start) / (n - 1)
    points = [i * step + start for i in range(n)]
    points[-1] = stop
    return points


def thresholds_passed(score: Column, grid: Sequence[float]) -> Column:
    """How many grid points are <= score, by arithmetic and one exact fix-up."""
    n, start = len(grid), grid[0]
    step = (grid[-1] - grid[0]) / (n - 1)
    points = F.array(*[F.lit(float(g)) for g in grid])
    guess = F.least(F.greatest(F.floor((score - F.lit(start)) / F.lit(step)).cast("int") + 1, F.lit(0)), F.lit(n))
    up = (guess < n) & (score >= F.get(points, guess))
    down = (guess > 0) & (score < F.get(points, guess - 1))
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def sweep(df: DataFrame, keys: Sequence[str], y: Column, score: Column, grid: Sequence[float]) -> DataFrame:
    """Confusion counts of ``score >= t`` for every t of the grid.

    Each row is reduced to the number of grid points it passes, so the data is
    aggregated once; the grid only multiplies the tiny histogram.
    """
    n = len(grid)
    hist = (
        df.withColumn("_passed", thresholds_passed(score, grid))
        .withColumn("_y", y)
        .groupBy(*keys, "_passed")
        .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    )
    points = F.array(*[F.lit(float(g)) for g in grid])
    spread = hist.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    above = F.col("_passed") > F.col("step")
    return (
        spread.groupBy(*keys, "step")
        .agg(
            F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
            F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"),
        )
        .withColumn("threshold", F.get(points, F.col("step")))
    )


def first_max(df: DataFrame, keys: Sequence[str], objective: str, order: str) -> DataFrame:
    """Row with the largest objective; the smallest order value wins ties."""
    from parleyspark.operators.sampling import top_per_group

    if keys:
        return top_per_group(df, keys, [F.desc(objective), F.asc(order)], 1)
    return df.orderBy(F.desc(objective), F.asc(order)).limit(1)


def youden(df: DataFrame, removed: Column, scores: Sequence[str]) -> DataFrame:
    """Best cut of each drop score: reject when score > cut, cuts rounded to 3 dp.

    All scores share one pass. A cut is decided by running counts over distinct
    values, so rows and cuts never meet in a cross product.
    """
    from parleyspark.operators.ranks import running_before

    named = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("v")) for s in scores]))
    values = (
        df.select(removed.alias("_r"), named.alias("s"))
        .select("_r", "s.score", "s.v")
        .filter("v IS NOT NULL")
        .groupBy("score", "v")
        .agg(F.count_if("_r").alias("r"), F.count_if(~F.col("_r")).alias("k"))
    )
    zero = F.lit(0).cast("bigint")
    both = F.array(
        F.struct("v", "r", "k", F.lit(False).alias("is_cut")),
        F.struct((F.rint(F.col("v") * 1000) / 1000).alias("v"), zero.alias("r"), zero.alias("k"), F.lit(True).alias("is_cut")),
    )
    merged = (
        values.select("score", F.inline(both))
        .groupBy("score", "v")
        .agg(F.sum("r").alias("r"), F.sum("k").alias("k"), F.max("is_cut").alias("is_cut"))
    )
    upto = running_before(merged, ["score"], "v", ["r", "k"]).filter("is_cut")
    above = lambda c: F.col(f"{c}_total") - F.col(f"{c}_before") - F.col(c)
    j = ratio(above("r"), F.col("r_total")) - ratio(above("k"), F.col("k_total"))
    scored = upto.select("score", F.col("v").alias("threshold"), j.alias("j"))
    return first_max(scored, ["score"], "j", "threshold")


def gate_table(df: DataFrame, removed: Column, gates: dict[str, Column], variant: str | None = None) -> DataFrame:
    """Detection, false rejects and J for several boolean gates at once."""
    gated = df.select(
        *([variant] if variant else []),
        removed.alias("_removed"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), g.alias("reject")) for n, g in gates.items()])).alias("_g"),
    ).select("*", "_g.gate", "_g.reject")
    keys = ["gate"] + ([variant] if variant else [])
    hit = F.col("reject")
    counts = gated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("rejected"),
        F.count_if(F.col("_removed")).alias("n_removed"),
        F.count_if(hit & F.col("_removed")).alias("rejected_removed"),
        F.count_if(hit & ~F.col("_removed")).alias("rejected_kept"),
    )
    sens = ratio(F.col("rejected_removed"), F.col("n_removed"), None)
    fr = ratio(F.col("rejected_kept"), F.col("n") - F.col("n_removed"), None)
    out = counts.withColumn("reject_rate", ratio(F.col("rejected"), F.col("n")))
    return out.withColumn("sensitivity", sens).withColumn("false_reject", fr).withColumn("youden_j", sens - fr)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    kd, nd = k.cast("double"), n.cast("double")
    p = kd / nd
    d = F.lit(1.0) + F.lit(z * z) / nd
    c = p + F.lit(z * z) / (F.lit(2.0) * nd)
    h = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / nd + F.lit(z * z) / (F.lit(4.0) * nd * nd))
    some = n > 0
    return F.when(some, (c - h) / d).otherwise(0.0), F.when(some, (c + h) / d).otherwise(0.0)


def trend_chi2(counts: DataFrame, group_score: str, n: str, x: str) -> DataFrame:
    """Cochran-Armitage statistic over ordered groups."""
    s, ni, xi = F.col(group_score).cast("double"), F.col(n).cast("double"), F.col(x).cast("double")
    sums = counts.agg(
        F.sum(ni).alias("n"), F.sum(xi).alias("x"), F.sum(s * xi).alias("sx"),
        F.sum(ni * s).alias("sn"), F.sum(ni * s * s).alias("ssn"),
    )
    pbar = F.col("x") / F.col("n")
    num = F.col("sx") - pbar * F.col("sn")
    den = pbar * (F.lit(1.0) - pbar) * (F.col("ssn") - F.col("sn") * F.col("sn") / F.col("n"))
    return sums.select("n", "x", F.try_divide(num * num, den).alias("chi2"))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson r; zero below three rows or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    enough = F.count_if(both) >= 3
    return F.when(enough, F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
