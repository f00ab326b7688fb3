"""Hash-ordered sampling: reproducible on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parleyspark.functions.hashing import hash_unit, stable_int


def hash_order(seed: int | str, key: Column) -> Column:
    return stable_int(F.lit(str(seed)), key)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First n rows per group; the rank filter is pruned before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def sample_per_group(df: DataFrame, group: Sequence[str], key: str, n: int, seed: int | str) -> DataFrame:
    order = [hash_order(seed, F.col(key).cast("string")), F.col(key)]
    return top_per_group(df, group, order, n)


def sample(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    return df.orderBy(hash_order(seed, F.col(key).cast("string")), key).limit(n)


def sample_ids(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """All rows of n sampled distinct ids."""
    ids = sample(df.select(key).distinct(), key, n, seed)
    return df.join(F.broadcast(ids), key, "left_semi")


def weighted_choice(unit: Column, items: Sequence[tuple[str, float]]) -> Column:
    """Item whose cumulative weight first reaches unit * total."""
    total = float(sum(w for _, w in items))
    out, acc = None, 0.0
    for name, weight in items[:-1]:
        acc += float(weight)
        cond = unit * F.lit(total) <= F.lit(acc)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(items[-1][0]) if out is None else out.otherwise(items[-1][0])


def unit_interval(seed: int | str, key: Column) -> Column:
    return hash_unit(F.lit(str(seed)), key)
