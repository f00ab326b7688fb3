"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.session import checkpoint_root

#: White space between words, as a class body for Java's and RE2's patterns.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def keep(df: DataFrame) -> DataFrame:
    """Write df once to a folder of its own under spark.checkpoint.dir and read it back.

    Cuts lineage: a lost executor costs a read. The folder goes with the checkpoint folder.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. The quick form is only taken where it means the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int = 100_000) -> DataFrame:
    """Join with a written table that is broadcast only if it has at most limit rows.

    Beyond that it is a shuffle join of two plain inputs, which adaptive execution can split at hot keys.
    Nulls of the keys match each other.
    """
    if right.limit(limit + 1).count() <= limit:
        right = F.broadcast(right)
    names = [f"{c}__" for c in on]
    right = right.withColumnsRenamed(dict(zip(on, names, strict=True)))
    held = F.lit(True)
    for a, b in zip(on, names, strict=True):
        held = held & left[a].eqNullSafe(right[b])
    return left.join(right, held, how).drop(*names)


def running(df: DataFrame, groups: list[str], order: list[str], amount: str | None = None) -> DataFrame:
    """Add `before` (long): the sum of amount (or number of rows) of earlier rows of the group.

    Rows are dealt by range of (groups, order), so a group with most of the rows lies in many blocks;
    block totals are added up first, then each block runs alone. Equal rows get an arbitrary order.
    """
    value = F.lit(1).cast("long") if amount is None else F.col(amount).cast("long")
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*groups, *order, "_tie"]
    dealt = keep(dealt.repartitionByRange(*keys).withColumn("_block", F.spark_partition_id()).withColumn("_value", value))
    totals = dealt.groupBy(*groups, "_block").agg(F.sum("_value").alias("_total"))
    by = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(totals.withColumn("_start", F.coalesce(F.sum("_total").over(by), F.lit(0))).drop("_total"))
    inside = Window.partitionBy("_block", *groups).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_inner", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    out = join_small(out, starts, [*groups, "_block"], "left")
    return out.withColumn("before", F.col("_start") + F.col("_inner")).drop("_tie", "_block", "_value", "_inner", "_start")
