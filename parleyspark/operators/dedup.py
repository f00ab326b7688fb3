"""Keyed deduplication and leak filters with explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parleyspark.functions import text as T
from parleyspark.session import cut_lineage


def last_wins(df: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """Newest record per key of an append-only log.

    ``row_number() = 1`` lets Spark prune to one row per key on the map side,
    so a hot key never travels as a whole.
    """
    w = W.partitionBy(*key).orderBy(F.desc(ordinal))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, key: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def norm_key(text: Column) -> Column:
    """Fixed-width key of the normalised text; long texts are never shuffled as keys."""
    return F.sha2(T.normalise(text), 256)


def with_norm(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its norm key and a blank flag."""
    return df.withColumns({"norm": norm_key(F.col(text)), "blank": T.normalise(F.col(text)) == ""}).drop(text)


def first_per_text(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First row per norm key."""
    return first_wins(df, ["norm"], order)


def mark_holdout(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Add ``in_holdout``: norm key shared with a holdout row, or blank text.

    The keys are written first, so that a join at a hot key can be split.
    """
    keys = cut_lineage(holdout.select("norm").distinct()).withColumn("_held", F.lit(True))
    joined = train.join(keys, "norm", "left")
    return joined.withColumn("in_holdout", F.coalesce(F.col("_held"), F.lit(False)) | F.col("blank")).drop("_held")


def pending(rows: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    """Rows whose id is in none of the finished sets."""
    ids = None
    for d in done:
        part = d.select(key)
        ids = part if ids is None else ids.union(part)
    return rows.join(ids, key, "left_anti")


def attach_all(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Inner lookup by a unique key in which every row must find its match.

    The check runs inside the same job: an unmatched row fails the query.
    """
    found = lookup.withColumn("_found", F.lit(True))
    joined = rows.join(found, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no match for {key} "), F.col(key).cast("string")))
    checked = F.when(F.col("_found"), True).otherwise(missing.cast("boolean"))
    return joined.filter(checked).drop("_found")


def attach_left(rows: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Lookup by a unique key; NULL where the key is absent. Columns that rows have already stay as they are."""
    fresh = [c for c in columns if c not in rows.columns]
    return rows.join(lookup.select(key, *fresh), key, "left")


def attach_by_number(rows: DataFrame, text_id: str, lookup: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Inner join on the whole number that a text id holds after its prefix; ids without one match nothing."""
    number = F.regexp_extract(text_id, f"^{prefix}([0-9]+)$", 1).try_cast("bigint")
    numbered = rows.withColumn("_number", number)
    return numbered.join(lookup, numbered["_number"] == lookup[key]).drop("_number")


def seen_once(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First delivery of each (contact, text)."""
    return first_wins(df, list(keys), [order])
