"""Frozen thread sets: a flat copy by split, a tree by cell, and a manifest that readers check.

The rows are computed once, into the flat copy ``all/``; the tree ``cells/`` is written from those files, so a lost
executor or a failed tree costs a read of them. The manifest is written last and holds, for each layout and cell,
the number of rows and a content hash that does not depend on their order. Without a manifest nothing is frozen yet; with
one, writing again needs ``replace``.

Defined results: equal rows count as often as they occur; null fields differ from absent text; an empty set freezes
to an empty manifest and reads as no rows; cell fields that are null make a cell of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parleyspark.sources.files import exists, remove

CELL = ("length", "script", "label", "split")
FLAT, TREE = "all", "cells"
#: What a manifest says of a cell.
FACTS = ("rows", "content", "second")


def _facts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and two order-free hash sums for each cell; sums of decimals, so that repeated rows do not cancel out."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    total = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    return df.withColumn("_row", row).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), total(F.xxhash64("_row")).alias("content"), total(F.xxhash64(F.lit("second"), F.col("_row"))).alias("second")
    )


def _schema(rows: DataFrame) -> StructType:
    """Types as the files give them back: JSON holds no nullability."""
    return StructType([type(f)(f.name, f.dataType, True) for f in rows.schema])


def _rows(spark: SparkSession, path: str, layout: str, schema: StructType) -> DataFrame:
    """A layout's records, which hold all their fields; those of the folders' names are left aside."""
    return spark.read.schema(schema).json(f"{path}/{layout}").select(*schema.names)


def freeze(rows: DataFrame, path: str, cell: Sequence[str] = CELL, replace: bool = False) -> None:
    """Write both layouts and the manifest. ``cell`` ends with the field that the flat copy is dealt by."""
    spark, split = rows.sparkSession, cell[-1]
    if exists(spark, f"{path}/manifest/_SUCCESS"):
        if not replace:
            raise FileExistsError(f"{path} is frozen")
        remove(spark, f"{path}/manifest")  # until the new one is there, nothing counts as frozen
    schema = _schema(rows)
    rows.withColumn("_split", F.col(split)).write.mode("overwrite").partitionBy("_split").option("ignoreNullFields", False).json(f"{path}/{FLAT}")
    flat = _rows(spark, path, FLAT, schema)
    salt = F.pmod(F.xxhash64(*flat.columns), F.lit(8))
    folders = {f"_{c}": F.col(c) for c in cell}
    flat.repartition(*cell, salt).withColumns(folders).write.mode("overwrite").partitionBy(*folders).option("ignoreNullFields", False).json(f"{path}/{TREE}")
    facts = _facts(flat, cell)
    both = facts.withColumn("layout", F.explode(F.array(F.lit(FLAT), F.lit(TREE))))
    both.write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, f"{path}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"{path} has no manifest")
    return spark.read.parquet(f"{path}/manifest")


def check(spark: SparkSession, path: str, schema: StructType, cell: Sequence[str] = CELL, layouts: Sequence[str] = (FLAT, TREE)) -> DataFrame:
    """(layout, cell, rows, found, intact) for each cell that the manifest or the files hold. Cells are few, rows stay where they are."""
    held = manifest(spark, path).filter(F.col("layout").isin(*layouts))
    seen = None
    for layout in layouts:
        facts = _facts(_rows(spark, path, layout, schema), cell).withColumn("layout", F.lit(layout))
        seen = facts if seen is None else seen.unionByName(facts)
    keys = ["layout", *cell]
    said = held.select(*keys, *FACTS, F.lit(0).alias("_found"))
    read = seen.select(*keys, *FACTS, F.lit(1).alias("_found"))
    side = lambda c, k: F.max(F.when(F.col("_found") == k, F.col(c)))
    same = F.lit(True)
    for c in FACTS:
        same = same & side(c, 0).eqNullSafe(side(c, 1))
    zero = F.lit(0).cast("bigint")
    return said.unionByName(read).groupBy(*keys).agg(F.coalesce(side("rows", 0), zero).alias("rows"), F.coalesce(side("rows", 1), zero).alias("found"), same.alias("intact"))


def read_frozen(spark: SparkSession, path: str, schema: StructType, split: str | None = None, cell: Sequence[str] = CELL) -> DataFrame:
    """The flat copy, or one split of it, checked against the manifest first. Raises ValueError naming cells that differ."""
    bad = check(spark, path, schema, cell, (FLAT,)).filter("NOT intact")
    if split is not None:
        bad = bad.filter(F.col(cell[-1]) == split)
    named = bad.select(*cell).limit(5).collect()  # a sample for the message
    if named:
        raise ValueError(f"{path} was altered after it was frozen: {[tuple(r) for r in named]}")
    rows = _rows(spark, path, FLAT, schema)
    return rows if split is None else rows.filter(F.col(cell[-1]) == split)
