"""Contacts that are remembered: the most recent ones over all messages, in one order.

A message finds its contact's history only if fewer than ``capacity`` other contacts came since the contact's last
message. The order is global, so messages are dealt into blocks by ranges of it. To later blocks a block is its
``capacity`` most recent contacts, in order; two such lists combine to one, whatever is combined first, so lists
are folded in stretches of blocks, then over stretches. Each block is then replayed from what comes in, as a stream
of rows with ``capacity`` contacts in memory.

A contact that comes back after it was forgotten starts a new generation, named by the order values of that message.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.session import cut_lineage

#: Blocks of one stretch.
FAN = 1024


def _newest(recent: dict, rows: list[tuple], capacity: int) -> dict:
    """The list after rows (contact, at) in order."""
    for contact, at in rows:
        recent.pop(contact, None)
        recent[contact] = at
    return dict(list(recent.items())[-capacity:])


def _fold(capacity: int, by: str):
    """Rows (by, _contact, _at) in order: for each value of ``by`` the contacts that were recent before it, and last of all the final ones."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: dict = {}
        now, rows = None, []
        for pdf in frames:
            out = []
            for number, contact, at in zip(pdf[by], pdf["_contact"], pdf["_at"], strict=True):
                if number != now:
                    recent, now, rows = _newest(recent, rows, capacity), number, []
                    out += [(number, c, a) for c, a in recent.items()]
                rows.append((contact, at))
            yield pd.DataFrame(out, columns=[by, "_contact", "_at"])

    return fold


def _tails(summary: DataFrame, by: Sequence[str], capacity: int) -> DataFrame:
    """The ``capacity`` most recent contacts of each value of ``by``."""
    latest = summary.groupBy(*by, "_contact").agg(F.max("_at").alias("_at"))
    newest = W.partitionBy(*by).orderBy(F.desc("_at"))
    return latest.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= capacity).drop("_rn")


def _carries(summary: DataFrame, capacity: int, stretches: int) -> DataFrame:
    """(_block, _contact, _at): what is recent before each block, from the tails of blocks."""
    one = lambda df, by: df.select(by, "_contact", "_at")
    if stretches <= 1:
        return one(summary, "_block").repartition(1).sortWithinPartitions("_block", "_at").mapInPandas(_fold(capacity, "_block"), one(summary, "_block").schema)
    whole = _tails(summary, ["_stretch"], capacity)
    before = one(whole, "_stretch").repartition(1).sortWithinPartitions("_stretch", "_at").mapInPandas(_fold(capacity, "_stretch"), one(whole, "_stretch").schema)
    first = summary.groupBy("_stretch").agg(F.min("_block").alias("_block"))
    entering = before.join(first, "_stretch").select("_block", "_contact", "_at", "_stretch")
    # what enters a stretch stands before its first block, so the fold of the stretch begins with it
    lists = entering.withColumn("_block", F.col("_block") - 1).unionByName(summary.select("_block", "_contact", "_at", "_stretch"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["_block", "_at"])
        return pd.concat(list(_fold(capacity, "_block")(iter([ordered]))))

    folded = lists.groupBy("_stretch").applyInPandas(inside, one(summary, "_block").schema)
    return folded.join(summary.select("_block").distinct(), "_block", "left_semi")


def _replay(capacity: int, columns: list[str]):
    """Rows of blocks in order, after what enters the block: whether each finds its contact."""

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: dict = {}
        now = None
        for pdf in frames:
            known = []
            for number, contact, carried in zip(pdf["_block"], pdf["_contact"], pdf["_carried"], strict=True):
                if number != now:
                    recent, now = {}, number
                known.append(contact in recent)
                recent.pop(contact, None)
                recent[contact] = None
                if len(recent) > capacity:
                    recent.pop(next(iter(recent)))
            yield pdf.assign(kept_history=known)[~pdf["_carried"]][columns]

    return replay


def remembered(df: DataFrame, contact: str, order: Sequence[str], capacity: int = C.MAX_CONTACTS, block_rows: int = 500_000, carried: DataFrame | None = None) -> DataFrame:
    """(contact, order..., kept_history, generation) of each message.

    carried: (contact, place, generation) of contacts that are recent before the first message, by place; without it
    nothing is. ``order`` is total. generation: the order values of the message that began it, joined by colons.
    """
    order = list(order)
    at = F.struct(*order)
    rows = df.select(F.col(contact).alias("_contact"), *order)
    blocks = max(1, math.ceil(rows.count() / block_rows))
    dealt = rows.repartitionByRange(blocks, *order) if blocks > 1 else rows.repartition(1)
    dealt = cut_lineage(dealt.withColumn("_block", F.spark_partition_id().cast("long")))
    stretch = F.floor(F.col("_block") / FAN).alias("_stretch")
    summary = _tails(dealt.select("_block", stretch, "_contact", at.alias("_at")), ["_block", "_stretch"], capacity)
    summary = cut_lineage(summary.withColumn("_at", F.struct(F.lit(1).alias("_from"), F.lit(0).cast("long").alias("_place"), F.col("_at"))))
    if carried is not None:  # stands before all blocks
        none = F.lit(None).cast(summary.schema["_at"].dataType.fields[2].dataType)
        early = carried.select(F.lit(-1).cast("long").alias("_block"), F.lit(0).cast("long").alias("_stretch"), F.col("contact").alias("_contact"), F.struct(F.lit(0).alias("_from"), F.col("place").cast("long").alias("_place"), none.alias("_at")).alias("_at"))
        summary = summary.unionByName(early)
    entering = _carries(_numbered(summary), capacity, math.ceil(blocks / FAN))
    every = dealt.withColumns({"_carried": F.lit(False), "_at": F.lit(None).cast("long")}).unionByName(entering.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
    # a key of its own: a union of inputs dealt by _block is not dealt by it
    every = every.repartition(F.xxhash64("_block")).sortWithinPartitions("_block", F.desc("_carried"), "_at", *order)
    columns = ["_block", "_contact", *order, "kept_history"]
    schema = dealt.select("_block", "_contact", *order).schema.add("kept_history", "boolean")
    replayed = cut_lineage(every.mapInPandas(_replay(capacity, columns), schema))
    out = _generations(replayed, at, carried)
    return out.select(F.col("_contact").alias(contact), *order, "kept_history", "generation")


def _numbered(summary: DataFrame) -> DataFrame:
    """Tails with a number for their order, which plain tasks can sort; only tails are numbered."""
    by = W.partitionBy("_stretch").orderBy("_at")
    return summary.withColumn("_at", F.col("_stretch") * F.lit(1 << 32) + F.row_number().over(by))


def _generations(replayed: DataFrame, at: Column, carried: DataFrame | None) -> DataFrame:
    """The last message at or before each one that did not find its contact. Blocks of a contact are summed up first."""
    begun = F.max(F.when(~F.col("kept_history"), at))
    by_block = replayed.groupBy("_contact", "_block").agg(begun.alias("_begun"))
    earlier = W.partitionBy("_contact").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = by_block.select("_contact", "_block", F.max("_begun").over(earlier).alias("_before"))
    inside = W.partitionBy("_contact", "_block").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    out = replayed.withColumn("_own", begun.over(inside)).join(before, ["_contact", "_block"])
    names = replayed.select(at.alias("s")).schema["s"].dataType.names
    last = F.coalesce("_own", "_before")
    named = F.concat_ws(":", *[last[n].cast("string") for n in names])
    if carried is None:
        return out.withColumn("generation", named)
    old = carried.select(F.col("contact").alias("_contact"), F.col("generation").alias("_old"))
    # carried holds at most ``capacity`` contacts
    return out.join(F.broadcast(old), "_contact", "left").withColumn("generation", F.when(last.isNotNull(), named).otherwise(F.col("_old")))


def most_recent(df: DataFrame, contact: str, order: Sequence[str], generation: str = "generation", capacity: int = C.MAX_CONTACTS, carried: DataFrame | None = None) -> DataFrame:
    """(contact, place, generation) of the contacts that are recent after the messages; place counts from the oldest."""
    latest = df.groupBy(F.col(contact).alias("contact")).agg(F.max(F.struct(*order)).alias("_at"), F.max_by(generation, F.struct(*order)).alias("generation"))
    latest = latest.select("contact", "generation", F.lit(1).alias("_from"), F.lit(0).cast("long").alias("_place"), "_at")
    if carried is not None:
        old = carried.join(latest.select("contact"), "contact", "left_anti")
        latest = latest.unionByName(old.select("contact", "generation", F.lit(0).alias("_from"), F.col("place").cast("long").alias("_place")), allowMissingColumns=True)
    newest = latest.orderBy(F.desc("_from"), F.desc("_place"), F.desc("_at")).limit(capacity)
    oldest_first = W.orderBy("_from", "_place", "_at")  # of at most capacity rows
    return newest.select("contact", F.row_number().over(oldest_first).cast("long").alias("place"), "generation")
