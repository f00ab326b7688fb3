"""Capped incident log with insert-if-absent among the retained rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.session import cut_lineage


def _replay(cap: int, columns: list[str]):
    """Ordered pass over the rows of blocks, after the log that enters each: the log that leaves it, oldest first.

    Memory is the retained rows of one block.
    """

    def run(frames):
        log: dict = {}
        block = None

        def leaving():
            return pd.DataFrame([(block, k, *row) for k, row in enumerate(log.values())], columns=["_block", "_place", *columns])

        for pdf in frames:
            for number, *row in zip(pdf["_block"], *(pdf[c] for c in columns), strict=True):
                if number != block:
                    if block is not None:
                        yield leaving()
                    log, block = {}, number
                if row[0] not in log:
                    log[row[0]] = row
                    if len(log) > cap:
                        log.pop(next(iter(log)))
        if block is not None:
            yield leaving()

    return run


def _guess(cap: int, columns: list[str]):
    """What enters each block, by its distinct ids alone.

    Rows of a block: the first rows of its ids (kind 0, at most cap + 1), then its log from nothing (kind 1). A block
    of more than ``cap`` ids is taken to leave the latter; another inserts those of its ids that are absent.
    """

    def run(frames):
        entering: dict = {}
        block, firsts, alone = None, {}, {}

        def leaving():
            if len(firsts) > cap:
                return alone
            both = entering | {k: r for k, r in firsts.items() if k not in entering}
            return dict(list(both.items())[-cap:])

        for pdf in frames:
            out = []
            for number, kind, *row in zip(pdf["_block"], pdf["_kind"], *(pdf[c] for c in columns), strict=True):
                if number != block:
                    entering = leaving()
                    out += [(number, k, *r) for k, r in enumerate(entering.values())]
                    block, firsts, alone = number, {}, {}
                (alone if kind else firsts)[row[0]] = row
            yield pd.DataFrame(out, columns=["_block", "_place", *columns])

    return run


#: Most blocks of one replay; what passes from block to block is at most twice the cap for each.
BLOCKS = 2048


def replayed(ids: DataFrame, order: Sequence[str], cap: int, block_rows: int = 1_000_000) -> DataFrame:
    """(id, order...) of the log after all rows, from blocks of the order that are replayed at once.

    What enters a block is guessed from the distinct ids of earlier blocks, which is right if their ids are many, or
    all in the log. Then blocks are replayed, and again as long as what enters one differs from what it was replayed
    from. A block whose predecessors no longer change is settled, and each round settles one more at least; so the
    log is that of one pass, however the rows repeat. Rows that repeat the id of the row before them never change a
    log and are left out.
    """
    columns = ["id", *order]
    blocks = min(max(1, math.ceil(ids.count() / block_rows)), BLOCKS)
    dealt = ids.select(*columns).repartitionByRange(blocks, *order) if blocks > 1 else ids.select(*columns).repartition(1)
    dealt = dealt.withColumn("_block", F.spark_partition_id())
    beside = W.partitionBy("_block").orderBy(*order)
    dealt = cut_lineage(dealt.withColumn("_same", F.lag("id").over(beside).eqNullSafe(F.col("id")) & (F.row_number().over(beside) > 1)).filter(~F.col("_same")).drop("_same"))
    followed = cut_lineage(dealt.select("_block").distinct().withColumn("_next", F.lead("_block").over(W.orderBy("_block"))))  # of blocks, not rows
    schema = dealt.select("_block").schema.add("_place", "long")
    for c in columns:
        schema = schema.add(dealt.schema[c])
    # a key of its own: a union of inputs dealt by _block is not dealt by it
    together = F.xxhash64("_block")

    def run(rows: DataFrame, entering: DataFrame | None) -> DataFrame:
        every = rows.withColumn("_place", F.lit(None).cast("long"))
        if entering is not None:
            every = every.unionByName(entering)
        every = every.repartition(together).sortWithinPartitions("_block", F.col("_place").asc_nulls_last(), *order)
        return cut_lineage(every.mapInPandas(_replay(cap, columns), schema))

    def digests(logs: DataFrame) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct("_place", *columns)))  # at most cap of them
        return cut_lineage(logs.groupBy("_block").agg(F.sha2(F.to_json(rows), 256).alias("_digest")))

    alone = run(dealt, None)
    firsts = dealt.groupBy("_block", "id").agg(F.min(F.struct(*order)).alias("_at")).select("_block", "id", "_at.*")
    firsts = firsts.withColumn("_place", F.row_number().over(beside).cast("long")).filter(F.col("_place") <= cap + 1)
    told = firsts.withColumn("_kind", F.lit(0)).unionByName(alone.withColumn("_kind", F.lit(1)))
    told = told.repartition(1).sortWithinPartitions("_block", "_kind", "_place")
    entering = cut_lineage(told.select("_block", "_kind", *columns).mapInPandas(_guess(cap, columns), schema))
    used, left = digests(entering), run(dealt, entering)
    while True:
        entering = left.join(followed, "_block").filter("_next IS NOT NULL").drop("_block").withColumnRenamed("_next", "_block")
        entering = cut_lineage(entering)
        now = digests(entering)
        changed = cut_lineage(now.join(used, ["_block", "_digest"], "left_anti").select("_block"))
        if changed.isEmpty():
            break
        again = run(dealt.join(changed, "_block", "left_semi"), entering.join(changed, "_block", "left_semi"))
        left = cut_lineage(left.join(changed, "_block", "left_anti").unionByName(again))
        used = now
    return left.join(followed.filter("_next IS NULL"), "_block").select(*columns)


def _safe_start(marked: list, cap: int):
    """Newest position from which ``cap`` first deliveries follow in a row.

    After such a run the log holds exactly those rows, whatever came before.
    ``marked`` is newest first.
    """
    run = 0
    for seq, is_first in marked:
        run = run + 1 if is_first else 0
        if run == cap:
            return seq
    return None


def incident_log(flagged: DataFrame, order: str | Sequence[str], cap: int = C.INCIDENT_CAP, probe: int = 50, block_rows: int = 1_000_000) -> DataFrame:
    """Final log after delivering the rows in order (``id`` and the ``order`` columns).

    An id evicted from the log may enter again, so deliveries are replayed in
    order. Only the newest stretch matters: the newest ``probe * cap`` rows are
    searched for a run of first deliveries, which fixes the log on its own. If
    repeats are so dense that no run exists, all rows are replayed, in blocks.
    """
    order = [order] if isinstance(order, str) else list(order)
    ids = cut_lineage(flagged.select("id", *order))
    at = F.struct(*order)
    tail = ids.orderBy(*[F.desc(c) for c in order]).limit(probe * cap)
    firsts = ids.join(tail.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(at).alias("_first"))
    marked = tail.join(firsts, "id").select(*order, (at == F.col("_first")).alias("is_first"))
    start = _safe_start(sorted(((tuple(r)[:-1], r[-1]) for r in marked.collect()), reverse=True), cap)
    since = None if start is None else F.struct(*[F.lit(v).cast(ids.schema[c].dataType) for c, v in zip(order, start, strict=True)])
    rows = ids if since is None else ids.filter(at >= since)
    kept = replayed(rows, order, cap, block_rows)
    return flagged.join(kept, ["id", *order])


def merge_into_log(log: DataFrame, batch: DataFrame, order: str, cap: int = C.INCIDENT_CAP) -> DataFrame:
    """Log after one more batch, in order of processing.

    Stored rows come first, whatever their ``order``: ``delivery`` numbers the
    batches, and rows of a batch follow ``order``.
    """
    stored = log if "delivery" in log.columns else log.withColumn("delivery", F.lit(0).cast("bigint"))
    number = stored.agg(F.coalesce(F.max("delivery"), F.lit(0)) + 1).first()[0]
    both = stored.unionByName(batch.withColumn("delivery", F.lit(number).cast("bigint")), allowMissingColumns=True)
    return incident_log(both, ["delivery", order], cap)


def counters(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "high").alias("high"))


def running_spend(calls: DataFrame, day: str, stretch: Sequence[str], order: Sequence[str], usd: str, cap: float) -> DataFrame:
    """Calls made before the running total reaches the cap, with ``spent_before``.

    Only the totals of days meet in one window. Days that start at or above the
    cap drop out whole; in the others, ``stretch`` (leading columns of the order)
    cuts a day into pieces whose totals carry the sum on.
    """
    stretch = list(stretch)
    days = calls.groupBy(day).agg(F.sum(usd).alias("_t"))
    before = W.orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    open_days = days.select(day, F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_day")).filter(F.col("_day") < F.lit(cap))
    left = calls.join(open_days, day)
    earlier = W.partitionBy(day).orderBy(*stretch).rowsBetween(W.unboundedPreceding, -1)
    totals = left.groupBy(day, *stretch).agg(F.sum(usd).alias("_t"))
    base = totals.select(day, *stretch, F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_base"))
    inside = W.partitionBy(day, *stretch).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    spent = left.join(base, [day, *stretch]).withColumn(
        "spent_before", F.col("_day") + F.col("_base") + F.coalesce(F.sum(usd).over(inside), F.lit(0.0))
    )
    return spent.filter(F.col("spent_before") < F.lit(cap)).drop("_base", "_day")
