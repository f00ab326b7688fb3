"""Bounded conversation windows over contacts of any size.

A contact's messages are cut into blocks by an order column. Each block gets
the few last slots of the earlier blocks as carry-in, so one busy contact is
spread over many tasks and the result is the same as one long pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.operators.recency import remembered


def _last(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), F.lit(n))


def block_summary(base: DataFrame, key: str, order: str, text: str, cols: Sequence[str], n: int) -> DataFrame:
    """Per (key, _block): text before the block and the last n slots before it.

    One pass finds the slots inside each block. The first row of a block is a
    slot only if it differs from the last text of the block before; that is
    settled on the table of blocks, where at most n + 1 slots stand for a block.
    """
    in_block = W.partitionBy(key, "_block").orderBy(order)
    before = F.lag(text).over(in_block)
    local = base.select(key, "_block", order, *cols).withColumn("_new", before.isNull() | (F.col(text) != before))
    ranked = local.withColumn(
        "_rn", F.row_number().over(W.partitionBy(key, "_block").orderBy(F.desc("_new"), F.desc(order)))
    )
    slot = F.struct(F.col(order), F.col("_block").alias("_from"), *cols)
    tails = ranked.groupBy(key, "_block").agg(
        F.sort_array(F.collect_list(F.when(F.col("_new") & (F.col("_rn") <= n + 1), slot))).alias("_tail"),
        F.min(order).alias("_start"),
        F.min_by(text, order).alias("_head"),
        F.max_by(text, order).alias("_end"),
    )
    blocks = W.partitionBy(key).orderBy("_block")
    tails = tails.withColumn("_before", F.lag("_end").over(blocks))
    repeat = F.col("_before").isNotNull() & (F.col("_head") == F.col("_before"))
    true_tail = F.filter("_tail", lambda s: ~(repeat & (s[order] == F.col("_start"))))
    tails = tails.withColumn("_tail", _last(true_tail, n))
    # frames count blocks that hold slots, so stretches of repeats cannot hide older slots
    filled = F.sum(F.when(F.size("_tail") > 0, 1).otherwise(0)).over(blocks)
    frame = W.partitionBy(key).orderBy("_filled").rangeBetween(-n, 0)
    tails = tails.withColumn("_filled", filled).withColumn("_all", F.flatten(F.collect_list("_tail").over(frame)))
    earlier = F.filter("_all", lambda s: s["_from"] < F.col("_block"))
    return tails.select(key, "_block", "_before", _last(F.sort_array(earlier), n).alias("_carry"))


def with_blocks(df: DataFrame, key: str, order: str, block_rows: int) -> DataFrame:
    """Add ``_block``: NULL for ordinary keys, else a stretch of the order column.

    Keys are counted on the map side. Only those with more than ``block_rows``
    rows are cut, into stretches of about that many, so the lookup table has at
    most rows / block_rows entries and quiet contacts cost nothing extra.
    """
    at = F.col(order).cast("double")
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    busy = sizes.filter(F.col("_n") > block_rows)
    width = (F.col("_hi") - F.col("_lo") + 1.0) / F.ceil(F.col("_n") / F.lit(block_rows))
    joined = df.join(busy, key, "left")
    return joined.withColumn("_block", F.floor((at - F.col("_lo")) / width)).drop("_n", "_lo", "_hi")


def rolling_window(
    df: DataFrame,
    key: str,
    order: str,
    text: str,
    tokens: str,
    *,
    payload: Sequence[str] = (),
    block: Column | None = None,
    block_rows: int = 65_536,
    max_slots: int = C.MAX_SLOTS,
    max_tokens: int = C.MAX_WINDOW_TOKENS,
    short_tokens: int = C.SHORT_TOKENS,
) -> DataFrame:
    """Add the kept slots after each message.

    A message equal to the one before it adds no slot. The kept slots are the
    longest suffix within both limits, never less than the newest slot.
    ``payload`` columns travel inside the slots; the order must be total per key.
    Keys above ``block_rows`` rows are cut into blocks; ``block`` states the cut.
    """
    cols = [text, tokens, *payload]
    base = with_blocks(df, key, order, block_rows) if block is None else df.withColumn("_block", block)
    in_block = W.partitionBy(key, "_block").orderBy(order)

    summary = block_summary(base.filter("_block IS NOT NULL"), key, order, text, cols, max_slots)
    base = base.join(summary.select(key, "_block", "_before"), [key, "_block"], "left")
    lagged = F.coalesce(F.lag(text).over(in_block), F.col("_before"))
    base = base.withColumn("_push", lagged.isNull() | (F.col(text) != lagged)).drop("_before")

    halo = summary.select(key, "_block", F.explode("_carry").alias("_s")).select(
        key, "_block", F.col(f"_s.{order}").alias(order), *[F.col(f"_s.{c}").alias(c) for c in cols]
    )
    halo = halo.withColumn("_push", F.lit(True)).withColumn("_halo", F.lit(True))
    rows = base.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)

    numbered = rows.withColumn("_no", F.sum(F.col("_push").cast("int")).over(in_block))
    frame = W.partitionBy(key, "_block").orderBy("_no").rangeBetween(1 - max_slots, 0)
    slot = F.struct(F.col("_no"), *cols)
    slots = F.sort_array(F.collect_list(F.when(F.col("_push"), slot)).over(frame))
    windowed = numbered.withColumn("_slots", slots).filter(~F.col("_halo"))

    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, s: acc + s[tokens])
    n = F.size("_slots")
    kept = F.filter(
        "_slots", lambda s, i: (i == n - 1) | (total(F.slice("_slots", i + 1, F.lit(max_slots))) <= max_tokens)
    )
    out = windowed.withColumn("slots", kept).withColumn("n_slots", F.size("slots").cast("bigint"))
    out = out.withColumn("window_tokens", total(F.col("slots")))
    use = (F.col("n_slots") > 1) & (F.col(tokens) < short_tokens)
    return out.withColumn("use_window", use).drop("_block", "_push", "_halo", "_no", "_slots")


def window_text(slots: Column, text: str) -> Column:
    return F.array_join(F.transform(slots, lambda s: s[text]), " ")


def fused_score(current: Column, window: Column, use_window: Column, fallback: Column | None = None) -> Column:
    """Own score, raised by the window score for short fragments; fallback if unscored."""
    score = F.when(use_window, F.greatest(current, window)).otherwise(current)
    return score if fallback is None else F.coalesce(score, fallback)


# --- recency eviction ------------------------------------------------------------
def contact_history(df: DataFrame, contact: str, seq: str, capacity: int = C.MAX_CONTACTS, block_rows: int = 500_000) -> DataFrame:
    """Whether each message still finds its contact's history under LRU eviction; ``seq`` is the order of all messages."""
    return remembered(df, contact, [seq], capacity, block_rows).select(contact, seq, "kept_history")
