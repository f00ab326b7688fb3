"""Thread assembly, cell quotas and paired comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parleyspark.functions import text as T
from parleyspark.operators.ranks import running_before
from parleyspark.operators.sampling import hash_order
from parleyspark.session import cut_lineage


def threads_from_turns(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Whole conversations as threads: the turns of a key in order, and their number.

    A thread is one value, so its size is that of the longest conversation.
    """
    return (
        turns.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_t"))
        .select(key, F.col(f"_t.{text}").alias("turns"))
        .withColumn("length", F.size("turns").cast("bigint"))
    )


def hash_ranks(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """(key, rk): place of each row, from 0, in hash order of its key. Running counts by bucket; no global sort."""
    placed = rows.select(F.col(key), hash_order(seed, F.col(key).cast("string")).alias("_h"))
    before = running_before(placed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")), [], "_h", ["n"]).select("_h", "n_before")
    tie = W.partitionBy("_h").orderBy(key)
    return placed.join(before, "_h").select(key, (F.col("n_before") + F.row_number().over(tie) - 1).alias("rk"))


def synthetic_windows(benign: DataFrame, abusive: DataFrame, key: str, seed: str) -> DataFrame:
    """(kind, example, pos, key) of benign windows and camouflage windows.

    Benign window e holds the benign rows 3e to 3e + 2 of a hash order, until fewer than three are left.
    Camouflage window k has the benign rows 2k and 2k + 1, starting over at the end, before abusive row k.
    """
    calm, bad = hash_ranks(benign, key, seed), hash_ranks(abusive, key, seed)
    n = benign.agg(F.count(F.lit(1)).alias("n")).scalar()
    shape = lambda d, kind, example, pos: d.select(F.lit(kind).alias("kind"), example.cast("bigint").alias("example"), pos.cast("bigint").alias("pos"), key)
    whole = calm.filter(F.col("rk") < F.floor(n / 3) * 3)
    out = shape(whole, "benign_window", F.floor(F.col("rk") / 3), F.col("rk") % 3)
    ends = bad.filter(n >= 2)
    slots = ends.select(F.col("rk").alias("example"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    slots = slots.withColumn("rk", (2 * F.col("example") + F.col("pos")) % n).join(calm, "rk")
    out = out.unionByName(shape(slots, "camouflage", F.col("example"), F.col("pos")))
    return out.unionByName(shape(ends, "camouflage", F.col("rk"), F.lit(2)))


def ancestor_chains(comments: DataFrame, max_hops: int) -> DataFrame:
    """Ids met when walking up from each comment, nearest first.

    ``comments`` has id and parent. Chains double in length with each join, so
    nine hops take four joins of id columns. A walk ends at the first id that
    is not a comment. Each round reads its input twice, so rounds are written
    out; otherwise the work would double every round.
    """
    chains = comments.filter(F.coalesce("parent", F.lit("")) != "").select("id", F.array("parent").alias("chain"))
    chains = cut_lineage(chains)
    length = 1
    while length < max_hops:
        nxt = chains.select(F.col("id").alias("_at"), F.col("chain").alias("_more"))
        joined = chains.join(nxt, F.element_at("chain", -1) == F.col("_at"), "left")
        longer = F.concat("chain", F.coalesce("_more", F.array().cast("array<string>")))
        chains = cut_lineage(joined.select("id", longer.alias("chain")))
        length *= 2
    return chains.select("id", F.slice("chain", 1, max_hops).alias("chain"))


def assemble_chains(comments: DataFrame, posts: DataFrame, max_hops: int = 9, max_chars: int = 900) -> DataFrame:
    """Turns of each comment: ancestors oldest first, then the comment itself.

    ``comments`` has id, parent and cleaned text; ``posts`` has id and text.
    """
    texts = comments.select("id", F.when(F.col("text") == "", "[empty]").otherwise(F.col("text")).alias("_text"))
    known = texts.unionByName(posts.filter(F.col("text") != "").select("id", F.col("text").alias("_text")))
    hops = ancestor_chains(comments, max_hops).select("id", F.posexplode("chain").alias("hop", "anc"))
    context = (
        hops.join(known.withColumnRenamed("id", "anc"), "anc")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("hop")).alias("o"), "_text"))).alias("_c"))
    )
    joined = comments.join(context, "id", "left")
    own = F.array("text")
    turns = F.when(F.col("_c").isNull(), own).otherwise(F.concat(F.col("_c._text"), own))
    return joined.withColumn("turns", F.transform(turns, lambda t: F.left(t, F.lit(max_chars)))).drop("_c")


def post_texts(parts: DataFrame, base: str, order: str, text: str) -> DataFrame:
    """Title and body of a post joined by a space."""
    return parts.groupBy(base).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_p")).select(
        F.col(base).alias("id"), F.trim(F.array_join(F.col(f"_p.{text}"), " ")).alias("text")
    )


def cell_deficits(records: DataFrame, grid: DataFrame, keys: Sequence[str], n: str, ok: Column, per_cell: int, overshoot: float) -> DataFrame:
    """Open quota per cell and the next free number."""
    have = records.groupBy(*keys).agg(F.count_if(ok).alias("accepted"), F.max(n).alias("top_n"))
    joined = grid.join(have, list(keys), "left")
    deficit = F.lit(per_cell) - F.coalesce("accepted", F.lit(0))
    need = F.ceil(deficit.cast("double") * F.lit(1.0 + overshoot)) + 2
    return joined.withColumn("deficit", deficit).filter("deficit > 0").select(
        *keys,
        F.coalesce("accepted", F.lit(0)).cast("bigint").alias("accepted"),
        F.col("deficit").cast("bigint").alias("deficit"),
        need.cast("bigint").alias("need"),
        (F.coalesce("top_n", F.lit(-1)) + 1).cast("bigint").alias("start"),
    )


def new_specs(deficits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per number still to be made, with its formatted key."""
    n = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("need") - 1))
    return deficits.select(*keys, n.alias("n")).withColumn("key", spec_key(*[F.col(k) for k in keys], F.col("n")))


def spec_key(script: Column, length: Column, label: Column, n: Column) -> Column:
    return F.format_string("%s:%d:%s:%06d", script, length, label, n)


def conditional_pair(df: DataFrame, key: str, arm: str, value: str, order: str, arms: Sequence[str]) -> DataFrame:
    """One row per key that has every arm; the last row of an arm counts.

    Conditional aggregates replace the self-join and combine on the map side.
    """
    def last(a):
        mine = F.col(arm) == a
        return F.max_by(F.when(mine, F.col(value)), F.when(mine, F.col(order))).alias(a)

    wide = df.groupBy(key).agg(*[last(a) for a in arms], *[F.count_if(F.col(arm) == a).alias(f"_n_{a}") for a in arms])
    cond = F.lit(True)
    for a in arms:
        cond = cond & (F.col(f"_n_{a}") > 0)
    return wide.filter(cond).drop(*[f"_n_{a}" for a in arms])


def marginals(df: DataFrame, fields: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """Counts per value of each field, per cell, and in total, in one shuffle."""
    named = df.select(*[F.col(f).cast("string").alias(f) for f in dict.fromkeys([*fields, *cell])])
    sets = [[f] for f in fields] + [list(cell), []]
    cols = named.columns
    agg = named.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n")
    )
    ids = {}
    for s in sets:
        gid = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s)
        ids[gid] = "+".join(s) or "total"
    grouping = F.lit(None).cast("string")
    for gid, name in ids.items():
        grouping = F.when(F.col("_gid") == gid, name).otherwise(grouping)
    return agg.select(grouping.alias("grouping"), F.concat_ws("|", *cols).alias("value"), "n")


def page(df: DataFrame, predicate: Column, order: str, page_no: int = 1, size: int = 50, most: int = 100) -> DataFrame:
    """One page of the hits in order. A size beyond ``most`` is an error."""
    if not 0 < size <= most:
        raise ValueError(f"a page has 1 to {most} rows, not {size}")
    offset = (max(page_no, 1) - 1) * size
    return df.filter(predicate).orderBy(order).offset(offset).limit(size)


def row_filter(fields: dict[str, str | None], text: str | None = None, last: str | None = None) -> Column:
    """Equality on given fields, substring in any turn, exact last turn."""
    cond = F.lit(True)
    for name, value in fields.items():
        if value is not None:
            cond = cond & (F.col(name).cast("string") == value)
    if text:
        cond = cond & F.contains(F.lower(F.array_join("turns", " ")), F.lit(text.lower()))
    if last:
        cond = cond & (F.lower(T.strip(F.element_at("turns", -1))) == last.strip().lower())
    return cond
