"""Sharding by a tree of regions, racks and shards with weighted hash draws.

A row draws at each level: every child node has a draw, and the least one takes the row. A shard's draw is
-ln(u) / weight with u from a hash of key and shard, an exponential variable of rate weight. An inner node's
draw is the least of its shards' draws, an exponential variable whose rate is the weight of its subtree: so a
subtree takes rows in proportion to its weight, and its draw depends on nothing outside it. If one weight
rises, rows move only into that shard, from others; if it falls, only out of it. A new shard is a weight that
rises from zero. Other subtrees keep their draws and their rows.

Defined results: a null key is a key like any other; repeated rows go to one shard, with slots of their own;
a shard of weight zero takes no row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleyspark.llm.common import running, unused

#: Columns that shard_documents() adds.
ADDED = ["size", "region", "rack", "shard", "slot", "grown_shard"]


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, racks: int = 3, regions: int = 4) -> list[Leaf]:
    """Shards dealt over regions and racks in turn; one more shard leaves the places of the others as they are."""
    return [Leaf(s % regions, s // regions % racks, s) for s in range(shards)]


def _draw(key: Column, leaf: Leaf) -> Column:
    """52 bits of the hash as u in (0, 1), then an exponential draw."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{leaf.region}/{leaf.rack}/{leaf.shard}")), 12)
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(leaf.weight))


def place(key: Column, leaves: Sequence[Leaf]) -> Column:
    """Struct of region, rack and shard for a key: descend from the top, taking the least draw at each level.

    Nodes compare as structs that start with the draw, so each level is one `least` over its children.
    """
    leaves = [x for x in leaves if x.weight > 0]
    if not leaves:
        raise ValueError("no shard has a weight")

    def least(nodes: list[Column]) -> Column:
        return nodes[0] if len(nodes) == 1 else F.least(*nodes)

    regions = []
    for region in dict.fromkeys(x.region for x in leaves):
        racks = []
        for rack in dict.fromkeys(x.rack for x in leaves if x.region == region):
            own = [x for x in leaves if (x.region, x.rack) == (region, rack)]
            racks.append(least([F.struct(_draw(key, x).alias("draw"), *[F.lit(v).alias(n) for n, v in (("region", x.region), ("rack", x.rack), ("shard", x.shard))]) for x in own]))
        regions.append(least(racks))
    return least(regions).dropFields("draw")


def shard_documents(docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ADDED: size, region, rack, shard, slot and grown_shard; names are changed if taken.

    size: bytes of the text plus 8. slot: 0, 1, 2, ... inside the shard in order of key. grown_shard: the
    shard under the `grown` tree, null without one.
    """
    out = unused(docs, *ADDED)
    spot = place(F.col(key).cast("string"), leaves)
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        spot.alias("place"),
        (place(F.col(key).cast("string"), grown)["shard"] if grown else F.lit(None).cast("int")).alias("grown_shard"),
    ).select("row", "key", "crc", "size", "place.region", "place.rack", "place.shard", "grown_shard")
    done = running(rows, ["shard"], ["key", "crc"]).withColumnRenamed("before", "slot")
    return done.select("row.*", *[F.col(c).alias(n) for c, n in zip(ADDED, out, strict=True)])


def write_shards(sharded: DataFrame, path: str, region: str = "region", rack: str = "rack", shard: str = "shard", slot: str = "slot") -> None:
    """Write a result of shard_documents() as Parquet, with a folder of its own for each region, rack and shard.

    Rows lie by range of (shard, key) already, so a task writes to few shards; each file is in order of slot.
    """
    keys = [region, rack, shard]
    sharded.sortWithinPartitions(*keys, slot).write.partitionBy(*keys).parquet(path)
