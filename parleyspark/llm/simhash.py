"""Near duplicates by SimHash fingerprints within two differing bits.

Each of sixteen 4-bit segments of a fingerprint has a bit count, which makes the fingerprint a point of a
16-dimensional grid. One differing bit moves one coordinate by one, so the Manhattan distance of two points is
at most the number of differing bits. Points within distance two have a common grid point within distance one
of both; so every fingerprint is entered at its own point and the at most 32 around it, equal entries meet in a
join, and the differing bits of those that meet are counted exactly. Only distinct fingerprints take part:
exact copies add nothing.

A grid point that more than `crowd` fingerprints enter does not form pairs. Its fingerprints go by way of
their one-bit neighbours: two fingerprints differ in two bits at most exactly if they share one, counting
themselves, and those that share one (65 at most) link to the least of them. So links between different
fingerprints are complete, in a number that follows the number of fingerprints.

Defined results: a null or empty text has no words and fingerprint zero, which links like any other; repeated
rows get the same component; a null doc_id is in its component but never names it, unless it has no other; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyspark.llm.common import keep
from parleyspark.llm.graph import components

SEED = 42
#: Differing bits at which fingerprints link; the joins below are built for this distance.
RADIUS = 2
#: Shingles whose bits are counted at once.
PIECE = 1 << 15


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the XXH64 of all shingles of words, repeats included; zero without a word."""
    found = text.lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not found:
        return 0
    joined, n = b" ".join(found), max(len(found) - shingle + 1, 1)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    ends = starts[min(shingle, len(found)) :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        digests = b"".join([xxhash.xxh64_digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + PIECE], ends[at : min(at + PIECE, n)])])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            made = [fingerprint(x.as_py(), shingle) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _expand(nodes: DataFrame, points) -> DataFrame:
    """(point, fp) for each fingerprint and each of points(array of fingerprints), an array (n, k) with a mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            made, valid = points(fps)
            again = np.repeat(fps, made.shape[1]).reshape(made.shape)
            yield pa.RecordBatch.from_arrays([pa.array(x[valid].view(np.int64)) for x in (made, again)], ["point", "fp"])

    return nodes.select("fp").mapInArrow(run, "point bigint, fp bigint")


def grid_points(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid point of each fingerprint, four bits a coordinate, and those one step away; valid: inside the grid."""
    pairs = (fps & np.uint64(0x5555555555555555)) + ((fps >> np.uint64(1)) & np.uint64(0x5555555555555555))
    counts = (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))
    made, valid = [counts], [np.ones(len(fps), bool)]
    for k in range(16):
        at = (counts >> np.uint64(4 * k)) & np.uint64(15)
        made += [counts + np.uint64(1 << 4 * k), counts - np.uint64(1 << 4 * k)]
        valid += [at < 4, at > 0]
    return np.stack(made, 1), np.stack(valid, 1)


def bit_neighbours(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint and the 64 that differ from it in one bit."""
    masks = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    made = fps[:, None] ^ masks[None, :]
    return made, np.ones(made.shape, bool)


def fingerprint_links(nodes: DataFrame, crowd: int = 32) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to join every pair within RADIUS bits."""
    met = keep(_expand(nodes, grid_points).groupBy("point").agg(F.count("*").alias("n")).where("n > 1"))
    entries = keep(_expand(nodes, grid_points).join(met, "point"))
    few = entries.where(F.col("n") <= crowd).drop("n")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "point").where("a < b")
    close = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b").distinct()
    many = keep(entries.where(F.col("n") > crowd).select("fp").distinct())
    stars = _expand(many, bit_neighbours)
    least = keep(stars.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"))
    through = stars.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return close.unionByName(through)


def near_duplicates(docs: DataFrame, shingle: int = 3, crowd: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    marked = keep(fingerprints(docs, shingle, doc_id, text))
    nodes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = keep(components(fingerprint_links(nodes, crowd)))
    named = found.join(nodes, found["node"] == nodes["fp"]).groupBy("root").agg(F.min("first").alias("component_id"))
    roots = keep(found.join(named, "root").select(F.col("node").alias("fp"), "component_id"))
    classes = keep(nodes.join(roots, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")
