"""Near copies by exact Jaccard similarity of the sets of word shingles.

Candidates come from MinHash bands: two sets of similarity J agree in a band of `rows` minima with probability
J**rows, so with 20 bands of 4 a pair at 0.8 is missed as a candidate with probability 3e-5, and one above with less.
SimHash cannot give them: at 0.8 some 10 of 64 bits differ, beyond what its grid can search. Each candidate pair is
then decided by the exact similarity of both sets. Only distinct sets take part: equal sets are one node.

A bucket of at most `crowd` sets forms all pairs. In a larger one each set first meets the least set and its `near`
followers in the order of the next bands. Where that leaves a crowded bucket in several components, all pairs of its
sets that lie in different components and can be similar follow (`across`): two sets at J or more have a common
shingle among the first of each in any fixed order, about (1 - J) / (1 + J) of the smaller and 1 - J of the larger set,
and rare shingles come first in it, so that sets which share no more than a passage hardly meet. What is left out are
pairs that are linked already or proven dissimilar. Sets that nearly reach J with many others are compared with all of
them, which is quadratic; pairs are then decided in growing shares, between which what has been linked leaves.

Defined results: words are those of `simhash`; a text with fewer words than a shingle is one shingle, one without
words the empty set, which equals itself; repeated rows get the same component; a null doc_id is in its component
but never names it, unless it has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyspark.llm.common import keep, running
from parleyspark.llm.graph import components

SEED = 42
#: Shingles whose minima are taken at once.
PIECE = 1 << 13
#: Counts of shingles are kept by the first SLOTS bits of their hash.
SLOTS = 20
#: Sets of a shingle that one task holds against all others of it, and pairs for each set that are decided at once.
GROUP, SHARE = 256, 64
#: Allows for rounding in bounds.
LITTLE = 1e-6


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of all shingles of words; none without a word."""
    found = text.lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(found)}
    hashes = np.array([known[w] for w in found], np.uint64)
    k = min(shingle, len(found))
    out = np.zeros(len(found) - k + 1, np.uint64)
    for at in range(k):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[at : at + len(out)])
    return np.unique(out)


def band_hashes(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of `rows` minima; for the empty set those of no shingle."""
    draw = np.random.default_rng(SEED).integers(0, 1 << 64, (2, bands * rows), np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PIECE):
        made = (hashes[at : at + PIECE, None] ^ draw[0]) * (draw[1] | np.uint64(1))
        least = np.minimum(least, made.min(0))
    out = np.arange(bands, dtype=np.uint64)
    for minima in least.reshape(bands, rows).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + minima)
    return out


def marked(docs: DataFrame, shingle: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, node, bands, hashes): the set of each whole text, its hash and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(x.as_py(), shingle) for x in pc.fill_null(part.column(1).cast(pa.large_binary()), b"")]
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                made = [band_hashes(x, bands, rows).view(np.int64) for x in sets]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes), pa.array(made, longs), pa.array([x.view(np.int64) for x in sets], longs)], ["doc_id", "node", "bands", "hashes"])

    each = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return each.mapInArrow(run, f"doc_id {each.schema['doc_id'].dataType.simpleString()}, node bigint, bands array<bigint>, hashes array<bigint>")


def candidates(nodes: DataFrame, crowd: int, near: int) -> tuple[DataFrame, DataFrame | None]:
    """(a, b), a < b: nodes (node, bands) to compare; (bucket, node) of buckets whose pairs are not all among them, if there are any."""
    after = lambda k: F.get("bands", F.pmod(F.col("at") + k, F.size("bands")))
    each = nodes.select("node", "bands", F.posexplode("bands").alias("at", "bucket")).select("node", "bucket", after(1).alias("o1"), after(2).alias("o2"))
    met = keep(each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
    entries = keep(each.join(met, "bucket"))
    few = entries.where(F.col("n") <= crowd).select("bucket", "node")
    pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "bucket").where("a < b").select("a", "b")
    if met.where(F.col("n") > crowd).isEmpty():
        return keep(pairs.distinct()), None
    many = keep(running(entries.where(F.col("n") > crowd).select("bucket", "node", "least", "o1", "o2"), ["bucket"], ["o1", "o2", "node"]))
    stars = many.where("least <> node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    later = many.select("bucket", F.col("before").alias("place"), F.col("node").alias("b"))
    follow = many.select("bucket", F.col("node").alias("a"), F.explode(F.sequence(F.col("before") + 1, F.col("before") + near)).alias("place"))
    beside = follow.join(later, ["bucket", "place"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return keep(pairs.unionByName(stars).unionByName(beside).distinct()), many.select("bucket", "node")


def frequent(sets: DataFrame, over: int) -> np.ndarray:
    """How often the shingles of each slot stand in the sets (hashes); 0 for slots with `over` or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, n = np.unique(_slots(batch.column(0).flatten().to_numpy(zero_copy_only=False)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(n, pa.int64())], ["slot", "n"])

    found = sets.select("hashes").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > over).toArrow()
    out = np.zeros(1 << SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - SLOTS)).astype(np.int64)


def first_shingles(sets: DataFrame, least: float, often: np.ndarray) -> DataFrame:
    """(shingle, node, component, n, place, early): the first shingles of each set (node, component, hashes) of n, rare ones first.

    Two sets at `least` or more have a common one, which is early in the smaller set: their first common shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = np.diff(part.column(2).offsets.to_numpy())
                flat, row = part.column(2).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
                flat = flat[np.lexsort((flat, often[_slots(flat)], row))]
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = place <= np.repeat(sizes - np.ceil(least * sizes - LITTLE), sizes)
                early = place <= np.repeat(sizes - np.ceil(2 * least / (1 + least) * sizes - LITTLE), sizes)
                at_row = pa.array(row[first])
                longs = (pa.array(x[first].astype(np.int64)) for x in (sizes[row], place))
                yield pa.RecordBatch.from_arrays([pa.array(flat[first]), part.column(0).take(at_row), part.column(1).take(at_row), *longs, pa.array(early[first])], ["shingle", "node", "component", "n", "place", "early"])

    return sets.select("node", "component", "hashes").mapInArrow(run, "shingle bigint, node bigint, component bigint, n bigint, place bigint, early boolean")


def across(sets: DataFrame, least: float, crowd: int) -> DataFrame:
    """(a, b): pairs of sets (node, component, hashes) of different components, all those with similarity `least` or more among them."""
    entries = keep(first_shingles(sets, least, frequent(sets, crowd)))
    met = entries.groupBy("shingle").agg(F.count_if("early").alias("count"), F.min("component").alias("x"), F.max("component").alias("y"))
    met = keep(met.where("count > 0 and x <> y").select("shingle", F.ceil(F.col("count") / GROUP).cast("int").alias("groups")))
    held = keep(entries.join(met, "shingle"))
    part = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
    small = held.where("early").select("shingle", part.alias("part"), *[F.col(c).alias(f"{c}_a") for c in ("node", "component", "n", "place")])
    large = held.select("shingle", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "place")])
    sized = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b"))
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    enough = (F.col("n_a") + LITTLE >= least * F.col("n_b")) & ((1 + least) * left + LITTLE >= least * (F.col("n_a") + F.col("n_b")))
    found = small.join(large, ["shingle", "part"]).where((F.col("component_a") != F.col("component_b")) & sized & enough)
    return keep(found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of sets (node, hashes) whose similarity is `least` or more."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return keep(both.where(F.col("common") >= F.lit(least) * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b"))


def crowded_links(many: DataFrame, sets: DataFrame, links: DataFrame, least: float, crowd: int) -> DataFrame:
    """links and those between sets of crowded buckets (bucket, node) that they leave in several components."""
    roots = keep(components(links))
    placed = many.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("component"))
    parted = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    parted = keep(placed.join(parted, "bucket", "left_semi").select("node", "component").distinct())
    if not (size := parted.count()):
        return links
    parted = keep(sets.select("node", "hashes").join(parted, "node"))
    pairs = across(parted, least, crowd)
    share = min(1.0, SHARE * size / max(1, pairs.count()))
    while True:
        now = pairs.where(F.rand(SEED) < share) if share < 1 else pairs
        now = keep(now)
        links = links.unionByName(similar(now, parted, least))
        if share >= 1:
            return links
        roots = keep(components(links))
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
        left = pairs.join(now, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        pairs, share = keep(left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")), min(1.0, 2 * share)


def near_copies(
    docs: DataFrame, shingle: int = 5, least: float = 0.8, bands: int = 20, rows: int = 4, crowd: int = 64, near: int = 16, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, component_id): documents whose sets have Jaccard similarity `least` or more are linked.

    component_id is the smallest doc_id reachable over links, itself included.
    """
    found = keep(marked(docs, shingle, bands, rows, doc_id, text))
    nodes = keep(found.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")))
    pairs, many = candidates(nodes.select("node", "bands"), crowd, near)
    named = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = keep(found.select("node", "hashes").join(named, "node", "left_semi").dropDuplicates(["node"]))
    links = similar(pairs, sets, least)
    if many is not None:
        links = crowded_links(many, sets, links, least, crowd)
    roots = keep(components(links))
    names = roots.join(nodes, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    classes = nodes.join(roots.join(names, "root").select("node", "component_id"), "node", "left")
    classes = keep(classes.select("node", F.coalesce("component_id", "first").alias("component_id")))
    return found.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")
