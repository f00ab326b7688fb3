"""Document fingerprints by order MinHash, whose likeness falls with edit distance.

The k-mers of a text are numbered by occurrence, so that repeats are told apart. Each of `size` random orders
selects the `chosen` least numbered k-mers; these keep their order in the text, and the hash of the tuple of k-mers
is one entry of the fingerprint. Two texts agree in an entry if they share the selected k-mers and their order, so
swapped passages lower the likeness, unlike that of sets of k-mers. The likeness of two fingerprints is their share
of equal entries.

`with_edits` also compares each document with an edited text, in which the next document's beginning replaces its
end. Rows are dealt and sorted by range of (doc_id, text hash), so one pass over each range meets a document and the
next one, and texts move once. The last row of a range waits for the first row of the next range; these rows, one
of either kind for each range, are resolved afterwards.

Defined results: a null or empty text has no k-mers, and an entry of zeros; one shorter than k is a k-mer of its
own; if a text has fewer k-mers than are chosen, all are taken. Null doc_ids come first, rows of one doc_id follow
each other by text hash, and equal rows in any order; the next of the last document is the first, of a single one
itself. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parleyspark.llm.common import keep

SEED = 42
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a k-mer's hash that give way to its position while equal k-mers are brought together.
PLACE_BITS = 24
#: K-mers that meet all orders at once.
PIECE = 1 << 12


@dataclass(frozen=True)
class Settings:
    """k: code points of a k-mer; chosen: k-mers of a tuple; size: entries of a fingerprint."""

    k: int = 8
    chosen: int = 2
    size: int = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _orders(size: int) -> np.ndarray:
    """Odd factors of 32 bits; the products of hashes' upper halves with a factor are one random order."""
    return np.random.default_rng(SEED).integers(0, 1 << 31, size, np.uint32) * np.uint32(2) + np.uint32(1)


def kmers(text: str, k: int) -> np.ndarray:
    """Hashes of all k-mers in text order, their low PLACE_BITS cleared."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    k = min(k, len(codes))
    if not k:
        return codes
    out = np.full(len(codes) - k + 1, k, np.uint64)
    for at in range(k):
        out *= STEP
        out += codes[at : at + len(out)]
    return _mixed(out) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)


def _numbered(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer, place, hash of k-mer and occurrence number) of each k-mer, in any order."""
    n, low = len(found), np.uint64((1 << PLACE_BITS) - 1)
    if n <= int(low):
        dealt = np.sort(found | np.arange(n, dtype=np.uint64))
        grams, places = dealt & ~low, (dealt & low).astype(np.int64)
    else:
        places = np.argsort(found, kind="stable")
        grams = found[places]
    first = np.zeros(n, np.int64)
    at = np.flatnonzero(grams[1:] != grams[:-1]) + 1
    first[at] = at
    occurrence = (np.arange(n) - np.maximum.accumulate(first)).astype(np.uint64)
    return grams, places, _mixed(grams + (occurrence + np.uint64(1)) * STEP)


def _least(hashes: np.ndarray, orders: np.ndarray, chosen: int) -> np.ndarray:
    """(chosen, orders) indices of the least hashes under each order; of equal products the first counts."""
    upper, every = (hashes >> np.uint64(32)).astype(np.uint32), np.arange(len(orders))
    found, values = [], []
    for at in range(0, len(upper), PIECE):
        products = orders[:, None] * upper[None, at : at + PIECE]
        for _ in range(min(chosen, products.shape[1])):
            least = products.argmin(1)
            found.append(least + at)
            values.append(products[every, least].astype(np.int64))
            products[every, least] = 0xFFFFFFFF
    if len(found) == chosen:
        return np.array(found)
    places, values, out = np.array(found), np.array(values), []
    for _ in range(chosen):
        least = values.argmin(0)
        out.append(places[least, every])
        values[least, every] = 1 << 32
    return np.array(out)


def fingerprint(text: str, s: Settings = Settings()) -> np.ndarray:
    """`size` entries of 32 bits of a whole text."""
    found = kmers(text, s.k)
    if not len(found):
        return np.zeros(s.size, np.uint32)
    grams, places, hashes = _numbered(found)
    least = _least(hashes, _orders(s.size), min(s.chosen, len(found)))
    inside = np.argsort(places[least], axis=0, kind="stable")
    out = np.zeros(s.size, np.uint64)
    for of_tuple in grams[np.take_along_axis(least, inside, 0)]:
        out = _mixed(out * STEP + of_tuple)
    return out.astype(np.uint32)


def signatures(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, signature): the fingerprint of each whole text as an array of 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py() or "", s).view(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], ["doc_id", "signature"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, signature array<int>")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two signatures, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many code points of the following one, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(text: str, own: np.ndarray, following: str, theirs: np.ndarray, s: Settings) -> list:
    """n_chars, SHA-256 of the edited text, its fingerprint, and both likenesses."""
    changed = edited(text, following)
    prints = own if changed == text else fingerprint(changed, s)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return [len(text), digest, prints.tobytes(), float(np.mean(own == prints)), float(np.mean(own == theirs))]


RESULTS = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: Columns of rows that wait: the range, and the text of its first (head) or last (tail) document.
EDGES = "part int, head string, tail string"


def with_edits(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    Fingerprints are little-endian 32-bit entries. near_edited and near_next: likeness to the edited text and to the next document.
    """
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), tie.alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    kind = dealt.schema["doc_id"].dataType
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "head", "tail"]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]

    def batch_of(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                now = (key.as_py(), value.as_py())
                prints = fingerprint(now[1], s)
                if held is None:
                    out.append([None, None, None, prints.tobytes(), None, None, None, part, now[1], None])
                else:
                    (before, own_text), own = held
                    n, digest, changed, *near = _compared(own_text, own, now[1], prints, s)
                    out.append([before, n, digest, own.tobytes(), changed, *near, None, None, None])
                held = now, prints
                if len(out) >= 1024:
                    yield batch_of(out)
                    out = []
        if held is not None:
            out.append([held[0][0], None, None, held[1].tobytes(), None, None, None, part, None, held[0][1]])
            yield batch_of(out)

    passed = keep(dealt.mapInArrow(run, f"doc_id {kind.simpleString()}, {RESULTS}, {EDGES}"))
    heads = passed.where("head is not null").select("part", F.col("fingerprint").alias("next_print"), "head")
    tails = passed.where("tail is not null").select("doc_id", "part", "fingerprint", "tail")
    # the parts are ranges, few and without texts here; the part after the last is the first
    parts = heads.select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    edges = tails.join(parts.select("part", following.alias("next")), "part")
    edges = edges.join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "tail", "fingerprint", "head", "next_print")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own_text, own, following_text, theirs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, digest, changed, *near = _compared(own_text, np.frombuffer(own, "<u4"), following_text, np.frombuffer(theirs, "<u4"), s)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([key, n, digest, own, changed, *near], types, strict=False)], names[:7])

    inner = passed.where("part is null").select(*names[:7])
    return inner.unionByName(edges.mapInArrow(resolve, f"doc_id {kind.simpleString()}, {RESULTS}"))
