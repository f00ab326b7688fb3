"""Word n-grams of a row's texts, counted in Arrow batches inside the row: only counts and matches leave it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose n-grams are counted at once, and words of such rows where they leave as rows of a table.
SLICE, WORDS = 512, 1 << 16
#: Hashes of n-grams are numbers below this prime; masks of them have at most 2**MOST_BITS bits.
PRIME, MOST_BITS = 2147483629, 27
RECORD = pa.struct([("n", pa.int32()), ("k", pa.int32()), ("gram", pa.string()), ("ch", pa.int64()), ("cr", pa.int64())])
RECORDS = "array<struct<n:int,k:int,gram:string,ch:bigint,cr:bigint>>"


@dataclass
class Sides:
    """Words of some rows as numbers, in runs: the hypothesis (k = -1) or reference k of a row."""

    codes: np.ndarray
    words: pa.Array
    run: np.ndarray
    row: np.ndarray
    k: np.ndarray

    @staticmethod
    def of(hyp: pa.Array | None, refs: pa.Array) -> Sides:
        lists = refs.values.slice(refs.offsets[0].as_py(), refs.offsets[-1].as_py() - refs.offsets[0].as_py())
        per_row = np.diff(refs.offsets.to_numpy())
        row = np.repeat(np.arange(len(refs)), per_row)
        k = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        sides = [lists]
        if hyp is not None:
            sides.insert(0, hyp)
            row, k = np.concatenate([np.arange(len(hyp)), row]), np.concatenate([np.full(len(hyp), -1), k])
        coded = pc.dictionary_encode(pa.chunked_array([x.flatten() for x in sides]), null_encoding="encode").combine_chunks()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        lengths = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in sides]).astype(np.int64)
        return Sides(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.repeat(np.arange(len(row)), lengths), row, k)

    def grams(self, orders: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, begins, ids, first begin of each id): n-grams that lie in one run; equal ones of one row have one id."""
        if not len(self.codes):
            return
        size, ids = len(self.words), self.row[self.run]
        for n in range(1, orders + 1):
            begins = np.flatnonzero(self.run[: len(self.run) - n + 1] == self.run[n - 1 :])
            if not len(begins):
                return
            _, first, dense = np.unique(ids[begins] * size + self.codes[begins + n - 1], return_index=True, return_inverse=True)
            ids = np.full(len(self.codes), -1)
            ids[begins] = dense
            yield n, begins, dense, begins[first]

    def counts(self, begins: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Count of each id in the hypothesis; (id, k, count) in the references."""
        k, size = self.k[self.run[begins]], int(ids.max()) + 1
        width = int(self.k.max()) + 1
        pairs, c = np.unique((ids * width + k)[k >= 0], return_counts=True)
        return np.bincount(ids[k < 0], minlength=size), pairs // max(width, 1), pairs % max(width, 1), c

    def texts(self, begins: np.ndarray, n: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.codes[begins + i])).cast(pa.string()) for i in range(n)]
        return pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word, with a space before it: its UTF-8 bytes as a number, and 256 to their count."""
        own = [b" " + (w or "").encode() for w in self.words.to_pylist()]
        return np.array([int.from_bytes(w, "big") % PRIME for w in own], np.int64), np.array([pow(256, len(w), PRIME) for w in own], np.int64)


def _slices(n: int) -> Iterator[int]:
    return iter(range(0, n, SLICE))


def _nested(rows: list[np.ndarray], parts: list[pa.Array], n_rows: int) -> pa.Array:
    """Records listed by row."""
    if not rows:
        return pa.array([[]] * n_rows, pa.list_(RECORD))
    at = np.concatenate(rows)
    order = np.argsort(at, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n_rows))])
    whole = pa.concat_arrays(parts).take(pa.array(order))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), whole)


def _records(n: int, k: np.ndarray, texts: pa.Array, ch: np.ndarray, cr: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.full(len(k), n), pa.int32()), pa.array(k, pa.int32()), texts, pa.array(ch, pa.int64()), pa.array(cr, pa.int64())], fields=list(RECORD))


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def clipped(hyp: Column, refs: Column, orders: int) -> Column:
    """[m1, t1, m2, t2, ...]: matched and total n-grams of the hypothesis, clipped by the best reference. Nulls have none."""

    @F.arrow_udf("array<bigint>")
    def run(h: pa.Array, r: pa.Array) -> pa.Array:
        out = np.zeros((len(h), 2 * orders), np.int64)
        for at in _slices(len(h)):
            sides, part = Sides.of(h.slice(at, SLICE), r.slice(at, SLICE)), out[at : at + SLICE]
            for n, begins, ids, first in sides.grams(orders):
                ch, gram, _, c = sides.counts(begins, ids)
                best, row = np.zeros(len(ch), np.int64), sides.row[sides.run[first]]
                np.maximum.at(best, gram, c)
                for i, x in enumerate((np.minimum(ch, best), ch)):
                    part[:, 2 * n - 2 + i] = np.bincount(row, weights=x, minlength=len(part)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * 2 * orders, pa.int32()), pa.array(out.reshape(-1)))

    return run(hyp, refs)


def _matches(h: pa.Array, r: pa.Array, orders: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(rows, records): by order, the n-grams that the hypothesis and a reference of some rows both have."""
    sides = Sides.of(h, r)
    for n, begins, ids, first in sides.grams(orders):
        ch, gram, k, c = sides.counts(begins, ids)
        met = ch[gram] > 0
        gram, k, c = gram[met], k[met], c[met]
        yield sides.row[sides.run[first[gram]]], _records(n, k, sides.texts(first[gram], n), ch[gram], c)


def _masked(r: pa.Array, orders: int, held: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(rows, records): by order, the n-grams of the references of some rows whose bit is set."""
    sides = Sides.of(None, r)
    if not len(sides.codes):
        return
    value, power = sides.hashes()
    hashed = np.zeros(len(sides.codes), np.int64)
    for n, begins, ids, first in sides.grams(orders):
        last = sides.codes[begins + n - 1]
        hashed[begins] = (hashed[begins] * power[last] + value[last]) % PRIME
        place = _place(hashed[first], len(held).bit_length() + 2)
        found = np.flatnonzero(held[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
        c = np.bincount(ids)[found]
        yield sides.row[sides.run[first[found]]], _records(n, np.zeros(len(c), np.int64), sides.texts(first[found], n), c, c)


def _listed(n_rows: int, found) -> pa.Array:
    """Records of found(at, number of rows), slice by slice, listed by row."""
    rows, parts = [], []
    for at in _slices(n_rows):
        for row, records in found(at, SLICE):
            rows.append(at + row)
            parts.append(records)
    return _nested(rows, parts, n_rows)


def matches(hyp: Column, refs: Column, orders: int) -> Column:
    """Records (n, k, gram, ch, cr) of the n-grams that the hypothesis and reference k both have."""

    @F.arrow_udf(RECORDS)
    def run(h: pa.Array, r: pa.Array) -> pa.Array:
        return _listed(len(h), lambda at, size: _matches(h.slice(at, size), r.slice(at, size), orders))

    return run(hyp, refs)


def _stretches(*sides: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of stretches with at most WORDS words, or one row, and at most SLICE rows."""
    counts = np.zeros(len(sides[0]), np.int64)
    for x in sides:
        if pa.types.is_list(x.type.value_type):
            counts += np.diff(x.values.offsets.to_numpy()[x.offsets.to_numpy()])
        else:
            counts += np.diff(x.offsets.to_numpy())
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, side="right"))
        size = min(max(most - at, 1), SLICE)
        yield at, size
        at += size


def _as_rows(df: DataFrame, found) -> DataFrame:
    """Records of found(hypotheses, references) as rows (_key, n, k, gram, ch, cr) of df (_key, sides).

    They leave in batches of a stretch and an order, so a worker holds few of them however many rows a batch has.
    """
    key = df.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, *sides = batch.columns
            for at, size in _stretches(*sides):
                for row, records in found(*[x.slice(at, size) for x in sides]):
                    if len(row):
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at + row)), *records.flatten()], ["_key", "n", "k", "gram", "ch", "cr"])

    return df.mapInArrow(run, f"_key {key}, n int, k int, gram string, ch bigint, cr bigint")


def match_rows(df: DataFrame, key: str, hyp: Column, refs: Column, orders: int) -> DataFrame:
    """(_key, n, k, gram, ch, cr): `matches` as rows."""
    return _as_rows(df.select(F.col(key).alias("_key"), hyp.alias("h"), refs.alias("r")), lambda h, r: _matches(h, r, orders))


def masked_rows(df: DataFrame, refs: Column, orders: int, held: np.ndarray) -> DataFrame:
    """(_key, n, k, gram, ch, cr): `masked` as rows; _key is null."""
    return _as_rows(df.select(F.lit(None).cast("int").alias("_key"), refs.alias("r")), lambda r: _masked(r, orders, held))


def mask(grams: DataFrame, gram: str) -> np.ndarray:
    """A bit for each hash that an n-gram of the table has. Its size follows the rows up to a bound; a text's hash is that of its bytes."""
    bits = min(max(16 * grams.count(), 1 << 16).bit_length(), MOST_BITS)

    @F.pandas_udf("bigint")
    def place(texts: pd.Series) -> pd.Series:
        return pd.Series(_place(np.array([int.from_bytes(b" " + t.encode(), "big") % PRIME for t in texts], np.int64), bits))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << 15, np.uint8)
        held[frame["at"].to_numpy() & 32767] = 1
        return pd.DataFrame({"block": [int(frame["at"].iloc[0]) >> 15], "held": [np.packbits(held).tobytes()]})

    at = grams.select(place(F.col(gram)).alias("at")).distinct().withColumn("block", F.shiftright("at", 15))
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in at.groupBy("block").applyInPandas(block, "block bigint, held binary").toLocalIterator():
        out[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["held"], np.uint8)
    return out


def masked(refs: Column, orders: int, held: np.ndarray) -> Column:
    """Records (n, k, gram, null, count) of the references' n-grams whose bit is set, equal ones of a row counted together."""

    @F.arrow_udf(RECORDS)
    def run(r: pa.Array) -> pa.Array:
        return _listed(len(r), lambda at, size: _masked(r.slice(at, size), orders, held))

    return run(refs)
