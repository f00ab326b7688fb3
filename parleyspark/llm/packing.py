"""Packing token sequences: bounded-space online best-fit.

A packer holds at most `open_bins` open bins. A bitset has a bit for every amount of free space that some open
bin has, so the bin that a piece fills best is the lowest set bit at or above the piece's length. If none has
room and all places are taken, the fullest open bin closes first. Every task packs the pieces of its input
partition, in their order; bins still open at its end are pieces of the next round, which few tasks pack in
the same way, until one task's worth is left. So memory is bounded in every task, and only the last round's
open bins stay partly empty.

Documents longer than a sequence are cut into full pieces, after a first piece with what is over.

Pieces carry their ids; (sequence_id, offset) tells pieces apart, also those of repeated rows. `sequences` joins
the ids of each sequence, and `write_sequences` writes them.

Defined results: a null or empty text is the final id alone; repeated rows are packed one by one; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyspark.llm.common import keep


@dataclass(frozen=True)
class Tokens:
    """A tokenizer file with the pattern that splits texts and the special string (both for .tiktoken files).

    whole: the .json file of the same vocabulary, for texts that the pattern cannot take.
    """

    path: str
    pattern: str = ""
    special: str = "<|endoftext|>"
    special_id: int = 50256
    whole: str = ""


class Bins:
    """Open bins by free space; items get (bin, offset). A new bin's number is the count of bins so far."""

    def __init__(self, room: int, open_bins: int):
        self.room, self.most = room, open_bins
        self.bits, self.by_free, self.count, self.open = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        return found

    def _put(self, number: int, free: int) -> None:
        stack = self.by_free.setdefault(free, [])
        if not stack:
            self.bits |= 1 << free
        stack.append(number)

    def add(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.open -= 1
            number, free = self.count, self.room
            self.count, self.open = self.count + 1, self.open + 1
        if free > length:
            self._put(number, free - length)
        else:
            self.open -= 1  # full
        return number, self.room - free

    def left(self) -> dict[int, int]:
        """Open bins with what they hold."""
        return {n: self.room - free for free, stack in self.by_free.items() for n in stack}


def cut(length: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, after a first one with what is over."""
    first = length % room
    starts = [0] * bool(first) + list(range(first, length, room))
    return [(a, (first if a == 0 and first else room)) for a in starts]


#: White space in a row beyond which the pattern of a .tiktoken file, which steps back through it, may end the process.
LONG_SPACE = 100_000


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str, special: str, special_id: int, whole: str = "") -> Callable[[str], bytes]:
    """Little-endian 32-bit ids of a whole text, by a tokenizer file.

    A .json file is read by tokenizers. A .tiktoken file holds the ranks of the same kind of vocabulary; with
    the pattern that splits its texts, tiktoken gives the same ids in a third of the time. The special string
    is one id in either. Texts with LONG_SPACE white space in a row are left to tokenizers.
    """
    if not path.endswith(".tiktoken"):
        from tokenizers import Tokenizer

        all_of = Tokenizer.from_file(path)
        return lambda text: np.array(all_of.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    between = np.array([special_id], "<u4").tobytes()
    ids = lambda text: np.array(plain.encode_ordinary(text), "<u4").tobytes()
    quick = lambda text: between.join(map(ids, text.split(special))) if special in text else ids(text)
    return lambda text: encoder(whole, "", "", 0)(text) if len(text) > LONG_SPACE and long_space(text) else quick(text)


def long_space(text: str) -> bool:
    """Whether white space of any kind stands more than LONG_SPACE in a row; such a row covers a multiple of LONG_SPACE."""
    for at in range(0, len(text), LONG_SPACE):
        before, after = text[max(at - LONG_SPACE, 0) : at], text[at : at + LONG_SPACE]
        if len(before) - len(before.rstrip()) + len(after) - len(after.lstrip()) > LONG_SPACE:
            return True
    return len(text) > LONG_SPACE and text[:LONG_SPACE].isspace()


def _pieces(rows: DataFrame, tokenizer: Tokens, room: int, open_bins: int, final: int) -> DataFrame:
    """First round: encode, cut and pack each partition. `held` is what an open bin holds at the end, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bins = TaskContext.get().partitionId(), Bins(room, open_bins)
        encode = encoder(tokenizer.path, tokenizer.pattern, tokenizer.special, tokenizer.special_id, tokenizer.whole)
        end = np.array([final], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, len(ids), 64):
                out = []
                for k, text in enumerate(batch.column(1).slice(at, 64)):
                    data = encode(text.as_py() or "") + end
                    for piece, (start, length) in enumerate(cut(len(data) // 4, room)):
                        out.append((at + k, piece, start, length, data[4 * start : 4 * (start + length)], *bins.add(length)))
                cols = list(zip(*out, strict=True))
                made = [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:4]], pa.array(cols[4], pa.binary())]
                made += [pa.array(np.array(cols[5], np.int64) + (task << 40)), pa.array(cols[6], pa.int64()), pa.nulls(len(out), pa.int64())]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids", "bin", "offset", "held"])
        left = bins.left()
        n = len(left)
        ends = [pa.nulls(n, ids_type), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 2, pa.nulls(n, pa.binary()), pa.array([(task << 40) + b for b in left], pa.int64()), pa.nulls(n, pa.int64()), pa.array(list(left.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(ends, ["doc_id", "piece", "start", "length", "ids", "bin", "offset", "held"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["doc_id"].dataType
    ids_type = to_arrow_type(kind)
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids binary, bin bigint, offset bigint, held bigint")


def _merge(open_rows: DataFrame, room: int, open_bins: int, tasks: int, level: int) -> DataFrame:
    """Later round: (bin, into, shift, held) for open bins (bin, held); rows without a bin tell what is open at the end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, bins = TaskContext.get().partitionId(), Bins(room, open_bins)
        base = (task << 40) + (level << 34)
        for frame in frames:
            placed = [bins.add(int(x)) for x in frame["held"]]
            yield pd.DataFrame({"bin": frame["bin"].astype("Int64"), "into": [base + b for b, _ in placed], "shift": [o for _, o in placed], "held": pd.array([None] * len(frame), "Int64")})
        left = bins.left()
        yield pd.DataFrame({"bin": pd.array([None] * len(left), "Int64"), "into": [base + b for b in left], "shift": [0] * len(left), "held": pd.array(list(left.values()), "Int64")})

    # longest first: best-fit loses least in that order
    dealt = open_rows.repartition(tasks, F.xxhash64("bin")).sortWithinPartitions(F.desc("held"), "bin")
    return dealt.mapInPandas(run, "bin bigint, into bigint, shift bigint, held bigint")


def pack(docs: DataFrame, tokenizer: Tokens, room: int = 2048, open_bins: int = 256, final: int = 0, per_task: int = 16_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of each piece; ids are little-endian 32-bit numbers.

    final: the id after each document. per_task: open bins that one task of a later round packs.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = keep(_pieces(rows, tokenizer, room, open_bins, final))
    pieces = made.where("held is null").withColumns({"sequence_id": F.col("bin"), "shift": F.lit(0).cast("long")})
    left, level, moves = made.where("held is not null").select("bin", "held"), 0, None
    while (n := left.count()) > 0:
        tasks, level = -(-n // per_task), level + 1
        found = keep(_merge(left, room, open_bins if tasks > 1 else n, tasks, level))
        step = found.where("held is null").select("bin", "into", "shift")
        if moves is None:
            moves = step
        else:  # bins that moved before move on with the bin they are in
            on = step.select(F.col("bin").alias("into"), F.col("into").alias("_next"), F.col("shift").alias("_more"))
            moves = keep(moves.join(on, "into", "left").select("bin", F.coalesce("_next", "into").alias("into"), (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift")))
        if tasks == 1:
            break
        left = found.where("held is not null").select(F.col("into").alias("bin"), "held")
    if moves is not None:
        pieces = pieces.drop("shift").join(moves, "bin", "left").withColumns({"sequence_id": F.coalesce("into", "bin"), "shift": F.coalesce("shift", F.lit(0))})
    return pieces.select("doc_id", "piece", "start", "length", "ids", "sequence_id", (F.col("offset") + F.col("shift")).alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces) of each sequence: all its ids, and what they are of by offset.

    pieces: a result of pack(), which is written first, as its sequences are dealt anew.
    """
    kind = pieces.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []

        def made() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x.pop("ids") for x in parts), "<u4").astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([parts], pa.list_(inner))], ["sequence_id", "ids", "pieces"])

        for batch in batches:
            for row in batch.to_pylist():
                if parts and row["sequence_id"] != held:
                    yield made()
                    parts = []
                held = row.pop("sequence_id")
                parts.append(row)
        if parts:
            yield made()

    from pyspark.sql.pandas.types import to_arrow_type

    inner = pa.struct([("doc_id", to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())])
    dealt = pieces.select("sequence_id", "doc_id", "piece", "start", "length", "offset", "ids")
    dealt = dealt.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return dealt.mapInArrow(run, f"sequence_id bigint, ids array<int>, pieces array<struct<doc_id: {kind.simpleString()}, piece: int, start: bigint, length: bigint, offset: bigint>>")


def write_sequences(pieces: DataFrame, path: str) -> None:
    """Write sequences(pieces) as Parquet."""
    sequences(pieces).write.parquet(path)
