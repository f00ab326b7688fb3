"""Language-model scores of a Brown class-based bigram model.

P(text) is the product over its tokens (words, then one end) of P(class | previous class) * P(word | class).
The `clustered` most frequent training words get one of `classes` classes by exchange clustering: from classes
dealt by rank, rounds move words to the class that raises the likelihood of class bigrams most. Each round
counts, in Spark, the classes before and after every clustered word and the class bigrams; blocks of words then
look for moves in parallel, each against the class bigrams of the round, and the next round's likelihood tells
whether the moves made together are kept. All other words belong to classes by spelling, which need no
lookup. Transitions are smoothed with class frequencies; words of spelling classes are smoothed with half a
count each, and half a count for all unseen words.

Counts cover every training word. What lies in a task's memory is bounded: the `hot` most frequent words with
counts, and class counts of the clustered ones. Other words go through a join with the full vocabulary.

Defined results: a null or empty text is its end alone; without training rows nothing is known and classes
are uniform; rows that repeat count as often as they occur; a null doc_id is in training; an empty table gives
no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.llm.common import keep

#: Spelling classes.
SHAPES = 11
BLOCKS = 64
#: Words that a task counts before it hands counts on.
FLUSH = 400_000


@dataclass(frozen=True)
class Settings:
    clustered: int = 16_384
    classes: int = 32
    hot: int = 200_000
    rounds: int = 10
    #: Weight of class frequencies in a transition.
    prior: float = 5.0

    @property
    def size(self) -> int:
        """Classes in all: clustered, spelling, and the end."""
        return self.classes + SHAPES + 1


def shape(word: bytes) -> int:
    """Spelling class: digits, then ASCII words by length and ending, words with marks, words with other letters."""
    last = word[-1]
    if 48 <= last <= 57:
        return 0
    if word.isascii():
        if word.isalpha():
            return (1 if last in b"aeiouy" else 2) + (2 if len(word) > 8 else 0)
        return 5 if last == 46 else 6 if last == 44 else 7
    return 8 if last > 127 else 9 if 97 <= last <= 122 else 10


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in pc.fill_null(column.cast(pa.large_binary()), b""):
        yield x.as_py()


def vocabulary(rows: DataFrame) -> DataFrame:
    """(word binary, n) of all texts of rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in _texts(batch.column(0)):
                counts.update(tokens(text))
                if len(counts) > FLUSH:
                    yield made()
        yield made()

    return rows.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, limit: int) -> DataFrame:
    """At most `limit` words: all above the least count that at most so many reach. No task sends more than its share of them."""
    kinds = words.groupBy("n").agg(F.count("*").alias("kinds"))
    upto = F.sum("kinds").over(Window.orderBy(F.desc("n")))  # over the distinct counts
    least = kinds.withColumn("upto", upto).where(F.col("upto") <= limit).agg(F.min("n")).first()[0]
    return words.where(F.lit(False) if least is None else F.col("n") >= least)


class Ids(dict):
    """Word to id; a word that is not there is noted and gets the id of its spelling class."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.hot, self.rare = len(words), []

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return self.hot + shape(word)


def encode(rows: DataFrame, words) -> DataFrame:
    """rows (row, doc_id, held_out, text) with ids (32-bit numbers) and the rare words instead of the text. words: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ids(words.value)
        for batch in batches:
            ids, rare = [], []
            for text in _texts(batch.column(3)):
                ids.append(np.array(list(map(known.__getitem__, tokens(text))), np.int32).tobytes())
                rare.append(known.rare)
                known.rare = []
            made = [pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], [*batch.schema.names[:3], "ids", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "held_out", "text").mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, ids binary, rare array<binary>")


def _sequence(batch_ids: pa.Array, end: int) -> np.ndarray:
    """Ids of a batch's texts in one line, with an end before, between and after them."""
    parts = [np.array([end], np.int32)]
    for x in batch_ids:
        parts += [np.frombuffer(x.as_py(), np.int32), parts[0]]
    return np.concatenate(parts)


def neighbour_counts(coded: DataFrame, class_of: np.ndarray, s: Settings, clustered: int) -> DataFrame:
    """(block, before, after) for words dealt to blocks by id, and block -1 with the class bigrams, as 32-bit counts of each task."""
    size, end = s.size, len(class_of) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = (np.zeros(clustered * size, np.int64) for _ in range(2))
        pairs = np.zeros(size * size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                line = _sequence(batch.column(0).slice(at, 1024), end)
                c = class_of[line]
                pairs += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
                in_ = np.flatnonzero(line < clustered)
                before += np.bincount(line[in_] * size + c[in_ - 1], minlength=clustered * size)
                after += np.bincount(line[in_] * size + c[in_ + 1], minlength=clustered * size)
        rows = [(-1, pairs, pairs[:0])]
        before, after = before.reshape(clustered, size), after.reshape(clustered, size)
        rows += [(b, before[b::BLOCKS], after[b::BLOCKS]) for b in range(min(BLOCKS, clustered))]
        made = [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k].astype(np.int64 if r[0] < 0 else np.int32).tobytes() for r in rows], pa.binary()) for k in (1, 2)]]
        yield pa.RecordBatch.from_arrays(made, ["block", "before", "after"])

    return coded.where("not held_out").select("ids").mapInArrow(run, "block int, before binary, after binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """Log-likelihood of class bigrams and words given classes, up to a constant."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum())


def moves(ids: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray, pairs: np.ndarray, classes: int) -> list[tuple[int, int]]:
    """(id, class) of the words that gain by moving, one after the other. own: their classes."""
    pairs, out = pairs.astype(np.float64), []
    for k in np.argsort(-before.sum(1), kind="stable"):
        a, left, right, n = own[k], before[k].astype(np.float64), after[k].astype(np.float64), float(before[k].sum())
        if n == 0:
            continue
        pairs[a] -= right
        pairs[:, a] -= left
        np.maximum(pairs, 0, out=pairs)
        sums = pairs.sum(0)[:classes]
        rows, cols = pairs[:classes], pairs[:, :classes].T
        gain = (_xlogx(rows + right) - _xlogx(rows)).sum(1) + (_xlogx(cols + left) - _xlogx(cols)).sum(1) - 2 * (_xlogx(sums + n) - _xlogx(sums))
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-9:
            b = a
        pairs[b] += right
        pairs[:, b] += left
        if b != a:
            out.append((int(ids[k]), b))
    return out


def exchange(coded: DataFrame, class_of: np.ndarray, s: Settings, clustered: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, class bigrams) after the rounds."""
    spark = coded.sparkSession
    best, share = None, 1.0
    for k in range(s.rounds + 1):
        counts = keep(neighbour_counts(coded, class_of, s, clustered))
        pairs = np.zeros(s.size * s.size, np.int64)
        totals = counts.where("block = -1").select("before").groupBy().applyInArrow(_summed, "sums binary").collect()
        for row in totals:
            pairs += np.frombuffer(row[0], np.int64)
        pairs = pairs.reshape(s.size, s.size)
        value = likelihood(pairs)
        if best is None or value >= best[0]:
            best = (value, class_of, pairs, counts)
        else:  # moves that are good one by one were bad together: try fewer of them
            share /= 2
        if k == s.rounds or not clustered:
            break
        _, base, held, counts = best
        state = spark.sparkContext.broadcast((base, held))
        size, classes = s.size, s.classes

        def look(frame: pa.Table) -> pa.Table:
            block = frame.column("block")[0].as_py()
            base_, held_ = state.value
            ids = np.arange(block, clustered, BLOCKS)
            sums = [np.sum([np.frombuffer(x.as_py(), np.int32) for x in frame.column(c)], axis=0, dtype=np.int64).reshape(-1, size) for c in ("before", "after")]
            found = moves(ids, *sums, base_[ids], held_, classes)
            return pa.table({"id": pa.array([x for x, _ in found], pa.int32()), "class": pa.array([x for _, x in found], pa.int32())})

        # at most one row a clustered word
        found = counts.where("block >= 0").groupBy("block").applyInArrow(look, "id int, class int").toPandas()
        state.unpersist()
        draw = np.random.default_rng(k).random(clustered)[found["id"].to_numpy()]
        found = found[draw < share]
        if found.empty:
            break
        class_of = base.copy()
        class_of[found["id"].to_numpy()] = found["class"].to_numpy()
    return best[1], best[2]


def _summed(frame: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in frame.column(0)], axis=0, dtype=np.int64)
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def shape_totals(words: DataFrame, clustered: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct training words and their tokens of each spelling class, without clustered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, sums = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in clustered:
                    k = shape(word)
                    kinds[k] += 1
                    sums[k] += n
        yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(kinds), pa.array(sums)], ["shape", "kinds", "n"])

    rows = words.select("word", "n").mapInArrow(run, "shape int, kinds bigint, n bigint").groupBy("shape").agg(F.sum("kinds"), F.sum("n")).collect()
    out = np.zeros((2, SHAPES))
    for k, kinds, n in rows:
        out[:, k] = kinds, n
    return out[0], out[1]


def _scored(coded: DataFrame, model) -> DataFrame:
    """Parts of the scores that need no vocabulary join. model: a broadcast of (class_of, step, emit, base, hot).

    emit and base hold, for ids of rare words, minus the denominators; their counts are added after the join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, step, emit, base, hot = model.value
        end = len(class_of) - 1
        for batch in batches:
            out = []
            for x in batch.column(3):
                line = np.concatenate([[end], np.frombuffer(x.as_py(), np.int32), [end]])
                c = class_of[line]
                word = line[1:]
                rare = int(((word >= hot) & (word < end)).sum())
                out.append((len(word), len(word) - rare, base[word].sum(), step[c[:-1], c[1:]].sum() + emit[word].sum()))
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], [*batch.schema.names[:3], "n_tokens", "hot_known", "base_part", "score_part"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("row", "doc_id", "held_out", "ids").mapInArrow(
        run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, hot_known bigint, base_part double, score_part double"
    )


def score_documents(docs: DataFrame, held_out: Column, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row.

    Rows without held_out train the model. base_score: smoothed frequencies of single tokens. score: the
    class model. Both are log10 probabilities of the whole text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    words = keep(vocabulary(rows.where("not held_out")))
    top = most_frequent(words, s.hot).toPandas().sort_values(["n", "word"], ascending=[False, True])
    listed, counts = [bytes(w) for w in top["word"]], top["n"].to_numpy(np.float64)
    clustered = min(s.clustered, len(listed))
    shared = spark.sparkContext.broadcast(listed)
    coded = keep(encode(rows, shared))

    ends = coded.where("not held_out").count()
    kinds, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, kinds = total + ends, kinds + (ends > 0)

    # ids: hot words, then spelling classes of rare words, then the end
    shapes = np.array([shape(w) for w in listed], np.int64)
    class_of = np.concatenate([np.arange(clustered) % s.classes, s.classes + shapes[clustered:], s.classes + np.arange(SHAPES), [s.size - 1]]).astype(np.int64)
    class_of, pairs = exchange(coded, class_of, s, clustered)

    frequency = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * s.size)
    step = np.log10((pairs + s.prior * frequency) / (pairs.sum(1, keepdims=True) + s.prior))
    shape_kinds, shape_tokens = shape_totals(words, set(listed[:clustered]))
    below = shape_tokens + 0.5 * (shape_kinds + 1)
    in_class = np.bincount(class_of[:clustered], counts[:clustered], minlength=s.size)
    emit = np.concatenate([np.log10(counts[:clustered] / in_class[class_of[:clustered]]), np.log10((counts[clustered:] + 0.5) / below[shapes[clustered:]]), -np.log10(below), [0.0]])
    under = total + 0.5 * (kinds + 1)
    base = np.concatenate([np.log10((counts + 0.5) / under), np.full(SHAPES, -np.log10(under)), [np.log10((ends + 0.5) / under)]])
    model = spark.sparkContext.broadcast((class_of, step, emit, base, len(listed)))

    parts = _scored(coded, model)
    rare = coded.select("row", F.explode("rare").alias("word"))
    met = rare.join(words, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.count("n").alias("rare_known"))
    added = F.coalesce("rare_log", F.lit(0.0))
    known = F.col("hot_known") - F.lit(0 if ends else 1) + F.coalesce("rare_known", F.lit(0))
    out = parts.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_part") + added).alias("base_score"), (F.col("score_part") + added).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
