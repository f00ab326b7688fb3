"""Toxicity as an ordered severity: cumulative-link regression on sparse text features.

P(severity >= k) = 1 / (1 + exp(threshold_k - w.x)) for grades 1 to 3: all thresholds share the weights w,
and the expected severity is the sum of these three. x counts, for hashed features, the distinct words of a
text that have them: the word itself, and its beginnings of 5 to 8 bytes, for words that go on beyond. A
feature's value is scaled by its log ratio of document frequencies in toxic and other training texts, zero for
features of fewer than `least` training texts, so that the fit starts from what single features tell.

Labels say toxic or not. Grades of toxic training texts are thirds by the share of their words that mark
toxicity, which are those whose features are far commoner in toxic than in other training texts.

The training sample is bounded: `sample` labelled documents at most, the first in hash order of their id, with
their features; they are fitted on the driver. Scoring reads every whole text, in tasks that hold the weights.

Defined results: a null or empty text has no features, so its severity is that of the intercepts; labels that
are null or have no document are left out, and repeated ones count as often as they occur; without training
rows severity is 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyspark.llm.common import keep

GRADES = 3
BEGINNINGS = (5, 6, 7, 8)
EDGES = b".,;:!?\"'()[]{}*#$%&|<>"
#: Words whose weight a task remembers.
MEMO = 400_000


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    sample: int = 8_000
    steps: int = 120
    rate: float = 0.05
    penalty: float = 1e-3
    #: Log ratio of document frequencies at which a feature marks toxicity; training texts that a feature needs.
    marked: float = 2.0
    least: int = 4


def features(word: bytes, bits: int) -> list[int]:
    """Hashed features of a lower-case word without punctuation at its edges."""
    found = [word, *[word[:k] + b"~" for k in BEGINNINGS if len(word) > k]]
    return [zlib.crc32(x) & ((1 << bits) - 1) for x in found]


def distinct_words(text: bytes) -> set[bytes]:
    return {w for w in {x.strip(EDGES) for x in set(text.lower().split())} if w}


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for x in pc.fill_null(column.cast(pa.large_binary()), b""):
        yield x.as_py()


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def above(self, margin: np.ndarray) -> np.ndarray:
        """(n, GRADES) of P(severity >= k)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -50, 50)))


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(toxic, features) of the sample; features as 32-bit numbers, repeated as often as they occur."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic"))
    chosen = F.broadcast(keep(chosen.orderBy(F.xxhash64("id"), "id", "toxic").limit(s.sample)))
    rows = docs.join(chosen, docs[doc_id] == chosen["id"]).select("toxic", F.col(text).alias("text"))
    bits = s.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.array([f for w in sorted(distinct_words(t)) for f in features(w, bits)], np.int32).tobytes() for t in _bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["toxic", "features"])

    return rows.mapInArrow(run, "toxic int, features binary")


def log_ratios(toxic: np.ndarray, found: list[np.ndarray], s: Settings) -> np.ndarray:
    """Log ratio of each feature's document frequencies in toxic and other texts; zero for rare features."""
    counts = np.zeros((2, 1 << s.bits))
    for t, x in zip(toxic, found, strict=True):
        counts[int(t), np.unique(x)] += 1
    n = np.bincount(toxic, minlength=2)
    ratio = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    return np.where(counts.sum(0) >= s.least, ratio, 0.0)


def grades(toxic: np.ndarray, found: list[np.ndarray], ratio: np.ndarray, s: Settings) -> np.ndarray:
    """0 for texts that are not toxic, else 1 to 3 by thirds of the share of features that mark toxicity."""
    share = np.array([(ratio[x] >= s.marked).mean() if len(x) else 0.0 for x in found])
    out = np.zeros(len(toxic), np.int64)
    if (toxic == 1).any():
        out[toxic == 1] = 1 + np.searchsorted(np.quantile(share[toxic == 1], [1 / 3, 2 / 3]), share[toxic == 1], side="right")
    return out


def fit(toxic: np.ndarray, found: list[np.ndarray], s: Settings) -> Model:
    """Weights and ascending thresholds by Adam steps on the penalised likelihood of the grades."""
    size = 1 << s.bits
    w, cuts = np.zeros(size), np.array([0.0, 0.5, 0.5])  # the first threshold, then the gaps (softplus)
    if not len(toxic) or toxic.max() == 0:
        return Model(w, np.full(GRADES, 50.0), s.bits)
    scale = log_ratios(toxic, found, s)
    y = grades(toxic, found, scale, s)
    found = [x[scale[x] != 0] for x in found]
    index, lengths = np.concatenate(found), np.array([len(x) for x in found])
    row = np.repeat(np.arange(len(found)), lengths)
    means, squares = [np.zeros(size), np.zeros(3)], [np.zeros(size), np.zeros(3)]
    for step in range(1, s.steps + 1):
        gaps = np.log1p(np.exp(cuts[1:]))
        theta = np.cumsum([cuts[0], *gaps])
        margin = np.bincount(row, (w * scale)[index], minlength=len(found))
        up = 1 / (1 + np.exp(np.clip(theta[None, :] - margin[:, None], -50, 50)))
        edges = np.concatenate([np.ones((len(y), 1)), up, np.zeros((len(y), 1))], axis=1)
        slope = edges * (1 - edges)
        at = np.arange(len(y))
        p = np.maximum(edges[at, y] - edges[at, y + 1], 1e-12)
        by_margin = -(slope[at, y] - slope[at, y + 1]) / p / len(y)
        by_theta = np.zeros(GRADES)
        for k in range(GRADES):
            low, high = y == k + 1, y == k
            by_theta[k] = (slope[low, k + 1] / p[low]).sum() / len(y) - (slope[high, k + 1] / p[high]).sum() / len(y)
        grow = 1 / (1 + np.exp(-cuts[1:]))
        tail = np.cumsum(by_theta[::-1])[::-1]
        grads = [np.bincount(index, by_margin[row], minlength=size) * scale + s.penalty * w, np.array([tail[0], *(tail[1:] * grow)])]
        for k, (value, grad) in enumerate(zip((w, cuts), grads, strict=True)):
            means[k] = 0.9 * means[k] + 0.1 * grad
            squares[k] = 0.999 * squares[k] + 0.001 * grad**2
            value -= s.rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w * scale, np.cumsum([cuts[0], *np.log1p(np.exp(cuts[1:]))]), s.bits)


class Weights(dict):
    """Word to the sum of its features' weights."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > MEMO:
            self.clear()
        self[word] = made = float(self.model.weights[features(word, self.model.bits)].sum())
        return made


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    rows = training_rows(docs, labels, s, doc_id, text, label).toPandas()
    found = [np.frombuffer(x, np.int32) for x in rows["features"]]
    return fit(rows["toxic"].to_numpy(np.int64).clip(0, 1), found, s)


def severity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, toxic): grade is the median grade, toxic its being above zero."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(shared.value)
        for batch in batches:
            margin = np.array([sum(map(weights.__getitem__, sorted(distinct_words(t)))) for t in _bytes(batch.column(1))], np.float64)
            up = shared.value.above(margin)
            grade = (up >= 0.5).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(up.sum(1)), pa.array(up[:, 0]), pa.array(grade), pa.array(grade > 0)], ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean")
