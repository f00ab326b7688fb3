"""Feature vectors, window attention scores and the logistic baseline."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from parleyspark import config as C
from parleyspark.functions import text as T
from parleyspark.session import cut_lineage

BASE_FEATURES = ("m_index", "i_index", "en_frac", "hi_frac", "dev_frac", "abuse_hit", "log_tokens", "switches", "qmark", "exclaim")


@dataclass(frozen=True)
class Weights:
    """Attention weights; ``load`` reads an exported file."""

    abuse_stems: tuple[str, ...]
    benign_stems: tuple[str, ...]
    mean: np.ndarray = field(repr=False)
    std: np.ndarray = field(repr=False)
    wk: np.ndarray = field(repr=False)
    wv: np.ndarray = field(repr=False)
    wq: np.ndarray = field(repr=False)
    head: np.ndarray = field(repr=False)
    bias: float = 0.0
    threshold: float = 0.5
    precision_threshold: float = 0.5

    @property
    def dim(self) -> int:
        return self.wk.shape[0]

    @staticmethod
    def load(path: str) -> "Weights":
        with open(path, encoding="utf-8") as f:
            w = json.load(f)
        arr = lambda k: np.asarray(w[k], dtype=np.float64)
        return Weights(
            tuple(w["abuseStems"]), tuple(w["benignStems"]), arr("mean"), arr("std"), arr("Wk"), arr("Wv"), arr("Wq"),
            arr("head"), float(w["bias"]), float(w["threshold"]), float(w.get("precisionThreshold", w["threshold"])),
        )

    def save(self, path: str) -> None:
        out = {
            "dim": self.dim, "maxSlots": C.MAX_SLOTS, "maxWindowTokens": C.MAX_WINDOW_TOKENS, "shortTokens": C.SHORT_TOKENS,
            "threshold": self.threshold, "precisionThreshold": self.precision_threshold,
            "featureNames": list(BASE_FEATURES) + [f"abuse:{s}" for s in self.abuse_stems] + [f"benign:{s}" for s in self.benign_stems],
            "abuseStems": list(self.abuse_stems), "benignStems": list(self.benign_stems),
            "enForce": list(C.ENGLISH_WORDS), "hindiClosed": list(C.BASE_WORDS),
            "mean": self.mean.tolist(), "std": self.std.tolist(), "head": self.head.tolist(),
            "Wk": self.wk.tolist(), "Wv": self.wv.tolist(), "Wq": self.wq.tolist(), "bias": self.bias,
        }
        with open(path, "w", encoding="utf-8") as f:
            json.dump(out, f)


def placeholder_weights(abuse: Sequence[str], benign: Sequence[str], dim: int = 16) -> Weights:
    """Weights from a rule, for runs without an exported file. Not a trained model."""
    n = len(BASE_FEATURES) + len(abuse) + len(benign)
    wave = lambda rows, phase: 0.3 * np.sin(np.add.outer(np.arange(rows) * 1.7, np.arange(n) * 0.9) + phase)
    head = 0.4 * np.cos(np.arange(n + dim) * 0.8)
    return Weights(
        tuple(abuse), tuple(benign), np.full(n, 0.2), np.full(n, 0.5), wave(dim, 0.1), wave(dim, 0.7), wave(dim, 1.3), head, -0.2
    )


def with_features(df: DataFrame, text: str, abuse: Sequence[str], benign: Sequence[str], out: str = "feats") -> DataFrame:
    """Add the feature vector; everything stays in built-in expressions."""
    d = T.with_mixing(df, text).withColumn("_content", T.content_tokens(T.tokens(F.col(text))))
    d = d.withColumns(
        {
            "_n": F.size("_content"),
            "_pad": F.concat(F.lit(" "), F.array_join("_content", " "), F.lit(" ")),
            "_dev": F.size(F.filter("_content", lambda t: t.rlike(C.DEVANAGARI))),
        }
    )
    hit = lambda s: F.when(T.stem_hit(F.col("_pad"), s), 1.0).otherwise(0.0)
    d = d.withColumn("_a", F.array(*[hit(s) for s in abuse]) if abuse else F.array().cast("array<double>"))
    d = d.withColumn("_be", F.array(*[hit(s) for s in benign]) if benign else F.array().cast("array<double>"))
    abuse_hits = F.aggregate("_a", F.lit(0.0), lambda acc, x: acc + x)
    flag = lambda ch: F.when(F.contains(F.col(text), F.lit(ch)), 1.0).otherwise(0.0)
    base = F.array(
        F.col("m_index"),
        F.col("i_index"),
        F.col("en_frac"),
        F.col("hi_frac"),
        F.col("_dev").cast("double") / F.greatest(F.col("_n"), F.lit(1)).cast("double"),
        F.least(abuse_hits, F.lit(3.0)) / 3.0,
        F.log1p(F.col("_n").cast("double")) / F.lit(math.log(32)),
        F.least(F.col("switches"), F.lit(8)).cast("double") / 8.0,
        flag("?"),
        flag("!"),
    )
    vector = F.concat(base, F.col("_a"), F.col("_be"))
    kept = [*df.columns, vector.alias(out), F.col("_n").cast("bigint").alias("n_content"), "m_index", "i_index"]
    return d.select(*kept)


def attend(slots: np.ndarray, w: Weights) -> tuple[float, float]:
    """Score of the newest slot given standardised slot features, and its own weight."""
    keys, values = np.tanh(slots @ w.wk.T), np.tanh(slots @ w.wv.T)
    scores = keys @ np.tanh(w.wq @ slots[-1]) / math.sqrt(w.dim)
    alpha = np.exp(scores - scores.max())
    alpha /= alpha.sum()
    logit = float(w.head @ np.concatenate([slots[-1], alpha @ values]) + w.bias)
    return 1.0 / (1.0 + math.exp(-min(20.0, max(-20.0, logit)))), float(alpha[-1])


def attention_udf(w: Weights):
    """Arrow UDF over the kept slots' feature vectors."""

    @F.pandas_udf(ST.StructType([ST.StructField("score", ST.DoubleType()), ST.StructField("attn_last", ST.DoubleType())]))
    def run(slots: pd.Series) -> pd.DataFrame:
        scale = np.maximum(w.std, 1e-6)
        rows = [attend((np.stack([np.asarray(v) for v in s]) - w.mean) / scale, w) for s in slots]
        return pd.DataFrame(rows, columns=["score", "attn_last"])

    return run


def standardisation(df: DataFrame, feats: str, n: int) -> DataFrame:
    """Mean and population deviation per feature; tiny deviations become one."""
    dims = range(n)
    aggs = [F.avg(F.get(F.col(feats), F.lit(i))).alias(f"m{i}") for i in dims]
    aggs += [F.stddev_pop(F.get(F.col(feats), F.lit(i))).alias(f"s{i}") for i in dims]
    s = lambda i: F.when(F.col(f"s{i}") < 1e-6, 1.0).otherwise(F.col(f"s{i}"))
    return df.agg(*aggs).select(
        F.array(*[F.col(f"m{i}") for i in dims]).alias("mean"), F.array(*[s(i) for i in dims]).alias("std")
    )


def fit_logistic(df: DataFrame, feats: str, y: str, n: int, epochs: int = 40, lr: float = 0.35, l2: float = 1e-3):
    """Class-balanced logistic regression by full-batch gradient steps.

    Each epoch is one pass: every Arrow batch returns one partial gradient row
    and Spark adds the rows up. Only the weight vector visits the driver.
    """
    data = cut_lineage(df.select(F.col(feats).alias("x"), F.col(y).cast("double").alias("y")))
    total, positive = data.agg(F.count(F.lit(1)), F.avg("y")).first()
    pos = max(float(positive or 0.0), 1e-6)
    w, b = np.zeros(n), 0.0
    schema = "g array<double>, e double"

    def gradient(weights, bias):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    x, t = np.stack(pdf["x"].to_list()), pdf["y"].to_numpy()
                    p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -20, 20)))
                    err = (p - t) * np.where(t > 0.5, 0.5 / pos, 0.5 / (1 - pos))
                    yield pd.DataFrame({"g": [x.T @ err], "e": [err.sum()]})

        return run

    sums = [F.sum(F.get("g", F.lit(i))) for i in range(n)] + [F.sum("e")]
    for epoch in range(epochs):
        parts = data.mapInPandas(gradient(w, b), schema).agg(*sums).first()
        grad, err = np.array(parts[:n], dtype=float), float(parts[n])
        step = lr / (1 + 0.05 * epoch)
        w = w - step * (grad / total + l2 * w)
        b = b - step * err / total
    return w, b


def logistic_score(feats: Column, w: Sequence[float], b: float) -> Column:
    weights = F.array(*[F.lit(float(x)) for x in w])
    terms = F.zip_with(feats, weights, lambda x, y: x * y)
    logit = F.aggregate(terms, F.lit(float(b)), lambda acc, x: acc + x)
    clipped = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), logit))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))
