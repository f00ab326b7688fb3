"""Data-parallel training of the window attention scorer.

Examples are hashed into small blocks. In every step each block returns the
gradient of its own mean loss from the executor that holds it; Spark averages
the block gradients and the driver, which only ever holds the weights, takes one
Adam step. Blocks, not partitions, define the loss, so the result does not depend
on how the data is spread.

Without a number of steps, every block of rows is an update, as in sequential
training: groups of hashed examples each take Adam steps through their own blocks, in
a new order each epoch, and weights and moments are averaged over groups after each
epoch. One group, which small tables are, is the sequential schedule itself.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyspark.functions.hashing import stable_int
from parleyspark.operators.attention import Weights
from parleyspark.session import cut_lineage

NAMES = ("wk", "wv", "wq", "head", "bias")


def contrastive_gradient(context: np.ndarray, y: np.ndarray, tau: float) -> tuple[float, np.ndarray]:
    """Supervised contrastive loss of context vectors and its gradient."""
    norm = np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-8)
    unit = context / norm
    others = ~np.eye(len(y), dtype=bool)
    same = (y[:, None] == y[None, :]) & others
    anchors = same.sum(1) > 0
    logits = np.where(others, unit @ unit.T / tau, -np.inf)
    log_p = logits - logits.max(1, keepdims=True)
    log_p = log_p - np.log(np.exp(log_p).sum(1, keepdims=True))
    target = same / np.maximum(same.sum(1, keepdims=True), 1)
    used = max(int(anchors.sum()), 1)
    loss = -(np.where(same, log_p, 0.0) * target)[anchors].sum() / used
    pull = np.where(anchors[:, None] & others, np.exp(np.where(others, log_p, 0.0)) - target, 0.0)
    d_unit = (pull + pull.T) @ unit / (tau * used)
    return float(loss), (d_unit - unit * (unit * d_unit).sum(1, keepdims=True)) / norm


def batch_gradient(x: np.ndarray, live: np.ndarray, y: np.ndarray, w: Weights, lam: float = 0.0, tau: float = 0.2):
    """Loss and gradients of one block.

    ``x`` is (examples, slots, features), padded at the front; ``live`` marks
    real slots. The contrastive part trains the value projection only.
    """
    n, f = len(y), x.shape[2]
    k, v, last = np.tanh(x @ w.wk.T), np.tanh(x @ w.wv.T), x[:, -1]
    q = np.tanh(last @ w.wq.T)
    root = math.sqrt(w.dim)
    s = np.where(live, np.einsum("bsd,bd->bs", k, q) / root, -np.inf)
    a = np.exp(s - s.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    ctx = np.einsum("bs,bsd->bd", a, v)
    hidden = np.concatenate([last, ctx], axis=1)
    p = 1 / (1 + np.exp(-np.clip(hidden @ w.head + w.bias, -20, 20)))
    loss = float(-(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).mean())
    err = (p - y) / n
    d_ctx = np.outer(err, w.head[f:])
    d_a = np.einsum("bsd,bd->bs", v, d_ctx)
    d_s = a * (d_a - (a * d_a).sum(1, keepdims=True)) / root
    d_value = d_ctx
    if lam:
        extra, d_con = contrastive_gradient(ctx, y, tau)
        loss, d_value = loss + lam * extra, d_ctx + lam * d_con
    d_v = a[:, :, None] * d_value[:, None, :] * (1 - v * v)
    d_k = d_s[:, :, None] * q[:, None, :] * (1 - k * k)
    d_q = np.einsum("bs,bsd->bd", d_s, k) * (1 - q * q)
    grads = {
        "wk": np.einsum("bsd,bsf->df", d_k, x),
        "wv": np.einsum("bsd,bsf->df", d_v, x),
        "wq": d_q.T @ last,
        "head": hidden.T @ err,
        "bias": np.array(err.sum()),
    }
    return loss, grads


def pad_slots(slots: list, n_features: int, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Standardised slots, aligned at the newest one."""
    width = max(len(s) for s in slots)
    x, live = np.zeros((len(slots), width, n_features)), np.zeros((len(slots), width), dtype=bool)
    scale = np.maximum(w.std, 1e-6)
    for i, s in enumerate(slots):
        x[i, width - len(s) :] = (np.stack([np.asarray(f, dtype=float) for f in s]) - w.mean) / scale
        live[i, width - len(s) :] = True
    return x, live


def _block_gradients(w: Weights, lam: float):
    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            # the newest block may continue in the next batch
            done = held[held["block"] != held["block"].iloc[-1]]
            held = held[held["block"] == held["block"].iloc[-1]]
            yield emit(done)
        if held is not None:
            yield emit(held)

    def emit(pdf):
        rows = []
        for _, part in pdf.groupby("block", sort=True):
            x, live = pad_slots(part["slots"].to_list(), len(w.mean), w)
            loss, g = batch_gradient(x, live, part["y"].to_numpy(dtype=float), w, lam)
            n = len(part)  # a block counts by its rows, so short ones need no rule of their own
            rows.append((n, n * loss, n * np.concatenate([np.ravel(g[m]) for m in NAMES])))
        return pd.DataFrame(rows, columns=["n", "loss", "g"])

    return run


def _pack(w: Weights) -> np.ndarray:
    return np.concatenate([np.ravel(getattr(w, m)) for m in NAMES]).astype(float)


def _unpack(flat: np.ndarray, like: Weights) -> Weights:
    sizes = [np.ravel(getattr(like, m)).size for m in NAMES]
    pieces = np.split(flat, np.cumsum(sizes)[:-1])
    new = {m: p.reshape(np.shape(getattr(like, m))) for m, p in zip(NAMES, pieces)}
    return replace(like, **{**new, "bias": float(new["bias"])})


def _adam(flat, first, second, g, t: int, lr: float, l2: float):
    g = g.copy()
    g[:-1] += l2 * flat[:-1]
    first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
    return flat - lr * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8), first, second


def _group_epoch(w: Weights, first: np.ndarray, second: np.ndarray, t: int, epoch: int, block_rows: int, lr: float, lam: float, l2: float):
    """One epoch of a group: an update for each block of rows; blocks of under four are left, as in the reference."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k").reset_index(drop=True)
        order = np.random.default_rng([epoch, int(pdf["part"].iloc[0])]).permutation(len(pdf))
        x, live = pad_slots(pdf["slots"].to_list(), len(w.mean), w)
        y = pdf["y"].to_numpy(dtype=float)
        flat, m, v, n, loss, steps = _pack(w), first, second, 0, 0.0, 0
        for at in range(0, len(order), block_rows):
            rows = order[at : at + block_rows]
            if len(rows) < 4:
                continue
            steps += 1
            one, g = batch_gradient(x[rows], live[rows], y[rows], _unpack(flat, w), lam)
            flat, m, v = _adam(flat, m, v, np.concatenate([np.ravel(g[k]) for k in NAMES]), t + steps, lr, l2)
            n, loss = n + len(rows), loss + len(rows) * one
        return pd.DataFrame({"n": [n], "steps": [steps], "loss": [loss], "state": [n * np.concatenate([flat, m, v])]})

    return run


def _train_groups(examples: DataFrame, key: str, slots: str, y: str, w: Weights, epochs: int, block_rows: int, group_blocks: int, lr: float, lam: float, l2: float):
    total = examples.count()
    groups = max(1, total // (block_rows * group_blocks))
    part = (stable_int(F.lit("part"), F.col(key).cast("string")) % groups).cast("bigint")
    data = examples.select(part.alias("part"), F.col(key).alias("k"), F.col(slots).alias("slots"), F.col(y).cast("double").alias("y"))
    data = cut_lineage(data.repartition("part"))
    size = len(_pack(w))
    first, second, t, losses = np.zeros(size), np.zeros(size), 0, []
    for epoch in range(epochs):
        run = _group_epoch(w, first, second, t, epoch, block_rows, lr, lam, l2)
        made = data.groupBy("part").applyInPandas(run, "n bigint, steps bigint, loss double, state array<double>").where("n > 0")
        rows = made.select("n", "steps", "loss", F.posexplode("state").alias("i", "v")).groupBy("i").agg(
            F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.max("steps").alias("steps")
        ).collect()  # three rows per weight
        if not rows:
            break
        state = np.zeros(3 * size)
        for r in rows:
            state[r["i"]] = r["v"] / r["n"]
        flat, first, second = np.split(state, 3)
        w, t = _unpack(flat, w), t + rows[0]["steps"]
        losses.append(rows[0]["loss"] / rows[0]["n"])
    return w, losses


def train_attention(
    examples: DataFrame, key: str, slots: str, y: str, start: Weights, *,
    epochs: int = 6, steps: int | None = None, block_rows: int = 32, group_blocks: int = 64, lr: float = 0.025, lam: float = 0.45, l2: float = 1e-4,
):
    """(trained weights, mean loss per step, or per epoch without steps). ``slots`` is array<array<double>>.

    steps: averaged updates per epoch; None: one update for each block of rows, group_blocks of them in a group.
    """
    if steps is None:
        return _train_groups(examples, key, slots, y, start, epochs, block_rows, group_blocks, lr, lam, l2)
    total = examples.count()
    n_blocks = max(1, total // block_rows)
    block = stable_int(F.lit("block"), F.col(key).cast("string")) % n_blocks
    data = examples.select(block.alias("block"), F.col(key).alias("k"), F.col(slots).alias("slots"), F.col(y).cast("double").alias("y"))
    data = cut_lineage(data.repartition("block").sortWithinPartitions("block", "k"))
    w, losses = start, []
    sizes = [np.ravel(getattr(w, m)).size for m in NAMES]
    first, second = np.zeros(sum(sizes)), np.zeros(sum(sizes))
    t = 0
    for _ in range(epochs):
        for step in range(steps):
            part = data.filter(F.col("block") % steps == step) if steps > 1 else data
            grads = part.mapInPandas(_block_gradients(w, lam), "n bigint, loss double, g array<double>")
            sums = grads.select("n", "loss", F.posexplode("g").alias("i", "v")).groupBy("i").agg(
                F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("loss").alias("loss")
            )
            rows = sums.collect()  # one row per weight
            if not rows:
                continue
            t += 1
            g = np.zeros(sum(sizes))
            for r in rows:
                g[r["i"]] = r["v"] / r["n"]
            losses.append(rows[0]["loss"] / rows[0]["n"])
            flat, first, second = _adam(_pack(w), first, second, g, t, lr, l2)
            w = _unpack(flat, w)
    return w, losses
