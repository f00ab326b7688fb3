from dataclasses import replace

import numpy as np
import pytest

from parleyspark.operators import attention as A
from parleyspark.operators import training as Tr

W = A.placeholder_weights(["aaaa"], ["bbbb"], dim=4)


def block(seed=0, n=9):
    rng = np.random.default_rng(seed)
    live = np.ones((n, 3), dtype=bool)
    live[::2, 0] = False
    x = rng.normal(size=(n, 3, 12)) * live[:, :, None]
    return x, live, (np.arange(n) % 3 == 0).astype(float)


def test_gradients_match_differences():
    x, live, y = block()
    _, grads = Tr.batch_gradient(x, live, y, W)
    for name in ("wk", "wv", "wq", "head"):
        for at in [(0, 0), (2, 5)] if name != "head" else [(3,), (14,)]:
            base = getattr(W, name)
            loss = []
            for eps in (1e-5, -1e-5):
                moved = base.copy()
                moved[at] += eps
                loss.append(Tr.batch_gradient(x, live, y, replace(W, **{name: moved}))[0])
            assert grads[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-6)


def test_contrastive_gradient_matches_differences():
    rng = np.random.default_rng(1)
    ctx, y = rng.normal(size=(7, 4)), np.array([0, 1, 0, 1, 1, 0, 2.0])
    _, g = Tr.contrastive_gradient(ctx, y, 0.2)
    for at in [(0, 1), (4, 3), (6, 0)]:
        loss = []
        for eps in (1e-6, -1e-6):
            moved = ctx.copy()
            moved[at] += eps
            loss.append(Tr.contrastive_gradient(moved, y, 0.2)[0])
        assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-5)


def test_forward_agrees_with_scorer():
    x, live, y = block(2, 5)
    loss, _ = Tr.batch_gradient(x, live, y, W)
    p = np.array([A.attend(x[i][live[i]], W)[0] for i in range(5)])
    assert loss == pytest.approx(float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()))


def test_training_learns_and_ignores_partitioning(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(160):
        y = float(i % 2)
        slots = rng.normal(size=(rng.integers(1, 4), 12))
        slots[:, 0] += 2 * y
        rows.append((i, y, [list(map(float, s)) for s in slots]))
    df = spark.createDataFrame(rows, "id int, y double, slots array<array<double>>")
    w, losses = Tr.train_attention(df.repartition(2), "id", "slots", "y", W, epochs=4, steps=2, lam=0.0)
    assert losses[-1] < losses[0]
    again, _ = Tr.train_attention(df.repartition(7), "id", "slots", "y", W, epochs=4, steps=2, lam=0.0)
    assert np.allclose(w.wk, again.wk) and np.allclose(w.head, again.head)
