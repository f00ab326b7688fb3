"""Training takes an update for each block of 32 rows, as the reference does."""

import numpy as np
import pytest

from parleyspark.operators import attention as A
from parleyspark.operators import training as Tr

W = A.placeholder_weights(["aaaa"], ["bbbb"], dim=4)


def rows(n):
    draw, out = np.random.default_rng(7), []
    for i in range(n):
        y = float(i % 3 == 0)
        slots = draw.normal(size=(draw.integers(1, 5), 12))
        slots[:, 0] += 0.8 * y
        slots[-1, 3] -= 0.8 * y
        out.append((i, y, [list(map(float, s)) for s in slots]))
    return out


def loss(data, w):
    x, live = Tr.pad_slots([s for *_, s in data], 12, w)
    return Tr.batch_gradient(x, live, np.array([y for _, y, _ in data]), w)[0]


def reference(data, w, epochs=6, batch=32, lr=0.025, lam=0.45, l2=1e-4):
    """The reference's loop: shuffle, one Adam step a batch, batches of under four left out."""
    draw, t = np.random.default_rng(0), 0
    p = {k: np.array(getattr(w, k), float) for k in Tr.NAMES}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    order = np.arange(len(data))
    for _ in range(epochs):
        draw.shuffle(order)
        for at in range(0, len(order), batch):
            part = [data[i] for i in order[at : at + batch]]
            if len(part) < 4:
                continue
            t += 1
            now = Tr.replace(w, **{**p, "bias": float(p["bias"])})
            x, live = Tr.pad_slots([s for *_, s in part], 12, now)
            _, g = Tr.batch_gradient(x, live, np.array([y for _, y, _ in part]), now, lam)
            for k in Tr.NAMES:
                d = g[k] + (0 if k == "bias" else l2 * p[k])
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Tr.replace(w, **{**p, "bias": float(p["bias"])})


@pytest.mark.parametrize("group_blocks,share", [(64, 0.25), (8, 0.5)])
def test_final_loss_is_that_of_the_reference(spark, group_blocks, share):
    """In one group, and in two of ten blocks, where averaging loses some of what two averaged steps an epoch lose."""
    data = rows(640)
    frame = spark.createDataFrame(data, "id int, y double, slots array<array<double>>")
    w, losses = Tr.train_attention(frame.repartition(3), "id", "slots", "y", W, group_blocks=group_blocks)
    few, _ = Tr.train_attention(frame, "id", "slots", "y", W, steps=2)
    want, got, barely = loss(data, reference(data, W)), loss(data, w), loss(data, few)
    assert len(losses) == 6 and abs(got - want) < share * (barely - want)
    again, _ = Tr.train_attention(frame.repartition(5), "id", "slots", "y", W, group_blocks=group_blocks)
    assert np.allclose(w.wk, again.wk) and np.allclose(w.head, again.head)
