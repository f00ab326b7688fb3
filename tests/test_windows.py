import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parleyspark.operators import attention as A
from parleyspark.operators import incidents as I
from parleyspark.operators import windows as Wi


def replay_window(rows, max_slots, max_tokens):
    """rows: (contact, seq, text, tokens) in order."""
    state, out = {}, {}
    for contact, seq, text, tokens in rows:
        slots = state.setdefault(contact, [])
        if not slots or slots[-1][0] != text:
            slots.append((text, tokens))
        while len(slots) > max_slots:
            slots.pop(0)
        while len(slots) > 1 and sum(t for _, t in slots) > max_tokens:
            slots.pop(0)
        out[(contact, seq)] = [t for t, _ in slots]
    return out


@pytest.mark.parametrize("block", [3, 7, 1000, None])
def test_window_equals_replay_with_hot_contact_and_repeats(spark, block):
    rng = random.Random(block or 5)
    rows = []
    for seq in range(400):
        contact = "hot" if rng.random() < 0.5 else f"c{rng.randint(0, 5)}"
        # long runs of one text make blocks without any new slot
        text = "same" if rng.random() < 0.5 else f"t{rng.randint(0, 3)}"
        rows.append((contact, seq, text, rng.choice([1, 5, 30, 120]) if text != "same" else 4))
    fixed = {}
    rows = [(c, s, t, fixed.setdefault((c, t), k)) for c, s, t, k in rows]
    want = replay_window(rows, 8, 96)
    df = spark.createDataFrame(rows, "contact string, seq bigint, text string, tokens bigint")
    got = Wi.rolling_window(df, "contact", "seq", "text", "tokens", **({"block": F.floor(F.col("seq") / block)} if block else {"block_rows": 40}))
    got = {(r["contact"], r["seq"]): [s["text"] for s in r["slots"]] for r in got.collect()}
    assert got == want


def test_window_gate(spark):
    rows = [("a", 0, "one two three four five six seven eight nine", 9), ("a", 1, "short", 1), ("a", 2, "tail", 1)]
    df = spark.createDataFrame(rows, "contact string, seq bigint, text string, tokens bigint")
    got = Wi.rolling_window(df, "contact", "seq", "text", "tokens", max_slots=2).orderBy("seq").collect()
    assert [(r["n_slots"], r["use_window"]) for r in got] == [(1, False), (2, True), (2, True)]
    assert [s["text"] for s in got[2]["slots"]] == ["short", "tail"]


@pytest.mark.parametrize("capacity,block", [(3, 5), (3, 1000), (24, 17)])
def test_contact_history_equals_lru_replay(spark, capacity, block):
    rng = random.Random(capacity * block)
    rows, live, want = [], OrderedDict(), {}
    for seq in range(600):
        c = "hot" if rng.random() < 0.35 else f"c{rng.randint(0, 40)}"
        want[seq] = c in live
        live.pop(c, None)
        live[c] = 1
        while len(live) > capacity:
            live.popitem(last=False)
        rows.append((c, seq))
    df = spark.createDataFrame(rows, "contact string, seq bigint").repartition(5)
    got = {r["seq"]: r["kept_history"] for r in Wi.contact_history(df, "contact", "seq", capacity, block).collect()}
    assert got == want


def test_recency_in_stretches_of_blocks(spark, monkeypatch):
    """Many blocks, folded in stretches of two, after contacts that were recent before; names of generations."""
    from parleyspark.operators import recency as R

    monkeypatch.setattr(R, "FAN", 2)
    rng = random.Random(2)
    live, rows, want = OrderedDict((c, f"old:{c}") for c in ("c3", "hot", "gone")), [], {}
    before = spark.createDataFrame([(c, k, g) for k, (c, g) in enumerate(live.items())], "contact string, place bigint, generation string")
    for seq in range(0, 3000, 10):
        c = "hot" if rng.random() < 0.3 else f"c{rng.randint(0, 12)}"
        known = c in live
        name = live.pop(c, None) or f"1:{seq}"
        live[c] = name
        if len(live) > 5:
            live.popitem(last=False)
        want[seq] = (known, name)
        rows.append((c, 1, seq))
    df = spark.createDataFrame(rows, "contact string, delivery bigint, seq bigint").repartition(3)
    got = R.remembered(df, "contact", ["delivery", "seq"], 5, 40, before)
    assert {r["seq"]: (r["kept_history"], r["generation"]) for r in got.collect()} == want
    after = R.most_recent(got, "contact", ["delivery", "seq"], capacity=5, carried=before)
    assert [(r["contact"], r["generation"]) for r in after.orderBy("place").collect()] == list(live.items())


def replay_log(rows, cap):
    log = []
    for id_, seq in rows:
        if id_ not in [i for i, _ in log]:
            log = (log + [(id_, seq)])[-cap:]
    return set(log)


@pytest.mark.parametrize("n_ids,probe", [(8, 2), (30, 3), (400, 5)])
def test_incident_log_equals_replay_with_reentry(spark, n_ids, probe):
    rng = random.Random(n_ids)
    rows = [(f"id{rng.randint(0, n_ids)}", s) for s in range(300)]
    df = spark.createDataFrame(rows, "id string, seq bigint").repartition(4)
    got = {(r["id"], r["seq"]) for r in I.incident_log(df, "seq", cap=10, probe=probe).collect()}
    assert got == replay_log(rows, 10)


@pytest.mark.parametrize("n_ids,cap,block", [(3, 5, 40), (7, 5, 40), (9, 6, 25), (14, 13, 60), (6, 5, 7), (200, 5, 40)])
def test_dense_repeats_in_blocks_equal_one_pass(spark, n_ids, cap, block):
    """Ids a little more than the log holds, in random order, in turn, and in runs of one id."""
    rng = random.Random(n_ids * cap)
    rows = [(f"id{rng.randint(0, n_ids)}", s) for s in range(200)] + [(f"id{s % n_ids}", s) for s in range(200, 300)]
    rows += [(f"id{rng.choice([0, 0, 0, 1, s // 9 % n_ids])}", s) for s in range(300, 400)]
    df = spark.createDataFrame(rows, "id string, seq bigint").repartition(4)
    assert {tuple(r) for r in I.replayed(df, ["seq"], cap, block).collect()} == replay_log(rows, cap)


def test_incident_log_in_batches(spark):
    rng = random.Random(9)
    rows = [(f"id{rng.randint(0, 25)}", s) for s in range(120)]
    schema = "id string, seq bigint"
    log = I.incident_log(spark.createDataFrame(rows[:50], schema), "seq", cap=10)
    log = spark.createDataFrame(log.collect(), schema)
    log = I.merge_into_log(log, spark.createDataFrame(rows[50:], schema), "seq", cap=10)
    assert {(r["id"], r["seq"]) for r in log.collect()} == replay_log(rows, 10)


def test_running_spend(spark):
    rows = [(s // 10, s, 0.25) for s in range(50)]
    df = spark.createDataFrame(rows, "day int, ord int, usd double")
    assert I.running_spend(df, "day", ["ord"], ["ord"], "usd", 3.0).count() == 12


def test_attention_equals_loop(spark):
    w = A.placeholder_weights(["aaaa"], ["bbbb"], dim=4)
    slots = np.random.default_rng(0).random((3, 12))
    score, last = A.attend(slots, w)
    keys = [np.tanh(w.wk @ f) for f in slots]
    q = np.tanh(w.wq @ slots[-1])
    e = np.exp([k @ q / 2.0 for k in keys])
    alpha = e / e.sum()
    ctx = sum(a * np.tanh(w.wv @ f) for a, f in zip(alpha, slots))
    logit = w.head @ np.concatenate([slots[-1], ctx]) + w.bias
    assert score == pytest.approx(1 / (1 + np.exp(-logit))) and last == pytest.approx(alpha[-1])


def test_features(spark):
    df = spark.createDataFrame([("le clowns ! the 42",)], ["text"])
    f = A.with_features(df, "text", ["clown"], ["le"]).first()["feats"]
    assert f[2] == pytest.approx(1 / 3) and f[5] == pytest.approx(1 / 3) and f[9] == 1.0 and f[8] == 0.0
    assert f[6] == pytest.approx(np.log1p(3) / np.log(32)) and f[10:] == [1.0, 1.0]


def test_logistic_equals_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=80) > 0.4).astype(float)
    df = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(x, y)], "x array<double>, y double")
    w, b = A.fit_logistic(df.repartition(3), "x", "y", 3, epochs=5)
    ww, bb, pos = np.zeros(3), 0.0, y.mean()
    for e in range(5):
        p = 1 / (1 + np.exp(-(x @ ww + bb)))
        err = (p - y) * np.where(y > 0.5, 0.5 / pos, 0.5 / (1 - pos))
        step = 0.35 / (1 + 0.05 * e)
        ww, bb = ww - step * (x.T @ err / 80 + 1e-3 * ww), bb - step * err.sum() / 80
    assert np.allclose(w, ww) and b == pytest.approx(bb)
    z = A.standardisation(df, "x", 3).first()
    assert np.allclose(z["mean"], x.mean(0)) and np.allclose(z["std"], x.std(0))


def replay(rows, cap):
    log = {}
    for key, seq in rows:
        if key not in log:
            log[key] = seq
            if len(log) > cap:
                log.pop(next(iter(log)))
    return log


def test_late_rows_and_reentries_follow_processing_order(spark):
    """Three batches: the log takes rows as they are processed, not by their number."""
    schema = "id string, seq bigint"
    batches = [[("a", 10), ("b", 11)], [("c", 5), ("a", 6)], [("a", 1), ("d", 2)]]
    log = I.incident_log(spark.createDataFrame(batches[0], schema), "seq", cap=2)
    for rows in batches[1:]:
        log = I.merge_into_log(log, spark.createDataFrame(rows, schema), "seq", cap=2)
    assert {r["id"]: r["seq"] for r in log.collect()} == replay([x for b in batches for x in sorted(b, key=lambda r: r[1])], 2)


def test_spend_cap_has_one_window_over_day_totals(spark):
    rows = [(d, c % 7, c, float(c % 5)) for d in range(6) for c in range(200)]
    calls = spark.createDataFrame(rows, "day int, stretch int, call bigint, usd double")
    kept = I.running_spend(calls, "day", ["stretch"], ["call"], "usd", 900.0)
    total, want = 0.0, set()
    for d, s, c, usd in sorted(rows):
        if total < 900.0:
            want.add((d, c, total))
        total += usd
    assert {(r["day"], r["call"], r["spent_before"]) for r in kept.collect()} == want
    plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("SinglePartition") <= 2  # the totals of days, which calls and pieces both read


def test_conversation_of_25_turns_is_one_thread(spark):
    from parleyspark.operators.threads import threads_from_turns

    turns = spark.createDataFrame([("k", n, f"t{n}") for n in reversed(range(25))], "conv string, turn int, text string")
    got = threads_from_turns(turns, "conv", "turn", "text").collect()
    assert len(got) == 1 and got[0]["length"] == 25 and got[0]["turns"] == [f"t{n}" for n in range(25)]
