import json
import os
import random

from pyspark.sql import functions as F

from parleyspark.functions import text as T
from parleyspark.functions.hashing import hash_unit
from parleyspark.operators import attention as A
from parleyspark.operators import windows as Wi
from parleyspark.sources.readers import read_message_stream
from parleyspark.streaming import live

W = A.placeholder_weights(["clown"], ["garden"], dim=4)


def scorer(text):
    return F.when(~F.contains(text, F.lit("fail")), hash_unit(F.lit("m"), text))


def messages(n=160):
    rng = random.Random(11)
    for seq in range(n):
        words = [rng.choice(["clown", "garden", "the", "le", "fail", "river", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(1, 6))]
        yield {"contact": f"c{rng.randint(0, 3)}" if rng.random() > 0.4 else "hot", "text": " ".join(words), "is_outgoing": rng.random() < 0.1, "seq": seq}


def write(folder, rows, name):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def features(df):
    return A.with_features(df, "text", W.abuse_stems, W.benign_stems)


def run(spark, folder, out):
    stream = read_message_stream(spark, str(folder), files_per_trigger=1)
    rows = features(live.admitted(stream))
    windowed = live.window_state(rows, F.col("feats"), weights=W, max_tokens=12, short_tokens=3)
    live.run_available(live.scored(windowed, scorer), str(out / "log"), str(out / "ckpt"), cap=15).awaitTermination()
    return {(r["seq"], round(r["score"], 9), r["severity"]) for r in live.current_log(spark, str(out / "log")).collect()}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = list(messages())
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, rows[:60], "a.json")
    run(spark, folder, tmp_path)
    write(folder, rows[60:110], "b.json")
    run(spark, folder, tmp_path)
    write(folder, rows[110:], "c.json")
    got = run(spark, folder, tmp_path)

    seen, kept = set(), []
    for r in rows:
        if not r["is_outgoing"] and len(r["text"].strip()) >= 5 and (r["contact"], r["text"]) not in seen:
            seen.add((r["contact"], r["text"]))
            kept.append((r["contact"], r["seq"], r["text"]))
    df = spark.createDataFrame(kept, "contact string, seq bigint, text string").withColumn("tokens", T.content_token_count(F.col("text")))
    w = Wi.rolling_window(features(df), "contact", "seq", "text", "tokens", payload=["feats"], max_tokens=12, short_tokens=3)
    w = w.withColumn("fallback", A.attention_udf(W)(F.transform("slots", lambda s: s["feats"]))["score"])
    batch = live.scored(w.withColumn("window_text", Wi.window_text(F.col("slots"), "text")), scorer).filter("flagged")
    rows = sorted(((r["seq"], round(r["score"], 9), r["severity"]) for r in batch.collect()))
    assert len(rows) > 15 and got == set(rows[-15:])


def test_seen_dedup_within_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"contact": "a", "text": "hello there", "is_outgoing": False, "seq": i, "ts": f"2024-01-01 00:00:0{i}"} for i in range(3)]
    write(folder, rows, "a.json")
    schema = "contact string, text string, is_outgoing boolean, seq bigint, ts timestamp"
    stream = read_message_stream(spark, str(folder), schema)
    q = live.admitted(stream, watermark=("ts", "10 minutes")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 1


def feed(folder, batches):
    """One file a micro-batch; streams read files by time, so each gets one of its own."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        write(folder, rows, f"{k:03d}.json")
        os.utime(folder / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))


def contacts(n, seed, of=9):
    """Messages of many contacts, some of whom are forgotten and come back; (contact, text) repeats."""
    rng = random.Random(seed)
    for seq in range(n):
        contact = "hot" if rng.random() < 0.3 else f"c{rng.randint(0, of)}"
        text = " ".join(rng.choice(["clown", "garden", "river", "road"]) for _ in range(rng.randint(1, 4))) + " end"
        yield {"contact": contact, "text": text, "is_outgoing": False, "seq": seq}


def replay_remembered(rows, capacity, max_slots, max_tokens):
    """Plain pass: a map of contacts in order of use, each with its slots."""
    chats, out = {}, {}
    for r in rows:
        known = r["contact"] in chats
        slots = chats.pop(r["contact"], [])
        if not slots or slots[-1] != r["text"]:
            slots = slots + [r["text"]]
        slots = slots[-max_slots:]
        while len(slots) > 1 and sum(len(s.split()) for s in slots) > max_tokens:
            slots = slots[1:]
        chats[r["contact"]] = slots
        if len(chats) > capacity:
            chats.pop(next(iter(chats)))
        out[r["seq"]] = (known, " ".join(slots))
    return out


def test_remembered_contacts_over_micro_batches(spark, tmp_path):
    """Five micro-batches and a rerun of the last equal one plain pass; some contacts are forgotten and begin anew."""
    rows = list(contacts(150, 3))
    feed(tmp_path / "in", [rows[a : a + 30] for a in range(0, 150, 30)])
    stream = read_message_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    sink = live.remembering_sink(str(tmp_path / "out"), capacity=4, max_slots=3, max_tokens=8)
    calls = []

    def counted(batch, number):
        calls.append(number)
        sink(batch, number)
        if number == 4:
            sink(batch, number)  # a retry

    stream.writeStream.foreachBatch(counted).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert calls == [0, 1, 2, 3, 4]
    got = {r["seq"]: (r["kept_history"], r["window_text"]) for r in spark.read.parquet(str(tmp_path / "out" / "windows")).collect()}
    want = replay_remembered(rows, 4, 3, 8)
    assert got == want
    again = [s for s, (known, _) in want.items() if not known]
    assert len(again) > len({r["contact"] for r in rows})  # contacts came back after they were forgotten
    state = live.Versions(spark, str(tmp_path / "out" / "carried"))
    assert state.read().count() == 4 and len(state.numbers()) == 3


def test_incident_log_is_cleared_and_old_versions_go(spark, tmp_path):
    rows = [dict(r, text=f"{r['text']} {r['seq']}") for r in contacts(120, 5)]
    folder, path = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()

    def go(k):
        write(folder, rows[20 * k : 20 * k + 20], f"{k}.json")
        live.run_available(live.scored(live.window_state(live.admitted(read_message_stream(spark, str(folder), files_per_trigger=1))).withColumn("fallback", F.lit(0.9)), lambda t: F.lit(0.95)), path, str(tmp_path / "ckpt"), cap=30).awaitTermination()
        return [r["seq"] for r in live.list_incidents(spark, path).orderBy("place").collect()]

    assert go(0) == list(range(19, -1, -1)) and go(1) == list(range(39, 9, -1))
    live.clear_log(spark, path)
    assert live.list_incidents(spark, path).collect() == []
    assert go(2) == list(range(59, 39, -1)) and go(3) == list(range(79, 49, -1)) and go(4)[-1] == 70
    assert [n for n, _ in live.Versions(spark, path).numbers()] == [2, 3, 4]


def test_retried_batch_after_a_clear(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "contact string, text string, seq bigint, flagged boolean, score double, severity string"
    batch = lambda a: spark.createDataFrame([("c", f"text {s}", s, True, 0.9, "high") for s in range(a, a + 3)], schema)
    sink = live.incident_sink(path, cap=5)
    seqs = lambda: sorted(r["seq"] for r in live.current_log(spark, path).collect())
    sink(batch(0), 0)
    sink(batch(3), 1)
    assert seqs() == [1, 2, 3, 4, 5]
    live.clear_log(spark, path)
    sink(batch(3), 1)  # ended before its commit, so it comes again: cleared it stays
    assert seqs() == []
    sink(batch(6), 2)
    sink(batch(6), 2)
    assert seqs() == [6, 7, 8]


def test_half_written_version_does_not_count(spark, tmp_path):
    path = tmp_path / "log"
    log = live.Versions(spark, str(path))
    assert log.read() is None and log.newest() is None
    log.clear()
    log.write(spark.range(3), 0)
    (path / "version-000000000001-000000").mkdir()  # a writer that was lost
    assert log.newest() == (0, 0) and log.read().count() == 3
    log.write(spark.range(5), 1)
    assert log.read().count() == 5 and log.read(below=1).count() == 3


def test_first_delivery_by_order(spark, tmp_path):
    """Repeats inside a micro-batch, in any order of the file, and across micro-batches."""
    rng = random.Random(7)
    rows = [dict(contact=f"c{rng.randint(0, 3)}", text=f"text number {rng.randint(0, 12)}", is_outgoing=False, seq=s) for s in range(200)]
    parts = [rows[a : a + 50] for a in range(0, 200, 50)]
    for p in parts:
        rng.shuffle(p)
    feed(tmp_path / "in", parts)
    stream = live.admitted(read_message_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        want.setdefault((r["contact"], r["text"]), r["seq"])
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(want) and {(r["contact"], r["text"]): r["seq"] for r in got} == want


def test_seen_keys_are_forgotten_by_event_time(spark, tmp_path):
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    row = lambda text, seq, minute: {"contact": "a", "text": text, "is_outgoing": False, "seq": seq, "ts": at(minute)}
    feed(tmp_path / "in", [[row("hello there", 1, 0), row("hello there", 0, 0)], [row("hello there", 2, 5)], [row("another one", 3, 40)], [row("another one", 4, 41)], [row("hello there", 5, 45)]])
    schema = "contact string, text string, is_outgoing boolean, seq bigint, ts timestamp"
    stream = live.admitted(read_message_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1), watermark=("ts", "10 minutes"))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 3, 5]
