import json

import pytest
from pyspark.sql import functions as F

from parleyspark.operators import ledger as L
from parleyspark.operators import threads as Th
from parleyspark.sources import readers as Rd
from parleyspark.sources import sinks as Sk


def test_labelled_split_is_numbered_after_dropping_gaps(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text('Label , TEXT\n0,"one\nline"\n1,\n1,two\n0,three\n')
    rows = Rd.load_labelled(spark, str(p), "train").orderBy("row_id").collect()
    assert [(r["row_id"], r["label"], r["text"]) for r in rows] == [("train-0", 0, "one\nline"), ("train-1", 1, "two"), ("train-2", 0, "three")]


def test_numbers_cross_file_splits(spark, tmp_path):
    p = tmp_path / "big.json"
    p.write_text("\n".join(json.dumps({"k": i}) for i in range(5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = spark.read.schema("k bigint").json(str(p)).withColumn("_ord", Rd.file_order())
        assert df.rdd.getNumPartitions() > 3
        got = Rd.number_rows(df, "_ord").select("k", "ordinal").collect()
        assert all(r["k"] == r["ordinal"] for r in got) and len(got) == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_logs(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"key": "a", "v": 1}\n{broken\n\n{"key": "b", "v": 2}\n{"key": "a", "v": 3}\n{"v": 9}\n')
    got = {r["key"]: r["v"] for r in Rd.read_log(spark, str(p), "key string, v int", "key", strict=False).collect()}
    assert got == {"a": 3, "b": 2}
    with pytest.raises(Exception):
        Rd.read_log(spark, str(p), "key string, v int", "key", strict=True).collect()


def test_attempt_log(spark, tmp_path):
    p = tmp_path / "meta.jsonl"
    lines = [{"row_id": "r1", "label": 0, "hindi_abuse": "0.5", "ok": False}, {"row_id": "r1", "label": 0, "hindi_abuse": "oops", "ok": True}]
    p.write_text("\n".join(json.dumps(x) for x in lines) + '\n{"row_id": "r2", bad\n')
    rows, bad = Rd.read_attempts(spark, str(p))
    got = rows.collect()
    assert len(got) == 1 and got[0]["ok"] is True and got[0]["hindi_abuse"] is None
    assert bad.first()["corrupt_lines"] == 1


def test_comment_tree(spark, tmp_path):
    p = tmp_path / "cad.tsv"
    head = "info_id\tinfo_id.parent\tmeta_text\tsplit\tannotation_Primary\tannotation_Context\n"
    rows = [
        "p1-title\tNA\tTitle\ttrain\tNeutral\tNA", "p1-post\tNA\tBody\ttrain\tNeutral\tNA", "c1\tp1\tfirst\ttrain\tNeutral\tNA",
        "c2\tc1\t[deleted]\ttrain\tNeutral\tNA", "c3\tc2\tthird\ttest\tNeutral\tPreviousContent", "c4\tc1\tx\texclude_lang\tNeutral\tNA",
    ]
    p.write_text(head + "\n".join(rows) + "\n")
    keep, comments, posts = Rd.load_comment_tree(spark, str(p))
    assert {r["id"] for r in keep.collect()} == {"c1", "c3"}
    turns = {r["id"]: r["turns"] for r in Th.assemble_chains(comments, posts).collect()}
    assert turns["c3"] == ["Title Body", "first", "[deleted]", "third"]


def test_votes_and_messages(spark, tmp_path):
    p = tmp_path / "votes.csv"
    head = "conv_id,prev_agent,prev_user,agent,user,bot,is_abuse.1,is_abuse.-1,is_abuse.-2,is_abuse.-3,type.sex_harassment\n"
    p.write_text(head + "1,_,hello,hey,bad words,b,0,1,0,0,1\n1,_,hello,hey,bad words,b,0,0,1,0,0\n2,_,_,hey,unclear,b,0,1,0,0,0\n2,_,_,hey,unclear,b,0,0,0,0,0\n2,_,_,hey,unclear,b,1,0,0,0,0\n")
    got = Rd.load_annotator_votes(spark, str(p)).collect()
    assert [(r["conv_id"], r["turns"], r["y"], r["y_sex"]) for r in got] == [("1", ["hello", "hey", "bad words"], 1, 1)]
    m = tmp_path / "m.csv"
    m.write_text("text,language,hate_label,source\nhi,english,0,s\nlonger text,hinglish,1,s\n")
    assert [(r["text"], r["y"]) for r in Rd.load_messages(spark, str(m)).collect()] == [("longer text", 1)]


def test_routed_sink_and_release(spark, tmp_path):
    df = spark.createDataFrame([(1, "accepted", "ok"), (2, "quarantined", "api_error:X"), (3, "quarantined", "refusal")], "id int, status string, fail_reason string")
    Sk.write_routed(df, str(tmp_path / "out"))
    q = Sk.read_routed(spark, str(tmp_path / "out"), "quarantined")
    keep, again = Sk.release_from_quarantine(q)
    assert [r["id"] for r in keep.collect()] == [3] and [r["id"] for r in again.collect()] == [2]
    with pytest.raises(ValueError):
        Sk.check_columns(df, ["id", "label"])


def test_thread_tree_prunes_and_reloads(spark, tmp_path):
    rows = [(f"t{i}", 3 + i % 2, "english", "benign", "train" if i % 3 else "test", ["a", "B"]) for i in range(12)]
    th = spark.createDataFrame(rows, "thread_id string, length int, script string, label string, split string, turns array<string>")
    path = str(tmp_path / "tree")
    Sk.write_thread_tree(th, path)
    Sk.write_thread_tree(th, path)
    back = spark.read.json(path).filter("length = 3 and split = 'test'")
    assert back.count() == sum(r[1] == 3 and r[4] == "test" for r in rows)
    Sk.write_splits(th, str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits")).count() == 12
    card = Sk.dataset_card(Th.marginals(th, ["split", "length"], ["length", "script", "label"]))
    assert "| train | 8 |" in card


def test_ledger_and_exports(spark, tmp_path):
    calls = spark.createDataFrame(
        [("2024-01-02 03:00:00", "j", "s", "local", 5, 6, 0.1), ("2024-01-02 04:00:00", "j", "s", "local", None, 1, None)],
        "ts_utc string, job string, service string, model string, input_tokens bigint, output_tokens bigint, usd_estimated double",
    ).withColumn("ts_utc", F.col("ts_utc").cast("timestamp"))
    rows = L.ledger(calls)
    assert {(r["n_calls"], r["input_tokens"], r["output_tokens"]) for r in rows.collect()} == {(2, 5, 7)}
    Sk.write_ledger(rows, str(tmp_path / "ledger"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ledger")).first()["usd_estimated"] == "0.100000"
    log = spark.createDataFrame([("a", 1), ("b", 2)], "id string, seq int")
    doc = json.loads(Sk.export_incidents(log, "seq"))
    assert [x["id"] for x in doc["incidents"]] == ["b", "a"]
    dump = Sk.prediction_dump(spark.createDataFrame([(["a", "b", "c", "d"], [0.123456])], "turns array<string>, p array<float>"), "turns", ["p"]).first()
    assert dump["turns"] == ["b", "c", "d"] and dump["p"] == [0.1235]


def test_lexicon_bound(spark, tmp_path):
    p = tmp_path / "lex.json"
    p.write_text("\n".join(json.dumps({"kind": "marker", "stem": f"s{i}", "surfaces": [f"s{i}"], "tier": "hard"}) for i in range(5)))
    assert len(Rd.load_lexicon(spark, str(p), "marker")) == 5
    with pytest.raises(ValueError):
        Rd.load_lexicon(spark, str(p), "marker", max_rows=4)


def test_documents_of_one_task_are_bounded(spark, tmp_path):
    rows = spark.range(5).selectExpr("'s' AS section", "cast(id AS string) AS key", "'m' AS metric", "cast(id AS double) AS value")
    path = str(tmp_path / "report")
    Sk.write_report(rows, path)
    assert sorted(map(tuple, Rd.read_report(spark, path).collect())) == sorted(map(tuple, rows.collect()))
    for write in (lambda: Sk.write_report(rows, path, most=4), lambda: Sk.export_incidents(rows, "key", most=4)):
        with pytest.raises(ValueError, match="at most 4 rows"):
            write()
    Sk.write_report(rows.limit(0), path)
    assert Rd.read_report(spark, path).collect() == []
    with pytest.raises(ValueError, match="1 to 100"):
        Th.page(rows, F.lit(True), "key", size=101)
