"""The split texts of attention training are tokenised once, not once for every use of their tokens."""

from parleyspark.plans import thread_queries as TQ


def test_texts_are_tokenised_once(spark, tmp_path, monkeypatch):
    texts = [(i, " ".join(["word", "the", "clown!"][(i + k) % 3] for k in range(5 + i % 9))) for i in range(40)]
    texts += [(40, None), (41, ""), (42, "one two three four five six seven"), (43, "a b c d e f g h"), (43, "a b c d e f g h")]
    rows = spark.createDataFrame([(i, t, "en", "web") for i, t in texts], "doc_id long, text string, lang string, source string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(44)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plans, kept = [], []

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        kept.append(cut(df))
        return kept[-1]

    cut = TQ.cut_lineage
    monkeypatch.setattr(TQ, "cut_lineage", spy)
    out = {r["doc_id"]: r for r in TQ.attention_training(spark, str(tmp_path)).collect()}
    # once for the pieces, twice for the features of a piece
    assert plans[0].count("regexp_extract_all") <= 3
    long = {i for i, t in texts if len((t or "").replace("!", " !").split()) >= 8}
    assert set(out) == long and 43 in long and 42 not in long
    assert {r["doc_id"]: len(r["slots"]) for r in kept[0].collect()} == {i: 8 if i == 43 else 4 for i in long}
    assert all(r["y"] == i % 2 and 0 < r["score"] < 1 for i, r in out.items())
