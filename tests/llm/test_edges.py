"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parleyspark.llm import adaptive_rules, balance, class_lm, cover_tree, hash_tree, line_runs, ordinal, packing, semicrf, simhash
from parleyspark.llm.queries import tokenizer

PLAIN = "The first line of a plain text that is long enough to pass the rules\nand a second line with some more words in it."
ROWS = [
    (1, PLAIN, "en", "a", 5),
    (1, PLAIN, "en", "a", 5),
    (2, None, None, None, None),
    (None, PLAIN + " without an id", "en", None, 5),
    (3, "", "fr", "", 0),
    (4, " \n\t\r ", "fr", "b", 0),
    (5, "word " * 60_000, "de", "b", 1),
    (6, "A" * 100_000, "de", "b", 1),
    (7, "é ñ 你好 text text mail me at x.y@z.org or +1 (444) 555-3382", "es", "c", None),
    (8, "<|endoftext|> special  double  space\n\n", "en", "c", 7),
]
#: Names that operators use for columns of their own.
CLASHES = "size target taken kept base_failed n_words draw shard slot key row bin held fp component_id line_count dropped_count kept_text mix_size mix_copies _words _line_id _copy _rank spans before".split()


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (7, 0, 1), (7, 0, 1), (None, 1, 1), (99, 0, None)], "doc_id bigint, quality int, toxic int")


SMALL = class_lm.Settings(clustered=20, classes=4, hot=30, rounds=2)
OPERATORS = {
    "class_lm": lambda d, _: class_lm.score_documents(d, F.col("doc_id") == 1, SMALL),
    "balance": lambda d, _: balance.mix(d),
    "simhash": lambda d, _: simhash.near_duplicates(d),
    "adaptive_rules": lambda d, _: adaptive_rules.adaptive_rules(d),
    "ordinal": lambda d, x: ordinal.severity(d, ordinal.train(d, x)),
    "hash_tree": lambda d, _: hash_tree.shard_documents(d, hash_tree.tree(24), hash_tree.tree(25)),
    "line_runs": lambda d, _: line_runs.dedup_lines(d),
    "semicrf": lambda d, _: semicrf.find(d, semicrf.train(d)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_for_each_row(docs, labels, name):
    got = sorted((r["doc_id"] for r in OPERATORS[name](docs, labels).collect()), key=str)
    assert got == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.where("false"), labels.where("false")).collect() == []


def test_packing(docs):
    got = packing.pack(docs, tokenizer()).toPandas()
    assert set(got["doc_id"].dropna()) == {1, 2, 3, 4, 5, 6, 7, 8} and got["length"].max() <= 2048
    assert (got[got["doc_id"] == 2][["start", "length"]].to_numpy() == [[0, 1]]).all()  # the final id alone
    assert len(got[(got["doc_id"] == 1)]) == 2
    assert packing.pack(docs.where("false"), tokenizer()).collect() == []


def test_scores_of_empty_texts(docs):
    got = {r["doc_id"]: r for r in class_lm.score_documents(docs, F.col("doc_id") == 1, SMALL).collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[4]["n_tokens"] == 1
    assert got[2]["score"] == got[3]["score"] and got[2]["n_known"] == 1
    assert got[1]["held_out"] and not got[None]["held_out"]


def test_without_training_rows(docs):
    got = class_lm.score_documents(docs, F.lit(True), SMALL).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0 for r in got)


def test_components(docs):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert got[2]["component_id"] == got[3]["component_id"] == got[4]["component_id"] == 2 and got[2]["fp"] == 0


def test_rules(docs):
    got = {r["doc_id"]: r for r in adaptive_rules.adaptive_rules(docs).collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[5]["n_repeat_words"] == 60_000 and got[6]["n_words"] == 1 and got[1]["kept"]
    assert got[1]["size"] == "own size"


def test_columns_stay(docs):
    mixed = balance.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns and {"mix_size_", "mix_copies_"} <= set(mixed.columns)
    assert {r["mix_size"] for r in mixed.collect()} == {"own mix_size"}
    cut = line_runs.dedup_lines(docs)
    assert cut.columns[: len(docs.columns)] == docs.columns and cut.columns[-1] == "kept_text_"


def test_personal_data(docs):
    got = {r["doc_id"]: [(x["kind"], x["start"]) for x in r["spans"]] for r in semicrf.find(docs, semicrf.train(docs)).collect()}
    text = ROWS[8][1]
    assert got[7] == [("email", text.index("x.y@")), ("phone", text.index("+1"))] and got[2] == got[3] == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("own"))
    got = sorted(tuple(r) for r in cover_tree.top_k(table, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 256 * 256 + 128 * 128), (0, 2, 2, 256 * 256 + 128 * 128)]
    assert cover_tree.top_k(table.where("false"), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs, "")
    assert out.count() > 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    assert stage(spark, docs.where("false"), "").collect() == []
