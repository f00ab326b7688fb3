"""N-grams leave their rows in batches of few words: the rows of the nested form, however many rows a worker gets."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parleyspark.functions import grams as N
from parleyspark.functions import similarity as S


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(8)
    text = lambda: [f"w{x}" for x in draw.integers(0, 9, draw.integers(0, 40))]
    rows = [(k, text(), [text() for _ in range(int(draw.integers(0, 3)))]) for k in range(40)] + [(None, None, [["w1"]]), (41, ["w1"], None), (42, ["w1", None], [None, ["w1"]])]
    return spark.createDataFrame(rows, "id bigint, h array<string>, r array<array<string>>").coalesce(1)


def test_rows_are_those_of_the_nested_form(spark, frame, monkeypatch):
    wanted = spark.createDataFrame([(1, "w1"), (2, "w1 w2")], "n int, gram string")
    held = N.mask(wanted, "gram")
    nested = [frame.select("id", F.inline(N.matches(F.col("h"), F.col("r"), 4))), frame.select(F.lit(None), F.inline(N.masked(F.col("r"), 4, held)))]
    rows = [N.match_rows(frame, "id", F.col("h"), F.col("r"), 4), N.masked_rows(frame, F.col("r"), 4, held)]
    for a, b in zip(nested, rows, strict=True):
        want, got = (sorted(map(str, (tuple(x) for x in d.collect()))) for d in (a, b))
        assert want == got and len(got) > 30


def test_stretches_have_few_words(monkeypatch):
    monkeypatch.setattr(N, "WORDS", 20)
    h = pa.array([["a"] * 5, ["a"] * 30, None, [], ["a"] * 9, ["a"] * 12], pa.list_(pa.string()))
    r = pa.array([[["b"] * 5, []], [], [["b"] * 3, None], None, [["b"]], [["b"] * 4]], pa.list_(pa.list_(pa.string())))
    assert list(N._stretches(h, r)) == [(0, 1), (1, 1), (2, 3), (5, 1)]
    assert list(N._stretches(h.slice(2), r.slice(2))) == [(0, 3), (3, 1)]


def test_scores_take_rows_in_batches(spark, frame):
    """No array of all n-grams of an Arrow batch is made for the counts of the references."""
    wanted = spark.createDataFrame([(1, "w1")], "n int, gram string")
    plan = S.gram_counts(frame, F.col("r"), wanted, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
