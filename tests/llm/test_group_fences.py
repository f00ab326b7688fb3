"""Fences of rates that are zero in most documents follow their group."""

import numpy as np

from parleyspark.llm import adaptive_rules


def _measured(spark, source, draw, share, n=400):
    """Documents of 500 words in 50 lines; a share of them has some symbols, repeats and duplicate lines."""
    some = draw.random(n) < share
    at = lambda low, high: np.where(some, draw.integers(low, high, n), 0)
    cols = zip(at(10, 25), at(2, 9), at(20, 50), strict=True)
    rows = [("en", source, 500, 2500, int(s), int(d), int(r), 50) for s, d, r in cols]
    names = "lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_full_lines bigint"
    return spark.createDataFrame(rows, names)


def test_fences_differ_between_a_clean_and_a_noisy_group(spark):
    draw = np.random.default_rng(0)
    both = _measured(spark, "clean", draw, 0.0).union(_measured(spark, "noisy", draw, 0.15))
    got = {r["source"]: r for r in adaptive_rules.fences(adaptive_rules.sketches(both)).collect()}
    for rule, least in (("symbol_rate", 0.03), ("dup_line_rate", 0.1), ("repeat_rate", 0.06)):
        clean, noisy = (got[g][f"high_{rule}"] for g in ("clean", "noisy"))
        assert noisy > clean + least, rule
    # one document, judged by both groups
    one = [("en", s, 500, 2500, 55, 0, 0, 50) for s in ("clean", "noisy")]
    judged = adaptive_rules.judge(spark.createDataFrame(one, both.schema), spark.createDataFrame(list(got.values())))
    assert {r["source"]: r["kept"] for r in judged.collect()} == {"clean": False, "noisy": True}


def test_junk_does_not_widen_its_own_fence(spark):
    draw = np.random.default_rng(1)
    docs = _measured(spark, "a", draw, 0.0)
    junk = spark.createDataFrame([("en", "a", 500, 2500, 1400, 0, 0, 50)] * 80, docs.schema)
    plain, mixed = (adaptive_rules.fences(adaptive_rules.sketches(d)).first() for d in (docs, docs.union(junk)))
    assert mixed["high_symbol_rate"] == plain["high_symbol_rate"] < 0.1


def test_room_is_the_error_of_the_groups_rate(spark):
    rows = [("en", "a", 500, 2500, 40, 0, 0, 50)] * 100
    names = _measured(spark, "a", np.random.default_rng(2), 0.0, 1).schema
    got = adaptive_rules.fences(adaptive_rules.sketches(spark.createDataFrame(rows, names))).first()
    rules = adaptive_rules.Rules()
    assert abs(got["room_symbol_rate"] - rules.errors * (0.08 * 2) ** 0.5) < 0.02
    assert got["room_dup_line_rate"] == rules.errors * 0.036**0.5
