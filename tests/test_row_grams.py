"""N-gram metrics count inside the row: plain Python results, and no n-gram that only one side has is shuffled."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parleyspark.functions import grams as N
from parleyspark.functions import similarity as S


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


@pytest.fixture(scope="module")
def pairs():
    """Rows (key, hypothesis, references); keys 3 and None stand in two rows each."""
    draw = np.random.default_rng(5)
    text = lambda n: [f"w{x}" for x in draw.integers(0, 9, n)]
    return [(k, text(draw.integers(0, 40)), [text(draw.integers(0, 40)) for _ in range(2)]) for k in (*range(30), 3, None, None)]


@pytest.fixture(scope="module")
def frame(spark, pairs):
    return spark.createDataFrame(pairs, "id bigint, h array<string>, r array<array<string>>").repartition(3)


def test_clipped_counts(frame, pairs):
    def want(h, refs):
        out = []
        for n in range(1, 5):
            own, others = grams(h, n), [grams(r, n) for r in refs]
            out += [sum(min(c, max(o[g] for o in others)) for g, c in own.items()), own.total()]
        return out

    got = frame.select("h", "r", N.clipped(F.col("h"), F.col("r"), 4).alias("c")).collect()
    assert len(got) == len(pairs) and all(r["c"] == want(r["h"], r["r"]) for r in got)


def test_matches_hold_only_what_both_sides_have(frame):
    for row in frame.select("h", "r", N.matches(F.col("h"), F.col("r"), 3).alias("m")).collect():
        want = set()
        for n in range(1, 4):
            own = grams(row["h"], n)
            for k, r in enumerate(row["r"]):
                want |= {(n, k, " ".join(g), own[g], c) for g, c in grams(r, n).items() if g in own}
        assert sorted(want) == sorted(tuple(x) for x in row["m"])


def test_corpus_scores_merge_rows_of_one_key(spark, pairs):
    """Counts of rows that share a key are clipped together, as by SQL's GROUP BY."""
    rows = [(k, " ".join(h), " ".join(r[0])) for k, h, r in pairs]
    df = spark.createDataFrame(rows, "id bigint, h string, a string").withColumn("r", F.array("a"))
    by_key = {}
    for k, h, r in rows:
        for n in range(1, 5):
            for side, t in enumerate((h, r)):
                by_key.setdefault((k, n), (Counter(), Counter()))[side].update(grams(t.split(), n))
    m, t = ([sum(f(*c) for (_, x), c in by_key.items() if x == n) for n in range(1, 5)] for f in (lambda h, r: (h & r).total(), lambda h, r: h.total()))
    hl, rl = (sum(len(x[i].split()) for x in rows) for i in (1, 2))
    want = math.exp(min(0, 1 - rl / hl)) * math.exp(sum(math.log(a / b) for a, b in zip(m, t)) / 4)
    assert S.corpus_bleu(df, "id", "h", "r").first()["bleu"] == pytest.approx(want, abs=1e-9)
    alone = {r["id"]: r["bleu"] for r in S.sentence_bleu(df, "id", "h", "r").collect() if r["id"] is None}
    assert alone == {None: 0.0}  # a null key meets no counts


def test_nist_of_shared_and_own_keys(spark, pairs):
    rows = [(k, h, r[0]) for k, h, r in pairs]
    total = Counter()
    for _, _, r in rows:
        for n in range(1, 6):
            total.update(grams(r, n))
    hw, rw = sum(len(h) for _, h, _ in rows), sum(len(r) for _, _, r in rows)
    s = 0.0
    for n in range(1, 6):
        by_key = {}
        for k, h, r in rows:
            for side, t in enumerate((h, r)):
                by_key.setdefault(k, (Counter(), Counter()))[side].update(grams(t, n))
        info = lambda g: math.log2((total[g[:-1]] if n > 1 else rw) / total[g])  # noqa: E731, B023
        s += sum(c * info(g) for h, r in by_key.values() for g, c in (h & r).items()) / sum(h.total() for h, _ in by_key.values())
    want = s * math.exp(math.log(0.5) / math.log(1.5) ** 2 * math.log(min(hw / rw, 1.0)) ** 2)
    df = spark.createDataFrame(rows, "id bigint, h array<string>, r array<string>")
    assert S.corpus_nist(df, "id", "h", "r").first()["nist"] == pytest.approx(want, abs=1e-9)


def test_mask_keeps_all_of_its_grams(spark, frame):
    """Counts of wanted n-grams are whole, and most of the others are left out before the shuffle."""
    wanted = spark.createDataFrame([(1, "w1"), (2, "w1 w2"), (3, "w8 w0 w0")], "n int, gram string")
    held = N.mask(wanted, "gram")
    got = {(r["n"], r["gram"]): r["c"] for r in S.gram_counts(frame, F.col("r"), wanted, 3).collect()}
    want = Counter()
    for row in frame.collect():
        for r in row["r"]:
            for n in range(1, 4):
                want.update((n, " ".join(g)) for g in grams(r, n).elements())
    assert got == {(r["n"], r["gram"]): want[r["n"], r["gram"]] for r in wanted.collect() if want[r["n"], r["gram"]]}
    assert frame.select(F.inline(N.masked(F.col("r"), 3, held))).select("gram").distinct().count() <= 10


def test_no_gram_of_one_side_is_shuffled(spark):
    """Texts that share no word: no exchange of the plan of rows with own keys carries their n-grams."""
    df = spark.range(200).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("w"), i, "id"))).alias("h"), F.array(F.lit("x y z")).alias("r"))
    once = S.bleu_parts(df, "id", "h", "r", 4)[0]
    assert once.count() == 200 and "Exchange" not in once._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_equal_gains_take_the_longest_reference(spark):
    """Gains of both references are zero or equal: the longer one's length enters the penalty."""
    df = spark.createDataFrame([(1, ["a", "b"], [["a", "b"], ["a", "b", "q", "q", "q"]]), (2, ["c"], [["d"], ["e", "f"]])], "id bigint, h array<string>, r array<array<string>>")
    one = S.corpus_nist_refs(df, "id", "h", "r").first()["nist"]
    turned = df.select("id", "h", F.reverse("r").alias("r"))
    assert one > 0 and S.corpus_nist_refs(turned, "id", "h", "r").first()["nist"] == pytest.approx(one, abs=1e-12)
