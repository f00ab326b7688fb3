import math
import random

import pytest
from pyspark.sql import functions as F

from parleyspark.functions import stats as St
from parleyspark.operators import dedup as D
from parleyspark.operators import gates as G
from parleyspark.operators import ledger as L
from parleyspark.operators import metrics as M
from parleyspark.operators import ranks as R
from parleyspark.operators import sampling as Sa
from parleyspark.operators import threads as Th


def val(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "label,h,g,want",
    [(0, 0.9, 0.7, "abuse_score_drop"), (0, 0.9, 0.8, "ok"), (1, 0.2, 0.6, "abuse_score_spike"), (1, 0.5, 0.6, "ok"), (1, 0.0, 0.49, "ok")],
)
def test_score_gate(spark, label, h, g, want):
    assert val(spark, G.score_gate(F.lit(label), F.lit(h), F.lit(g))) == want


@pytest.mark.parametrize(
    "src,out,want",
    [
        ("a b", "", "empty"),
        ("a b", "I cannot do that for you", "refusal"),
        ("a b", "शब्द और", "devanagari_remaining"),
        ("one", "x", "collapsed_length"),
        ("a b c d e f g h i j", "x y", "collapsed_length"),
        ("a b c d e f g h i j", "x y z", "ok"),
        ("you clown x", "you are nice", "abuse_lexicon_missing"),
        ("you clown x", "you cl-own there", "ok"),
    ],
)
def test_hard_check(spark, src, out, want):
    assert val(spark, G.hard_check(F.lit(src), F.lit(out))) == want


def test_severity_bounds(spark):
    for s, want in ((0.5, None), (0.51, "medium"), (0.9, "high")):
        flag = G.flagged(F.lit(s), F.lit(False), 0.6)
        assert val(spark, G.severity(flag, F.lit(s))) == want


def test_abusive_score(spark):
    arr = lambda l, s: F.array(F.struct(F.lit(l).alias("label"), F.lit(s).alias("score")))
    assert val(spark, G.abusive_score(arr("LABEL_0", 0.7))) == 0.7
    assert val(spark, G.abusive_score(arr("non-abusive", 0.7))) == pytest.approx(0.3)
    assert val(spark, G.abusive_score(arr("x", 0.7))) == 0.0


def test_attempts_first_pass_wins(spark):
    rows = [
        (1, 0, 1, "a b c", "", 0.1, 0.1), (1, 1, 1, "a b c", "fine words here", 0.1, 0.2), (1, 2, 1, "a b c", "later words", 0.1, 0.3),
        (2, 0, 1, "a b c", "x y z", 0.1, 0.9), (2, 1, 1, "a b c", "", 0.1, 0.9),
    ]
    df = spark.createDataFrame(rows, "id int, attempt int, label int, source string, raw string, h double, g double")
    got = {r["id"]: r for r in G.resolve_attempts(df, ["id"]).collect()}
    assert (got[1]["status"], got[1]["attempts"], got[1]["text"], got[1]["g"]) == ("accepted", 2, "fine words here", 0.2)
    assert (got[2]["status"], got[2]["fail_reason"], got[2]["attempts"]) == ("quarantined", "empty", 2)


def test_dedup_is_idempotent(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice(["A  b", "a B", "c", "hot", "HOT "])) for i in range(100)]
    df = D.with_norm(spark.createDataFrame(rows, "id int, text string").repartition(5))
    once = D.first_per_text(df, ["id"])
    assert once.count() == 3 and D.first_per_text(once, ["id"]).count() == 3
    assert {r["id"] for r in once.collect()} == {min(i for i, t in rows if " ".join(t.lower().split()) == k) for k in ("a b", "c", "hot")}


def test_sampling_is_independent_of_partitioning(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    pick = lambda d: {r["id"] for r in Sa.sample_per_group(d, ["g"], "id", 7, 1).collect()}
    assert pick(df.repartition(1)) == pick(df.repartition(9)) and len(pick(df)) == 21


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_rank_statistics_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.4, 0.5 if rng.random() < 0.34 else round(rng.random(), 2), round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y boolean, s double, t double")
    assert R.auc(df, [], F.col("y"), "s").first()["auc"] == pytest.approx(brute_auc([(y, s) for y, s, _ in rows]))
    q = R.quantiles(df, [], "s", {"a": 0.5, "b": 0.9}).first()
    xs = sorted(s for _, s, _ in rows)
    k = 299 * 0.9
    lo = int(k)
    assert q["b"] == pytest.approx(xs[lo] + (xs[lo + 1] - xs[lo]) * (k - lo)) and q["a"] == pytest.approx((xs[149] + xs[150]) / 2)

    def midrank(v):
        return {x: sum(z < x for z in v) + (v.count(x) + 1) / 2 for x in set(v)}

    a, b = [r[1] for r in rows], [r[2] for r in rows]
    ra, rb = [midrank(a)[x] for x in a], [midrank(b)[x] for x in b]
    m = 150.5
    rho = sum((x - m) * (y - m) for x, y in zip(ra, rb)) / math.sqrt(sum((x - m) ** 2 for x in ra) * sum((y - m) ** 2 for y in rb))
    assert R.spearman(df, "s", "t").first()["rho"] == pytest.approx(rho)
    u = R.mann_whitney(df, F.col("y"), "s").first()["u"]
    assert u == pytest.approx(sum((p > n) + 0.5 * (p == n) for y, p, _ in rows if y for z, n, _ in rows if not z))
    e = {r["s"]: r["ecdf"] for r in R.ecdf(df, "s").collect()}
    assert e[0.5] == pytest.approx(sum(x <= 0.5 for x in a) / 300)


def test_sweep_and_youden_against_brute_force(spark):
    rng = random.Random(5)
    grid = M.linspace(0.15, 0.85, 36)
    rows = [(rng.random() < 0.5, rng.choice(grid + [rng.random()])) for _ in range(200)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    got = {r["step"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in M.sweep(df, [], F.col("y").cast("int"), F.col("s"), grid).collect()}
    for i, t in enumerate(grid):
        hit = [(y, s >= t) for y, s in rows]
        want = tuple(hit.count(k) for k in ((True, True), (False, True), (True, False), (False, False)))
        assert got[i] == want
    tps = [got[i][0] for i in range(36)]
    assert tps == sorted(tps, reverse=True)
    best = M.youden(df.withColumnRenamed("s", "d"), F.col("y"), ["d"]).first()
    cuts = sorted({round(s * 1000) / 1000 for _, s in rows})
    n1 = sum(y for y, _ in rows)
    j = lambda c: sum(y and s > c for y, s in rows) / n1 - sum((not y) and s > c for y, s in rows) / (200 - n1)
    top = max(cuts, key=lambda c: (round(j(c), 12), -c))
    assert best["threshold"] == pytest.approx(top) and best["j"] == pytest.approx(j(top))


def test_fpr_without_negatives(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "y int, p int")
    c = M.confusion(df, [], F.col("y"), F.col("p"))
    assert M.binary_metrics(c, []).first()["fpr"] is None
    assert M.binary_metrics(c, [], 1.0).first()["fpr"] == 1.0


def test_p_values():
    assert St.binomial_two_sided(2, 10) == pytest.approx(0.109375)
    assert St.binomial_two_sided(5, 10) == 1.0
    assert St.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-6)
    assert St.chi2_one_df(3.841459) == pytest.approx(0.05, abs=1e-6)
    assert St.normal_upper(1.644854) == pytest.approx(0.05, abs=1e-6)
    assert St.correlation_p(0.6319, 10) == pytest.approx(0.05, abs=1e-4)


def test_chains_match_walk(spark):
    rng = random.Random(6)
    parent = {i: (rng.randint(0, i - 1) if rng.random() < 0.95 else None) for i in range(1, 120)}
    # node 0 is a post; a few nodes point at something unknown
    rows = [(f"n{i}", f"n{p}" if p is not None else "gone", "" if i % 13 == 0 else f"t{i}") for i, p in parent.items()]
    comments = spark.createDataFrame(rows, "id string, parent string, text string")
    posts = spark.createDataFrame([("n0", "post")], "id string, text string")
    got = {r["id"]: r["turns"] for r in Th.assemble_chains(comments, posts, 9).collect()}
    for i in parent:
        chain, cur, hops = [f"t{i}" if i % 13 else ""], parent[i], 0
        while cur is not None and hops < 9:
            hops += 1
            if cur == 0:
                chain.append("post")
                break
            chain.append("[empty]" if cur % 13 == 0 else f"t{cur}")
            cur = parent[cur]
        assert got[f"n{i}"] == chain[::-1]


def test_quota(spark):
    rec = spark.createDataFrame([("s", 3, "l", i, True) for i in range(7)], "script string, length int, label string, n int, ok boolean")
    grid = spark.createDataFrame([("s", 3, "l"), ("s", 5, "l")], "script string, length int, label string")
    got = {r["length"]: r for r in Th.cell_deficits(rec, grid, ["script", "length", "label"], "n", F.col("ok"), 10, 0.1).collect()}
    assert (got[3]["need"], got[3]["start"]) == (6, 7) and (got[5]["need"], got[5]["start"]) == (13, 0)
    assert val(spark, Th.spec_key(F.lit("s"), F.lit(3), F.lit("l"), F.lit(7))) == "s:3:l:000007"


def test_cost(spark):
    assert val(spark, L.token_cost(F.lit("other"), F.lit(10**6), F.lit(10**6))) == pytest.approx(0.75)
    assert [val(spark, L.retry_delay(F.lit(i))) for i in (1, 2, 5, 6)] == [500.0, 1000.0, 8000.0, 8000.0]
    hours = L.billed_hours(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:10").cast("timestamp"))
    assert val(spark, hours) == pytest.approx(60 / 3600)
    assert str(val(spark, L.parse_end_time(F.lit("User initiated (2024-05-01 10:00:00 GMT)")))) == "2024-05-01 10:00:00"


def test_lookup_must_be_complete(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    full = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    assert D.attach_all(rows, full, "id").count() == 2
    with pytest.raises(Exception, match="no match for id 2"):
        D.attach_all(rows, full.filter("id <> 2"), "id").collect()


def test_nist_against_counters(spark):
    from collections import Counter

    from parleyspark.functions import similarity as S

    rng = random.Random(8)
    rows = [(i, [rng.choice("abcde") for _ in range(rng.randint(3, 9))], [rng.choice("abcde") for _ in range(rng.randint(3, 9))]) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, h array<string>, r array<string>")
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    freq = Counter(g for _, _, r in rows for n in range(1, 6) for g in grams(r, n))
    words = sum(len(r) for _, _, r in rows)
    total = 0.0
    for n in range(1, 6):
        num = den = 0.0
        for _, h, r in rows:
            ch, cr = Counter(grams(h, n)), Counter(grams(r, n))
            den += sum(ch.values())
            for g, c in (ch & cr).items():
                num += c * math.log2((freq[g[:-1]] if n > 1 else words) / freq[g])
        total += num / den if den else 0.0
    ratio = sum(len(h) for _, h, _ in rows) / words
    beta = math.log(0.5) / math.log(1.5) ** 2
    penalty = math.exp(beta * math.log(min(ratio, 1.0)) ** 2)
    assert S.corpus_nist(df, "id", "h", "r").first()["nist"] == pytest.approx(total * penalty)


def test_batch_scorer_and_unique_scores(spark):
    from parleyspark.operators import scoring as Sc

    def load():
        import numpy as np

        return lambda texts: np.array([len(t) / 10 for t in texts], dtype="float64")

    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "hello")], "id int, text string")
    got = {r["id"]: r["score"] for r in Sc.score_unique(df, "text", Sc.batch_scorer(load)).collect()}
    assert got == {1: pytest.approx(0.3), 2: pytest.approx(0.3), 3: pytest.approx(0.5)}


def test_ranks_of_values_that_crowd(spark):
    """Nine tenths of the values lie in a thousandth of the range: buckets stay even."""
    df = spark.range(20_000).select((F.when(F.col("id") % 10 < 9, 0.999 + F.col("id") / 2e7).otherwise(F.col("id") / 20_000)).alias("v"), F.lit(1).alias("n"))
    df = df.groupBy("v").agg(F.sum("n").alias("n"))
    ranked = R.running_before(df, [], "v", ["n"], buckets=64).collect()
    before = 0
    for r in sorted(ranked, key=lambda r: r["v"]):
        assert (r["n_before"], r["n_total"]) == (before, 20_000)
        before += r["n"]


def test_ranks_by_key_over_many_blocks(spark):
    """One key with most of the values, small ones beside it, one of them with NaN; as many blocks as asked for, beyond 256 too."""
    rows = [("hot", float(v), 1) for v in range(3000)] + [("b", 5.0, 2), ("b", 7.0, 3), ("b", float("nan"), 4), ("c", -1.0, 5)]
    df = spark.createDataFrame(rows, "k string, v double, n bigint")
    got = {(r["k"], str(r["v"])): (r["n_before"], r["n_total"]) for r in R.running_before(df, ["k"], "v", ["n"], buckets=300).collect()}
    want = {("hot", str(float(v))): (v, 3000) for v in range(3000)}
    want |= {("b", "5.0"): (0, 9), ("b", "7.0"): (2, 9), ("b", "nan"): (5, 9), ("c", "-1.0"): (0, 5)}
    assert got == want
    assert R.running_before(df.limit(0), ["k"], "v", ["n"]).collect() == []


def test_exact_tests_of_large_counts_are_quick():
    import time
    from math import comb

    from parleyspark.functions import stats

    def fisher(a, b, c, d):
        r1, r2, c1 = a + b, c + d, a + c
        p = lambda x: comb(r1, x) * comb(r2, c1 - x) / comb(r1 + r2, c1)
        return sum(p(x) for x in range(max(0, c1 - r2), min(r1, c1) + 1) if p(x) <= p(a) * (1 + 1e-7))

    for a, b, c, d in [(3, 1, 1, 3), (0, 9, 8, 2), (12, 30, 41, 5), (5, 5, 5, 5), (0, 0, 4, 3), (60, 2, 1, 9)]:
        assert stats.fisher_two_sided(a, b, c, d) == pytest.approx(min(1, fisher(a, b, c, d)), abs=1e-9)
    for k, n in [(0, 5), (3, 10), (5, 10), (70, 90)]:
        low = min(k, n - k)
        assert stats.binomial_two_sided(k, n) == pytest.approx(1 if 2 * low == n else min(1, 2 * sum(comb(n, i) for i in range(low + 1)) / 2**n), abs=1e-9)
    start = time.perf_counter()
    stats.binomial_two_sided(499_990_000, 10**9)
    stats.fisher_two_sided(10**9, 10**9 + 50_000, 10**9 - 20_000, 10**9)
    assert time.perf_counter() - start < 0.5


def test_metrics_of_a_group_without_negatives(spark):
    """Both rates of false positives: none at all, and one minus the specificity of no rows."""
    from parleyspark.operators import metrics as M

    d = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("b", 1, 1), ("b", 0, 1), ("b", 0, 0)], "g string, y int, p int")
    plain = {r["g"]: r["fpr"] for r in M.binary_metrics(M.confusion(d, ["g"], F.col("y"), F.col("p")), ["g"]).collect()}
    spec = {r["g"]: r["fpr"] for r in M.binary_metrics(M.confusion(d, ["g"], F.col("y"), F.col("p")), ["g"], 1.0).collect()}
    assert plain == {"a": None, "b": 0.5} and spec == {"a": 1.0, "b": 0.5}
