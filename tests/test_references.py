"""Scores against several references, and lexicons of any size, against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import similarity as S
from parleyspark.functions import text as T
from parleyspark.operators import lexicon as X


def grams(seq, n):
    return Counter(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))


def plain_nist(hyps, refs, top=5):
    freq, words = Counter(), 0
    for rs in refs:
        for r in rs:
            words += len(r)
            for n in range(1, top + 1):
                freq.update(grams(r, n))
    info = lambda g: math.log2((freq[g[:-1]] if len(g) > 1 else words) / freq[g])
    score, sys_len, ref_len = 0.0, 0, 0
    for n in range(1, top + 1):
        num = den = 0
        for h, rs in zip(hyps, refs):
            found = []
            for r in rs or [[]]:
                met, total = grams(h, n) & grams(r, n), sum(grams(h, n).values())
                gain = sum(info(g) * c for g, c in met.items())
                found.append((round(gain / total, 12) if total else 0, gain, total, len(r)))
            _, gain, total, length = max(found)
            num, den, ref_len, sys_len = num + gain, den + total, ref_len + length, sys_len + len(h)
        score += num / den if den else 0
    ratio = sys_len / ref_len if ref_len else 0
    beta = math.log(0.5) / math.log(1.5) ** 2
    return score * (math.exp(beta * math.log(min(ratio, 1)) ** 2) if ratio > 0 else 0)


def plain_chrf(hyps, refs, top=6):
    sums = [[0, 0, 0] for _ in range(top)]
    for h, rs in zip(hyps, refs):
        h = "".join((h or "").split())
        best = None
        for r in rs or [""]:
            r = "".join((r or "").split())
            rows = []
            for n in range(1, top + 1):
                a, b = grams(h, n), grams(r, n)
                rows.append([sum((a & b).values()), sum(a.values()) if b else 0, sum(b.values())])
            f = S.f_score(rows, 2.0)
            best = (f, rows) if best is None or f > best[0] else best
        sums = [[x + y for x, y in zip(s, r)] for s, r in zip(sums, best[1])]
    return 100 * S.f_score(sums, 2.0)


def cases(seed, n):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice("the cat sat on a mat and ran off again".split()) for _ in range(rng.randint(0, 12)))
    return [(k, text(), [text() for _ in range(rng.randint(0, 3))]) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_several_references(spark, seed):
    rows = cases(seed, 40)
    df = spark.createDataFrame(rows, "k bigint, h string, r array<string>")
    assert S.corpus_chrf_refs(df, "h", "r").first()["chrf"] == pytest.approx(plain_chrf([h for _, h, _ in rows], [r for *_, r in rows]))
    words = df.select("k", T.word_list(F.col("h")).alias("h"), F.transform("r", T.word_list).alias("r"))
    assert S.corpus_nist_refs(words, "k", "h", "r").first()["nist"] == pytest.approx(plain_nist([h.split() for _, h, _ in rows], [[x.split() for x in r] for *_, r in rows]))


def test_by_hand(spark):
    df = spark.createDataFrame([(1, "abc", ["xyz", "abc"])], "k bigint, h string, r array<string>")
    assert S.corpus_chrf_refs(df, "h", "r").first()["chrf"] == pytest.approx(100.0)
    # every word of four is once in four: two bits each; the following words are certain
    words = spark.createDataFrame([(1, ["a", "b"], [["c", "d"], ["a", "b"]])], "k bigint, h array<string>, r array<array<string>>")
    assert S.corpus_nist_refs(words, "k", "h", "r").first()["nist"] == pytest.approx(2.0)


def test_one_reference_is_the_plain_score(spark):
    rows = [(k, h, r[0]) for k, h, r in cases(5, 40) if r]
    df = spark.createDataFrame(rows, "k bigint, h string, r string").select("k", T.word_list(F.col("h")).alias("h"), T.word_list(F.col("r")).alias("r"))
    one = S.corpus_nist(df, "k", "h", "r").first()["nist"]
    assert S.corpus_nist_refs(df.withColumn("r", F.array("r")), "k", "h", "r").first()["nist"] == pytest.approx(one)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k bigint, h string, r array<string>")
    assert S.corpus_chrf_refs(df, "h", "r").first()["chrf"] == 0.0
    words = spark.createDataFrame([], "k bigint, h array<string>, r array<array<string>>")
    assert S.corpus_nist_refs(words, "k", "h", "r").first()["nist"] == 0.0


# --- lexicons -------------------------------------------------------------------------
TEXTS = ["The clowns and a clownish loser.", "Trash, TRASHED tr.a.s.h c l o w n", None, "", "the thesis 12 http://x.y ABC tion tional", "cl0wn! l0sers *loser* losersss"]


def test_large_lexicon_equals_literals(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k bigint, text string")
    stems = ["clown", "trash", "loser", "tion", "the"]
    many = spark.createDataFrame([(s,) for s in [*stems, *stems, None, ""]], "stem string").unionByName(spark.range(200_000).select(F.concat(F.lit("zz"), F.col("id").cast("string")).alias("stem")))
    got = {(r["k"], r["stem"]) for r in X.stem_matches(df, "k", "text", many).collect()}
    padded = df.withColumn("pad", T.padded_content(F.col("text")))
    want = {(r["k"], s) for r in padded.select("k", *[T.stem_hit(F.col("pad"), s).alias(s) for s in stems]).collect() for s in stems if r[s]}
    assert got == want and len(want) >= 6


def test_markers_equal_literals(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k bigint, text string")
    table = spark.createDataFrame([("marker", m.stem, list(m.surfaces), None) for m in C.MARKERS] + [("other", "the", ["the"], "mild")], "kind string, stem string, surfaces array<string>, tier string")
    found = X.marker_matches(df, "k", "text", X.lexicon_table(table, "marker"))
    got = {(r["k"], r["position"]) for r in found.collect()}
    want = {(r["k"], p) for r in df.select("k", T.marker_positions(F.col("text"), C.MARKER_SURFACES).alias("p")).collect() for p in r["p"] or []}
    assert got == want and want
    assert X.marker_matches(df, "k", "text", X.lexicon_table(table, "none")).collect() == []
