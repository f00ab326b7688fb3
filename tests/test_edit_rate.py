"""Translation edit rate: shifts worked out by hand, and a plain edit table, one candidate at a time, on random texts."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from parleyspark.functions import edit_rate as E


@pytest.mark.parametrize(
    "hyp,ref,edits",
    [
        ("", "", 0), ("", "a b", 2), ("a b", "", 2), ("a b c", "a b c", 0), ("d e f", "a b c", 3),
        ("d e f g h a b c", "a b c d e f g h", 1),  # one run moves
        ("c a b", "a b c", 1),
        ("a c b d", "a b c d", 1),
        ("e f c d a b", "a b c d e f", 4),  # two moves would do, but neither alone helps
        ("a b e f g h c d i", "a b c d e f g h i", 1),
        ("b a x", "a b c", 2),  # one move, one replacement
        ("a b c d e f x", "a b c d e f", 1),
        ("the house the blue big", "the big blue house", 3),
    ],
)
def test_by_hand(hyp, ref, edits):
    assert E.translation_edits(hyp.split(), ref.split()) == edits


def plain_table(words, ref):
    """Distance and operations of one text, cell by cell."""
    n, m, inf = len(words), len(ref), math.inf
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    kind = [[2] * (m + 1) for _ in range(n + 1)]
    cost[0] = list(range(m + 1))
    for i in range(1, n + 1):
        ratio = m / n
        half = math.ceil(ratio / 2 + 25) if ratio / 2 > 25 else 25
        mid = math.floor(i * ratio)
        for j in range(max(0, mid - half), m + 1 if i == n else min(m + 1, mid + half)):
            ways = [(cost[i - 1][j - 1] + (words[i - 1] != ref[j - 1]), 0) if j else (inf, 0), (cost[i - 1][j] + 1, 1), (cost[i][j - 1] + 1, 2) if j else (inf, 2)]
            cost[i][j], kind[i][j] = min(ways, key=lambda w: w[0])
    i, j, ops = n, m, []
    while i or j:
        k = 2 if i == 0 else kind[i][j]
        ops.append(k)
        i, j = i - (k != 2), j - (k != 1)
    return cost[n][m], ops[::-1]


def plain_edits(hyp, ref):
    if not hyp or not ref:
        return max(len(hyp), len(ref))
    words, shifts, tried = list(hyp), 0, 0
    while True:
        before, ops = plain_table(words, ref)
        at, bad_ref, bad, i, j = {}, [], [], -1, -1
        for k in ops:
            if k == 0:
                i, j = i + 1, j + 1
                bad.append(words[i] != ref[j])
                bad_ref.append(bad[-1])
                at[j] = i
            elif k == 1:
                i += 1
                bad.append(True)
            else:
                j += 1
                bad_ref.append(True)
                at[j] = i
        best = None
        for s in range(len(words)):
            for r in range(len(ref)):
                if abs(s - r) > 50:
                    continue
                size = 0
                while size < 10 and s + size < len(words) and r + size < len(ref) and words[s + size] == ref[r + size]:
                    size += 1
                    if not any(bad[s : s + size]) or not any(bad_ref[r : r + size]) or s <= at[r] < s + size:
                        continue
                    seen = None
                    for place in range(r - 1, r + size):
                        to = 0 if place < 0 else at[place] + 1
                        if to == seen:
                            continue
                        seen = to
                        run, rest = words[s : s + size], words[:s] + words[s + size :]
                        cut = to if to < s else to - size if to > s + size else to
                        moved = rest[:cut] + run + rest[cut:]
                        tried += 1
                        found = (before - plain_table(moved, ref)[0], size, -s, -to, moved)
                        best = max(best, found, key=lambda f: f[:4]) if best else found
                    if tried >= 1000:
                        break
                if tried >= 1000:
                    break
            if tried >= 1000:
                break
        if tried >= 1000 or not best or best[0] <= 0:
            return shifts + before
        words, shifts = best[4], shifts + 1


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(25):
        ref = [rng.choice("abcdefghij" * 3 + "klmnopqrst") for _ in range(rng.randint(1, 18))]
        hyp = list(ref)
        for _ in range(rng.randint(0, 4)):
            a, b = sorted(rng.randint(0, len(hyp)) for _ in range(2))
            run = hyp[a:b]
            rest = hyp[:a] + hyp[b:]
            to = rng.randint(0, len(rest))
            hyp = rest[:to] + run + rest[to:]
            if rng.random() < 0.5 and hyp:
                hyp[rng.randrange(len(hyp))] = rng.choice("abcxyz")
        assert E.translation_edits(hyp, ref) == plain_edits(hyp, ref)


def test_unlike_lengths():
    rng = random.Random(9)
    for n, m in ((1, 60), (3, 200), (70, 2), (40, 90)):
        hyp, ref = ([rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k)] for k in (n, m))
        assert E.translation_edits(hyp, ref) == plain_edits(hyp, ref)


def test_long_texts_in_bounded_time():
    rng = random.Random(4)
    ref = [f"w{rng.randrange(400)}" for _ in range(5000)]
    hyp = ref[20:40] + ref[:20] + ref[40:]
    rng.shuffle(hyp[3000:])
    start = time.time()
    assert E.translation_edits(hyp, ref) > 0
    assert time.time() - start < 60


def test_corpus(spark):
    rows = [("The Cat sat", ["the cat sat", "a cat sat down"]), ("c a b", ["a b c", "a b c"]), (None, ["one two"]), ("x y", []), ("x", None), ("", [None, ""])]
    df = spark.createDataFrame(rows, "hyp string, refs array<string>")
    got = df.select(E.edit_counts(F.col("hyp"), F.col("refs")).alias("c")).collect()
    assert [(r["c"]["edits"], r["c"]["length"]) for r in got] == [(0, 3.5), (1, 3.0), (2, 2.0), (2, 0.0), (1, 0.0), (0, 0.0)]
    assert tuple(E.corpus_ter(df, "hyp", "refs").first()) == (6, 8.5, 6 / 8.5)
    assert tuple(E.corpus_ter(df.where("false"), "hyp", "refs").first()) == (0, 0.0, 0.0)
