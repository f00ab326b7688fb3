"""Near copies at Jaccard similarity 0.8 and above, which SimHash at two bits leaves."""

import itertools
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from parleyspark.llm import shingle_sets, simhash


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def brute(texts, least=0.8):
    root = {i: i for i in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, j in itertools.combinations(sorted(texts), 2):
        if jaccard(texts[i], texts[j]) >= least:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in texts}


def copies(seed, bases, each, words=200, changes=(0, 1, 2, 3, 4, 6, 8)):
    """Texts with copies of which some words are changed: similarities from about 0.65 to 1."""
    draw, texts = np.random.default_rng(seed), {}
    for _ in range(bases):
        base = [f"w{x}" for x in draw.integers(0, 5000, words)]
        texts[len(texts)] = " ".join(base)
        for _ in range(each):
            copy = list(base)
            for at in draw.choice(words, int(draw.choice(changes)), replace=False):
                copy[at] = f"v{draw.integers(0, 10**9)}"
            texts[len(texts)] = " ".join(copy)
    return texts


@pytest.fixture(scope="module")
def frame(spark):
    return lambda texts: spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stage_takes_planted_copies(spark, frame):
    texts = copies(1, 30, 2)
    found = sorted(jaccard(texts[b], texts[b + k]) for b in range(0, len(texts), 3) for k in (1, 2))
    assert sum(0.8 <= x < 0.95 for x in found) >= 15 and sum(x < 0.8 for x in found) >= 8
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(texts), "").collect()}
    assert left == set(brute(texts).values())


@pytest.mark.parametrize("crowd", [2, 64])
def test_components_of_large_groups(frame, crowd):
    """Groups above and below the crowd's size, with chains: copies of one base that link through it."""
    texts = copies(2, 3, 60, changes=(1, 2, 3, 4, 5))
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.near_copies(frame(texts), crowd=crowd).collect()}
    assert got == brute(texts)


def test_similarity_is_exact(frame):
    """Pairs at 0.8, which link, and just below, which do not; texts without words are one document."""
    words = [f"w{k}" for k in range(40)]
    at = " ".join(words[:12]), " ".join(words[:14])  # 8 and 10 shingles, 8 common: 0.8
    below = " ".join(words[20:35]), " ".join(words[20:38])  # 11 and 14 shingles, 11 common: 0.786
    texts = dict(enumerate([*at, *below, "", " "]))
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.near_copies(frame(texts), bands=60, rows=1).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}


def test_stage_takes_fingerprint_links(spark, frame):
    """Texts of one repeated line and words of their own: equal fingerprints, sets that are not similar."""
    own = lambda k: " ".join(f"v{k}x{i}" for i in range(20))
    texts = {k: "a b c " * 100 + own(k) for k in range(4)} | {k: own(k) for k in (10, 11)}
    assert len({simhash.fingerprint(texts[k].encode(), 3) for k in range(4)}) == 1 and jaccard(texts[0], texts[1]) < 0.1
    texts[12] = texts[11] + " and one more word here"[:4]  # a similar set besides
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(texts), "").collect()}
    assert left == {0, 10, 11}


def crowded(seed=7):
    """Near copies in pairs, all of one template, of which each pair has a seventh in words of its own: no two pairs are similar."""
    draw, texts = np.random.default_rng(seed), {}
    for k in range(80):
        one = [f"w{x}" for x in range(174)] + [f"v{k}x{x}" for x in range(26)]
        two = list(one)
        for at in draw.choice(34, 4, replace=False) * 5:
            two[at] = f"u{draw.integers(0, 10**9)}"
        texts[2 * k], texts[2 * k + 1] = " ".join(one), " ".join(two)
    return texts


def test_all_similar_sets_of_crowded_buckets_link(frame):
    """Every near copy is found, also where it stands in crowded buckets only and meets two other sets there."""
    texts = crowded()
    want = brute(texts)
    assert len(set(want.values())) == 80 and 0.7 < jaccard(texts[0], texts[2]) < 0.8
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.near_copies(frame(texts), bands=8, crowd=8, near=1).collect()}
    assert got == want


def test_pairs_are_decided_in_shares(frame, monkeypatch):
    monkeypatch.setattr(shingle_sets, "SHARE", 0.05)
    monkeypatch.setattr(shingle_sets, "GROUP", 4)
    texts = copies(5, 1, 90, changes=(3, 4, 5))
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.near_copies(frame(texts), crowd=4, near=1).collect()}
    assert got == brute(texts)


def test_first_shingles_hold_all_similar_pairs(spark):
    """Random sets of unlike sizes: every pair at 0.8 or more is among the pairs, few others are."""
    draw, sets = np.random.default_rng(3), []
    for k in range(120):
        n = int(draw.integers(1, 60))
        own = draw.integers(-(2**63), 2**63, n, np.int64)
        sets.append(np.unique(own))
        sets.append(np.unique(np.concatenate([own[int(draw.integers(0, max(1, n // 4))) :], draw.integers(-(2**63), 2**63, int(draw.integers(0, 4)), np.int64)])))
    df = spark.createDataFrame([(k, k, x.tolist()) for k, x in enumerate(sets)], "node bigint, component bigint, hashes array<bigint>")
    got = {(r["a"], r["b"]) for r in shingle_sets.across(df, 0.8, 2).collect()}
    alike = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(x := np.intersect1d(sets[a], sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(x))}
    assert alike and alike <= got and len(got) < 2 * len(alike) + 60
