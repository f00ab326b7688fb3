"""Edit rates of many pairs in step: the results of one table at a time, and rows that do not follow the number of pairs."""

import numpy as np
import pandas as pd

from parleyspark.functions import edit_bits
from parleyspark.functions import edit_rate as E


def drawn(seed, pairs):
    draw, out = np.random.default_rng(seed), []
    for _ in range(pairs):
        n, words = int(draw.integers(1, 90)), int(draw.choice([2, 6, 30, 200]))
        m = int(np.clip(n * draw.choice([0.1, 0.5, 0.9, 1, 1.1, 2, 6, 12]), 1, 250))
        hyp, ref = ([f"w{x}" for x in draw.integers(0, words, k)] for k in (n, m))
        if draw.random() < 0.4:  # the same words with runs that have moved
            hyp = list(ref)
            for _ in range(4):
                a, b = sorted(int(x) for x in draw.integers(0, len(hyp) + 1, 2))
                rest = hyp[:a] + hyp[b:]
                to = int(draw.integers(0, len(rest) + 1))
                hyp = rest[:to] + hyp[a:b] + rest[to:]
        out.append((hyp, ref))
    return out


def plain(hyp, ref):
    number = {}
    return E._by_table(*(np.array([number.setdefault(w, len(number)) for w in x], np.int32) for x in (hyp, ref)))


def test_many_pairs_equal_single_tables():
    pairs = drawn(1, 150)
    assert E.edits_of_pairs([*pairs, ([], ["a"]), (["a"], []), ([], [])]) == [*(plain(*x) for x in pairs), 1, 1, 0]


def test_groups_of_pairs_do_not_matter(monkeypatch):
    pairs = drawn(2, 60)
    want = E.edits_of_pairs(pairs)
    monkeypatch.setattr(E, "TOGETHER", 100)
    monkeypatch.setattr(edit_bits, "BLOCK", 16)
    assert E.edits_of_pairs(pairs) == want


def test_bound_of_tries(monkeypatch):
    """Tries end at the same shift."""
    pairs = drawn(3, 40)
    for most in (1, 5, 40):
        monkeypatch.setattr(E, "TRIED", most)
        assert E.edits_of_pairs(pairs) == [plain(*x) for x in pairs]


def test_rows_are_taken_for_all_pairs_at_once(monkeypatch):
    """No table of a single pair is made, and steps follow the longest text and its shifts, not the pairs."""
    draw, alone, together = np.random.default_rng(4), [], []
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 40, 60)) for _ in range(201)]
    own, step = E._next_row, edit_bits.Rows.step
    monkeypatch.setattr(E, "_next_row", lambda *a: alone.append(1) or own(*a))
    monkeypatch.setattr(edit_bits.Rows, "step", lambda *a: together.append(1) or step(*a))
    got = E._edit_counts.func(pd.Series(texts[:200]), pd.Series([[t] for t in texts[1:]]))
    assert len(got) == 200 and not alone and len(together) < 200 * 60
