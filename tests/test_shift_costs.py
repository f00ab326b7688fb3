"""Costs of shifts from the rows they change and the costs of the rest, against a table of the whole shifted text."""

import numpy as np

from parleyspark.functions import edit_rate as E


def test_distances_equal_whole_tables():
    draw = np.random.default_rng(3)
    for n, m, words in [(1, 1, 2), (12, 9, 3), (40, 45, 5), (150, 60, 8), (60, 200, 8), (130, 130, 20)]:
        text, ref = (draw.integers(0, words, x).astype(np.int32) for x in (n, m))
        table, moves = E.Table(text, ref), []
        for _ in range(60):
            start = int(draw.integers(0, n))
            moves.append(E._moved(text, start, int(draw.integers(1, min(10, n - start) + 1)), int(draw.integers(0, n + 1))))
        moves = [x for x in moves if x[1] > x[0]]
        whole = [E.Table(np.concatenate([text[:a], w, text[b:]]), ref).distance for a, b, w in moves]
        assert table.distances(moves).tolist() == whole


def test_rows_follow_the_change_not_the_text(monkeypatch):
    """A long text tries its shifts without going down to its end: the table's rows are the only ones taken."""
    draw = np.random.default_rng(4)
    text, ref = (draw.integers(0, 500, 3000).astype(np.int32) for _ in range(2))
    table, taken, own = E.Table(text, ref), [], E._next_row
    monkeypatch.setattr(E, "_next_row", lambda *a: taken.append(1) or own(*a))
    table.distances([E._moved(text, k, 3, k + 20) for k in range(0, 1000, 7)])
    assert not taken
