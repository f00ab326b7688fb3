"""Cover trees of points without near neighbours stay small; searches of scattered and of clustered points are exact."""

import numpy as np
import pytest

from parleyspark.llm import cover_tree


def test_scattered_points_are_one_leaf():
    points = np.floor(256 * np.random.default_rng(1).normal(size=(2000, 64)))
    assert len(cover_tree.Tree(points).span) < 100  # about one node for each point before


@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_search_is_exact(spread):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(8, 16))
    points = np.floor(64 * (centres[draw.integers(0, 8, 3000)] + spread * draw.normal(size=(3000, 16))))
    ids = np.arange(3000)
    own = ids % 10 == 0
    got = cover_tree.search(points[own], ids[own], points, ids, 5)
    want = []
    for q in ids[own]:
        scores = (points @ points[q]).astype(np.int64)
        scores[q] = -(10**15)
        want += [(int(q), int(n), int(scores[n])) for n in np.lexsort((ids, -scores))[:5]]
    assert sorted(got) == sorted(want)
