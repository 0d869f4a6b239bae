"""Paths of next places, by doubling, against a walk."""

import random

import numpy as np

from sensorframe.operators.filters import _ends, _path


def test_ends_and_paths():
    pick = random.Random(1)
    for _ in range(200):
        n = pick.randint(1, 60)
        nxt = np.array([pick.randint(i + 1, min(n, i + pick.choice([1, 3, 60]))) for i in range(n)])
        ends = _ends(nxt)
        for i in range(n):
            walk = [i]
            while nxt[walk[-1]] < n:
                walk.append(int(nxt[walk[-1]]))
            assert ends[i] == walk[-1] and _path(nxt, i).tolist() == walk


def test_long_path():
    nxt = np.arange(1, 1_000_001)
    assert len(_path(nxt, 0)) == 1_000_000 and (_ends(nxt) == 999_999).all()
