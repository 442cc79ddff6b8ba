"""Tuning by a population: shares against plain Python, and against one climb."""

import random

import numpy as np

from tessera.operators import rank, tuning


def seeded(n=400, seed=5):
    """Pairs that two of three hidden rules tell apart: one line of weights can't."""
    rnd = random.Random(seed)
    rules = [[5, -3, 0, 0, 1, 0], [0, 0, 4, -5, 0, 2], [-2, 0, 3, 0, 0, 5]]
    sign = lambda a, b: 0 if a > 0 and b > 0 and abs(a - b) / (a + b) < 0.125 else (a > b) - (a < b)
    rows = []
    while len(rows) < n:
        x, y = ([rnd.randint(0, 40) for _ in range(6)] for _ in range(2))
        votes = sum(sum(w * sign(a, b) for w, a, b in zip(r, x, y)) < 0 for r in rules)
        rows.append((x, y) if votes >= 2 else (y, x))
    return rows, sign


def share_of(nets, rows, sign):
    signs = np.array([[sign(a, b) for a, b in zip(x, y)] for x, y in rows], float)
    good = sum((net.judge(signs) == -1).astype(int) for net in nets)
    return float((2 * good > len(nets)).mean())


def test_population_is_better_than_one_climb(spark):
    rows, sign = seeded()
    pairs = spark.createDataFrame(rows, "left array<int>, right array<int>")
    out = tuning.evolved(pairs, 6, seed=3)
    assert abs(out.share - share_of(out.nets, rows, sign)) < 1e-12 and len(out.nets) % 2 == 1
    assert list(out.shares) == list(tuning.PHASES) and sorted(out.shares.values()) == list(out.shares.values())
    _, climbed = rank.tuned(pairs, [0.0] * 6)
    assert out.share > climbed and out.share > 0.85


def test_committees_and_layers(spark):
    rows, sign = seeded(120, 8)
    rng = np.random.default_rng(2)
    one, two, three = (tuning.random_net(6, layers, 3, rng) for layers in (1, 2, 3))
    table = tuning.sign_table(spark.createDataFrame(rows + [(None, [1] * 6)], "left array<int>, right array<int>"))
    groups = [[one], [two], [three], [one, two, three]]
    got = {r["copy"]: r["right"] / r["total"] for r in tuning.population_scores(table, groups).collect()}
    assert all(abs(got[i] - share_of(c, rows, sign)) < 1e-12 for i, c in enumerate(groups))
    assert two.rows == 3 and three.judge(np.zeros((1, 6))).tolist() == [0]
    kept = tuning.varied(one, 0.5, rng)
    assert [k[:4] for k in kept.links] == [k[:4] for k in one.links]


def test_start_and_empty_tables(spark):
    pairs = spark.createDataFrame([([i + 5, 1], [i, 9]) for i in range(20)], "left array<int>, right array<int>")
    good = rank.Net(2, 2, 2, ((0, 0, 1, 0, 0), (0, 1, 1, 0, 1)))
    out = tuning.evolved(pairs, 2, start=[good], groups=1, members=2, phases={"restart": 1, "combo": 1})
    assert out.share == 1.0
    none = tuning.evolved(pairs.limit(0), 2, groups=1, members=2, phases={"restart": 1, "solo": 1})
    assert none.share == 0.0 and len(none.nets) == 1
