"""The two vector searches against brute force."""

import numpy as np
import pytest

from ledgerlens.llm import curves, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def vectors(n, d=24, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, d)]) for i in range(n)]


ODD = [
    (60_000, None), (60_001, []), (60_002, [None] * 24), (60_003, [float("nan")] * 24),
    (60_050, [float("inf")] + [0.0] * 23), (None, [0.1] * 24), (60_100, [0.5, 0.25]), (60_150, [0.5, 0.5]),
]


def brute_scores(rows, every, k):
    ints = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows}
    found = []
    for q in ints:
        if q % every == 0:
            best = sorted(
                (-int(ints[q] @ ints[c]), c) for c in ints if c != q and len(ints[c]) == len(ints[q])
            )
            found += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best[:k])]
    return sorted(found)


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 90)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rows = vectors(600)
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    # Rows repeated under one id stand for one vector.
    frame = table(spark, rows + rows[:5] + ODD)
    got = sorted(tuple(r) for r in topk.top_k(frame, every=10).collect())
    assert got == brute_scores(rows + ODD[-2:], 10, 5)


def test_components_of_any_size_take_part(spark):
    rng = np.random.default_rng(4)
    rows = vectors(30, 8)
    large = [[0.0, *map(float, rng.normal(0, 2.0**n, 7).astype(np.float32))] for n in range(10, 21)]
    rows += [(100 + i, v) for i, v in enumerate(large)] + [(200, [2.0**36] + [0.0] * 7)]
    exact = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in exact:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(exact[q], exact[c])), c) for c in exact if c != q)
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best[:5])]
    got = sorted(tuple(r) for r in topk.top_k(table(spark, rows), every=5).collect())
    assert got == sorted(want)
    # A score among the best that 64 bits cannot hold is an error, not another number.
    large = np.full((1, 256), float(1 << 30))
    with pytest.raises(OverflowError):
        topk.search(large, np.array([0]), np.repeat(large, 2, 0), np.array([0, 1]), 5)
    best, _ = topk.search(large, np.array([0]), np.vstack([-large * 4, large / 64]), np.array([1, 2]), 1)
    assert best == [(0, 2, 2**62)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 60, (20, 64))
    rows = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 8, (4000, 64)))
    for length in topk.SEGMENTS:
        stats = topk.statistics(rows[:200], length)
        assert (stats @ stats.T + 1e-6 >= rows[:200] @ rows[:200].T).all()
    ids = np.arange(4000)
    _, scored = topk.search(rows[:20], ids[:20], rows, ids, 5)
    assert scored < 20 * 4000 / 4


def test_few_candidates_and_empty_table(spark):
    assert topk.top_k(table(spark, [])).count() == 0
    assert curves.nearest(table(spark, [])).count() == 0
    assert topk.top_k(table(spark, [(0, [0.5, 0.5])])).count() == 0
    assert curves.nearest(table(spark, [(0, [0.5, 0.5])])).count() == 0
    two = table(spark, [(0, [0.5, 0.5]), (1, [-0.5, 0.1])])
    assert [tuple(r) for r in topk.top_k(two).collect()] == [(0, 1, 1, 128 * -128 + 128 * 25)]
    assert [tuple(r)[:3] for r in curves.nearest(two).collect()] == [(0, 1, 1)]


def brute_nearest(rows, every, k):
    found = {}
    for q, v in rows:
        if q % every == 0:
            best = sorted(
                (-float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), c)
                for c, w in rows if c != q and len(w) == len(v)
                for a, b in [(np.array(v, float), np.array(w, float))]
            )
            found[q] = [(c, -s) for s, c in best[:k]]
    return found


def test_nearest_finds_nine_of_ten_and_all_copies(spark):
    rows = vectors(3000, 64, seed=2)
    rows += [(5000 + i, rows[0][1]) for i in range(300)]
    frame = table(spark, rows + ODD + [(60_200, [0.0] * 64)])
    found = {}
    for r in curves.nearest(frame).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    true = brute_nearest(rows + ODD[-2:], 50, 5)
    assert set(found) == set(true)
    hit = total = 0
    for q, best in true.items():
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        hit += len({c for c, _ in best} & {c for _, c, _ in own})
        total += len(best)
        lookup = dict(best)
        # The very number that the original vectors give.
        assert all(s == lookup[c] for _, c, s in own if c in lookup)
    assert hit / total >= 0.9
    # Among equal vectors the smallest ids win, for each of them that asks.
    assert [c for _, c, _ in sorted(found[5050])] == [0, 5000, 5001, 5002, 5003]
    assert [c for _, c, _ in sorted(found[0])] == [5000, 5001, 5002, 5003, 5004]


def test_nearest_within_clusters_of_near_copies(spark):
    """Clusters below and above the rows of a window, tight and tighter, and parallel vectors."""
    rng = np.random.default_rng(9)
    parts = []
    for n, spread in ((60, 0.05), (300, 0.02), (300, 1e-4), (2500, 0.02)):
        parts.append(rng.normal(size=64) + spread * rng.normal(size=(n, 64)))
    parts.append(rng.integers(1, 9, 64) * np.arange(1, 61)[:, None] / 8)
    values = np.concatenate(parts).astype(np.float32)
    labels = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    found = {}
    for r in curves.nearest(table(spark, rows), every=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    units = curves.unit(values.astype(np.float64))
    hits = {}
    for q in range(0, len(rows), 20):
        scores = units @ units[q]
        scores[q] = -2
        if labels[q] == 4:  # all alike: the smallest ids win
            same = [i for i in np.flatnonzero(labels == 4).tolist() if i != q][:5]
            assert [c for _, c in sorted(found[q])] == same
            continue
        best = set(np.argsort(-scores, kind="stable")[:5].tolist())
        hits.setdefault(int(labels[q]), []).append(len(best & {c for _, c in found[q]}) / 5)
    assert all(np.mean(own) >= 0.9 for own in hits.values()), {c: np.mean(o) for c, o in hits.items()}


def test_hilbert_visits_every_cell_by_single_steps():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = curves.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
