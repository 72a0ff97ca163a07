import numpy as np
import pytest

from cohortlens.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, label int"


def brute(rows, every, k):
    good = {}
    for i, x, *_ in rows:
        if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x) and any(x):
            good.setdefault(i, []).append(np.array(x, np.float32).astype(float))
    out = {}
    for q in (q for q in good if q % every == 0):
        scored = sorted((-max(float(a @ b) for a in good[q] for b in xs), i) for i, xs in good.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 24))
    x[1000:1400] = x[1000] + 0.05 * rng.normal(size=(400, 24))
    x[2000:2100] *= 10
    rows = [(i, [float(v) for v in a], "c", 1, 2) for i, a in enumerate(x)]
    got = ann.forest_search(spark.createDataFrame(rows, SCHEMA), every=60, k=20, search=1.6, sample=1500, leaf=32).collect()
    want = brute(rows, 60, 20)
    found = {}
    for g in got:
        found.setdefault(g.query_id, {})[g["rank"]] = (g.vec_id, g.score)
    assert set(found) == set(want)
    hits = 0
    for q, ranks in found.items():
        assert sorted(ranks) == list(range(1, 21))
        own = [ranks[i] for i in range(1, 21)]
        assert own == sorted(own, key=lambda r: (-r[1], r[0]))
        for i, s in own:
            assert s == pytest.approx(float(x[q].astype(np.float32).astype(float) @ x[i].astype(np.float32).astype(float)), abs=1e-9)
        hits += len({i for i, _ in own} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_odd_rows_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)]
    rows += [(100 + i, [float(v) for v in rng.normal(size=3)]) for i in range(60)]
    rows += [(400, None), (420, []), (440, [0.0, 0.0, 0.0]), (460, [1.0, None, 2.0]), (480, [float("nan"), 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0]),
             (None, [1.0, 2.0, 3.0]), (520, [1.0, 2.0]), (7, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 3.0])]
    rows = [(*r, "x", 1, 1) for r in rows]
    got = ann.forest_search(spark.createDataFrame(rows, SCHEMA).repartition(3), every=20, k=5, search=10.0, sample=64, leaf=4).collect()
    want = {q: v for q, v in brute([r for r in rows if r[1] is None or len(r[1]) == 3], 20, 5).items()}
    found = {}
    for g in sorted(got, key=lambda g: (g.query_id, g["rank"])):
        found.setdefault(g.query_id, []).append((g.vec_id, g.score))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_repeats_take_one_place(spark):
    """A near row that stands 30 times, and an id of 30 near vectors, are one candidate each."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(50)]
    rows += [(1000, [9.0, 9.0, 9.0, 9.0])] * 30 + [(1001, [8.0, 8.0, 8.0, 8.0 + j / 64]) for j in range(30)]
    rows = [(*r, "x", 1, 1) for r in rows]
    got = ann.forest_search(spark.createDataFrame(rows, SCHEMA).repartition(3), every=20, k=20, search=10.0, leaf=200).collect()
    want = brute(rows, 20, 20)
    found = {}
    for g in sorted(got, key=lambda g: (g.query_id, g["rank"])):
        found.setdefault(g.query_id, []).append(g.vec_id)
    assert found == {q: [i for i, _ in v] for q, v in want.items()} and all(len(v) == 20 for v in found.values())


def test_recall_with_a_third_equal_vectors(spark):
    """At the production parameters: copies on the way of the queries, but not
    among their nearest, take nothing of the others' search."""
    rng = np.random.default_rng(4)
    x, d = rng.normal(size=(3000, 64)), rng.normal(size=64)
    x[:1000] = d
    x[1000:1200] += 0.25 * d
    ids = np.concatenate([1 + 20 * np.arange(1000), 20 * np.arange(200), 2 + 20 * np.arange(1800)])
    rows = [(int(i), [float(v) for v in a], "x", 1, 1) for i, a in zip(ids, x)]
    got = ann.forest_search(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {q: {i for i, _ in v} for q, v in brute(rows, 20, 20).items()}
    found = {}
    for g in got:
        found.setdefault(g.query_id, set()).add(g.vec_id)
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    others = [q for q, v in want.items() if not any(i % 20 == 1 for i in v)]
    assert len(others) > 100 and sum(len(found[q] & want[q]) for q in others) >= 0.98 * 20 * len(others)


def test_few_rows(spark):
    assert ann.forest_search(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(0, [1.0, 0.0], "", 0, 0), (1, [0.5, 0.5], "", 0, 0), (2, [-1.0, 0.0], "", 0, 0)]
    got = ann.forest_search(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(g.query_id, g["rank"], g.vec_id, g.score) for g in got] == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
