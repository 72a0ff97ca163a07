from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import metric_join as M

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, cid long, kept int"


def brute(rows, t):
    fine = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    units = [np.array(r[1]) / np.linalg.norm(r[1]) if f else None for r, f in zip(rows, fine)]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and units[i] @ units[j] >= t:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    out = []
    for i, r in enumerate(rows):
        c = low.get(find(i)) if fine[i] else r[0]
        out.append((r[0], links[i], c, r[0] is not None and r[0] == c))
    return Counter(out)


def corpus(seed=1, n=700, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, dim))
    rows = []
    for i in range(n):
        x = base[rng.integers(60)] + rng.choice([0.0, 0.02, 0.06, 0.12]) * rng.normal(size=dim)
        rows.append((i, [float(v) for v in x * rng.choice([1, 3])], int(rng.choice([0, 0, 0, 1, 2]))))
    rows += [(n + i, [1.0, 0.0, -0.0, 0, 0, 0, 0, 1], 0) for i in range(40)] + [(n + 100, [1.0, -0.0, 0.0, 0, 0, 0, 0, 1], 0)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dim, 1), (903, [1.0, None] + [0.0] * 6, 1), (904, [float("nan")] + [1.0] * 7, 1),
             (905, [float("inf")] + [1.0] * 7, 1), (906, rows[0][1], None), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (None, rows[3][1], rows[3][2]),
             (None, [9.0, 1.0, 2.0], 5), (5, rows[5][1], rows[5][2])]
    return [(*r[:1], None if r[1] is None else [None if v is None else float(v) for v in r[1]], r[2], "x", 1, 2) for r in rows]


@pytest.mark.parametrize("cell, block", [(2048, 2048), (40, 16)])
def test_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(M, "CELL_MAX", cell)
    monkeypatch.setattr(M, "BLOCK", block)
    rows = corpus()
    got = M.cosine_groups(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert Counter((g.vec_id, g.n_links, g.component_id, g.kept) for g in got) == brute(rows, 0.98)


def test_near_copies_meet_in_blocks(spark, monkeypatch):
    """No task holds more than two blocks of a group that pivots can't split,
    such a group is not copied, and another label's cell is split all the same."""
    monkeypatch.setattr(M, "CELL_MAX", 64)
    monkeypatch.setattr(M, "BLOCK", 32)
    rng = np.random.default_rng(6)
    near = rng.normal(size=8) + 0.001 * rng.normal(size=(400, 8))
    far = rng.normal(size=(6, 8))[rng.integers(6, size=200)] + 0.01 * rng.normal(size=(200, 8))
    rows = [(i, [float(v) for v in x], int(i >= 400), "x", 1, 2) for i, x in enumerate([*near, *far])]
    split, dealt = [], []
    join, cut = M.join_cells, M.split_cells
    monkeypatch.setattr(M, "split_cells", lambda *a: split.append(a[1].count()) or cut(*a))
    monkeypatch.setattr(M, "join_cells", lambda cells, t: dealt.append(cells.groupBy("cell").count().collect()) or join(cells, t))
    got = M.cosine_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((g.vec_id, g.n_links, g.component_id, g.kept) for g in got) == brute(rows, 0.98)
    sizes = sorted(r["count"] for r in dealt[0])
    assert split[0] == 1 and sizes[-1] == 400 and sum(s == 400 for s in sizes) == 1 and sizes[-2] < 200


def test_empty_table(spark):
    assert M.cosine_groups(spark.createDataFrame([], SCHEMA)).collect() == []
