"""op2 sends and keeps its vectors a bounded number of times, with the same groups."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_metric_join import brute

from cohortlens.llm import metric_join as M


def table(spark, rows, kind):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)


def found(df):
    return Counter((g.vec_id, g.n_links, g.component_id, g.kept) for g in df.collect())


def vectors(x, labels):
    return [(i, [float(v) for v in np.float32(row)], int(label)) for i, (row, label) in enumerate(zip(x, labels))]


def test_vectors_without_structure_are_not_copied(spark, monkeypatch):
    """Random vectors lie near all borders: cells that hold them are not split, and their blocks meet in turns."""
    monkeypatch.setattr(M, "CELL_MAX", 256)
    monkeypatch.setattr(M, "BLOCK", 200)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x[2000:] = x[:1000] + rng.choice([0.0, 0.05, 0.25], size=(1000, 1)) * rng.normal(size=(1000, 32))
    rows = vectors(x, np.arange(3000) % 1000 % 2)
    kept, write = {}, M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: kept.setdefault((name, len(kept)), write(df, name)))
    sent = []
    if hasattr(M, "compare_blocks"):
        compare = M.compare_blocks
        monkeypatch.setattr(M, "FEW", 0)
        monkeypatch.setattr(M, "compare_blocks", lambda dealt, *a: sent.append(dealt.groupBy("cell", "a", "b").agg(
            F.sum("rows").alias("rows"), F.countDistinct("own").alias("owns")).collect()) or compare(dealt, *a))
    cells, split = [], M.split_cells
    monkeypatch.setattr(M, "split_cells", lambda *a: cells.append(split(*a).count()) or split(*a))
    assert found(M.cosine_groups(table(spark, rows, "float"))) == brute(rows, 0.98)
    assert max(cells, default=0) <= 1.5 * len(rows), cells
    assert len(sent) > 2 and all(sum(r.rows for r in turn) <= len(rows) for turn in sent)
    pairs = Counter((r.cell, r.a, r.b) for turn in sent for r in turn)
    assert set(pairs.values()) == {1} and len({cell for cell, _, _ in pairs}) == 2
    for cell in {cell for cell, _, _ in pairs}:
        blocks = {b for c, a, b in pairs if c == cell and a == b}
        assert len(blocks) >= 5 and {(a, b) for c, a, b in pairs if c == cell} >= {(a, b) for a in blocks for b in blocks if a <= b}


def test_groups_over_many_turns(spark, monkeypatch):
    """Near copies, vectors of few values and a group in a line, over turns whose links are merged on the way."""
    for name, value in (("CELL_MAX", 32), ("BLOCK", 32), ("FEW", 0), ("LEAF", 8), ("COLUMNS", 16), ("PIECE", 256), ("HELD", 4096)):
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(3)
    near = rng.normal(size=6) + 0.001 * rng.normal(size=(150, 6))
    few = rng.integers(0, 2, size=(100, 6)).astype(float)
    turn = np.linspace(0, 3, 120)
    line = np.stack([np.cos(turn), np.sin(turn), *np.zeros((4, 120))], 1)
    rows = vectors([*near, *few, *line], [0] * 150 + [1] * 100 + [2] * 120)
    merged, merge = [], M._merged
    monkeypatch.setattr(M, "_merged", lambda df: merged.append(1) or merge(df))
    assert found(M.cosine_groups(table(spark, rows, "double"), threshold=0.99)) == brute(rows, 0.99)
    assert merged


def test_links_of_blocks_in_any_density():
    """One block with itself and two with each other, sparse and dense, against all pairs."""
    rng = np.random.default_rng(4)
    for noise in (0.0, 0.02, 0.3):
        x = (rng.normal(size=(7, 20))[rng.integers(7, size=900)] + noise * rng.normal(size=(900, 20))).astype(np.float32)
        n = rng.integers(1, 9, size=900)
        u = M._unit(x)
        hit = (u[:, None] * u[None]).sum(axis=2) >= 0.98
        np.fill_diagonal(hit, True)
        one = M._Links(x, n, 0.98, None)
        one.run(np.arange(900), None)
        assert (one.links == hit @ n).all()
        two = M._Links(x, n, 0.98, None)
        two.run(np.arange(400), np.arange(400, 900))
        assert (two.links[:400] == hit[:400, 400:] @ n[400:]).all() and (two.links[400:] == hit[400:, :400] @ n[:400]).all()
        i, j = np.nonzero(hit)
        assert (one.roots[i] == one.roots[j]).all()
