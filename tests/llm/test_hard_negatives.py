import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, a int, at int, id string, x string"


def brute(rows):
    fine = set()
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(v is None or not math.isfinite(v) for v in vec):
            continue
        fine.add((vec_id, math.fmod(label + 1, 10) if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(v))) for v in vec)))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = []
    for anchor in fine:
        if anchor[0] % 100:
            continue
        scored = sorted(((-dot(anchor[2], r[2]), r[0], r[1]) for r in fine if r != anchor))
        for s, pid, _ in [r for r in scored if r[2] == anchor[1]][:5]:
            hits = [(n, nid) for n, nid, label in scored if label != anchor[1] and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(anchor[0], pid, i + 1, nid, -s, -n) for i, (n, nid) in enumerate(hits)]
    return sorted(out)


def corpus(seed, n=900, dim=24, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        x = middle[(label + rng.integers(2)) % labels] + rng.choice([0.05, 0.5]) * rng.normal(size=dim)
        rows.append((i, [float(v) for v in np.round(x, rng.integers(0, 3))], label))
    return rows


ODD = [(2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")] * 3, 1), (2300, [float("inf")], 1), (2400, [1.0] * 24, None), (None, [1.0] * 24, 1),
       (2500, [], 1), (2600, [2.0], 2), (2601, [3.0, 1.0], 2), (2602, [2.0], 3), (2700, [0.0] * 24, 1), (2800, [1.0] * 24, -1)]


def found(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, 2, "i", "x") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in H.embedding_negatives(df).collect())


@pytest.mark.parametrize("seed, sizes", [(1, (2048, 4096, 4)), (2, (64, 4, 2)), (3, (32, 2, 3))])
def test_against_brute_force(spark, monkeypatch, seed, sizes):
    for name, v in zip(("ROWS", "ANCHORS", "RUN"), sizes):
        monkeypatch.setattr(H, name, v)
    rows = corpus(seed) + ODD
    rows += rows[100:140] + [(5000 + i, rows[100][1], 1) for i in range(60)] + [(100, rows[101][1], 2)]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 200


def test_hot_label_and_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 64)
    rows = [(i, [1.0, 0.5], 1) for i in range(600)] + [(1000 + i, [0.5, 0.5 if i % 2 else 0.25], 2) for i in range(300)] + [(2000, [1.0, 1.0], 1)]
    assert found(spark, rows) == brute(rows)


def test_empty_and_no_anchors(spark):
    assert found(spark, [], 1) == [] and found(spark, [(1, [1.0], 1), (2, [1.0], 1), (3, [0.5], 2)]) == []
    assert found(spark, [(100, [1.0], 1)]) == []


def test_components_beyond_a_long_fail_openly(spark):
    with pytest.raises(Exception, match="may not fit a long"):
        found(spark, [(100, [1e30], 1), (101, [1e30], 1)])


def test_scan_reads_less_than_everything():
    rng = np.random.default_rng(4)
    n, dim = 4000, 64
    x = np.floor(256 * rng.normal(size=(dim, n)) * np.geomspace(1, 0.01, dim)[:, None]).astype(np.int64)
    block = H.Block(H.pack(np.arange(n)), H.pack(np.zeros(n, np.int64)), [H.pack(c) for c in x])
    anchor = x[:, 0]
    windows = H.Windows(np.array([H._LEAST]), np.array([2**62]), 5)
    read = H.scan(block, anchor, np.ones(n, bool), windows)
    score = anchor @ x
    assert list(windows.id[0]) == list(np.lexsort((np.arange(n), -score))[:5])
    assert read < 0.5 * n * dim


def test_windows_of_any_share(spark):
    rows = corpus(6, 400, 8)
    df = spark.createDataFrame([(i, label, [int(10 * v) for v in x]) for i, x, label in rows], "id long, label long, x array<long>")
    wide = H.hard_negatives(df, F.col("id") % 50 == 0, positives=2, negatives=3, low=-100, high=100).collect()
    for r in wide:
        assert -r.positive_score <= r.negative_score <= r.positive_score and r.rank <= 3
    assert len(wide) == 8 * 2 * 3
