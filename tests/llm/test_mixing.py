import random
from collections import defaultdict

import pytest

from cohortlens.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def words(text):
    return len((text or "").encode().split())


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += words(text)
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    assert sorted(((g.doc_id, g.source, g.size) for g in got), key=str) == sorted(((r[0], r[2], words(r[1])) for r in rows), key=str)
    by = defaultdict(int)
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(want[g.source])
        assert 0 <= g.taken <= 3 * g.size
        by[g.source] += g.taken
    for s, t in want.items():
        assert abs(by[s] - t) <= 0.5 + 1e-6
    # Whole turns of a stream: what is taken of a source's documents differs by one turn at most.
    for s in want:
        turns = {g.taken // g.size for g in got if g.source == s and g.size}
        assert not turns or max(turns) - min(turns) <= 1


def corpus(seed=1, n=900):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["big"] * 12 + ["b", "c", "Z", "é", None, "tiny"[: r.randint(1, 4)]])
        rows.append((i, r.choice([" ", "\n"]).join(["w"] * r.choice([0, 1, 3, 40, 700])), source, 1, "x"))
    return rows + [(None, "no id here", "b", 1, "x"), (5, None, None, 1, "x"), (7, "same row", "c", 1, "x"), (7, "same row", "c", 1, "x"),
                   (9999, "long " * 200_000, "Z", 1, "x"), (10000, "one", "alone", 1, "x"), (10001, None, "nothing", 1, "x")]


def test_mix_keeps_targets(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    check(rows, got)
    monkeypatch.setattr(mixing, "CHUNK", 64)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("sa", 10_000, 30_000.0, 0.0, 0.3), ("sb", 90_000, 70_000.0, 0.3, 1.0)], "key string, source_size long, target double, lo double, hi double")
    got = [r.key for r in mixing.schedule(targets, 100).orderBy("slot").collect()]
    assert got.count("sa") == 300 and got.count("sb") == 700
    for n in range(1, 1000):
        assert abs(got[:n].count("sa") - 0.3 * n) < 4


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a", 1, ""), (2, " ", None, 1, "")], SCHEMA)).collect()
    assert [(g.size, g.source_size, g.target, g.taken) for g in got] == [(0, 0, 0.0, 0)] * 2


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check(rows, mixing.mix(docs).collect())
