import itertools
import random

import numpy as np
import xxhash

from cohortlens.llm import simhash
from cohortlens.llm.components import connected_components


def brute(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(keys), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_masks_cover_every_small_difference():
    for seed in (1, 2):
        masks = simhash.covering_masks(4, seed)
        assert len(masks) == 31
        positions = [sum((m >> i & 1) << t for t, m in enumerate(masks)) for i in range(64)]
        for four in itertools.combinations(range(64), 4):
            hit = 0
            for i in four:
                hit |= positions[i]
            assert hit != (1 << 31) - 1


def test_spark_hash_is_the_same(spark):
    row = spark.sql("select xxhash64('the of and to') h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"the of and to", 42)


def test_groups_match_brute_force(spark, monkeypatch):
    r = random.Random(2)
    words = ["the", "of", "AND", "to", "éa", "x1", "Tion", "re", "İ", "K"]
    texts = [None, "", " \n", "a b", "A B", "one", "a b c d"]
    for _ in range(25):
        base = [r.choice(words) + str(r.randint(0, 40)) for _ in range(r.randint(30, 300))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = "changed"
            texts.append(r.choice([" ", "\n", "\t "]).join(copy))
    texts.append("long text of many words " * 30_000)
    rows = [(7 + 3 * i, t, "x") for i, t in enumerate(texts)] + [(None, texts[3], "x"), (None, "no other like this", "x"), (7, texts[0], "x")]
    want_fp = [brute(t) for _, t, _ in rows]
    parts = brute_components(set(want_fp), lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for (i, _, _), fp in zip(rows, want_fp):
        if i is not None:
            first[parts[fp]] = min(i, first.get(parts[fp], i))
    want = sorted([(i, f"{fp:016x}", first.get(parts[fp])) for (i, _, _), fp in zip(rows, want_fp)], key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    for limit in (1 << 14, 3):
        monkeypatch.setattr(simhash, "BUCKET_MAX", limit)
        got = [(g.doc_id, g.fingerprint, g.component_id) for g in simhash.simhash_groups(df).collect()]
        assert sorted(got, key=str) == want


def test_dense_and_random_fingerprints(spark, monkeypatch):
    r = random.Random(6)
    centre = r.getrandbits(64)
    fps = {r.getrandbits(64) for _ in range(300)}
    for _ in range(400):
        x = centre
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = brute_components(set(signed), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4)
    for limit in (1 << 14, 50):
        monkeypatch.setattr(simhash, "BUCKET_MAX", limit)
        edges = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
        got = {x.node: x.component for x in connected_components(edges, "a", "b").collect()}
        assert {x: got.get(x, x) for x in signed} == want


def test_empty_table(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(5, i) for i in range(200, 260)] + [(3, 3), (None, 2), (260, 5), (5, 260)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {i: 50 for i in range(50, 91)} | {i: 5 for i in [5, *range(200, 261)]}
