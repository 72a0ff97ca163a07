import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import pitman_yor as P

SCHEMA = "doc_id long, text string, score string, block long"


def tokens(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()] + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check_base(rows, got):
    train = [t for i, x, *_ in rows if not held(i) for t in tokens(x)]
    count, n, v = Counter(train), len(train), len(set(train))
    want = Counter()
    for i, x, *_ in rows:
        own = tokens(x)
        want[(i, held(i), len(own), sum(t in count for t in own), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own), 6))] += 1
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want


def test_stirling_counts_seatings():
    # With discount d, all seatings of 3 customers: 1, 2 or 3 tables.
    d = 0.4
    s = np.exp(P.stirling(d, 4))
    assert s[3, 1:4] == pytest.approx([(1 - d) * (2 - d), 3 * (1 - d), 1])
    assert s[2, 1:3] == pytest.approx([1 - d, 1])


def test_seating_follows_the_exact_conditional():
    d, strength, base, rest = 0.6, 1.0, 0.2, 5
    rng, log_s = np.random.default_rng(3), P.stirling(0.6)
    for c in (2, 5):
        weight = [np.exp(log_s[c, t]) * np.prod([(strength + d * (rest + j)) * base for j in range(t)]) for t in range(1, c + 1)]
        got = P.seat(np.full(200_000, c), np.full(200_000, rest), np.full(200_000, base), d, strength, log_s, rng)
        share = np.bincount(got, minlength=c + 1)[1:] / 200_000
        assert share == pytest.approx(np.array(weight) / sum(weight), abs=0.005)
    assert P.seat(np.array([0, 1]), np.array([3, 3]), np.array([.1, .1]), d, strength, log_s, rng).tolist() == [0, 1]
    large = P.seat(np.array([100_000] * 50), np.zeros(50), np.full(50, 1.0), d, strength, log_s, rng)
    assert 0.5 < np.log(large).mean() / np.log(100_000) < 0.75  # about customers ** discount


def corpus(n=800, seed=1):
    r = random.Random(seed)
    follow = {a: [r.choice("abcdefghijklmnop") for _ in range(3)] for a in "abcdefghijklmnop"}
    rows = []
    for i in range(n):
        out = [r.choice("abcdefgh")]
        for _ in range(r.randint(0, 60)):
            out.append(r.choice(follow[out[-1]]) if r.random() < .8 else r.choice("abcdefghijklmnop"))
        rows.append((i, r.choice([" ", "\n ", "\t"]).join((x.upper() if r.random() < .2 else x) * 2 for x in out), "x", 1))
    rows += [(n, None, "x", 1), (n + 1, "", "x", 1), (n + 2, "never seen words é È", "x", 1), (None, "aa bb aa", "x", 1), (3, rows[3][1], "x", 1), (n + 3, "aa bb " * 100_000, "x", 1)]
    return rows


def test_scores(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = P.document_scores(df).collect()
    check_base(rows, got)
    own = [g for g in got if g.held_out and g.n_tokens < 1000]
    assert len(own) > 50 and all(g.score < 0 for g in got)
    # The model knows what follows what.
    assert sum(g.score for g in own) > 0.85 * sum(g.base_score for g in own)
    empty = [g for g in got if g.n_tokens == 1]
    assert len({round(g.score, 9) for g in empty}) == 1


def test_probabilities_sum_to_one(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(words[:6] if r.random() < .7 else words) for _ in range(40)), "", 1) for i in range(200) if not held(i)]
    # A held-out text asks for every word after w0, the end and an unknown one.
    asking = next(i for i in range(1000, 2000) if held(i))
    rows.append((asking, " ".join(f"w0 {w}" for w in [*words, "unknown"]) + " w0", "", 1))
    model = P.fit(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert model.vocabulary == 31
    found = {}
    for row in model.state.collect():
        me = P.Bucket(bytes(row.pairs))
        for u, p in zip(me.us[me.at].tolist(), P.Predictive(model)(me, P.unpack(bytes(row.kept)))):
            found.setdefault(u, []).append(p)
    whole = [sum(p) for p in found.values() if len(p) == 32]
    assert len(whole) == 1 and whole[0] == pytest.approx(1.0, abs=1e-9)
    assert all(sum(p) < 1 for p in found.values() if len(p) < 32)


def test_sections_of_frequent_contexts(spark, monkeypatch):
    rows = corpus(300, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plain = {(g.doc_id, g.n_tokens): g.score for g in P.document_scores(df).collect()}
    real = P.Sections.__init__

    def many(self, ids, counts):
        real(self, ids, np.full(len(ids), 3))
    monkeypatch.setattr(P.Sections, "__init__", many)
    dealt = {(g.doc_id, g.n_tokens): g.score for g in P.document_scores(df).collect()}
    a, b = sum(plain.values()), sum(dealt.values())
    assert plain.keys() == dealt.keys() and abs(a - b) < 0.02 * abs(a)


def test_empty_table(spark):
    assert P.document_scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = P.document_scores(docs).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    own = [g for g in got if g.held_out]
    assert sum(g.score for g in own) > sum(g.base_score for g in own)
