import random

import numpy as np
import pytest

from cohortlens.llm import toxicity as T


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice("abcdefghij") + r.choice(["and", "tion", "er", "ou"]) for _ in range(r.randint(3, 60))]
        low, toxic = int(r.random() < .2), 0
        if low:
            words = [w + "%%%" for w in words] + ["clickbait"]
        if r.random() < (.4 if low else .08):
            toxic = 1
            words[r.randrange(len(words))] = r.choice(["Idiot", "scum!", "lowei" + r.choice(["xa", "yb", "zc", "qd"])])
        rows.append((i, " ".join(words), low, toxic))
    return rows


def test_held_out_accuracy_and_chain(spark):
    rows = made(3000, 1)
    df = spark.createDataFrame(rows, "id long, text string, low_quality int, toxic int")
    chain = T.train(df.where("id < 2000"), ["low_quality", "toxic"])
    assert [len(m["earlier"]) for m in chain] == [0, 1]
    got = {g.id: g for g in T.apply_chain(df.where("id >= 2000"), chain, id_col="id").collect()}
    for c, k in (("low_quality", 2), ("toxic", 3)):
        assert np.mean([getattr(got[r[0]], c) == bool(r[k]) for r in rows[2000:]]) > 0.98
        assert all((getattr(got[r[0]], c + "_probability") >= .5) == getattr(got[r[0]], c) for r in rows[2000:])


def test_out_of_fold_scores_are_used():
    # The first category is noise: fitted on itself it looks sure, out of fold it is worth nothing.
    rng = np.random.default_rng(0)
    x = T.Rows([rng.choice(400, 12, replace=False) for _ in range(300)])
    noise = rng.integers(0, 2, 300)
    chain = T.fit_chain(x, np.stack([noise, noise], 1), 400)
    assert abs(chain[1].weights[-1]) < 1.0


def test_odd_rows(spark):
    rows = made(300, 2) + [(1, None, 0, 0), (None, "idiot", 0, 1), (5, "x", None, 1), (6, "", 0, 0)]
    docs = spark.createDataFrame([(r[0], r[1], "t", 1) for r in rows] + [(900, "idiot " * 50_000, "t", 1)], "doc_id long, text string, toxic string, low_quality int")
    labels = spark.createDataFrame([(r[0], None if r[2] is None else 1 - r[2], r[3]) for r in rows if r[0] != 7], "doc_id long, quality int, toxic int")
    got = T.document_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 1 and sum(g.doc_id is None for g in got) == 1
    assert {g.doc_id: g.toxic for g in got}[900] and not [g for g in got if g.doc_id == 6][-1].toxic
    assert T.document_toxicity(docs.limit(0), labels).collect() == []
    assert len(T.document_toxicity(docs, labels.limit(0)).collect()) == len(rows) + 1


def test_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    chain_docs = T.document_toxicity(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id")
    rows = chain_docs.select("toxic", "truth").collect()
    caught = np.mean([r.toxic for r in rows if r.truth])
    false = np.mean([r.toxic for r in rows if not r.truth])
    assert len(rows) > 1000 and caught > 0.88 and false < 0.01, (caught, false)
