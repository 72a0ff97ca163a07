import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import language_id as L

WORDS = {"en": "the of and that with from this which".split(), "de": "der die und nicht über schön große".split(), "fr": "le été où garçon être deux même".split()}


def text(r, lang, n=30):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(i, text(r, lang), lang) for i, lang in enumerate(list(WORDS) * 60)] + [(None, None, "en"), (9, "x", None)]
    return L.fit_likelihoods(spark.createDataFrame(rows, "id long, text string, language string"))


def test_likelihoods(model):
    names, table = model
    assert names == ["de", "en", "fr"] and table.shape == (4, L.CLASSES)
    assert np.exp(table).sum(axis=1) == pytest.approx([1] * 4)


def test_rare_language_is_known(spark):
    """A language of one document in a thousand, in a script of its own, none
    among the 20,000 smallest id hashes: known as in a small table."""
    rows = spark.range(25_000).withColumn("rare", F.xxhash64("id") > int(2**63 * 0.998))
    rows = rows.withColumn("text", F.when(F.col("rare"), "και το να είναι με από για που δεν ").otherwise("the of and that with from this which ")).withColumn("text", F.repeat("text", 4))
    rows = rows.withColumn("language", F.when(F.col("rare"), "el").otherwise("en")).drop("rare")
    names, table = L.fit_likelihoods(rows)
    assert names == ["el", "en"]
    some = rows.where("language = 'el'").select(F.col("id").alias("doc_id"), "text", F.col("language").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.lit("h").alias("host"), "language")
    got = L.identify(some, names, table).collect()
    assert got and all((g.language, g.accepted) == ("el", True) for g in got)


def test_trigrams_by_plain_loops():
    r = random.Random(2)
    texts = ["".join(r.choice("aB é1 É.\n×") for _ in range(r.randint(0, 30))) for _ in range(200)] + ["", "a", " "]
    owner, code = L._trigrams([t.encode() for t in texts])
    want = []
    for i, t in enumerate(texts):
        raw = []
        for ch in " " + t + " ":
            ch = ch.lower() if "A" <= ch <= "Z" or "À" <= ch <= "Þ" and ch != "×" else ch
            for b in (ch.encode() if ord(ch) > 127 or ch.isalpha() else b" "):
                if b != 32 or not raw or raw[-1] != 32:
                    raw.append(b)
        want += [(i, (((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 0x9E3779B1) % 2**32) >> 16) for k in range(len(raw) - 2)]
    assert list(zip(owner.tolist(), code.tolist())) == want


def evidence(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string, language string")


def test_fusion(spark, model):
    r = random.Random(3)
    rows = [(i, text(r, "de"), "de", "de", "a.shop.de", "x") for i in range(200)] + [(200 + i, text(r, "en"), "en", "com", f"h{i}.news.com", "x") for i in range(200)]
    rows += [(1000, None, "de", None, None, "x"), (1001, "", None, None, "a.shop.de", "x"), (1002, None, None, None, None, "x"),
             (1003, "12 34 !!", None, None, "new.shop.de", "x"), (1004, "qzx wvk jjq xkcd zzq wqp vvx " * 30, "en", "com", None, "x"),
             (1005, text(r, "fr"), "de", "de", "a.shop.de", "x"), (None, text(r, "en"), None, None, None, "x"), (0, rows[0][1], "de", "de", "a.shop.de", "x"),
             (1006, text(r, "en") * 20_000, None, None, None, "x"), (1007, "qxz", None, None, "a.shop.de", "x")]
    got = {}
    out = L.identify(evidence(spark, rows).repartition(4), *model)
    assert out.columns == ["doc_id", "declared", "suffix", "host", "language", "probability", "accepted"]
    out = out.collect()
    assert len(out) == len(rows)
    got = {g.doc_id: (g.language, g.accepted) for g in out}
    assert all(got[i] == ("de", True) for i in range(200)) and all(got[i] == ("en", True) for i in range(200, 400))
    assert got[1000] == ("de", True) and got[1001] == ("de", True) and got[1002] == ("und", False)
    assert got[1004] == ("und", False)  # not like any known language, whatever is declared
    assert got[1005] == ("fr", True)  # a long text outweighs the rest
    assert got[None] == ("en", True) and got[1006] == ("en", True)
    assert got[1007][0] == "de"  # little text: the host decides
    assert not L.identify(evidence(spark, rows), *model, accept=["en"]).where("language = 'de' and accepted").collect()


def test_counts_by_brute_force(spark, model):
    """Posterior of every row against plain sums."""
    names, table = model
    r = random.Random(5)
    rows = [(i, text(r, r.choice(names), r.randint(0, 6)), r.choice([None, *names]), r.choice([None, "com", "de"]), r.choice([None, "a.x.com", "b.x.com", "c.y.de"]), "") for i in range(300)]
    scored = {g.doc_id: (list(g.evidence), g.trigrams) for g in L.text_evidence(evidence(spark, rows), table).collect()}
    best = {i: ([*names, "und"][int(np.argmax(e))] if n else None) for i, (e, n) in scored.items()}
    whole = [sum(b == n for b in best.values()) for n in names]
    domain = lambda h: None if h is None else ".".join(h.split(".")[-2:])

    def counts(k, value):
        return [sum(best[x[0]] == n for x in rows if (domain(x[4]) if k == "d" else x[k]) == value) for n in names]
    for g in L.identify(evidence(spark, rows), names, table).collect():
        x, (e, n) = rows[g.doc_id], scored[g.doc_id]
        prior = [(c + 1) / (sum(whole) + 3) for c in whole]
        for k, v in (("d", domain(x[4])), (4, x[4])):
            c = counts(k, v) if v is not None else [0] * 3
            prior = [(a + 20 * p) / (sum(c) + 20) for a, p in zip(c, prior)]
        score = [e[j] + np.log(prior[j]) for j in range(3)] + [e[3] + np.log(L.UNKNOWN_PRIOR)]
        for k in (2, 3):
            if x[k] is not None:
                c = counts(k, x[k])
                score = [s + np.log((a + 1) / (w + 2)) for s, a, w in zip(score, c, whole)] + [score[3] + np.log((sum(c) + 1) / (sum(whole) + 2))]
        p = np.exp(np.array(score) - max(score))
        if not n and x[2] is None and x[3] is None and x[4] is None:
            assert (g.language, g.probability, g.accepted) == ("und", 0.0, False)
            continue
        assert g.language == [*names, "und"][int(np.argmax(p))] and g.probability == pytest.approx(p.max() / p.sum())


def test_empty_and_page_parts(spark, model):
    assert L.identify(evidence(spark, []), *model).collect() == []
    assert L.identify(evidence(spark, [(1, "x", None, None, None, "")]), *L.fit_likelihoods(spark.createDataFrame([], "id long, text string, language string"))).first().accepted is False
    html = '<!DOCTYPE html><HTML class="x" lang="en-GB"><style>p{}</style><script>a("<b>")</script><p>Text</p><!-- c --></HTML>'
    row = spark.createDataFrame([(html, "http://a.b.co.uk/x")], "h string, u string").select(L.markup_language(F.col("h")).alias("m"), L.visible_text(F.col("h")).alias("t")).first()
    assert row.m == "en" and row.t.split() == ["Text"]


def test_corpus(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    got = L.corpus_languages(docs, pages)
    assert got.count() == docs.count() + pages.count()
    right = got.where("doc_id is not null").groupBy().agg(F.avg((F.col("language") == F.col("declared")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert right[0] > 0.97 and right[1] > 0.98
