import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from test_bpe import library
from test_line_dedup import brute as brute_lines
from test_mixing import plain_targets, words
from test_simhash import brute as brute_fingerprint
from test_simhash import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and that with from this which".split(), "de": "der die und nicht über schön große".split()}


def text(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + str(r.randint(0, 30)) for _ in range(n))


def corpus():
    r = random.Random(4)
    rows = []
    for i in range(200):
        lang = r.choice(["en", "de"])
        body = "\n".join([text(r, lang, r.randint(5, 60)), *(["Read more here now"] if r.random() < .4 else []), text(r, lang, 20)])
        rows.append((i, body, lang, r.choice(["a", "a", "b", "c", None]), len(body)))
    rows += [(300 + k, rows[3][1], "en", "b", 5) for k in range(5)] + [rows[7], rows[7]]
    rows += [(400, None, None, "a", None), (401, "", "en", None, 0), (402, " \n", None, None, 2), (None, text(r, "en", 30), "en", "a", 9), (None, text(r, "en", 30), "en", "a", 9)]
    rows.append((403, text(r, "de", 60_000), "de", "c", 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4)


def rows_of(df):
    assert df.schema.simpleString() == "struct<doc_id:bigint,text:string,lang:string,source:string,n_chars:bigint>"
    return Counter(map(tuple, df.collect()))


def test_stages_are_named():
    assert [f for _, f in C.STAGES] == [C.languages, C.lines, C.near_duplicates, C.mixed, C.tokens] and C.ORACLE_SQL is None


def test_languages_keep_clean_documents(spark, docs):
    kept = rows_of(C.languages(spark, docs, ""))
    every = Counter(corpus())
    gone = every - kept
    assert not kept - every
    assert {r[0] for r in gone} <= {400, 401, 402} and 400 not in {r[0] for r in kept if r[3] is None}
    assert all(not (r[1] or "").strip() for r in gone)


def test_lines_against_brute_force(spark, docs):
    got = C.lines(spark, docs, "").collect()
    want = brute_lines([(r[0], r[1], r[3]) for r in corpus()], 0.1, 2)
    assert sorted(((g.doc_id, g.text, g.source) for g in got), key=str) == sorted(((i, t, h) for i, t, h, _ in want), key=str)
    assert any(n for *_, n in want) and all(g.n_chars == len(g.text) for g in got if g.text and "Read more" not in g.text and g.doc_id is not None and g.doc_id < 200)


def test_near_duplicates_against_brute_force(spark, docs):
    kept = rows_of(C.near_duplicates(spark, docs, ""))
    parts = brute_components({brute_fingerprint(r[1]) for r in corpus()}, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = {}
    for r in corpus():
        groups.setdefault(parts[brute_fingerprint(r[1])], []).append(r)
    assert sum(kept.values()) == len(groups) and not kept - Counter(corpus())
    found = {parts[brute_fingerprint(r[1])]: r for r in kept}
    for g, rows in groups.items():
        ids = [r[0] for r in rows if r[0] is not None]
        assert found[g][0] == (min(ids) if ids else None)


def shares(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    return sizes


def prefix(part, whole):
    return part is not None and whole is not None and whole.startswith(part) and words(part) < words(whole)


def check_mix(rows, got):
    """Every source gives its target's words; of its documents one at most is cut."""
    left, cut = Counter(got), Counter()
    for r in list(left):
        if r not in set(rows):
            mine = [x for x in rows if x[0] == r[0] and x[2:4] == r[2:4] and prefix(r[1], x[1])]
            assert mine and left[r] == 1 and r[4] == len(r[1])
            cut[r[3]] += 1
    assert all(n == 1 for n in cut.values())
    taken = shares(r for r, n in got.items() for _ in range(n))
    for s, t in plain_targets(shares(rows)).items():
        assert abs(taken[s] - t) <= 1, s
    for r, n in got.items():
        if r in set(rows):
            assert n <= 3 * Counter(rows)[r]


def test_mixed_meets_targets(spark, docs):
    clean = [r for r in corpus() if r[0] is not None]
    check_mix(clean, rows_of(C.mixed(spark, spark.createDataFrame(clean, SCHEMA), "")))


def test_mixed_keeps_a_source_of_one_document(spark):
    r = random.Random(2)
    rows = [(1, text(r, "en", 20_000), "en", "a", 1)] + [(10 + i, text(r, "en", 100), "en", "b", 1) for i in range(40)] + [(90, "x y\u00a0z\x0bw", "en", None, 1)]
    rows += [(70, "one two three", "en", "d", 13)] * 7
    got = rows_of(C.mixed(spark, spark.createDataFrame(rows, SCHEMA), ""))
    assert {r[3] for r in got} == {"a", "b", "d", None}
    check_mix(rows, got)


CLASHING = ["mark", "key", "times", "_mark", "_key", "_turn", "row", "group", "n", "i", "size", "_host", "_marks", "_kept", "dropped_lines", "component_id", "fingerprint", "taken"]


def test_stages_keep_columns_of_any_name(spark, docs):
    more = docs
    for k, c in enumerate(CLASHING):
        more = more.withColumn(c, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    more = more.withColumn("a.b", F.lit(1))
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, more, "")
        assert out.columns == more.columns
        plain = stage(spark, docs, "")
        assert Counter(map(tuple, out.select("doc_id", "text", "lang", "source", "n_chars").collect())) == rows_of(plain)
        for r in out.select("doc_id", *CLASHING).collect():
            assert [r[c] for c in CLASHING] == [f"{k}:{'-' if r.doc_id is None else r.doc_id}" for k in range(len(CLASHING))]
    assert C.tokens(spark, more, "").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_tokens(spark, docs):
    got = Counter(map(tuple, C.tokens(spark, docs, "").collect()))
    want = Counter((r[0], len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
                   for r, x in zip(corpus(), library([r[1] for r in corpus()])))
    assert got == want


def test_stages_on_an_empty_table(spark, docs):
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == []


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    out = C.run(spark, folder)
    ids = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.doc_id for r in out.collect()}
    assert got <= ids and len(got) > len(ids) / 3
