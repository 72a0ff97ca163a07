import random
from collections import Counter

import duckdb

from cohortlens.llm import line_dedup as L

SCHEMA = "doc_id long, text string, host string, dropped_lines string, lines int"


def brute(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for r in rows:
        if r[2] is not None:
            pages[r[2]] += 1
            seen.update({(r[2], x) for x in (r[1] or "").split("\n") if x})
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, text, host, *_ in rows:
        if text is None or host is None:
            out.append((i, text, host, 0))
        else:
            lines = text.split("\n")
            kept = [x for x in lines if not x or (host, x) not in bad]
            out.append((i, "\n".join(kept), host, len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        lines = [r.choice(["menu", "foot", "", " menu", "é|x", f"own {r.random()}"]) if r.random() < .6 else f"l{r.randint(0, 60)}" for _ in range(r.randint(0, 9))]
        rows.append((i, "\n".join(lines), r.choice(["a", "a", "a", "b", "c", None, f"single{i}"]), "x", 1))
    rows += [(None, "menu\nmenu", "a", "x", 1), (500, None, "a", "x", 1), (7, *rows[7][1:]), (501, "", "a", "x", 1), (502, "menu\n" * 100_000, "a", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for ratio, least in ((0.1, 3), (0.5, 1)):
        got = L.line_dedup(df, "host", "text", ratio, least)
        assert got.columns == ["doc_id", "text", "host", "lines", "dropped_lines"]
        assert sorted(((g.doc_id, g.text, g.host, g.dropped_lines) for g in got.collect()), key=str) == brute(rows, ratio, least)


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], SCHEMA), "host").collect() == []


def test_pages_match_sql(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(g.page_id, g.host, g.text, g.dropped_lines) for g in L.page_line_dedup(spark.read.parquet(f"{folder}/pages.parquet")).collect()]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet')")
    want = con.execute(f"select page_id, host, text, dropped_lines from ({L.ORACLE})").fetchall()
    assert sorted(rows) == sorted(want) and any(r[3] for r in rows)
    odd = [(1, None, None), (2, "no host", "<p>a<p>b"), (3, "http://H.example/x", ""), (None, "http://h.example", "<P> x </p>\n\n<br/>y<!-- c -->")]
    got = L.page_line_dedup(spark.createDataFrame(odd, "page_id long, url string, html string")).collect()
    assert [(g.host, g.text) for g in got] == [(None, None), (None, "a\nb"), ("h.example", ""), ("h.example", "x\ny")]
