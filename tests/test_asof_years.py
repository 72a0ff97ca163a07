"""As-of joins and period normalisation against brute force; yearly folders in one scan."""

import datetime as dt
import os
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import model_ops, resolve, upsert
from cohortlens.operators.asof import asof_join, normal_periods
from conftest import rows

DAY = dt.date(2000, 1, 1)
PERIODS = "k string, f date, e date, v string"


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def brute_value(periods, key, when):
    """What the rules of normal_periods say for one date, period by period."""
    if key is None or when is None:
        return None
    mine = sorted({(f, e, v) for k, f, e, v in periods if k == key and (f is None or e is None or f < e)}, key=lambda p: (p[0] is not None, p[0] or 0))
    starts = {}
    for f, e, v in mine:
        best = starts.get(f)
        rank = (e is None, e or 0, v is not None, v or "")
        if best is None or rank > best[0]:
            starts[f] = (rank, e, v)
    chain = []
    for f, (_, e, v) in starts.items():
        if chain and chain[-1][2] == v and (chain[-1][1] is None or f is None or f <= chain[-1][1]):
            old = chain[-1][1]
            chain[-1] = (chain[-1][0], None if old is None or e is None else max(old, e), v)
        else:
            chain.append((f, e, v))
    last = None
    for f, e, v in chain:
        if f is None or f <= when:
            last = (e, v)
    return last[1] if last and (last[0] is None or when < last[0]) else None


NUM = st.one_of(st.none(), st.integers(0, 12))
PERIOD = st.tuples(st.sampled_from(["a", "b", None]), NUM, NUM, st.sampled_from(["x", "y", None]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(periods=st.lists(PERIOD, max_size=12))
def test_asof_against_brute_force(spark, periods):
    p = spark.createDataFrame([(k, day(f), day(e), v) for k, f, e, v in periods], PERIODS)
    ask = [(i, k, n) for i, (k, n) in enumerate([(k, n) for k in ("a", "b", "c", None) for n in [None, *range(-1, 14)]])]
    df = spark.createDataFrame([(i, k, day(n)) for i, k, n in ask + ask[3:5]], "id int, k string, d date")
    normal = normal_periods(p, ["k"], "f", "e", ["v"])
    out = Counter((r["id"], r["got"]) for r in asof_join(df, normal, [("k", "k")], F.col("d"), "f", "e", {"v": "got"}).collect())
    assert out == Counter((i, brute_value(periods, k, n)) for i, k, n in ask + ask[3:5])
    spans = rows(normal)
    for a in spans:
        for b in spans:
            if a is not b and a["k"] == b["k"]:
                first, then = sorted((a, b), key=lambda s: (s["f"] is not None, s["f"] or DAY))
                assert first["e"] is not None and then["f"] is not None and first["e"] <= then["f"]
                assert not (first["e"] == then["f"] and first["v"] == then["v"])


def test_overlapping_names_keep_one_row_each(spark):
    names = spark.createDataFrame([("I1", day(0), day(10), "A", "a"), ("I1", day(5), None, "B", "b"), ("I1", day(5), day(7), "C", "c"), ("I1", day(8), day(9), "D", "d")],
                                  "inid string, effective_from date, effective_to date, inname string, inabv string")
    df = spark.createDataFrame([(n, "I1", day(n)) for n in range(-1, 12)], "inname int, inid string, d date")
    out = rows(model_ops.institution_name_asof(df, "d", names), "inname")
    assert [r["name_asof"] for r in out] == [None] + ["A"] * 5 + ["B"] * 3 + ["D"] + [None] * 3
    assert list(out[0]) == ["inname", "inid", "d", "name_asof", "abv_asof"]


def test_a_hot_key_is_dealt_to_parts(spark):
    df = spark.range(2000).select(F.lit("a").alias("k"), F.col("id"), F.date_add(F.lit(DAY), (F.col("id") % 30).cast("int")).alias("d"))
    p = spark.createDataFrame([("a", day(n), day(n + 1), f"v{n}") for n in range(0, 30, 2)], PERIODS)
    out = asof_join(df, p, [("k", "k")], F.col("d"), "f", "e", {"v": "got"})
    assert out.count() == 2000
    assert {(r["id"] % 30, r["got"]) for r in out.collect()} == {(n, f"v{n}" if n % 2 == 0 else None) for n in range(30)}


def test_mapping_of_each_rows_date(spark):
    m = spark.createDataFrame([(2023, "X", "I", "C0", None), (2023, "X", "I", "C1", day(5)), (2023, "X", "I", "C9", day(5)), (2023, "X", "I", "C2", day(9))],
                              "year int, old_course_code string, institution_id string, new_course_code string, mapping_date date")
    df = spark.createDataFrame([(n or -9, "X", 2023, "I", day(n)) for n in (None, 1, 4, 5, 8, 9, 99)] + [(100, "Y", 2023, "I", day(9)), (101, "X", 2023, None, day(9))],
                               "n int, course_code string, year int, institution_id string, d date")
    out = {r["n"]: (r["course_code"], r["remapped"]) for r in resolve.remap_course_codes(df, m, date_col="d").collect()}
    assert out == {-9: ("X", False), 1: ("C0", True), 4: ("C0", True), 5: ("C1", True), 8: ("C1", True), 9: ("C2", True), 99: ("C2", True),
                   100: ("Y", False), 101: ("X", False)}


def test_yearly_folders_are_one_scan(spark, tmp_dir):
    def put(name, data, ddl):
        spark.createDataFrame(data, ddl).write.parquet(os.path.join(tmp_dir, name))
        return os.path.join(tmp_dir, name)
    paths = [put("candidates_2019", [("A", 1)], "regnumber string, aggregate int"), put("candidates_2020", [("B", 2**40, "x")], "regnumber string, aggregate long, email string"),
             put("candidates_2021", [("C", 3.5 and None)], "regnumber string, aggregate int")]
    df = upsert.read_years(spark, paths)
    assert dict(df.dtypes) == {"regnumber": "string", "aggregate": "bigint", "email": "string", "year": "int"}
    assert sorted(map(tuple, df.select("regnumber", "aggregate", "email", "year").collect())) == [("A", 1, None, 2019), ("B", 2**40, "x", 2020), ("C", None, None, 2021)]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    with pytest.raises(ValueError, match="aggregate"):
        upsert.read_years(spark, [paths[0], put("candidates_2022", [("D", "x")], "regnumber string, aggregate string")])
    with pytest.raises(Exception, match="needs its year"):
        upsert.read_years(spark, [put("candidates", [("E", 1)], "regnumber string, aggregate int")]).collect()
    with pytest.raises(ValueError, match="already"):
        upsert.read_years(spark, [put("candidates_2023", [("E", 1)], "regnumber string, year int")])
