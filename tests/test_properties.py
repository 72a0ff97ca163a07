"""Property tests (hypothesis) for report and import invariants."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortlens.operators import ingest, reports as R, upsert
from cohortlens.sources.tables import FrameTables

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

cand_rows = st.lists(st.tuples(
    st.integers(min_value=0, max_value=400) | st.none(),
    st.sampled_from(["M", "F", None]),
    st.integers(min_value=2020, max_value=2023)), min_size=0, max_size=30)


@SETTINGS
@given(cand_rows)
def test_band_counts_and_gender_bounds(spark, data):
    df = spark.createDataFrame([(f"R{i}", a, g, y) for i, (a, g, y) in enumerate(data)],
                               "regnumber string, aggregate int, gender string, year int")
    t = FrameTables(spark, candidate=df)
    bands = sum(r["count"] for r in R.score_distribution(t).collect())
    assert bands == sum(1 for a, _, _ in data if a is not None)
    genders = sum(r["count"] for r in R.gender_stats(t).collect())
    assert genders <= len(data)
    years = {r["year"]: r for r in R.year_comparison(t).collect()}
    for y, r in years.items():
        assert r["female_candidates"] + r["male_candidates"] <= r["total_candidates"]


raw_values = st.sampled_from(["", " ", "12", " 7 ", "x", "n/a", "M", "female", "yes", "0", None])


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["A", "B", "", " C "]), raw_values, raw_values, raw_values),
                max_size=25))
def test_good_plus_bad_is_input(spark, data):
    df = spark.createDataFrame(data, "REGNUMBER string, AGGREGATE string, GENDER string, IS_ADMITTED string")
    checked = ingest.clean_candidates(ingest.map_columns(df))
    good, bad = ingest.split_valid(checked)
    assert good.count() + bad.count() == len(data)


batch_rows = st.lists(st.tuples(st.sampled_from(["A", "B", "C", "D"]),
                                st.sampled_from(["x", "", None, "y"]),
                                st.integers(min_value=0, max_value=9) | st.none(),
                                st.integers(min_value=1, max_value=5)), max_size=12)


@SETTINGS
@given(batch_rows)
def test_upsert_idempotent_and_blank_never_erases(spark, data):
    target = spark.createDataFrame([("A", "old", 1), ("B", "old", 2)],
                                   "regnumber string, surname string, aggregate int")
    batch = spark.createDataFrame(data, "regnumber string, surname string, aggregate int, _seq int")
    once = upsert.upsert_candidates(target, batch)
    twice = upsert.upsert_candidates(once, batch)
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    res = {r[0]: r for r in a}
    for key in ("A", "B"):
        assert res[key][1] is not None            # blank / NULL never erased a surname
    assert len(res) == len({"A", "B"} | {k for k, *_ in data})


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


short_text = st.text(alphabet="abc ", min_size=0, max_size=7)


@SETTINGS
@given(st.lists(short_text, min_size=1, max_size=8), st.lists(short_text, min_size=1, max_size=8), st.integers(0, 2))
def test_theta_joins_match_brute_force(spark, lefts, rights, k):
    from cohortlens.operators import theta
    # Repeated rows keep their number; long texts are in the way of nothing.
    lefts, rights = [*lefts, *lefts[:2], "a" * 1200], [*rights, rights[0]]
    l_df = spark.createDataFrame([(i % 3, s) for i, s in enumerate(lefts)], "li int, a string")
    r_df = spark.createDataFrame([(j % 2, s) for j, s in enumerate(rights)], "ri int, b string")
    want = sorted((i % 3, j % 2) for i, a in enumerate(lefts) for j, b in enumerate(rights) if len(a) < 100 and _lev(a, b) <= k)
    got = sorted((r["li"], r["ri"]) for r in theta.edit_distance_pairs(l_df, "a", r_df, "b", k).collect())
    assert got == want
    want_c = sorted((i % 3, j % 2) for i, a in enumerate(lefts) for j, b in enumerate(rights) if b and b in a)
    got = sorted((r["li"], r["ri"]) for r in theta.contains_pairs(l_df, "a", r_df, "b").collect())
    assert got == want_c


def test_edit_distance_bound_is_checked(spark):
    from cohortlens.operators import theta
    df = spark.createDataFrame([("a",)], "a string")
    for k in (-1, 3):
        with pytest.raises(ValueError):
            theta.edit_distance_pairs(df, "a", df.withColumnRenamed("a", "b"), "b", k)


def test_cluster_conf_bounds():
    from cohortlens.session import cluster_conf
    small = cluster_conf(8, 40 << 20)
    assert int(small["spark.sql.files.maxPartitionBytes"]) >= 1 << 20
    assert 24 <= int(small["spark.sql.shuffle.partitions"]) <= 80
    big = cluster_conf(8000, 100 << 40)
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 128 << 20
    assert int(big["spark.sql.shuffle.partitions"]) == 80000
