"""Stored tables: all canonical ones, facts co-partitioned by registration number."""

import os
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import model_ops
from cohortlens.operators import reports as R
from cohortlens.sources import tables as S
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("stored") / "x y")
    derived = S.DriverTables(spark, SF_SMALL)
    S.materialize(derived, out, buckets=4)
    return derived, S.StoredTables(spark, out)


def same(a, b):
    key = sorted
    return key(map(str, map(tuple, a.collect()))) == key(map(str, map(tuple, b.select(*a.columns).collect())))


def test_every_canonical_table_is_stored(pair):
    derived, stored = pair
    assert stored.co_partitioned and not derived.co_partitioned
    for name in S.CANONICAL_TABLES:
        assert same(derived.table(name), stored.table(name)), name


def test_operators_give_the_same_on_stored_tables(pair):
    derived, stored = pair
    for fn in (R.top_subjects, R.subject_correlation, R.year_comparison, R.institution_ranking, model_ops.candidate_profiles,
               lambda t: model_ops.check_constraints(t), lambda t: model_ops.candidate_star(t, dims=["state", "disabilities", "scores"]),
               lambda t: model_ops.disability_stats(t.candidate("regnumber", "year", "statecode").join(t.candidate_disabilities, F.col("cand_reg_number") == F.col("regnumber"))),
               lambda t: model_ops.institution_name_asof(t.candidate("regnumber", "inid", "year").selectExpr("*", "make_date(year, 1, 1) as d"), "d", t.institution_names),
               lambda t: model_ops.institution_profiles(t.institution, t.institution_names)):
        assert same(fn(derived), fn(stored))


KEYS = {"regnumber", "cand_reg_number", "o_orderkey", "l_orderkey", "_k", "_cd", "_cs"}


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df):
    """Hash exchanges on a candidate's number in the plan, by their first key."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [k for k in re.findall(r"Exchange hashpartitioning\((\w+)#", plan) if k in KEYS]


def test_per_candidate_work_needs_no_exchange(pair, no_broadcast):
    def joined(t):
        return t.candidate("regnumber", "aggregate").join(t.candidate_exam_info, F.col("cand_reg_number") == F.col("regnumber"))
    for fn in (joined, model_ops.candidate_profiles, lambda t: model_ops.candidate_star(t, dims=["disabilities", "scores"])):
        old, new = (exchanges(fn(t)) for t in pair)
        # Joins with dimensions move rows by the dimension's key; those with facts must not move the facts.
        assert old and len(new) < len(old), (old, new)
    assert exchanges(joined(pair[1])) == []


def test_top_subjects_moves_no_candidate(pair):
    assert exchanges(R.top_subjects(pair[1])) == [] and exchanges(R.top_subjects(pair[0]))
    assert exchanges(R.subject_correlation(pair[1])) == []


def test_a_folder_without_buckets_is_read_as_before(spark, tmp_dir):
    path = os.path.join(tmp_dir, "candidate")
    spark.createDataFrame([("A", 2020)], "regnumber string, year int").write.partitionBy("year").parquet(path)
    t = S.StoredTables(spark, tmp_dir, tables=["candidate"])
    assert not t.co_partitioned and t.candidate("regnumber").collect()[0][0] == "A"


def test_loading_again_replaces_the_table(spark, tmp_dir):
    for n in (5, 3):
        cand = spark.range(n).selectExpr("id as regnumber", "cast(2020 + id % 2 as int) as year")
        S.materialize(S.FrameTables(spark, candidate=cand), tmp_dir, tables=["candidate"], buckets=2)
        assert S.StoredTables(spark, tmp_dir, tables=["candidate"]).candidate().count() == n


def test_constraints_of_facts_move_no_candidate(pair, no_broadcast):
    def keys(t):
        plan = model_ops.check_constraints(t)._jdf.queryExecution().executedPlan().toString()
        return set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)), plan.count("Scan parquet")
    moved, scans = keys(pair[1])
    # Only entries (by domain, value) and their sums move, and each fact is read a few times, not once a rule.
    assert not moved & (KEYS | {"_key", "_p0"}), moved
    assert keys(pair[0])[0] & KEYS and scans < 30
