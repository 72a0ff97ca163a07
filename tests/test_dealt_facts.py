"""Facts of many lines are dealt to tasks by row counts, with the same results."""

import re

import pytest

from cohortlens.operators import model_ops
from cohortlens.plans import ops_registry
from cohortlens.sources import tables as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("facts"))
    tables = {
        "orders": spark.range(60).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "'F' as o_orderstatus", "1250.0 * id as o_totalprice", "date'2020-01-01' as o_orderdate",
                                             "if(id % 4 = 0, '5-LOW', '1-URGENT') as o_orderpriority"),
        # Two lines without an order, one without a key.
        "lineitem": spark.range(240).selectExpr("if(id = 9, null, id % 62) as l_orderkey", "id % 11 as l_partkey", "id % 3 as l_suppkey", "cast(id % 50 as double) as l_quantity"),
        "part": spark.range(11).selectExpr("id as p_partkey", "'n' as p_name", "'B1' as p_brand", "concat('T', id % 8) as p_type"),
        "customer": spark.range(6).selectExpr("id as c_custkey", "'c' as c_name", "'BUILDING' as c_mktsegment", "cast(id as int) as c_nationkey")}
    for name, df in tables.items():
        df.write.parquet(f"{out}/{name}.parquet")
    return out


QUERIES = {
    "unpivot_scores": ops_registry.q_unpivot_scores, "unmapped_scores": ops_registry.q_unmapped_scores, "star_scores": ops_registry.q_star_scores,
    "check_constraints": lambda spark, d: model_ops.check_constraints(S.DriverTables(spark, d), ["candidate", "candidate_scores", "candidate_disabilities"])}
KEYS = {"check_constraints": {"l_orderkey", "regnumber", "cand_reg_number"}}


@pytest.mark.parametrize("name", QUERIES)
def test_many_lines_are_dealt(spark, folder, monkeypatch, name):
    run = QUERIES[name]
    want = sorted(map(str, run(spark, folder).collect()))
    assert want and "REPARTITION_BY_NUM" not in run(spark, folder)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "FEW_LINES", 100)
    monkeypatch.setattr(S, "TASK_LINES", 20)
    df = run(spark, folder)
    dealt = re.findall(r"hashpartitioning\((\w+)#\w+, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())
    assert KEYS.get(name, {"l_orderkey"}) <= {k for k, _ in dealt} and {n for _, n in dealt} == {"12"}, dealt
    assert sorted(map(str, df.collect())) == want
