"""The wide score file has a column for every subject, and all are read."""

import pytest

from cohortlens.plans import ops_registry
from cohortlens.sources.tables import DriverTables


@pytest.fixture(params=[0, 3, 9])
def folder(spark, tmp_dir, request):
    n = request.param
    tables = {
        "orders": spark.range(40).selectExpr("id as o_orderkey", "date'2020-01-01' as o_orderdate"),
        # Lines repeat; one has no order, one no key.
        "lineitem": spark.range(200).selectExpr("if(id = 9, null, id % 41) as l_orderkey", "id % 13 as l_partkey", "cast(id % 50 as double) as l_quantity"),
        "part": spark.range(13 if n else 0).selectExpr("id as p_partkey", f"if(id = 12, null, concat('T', id % {max(n, 1)})) as p_type")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_dir}/{name}.parquet")
    return tmp_dir, n


def test_all_subjects(spark, folder):
    d, n = folder
    scores = [(r.cand_reg_number, r.year, r.subject_id, r.score) for r in DriverTables(spark, d).candidate_scores.collect()]
    assert len({r[2] for r in scores}) == n
    got = ops_registry.q_unpivot_scores(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted((*r[:2], r[2], r[2], r[3]) for r in scores)
    lost = ops_registry.q_unmapped_scores(spark, d).collect()
    assert sorted(map(tuple, lost)) == sorted((*r[:2], "S6", r[3], "unknown subject code: S6") for r in scores if r[2] == 6)
