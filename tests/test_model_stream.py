"""Data-model operators (D1-D7, N6, N7, S5) and the streaming import (S10)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cohortlens import schemas
from cohortlens.operators import ingest, model_ops
from cohortlens.sources.tables import FrameTables
from cohortlens.streaming import incremental
from conftest import rows


def test_asof_interval_bounds(spark):
    names = spark.createDataFrame([
        ("I1", "2000-01-01", "2010-01-01", "Old", "O"),
        ("I1", "2010-01-01", None, "New", "N")],
        "inid string, effective_from string, effective_to string, inname string, inabv string") \
        .select("inid", F.to_date("effective_from").alias("effective_from"),
                F.to_date("effective_to").alias("effective_to"), "inname", "inabv")
    df = spark.createDataFrame([("a", "I1", "1999-12-31"), ("b", "I1", "2000-01-01"), ("c", "I1", "2009-12-31"),
                                ("d", "I1", "2010-01-01"), ("e", "I1", "2030-01-01"), ("f", "I2", "2005-01-01")],
                               "k string, inid string, d string").withColumn("d", F.to_date("d"))
    out = {r["k"]: r["name_asof"] for r in model_ops.institution_name_asof(df, "d", names).collect()}
    assert out == {"a": None, "b": "Old", "c": "Old", "d": "New", "e": "New", "f": None}


def test_unpivot_and_disability(spark):
    wide = spark.createDataFrame([("R1", 2023, 50, None, 70)], "cand_reg_number string, year int, S1 int, S2 int, X9 int")
    m = spark.createDataFrame([("S1", 1, 1), ("S2", 2, 2)], "csv_code string, su_id int, position int")
    out = rows(model_ops.unpivot_scores(wide, m))
    assert out == [{"cand_reg_number": "R1", "year": 2023, "subject_id": 1, "position": 1, "score": 50}]
    lost = rows(model_ops.unmapped_scores(wide, m))
    assert lost == [{"cand_reg_number": "R1", "year": 2023, "csv_code": "X9", "score": 70, "error_message": "unknown subject code: X9"}]
    c = spark.createDataFrame([(2023, 1, True, False), (2023, 1, None, True), (2023, 2, False, None)],
                              "year int, statecode int, is_blind boolean, is_deaf boolean")
    d = {r["statecode"]: r for r in rows(model_ops.disability_stats(c))}
    assert (d[1]["blind"], d[1]["deaf"], d[1]["candidates"]) == (1, 1, 2)


def test_constraints_detect_violations(spark):
    cand = spark.createDataFrame([("A", 1, 2023, "x" * 101), ("A", 9, 2023, "ok"), ("B", None, None, "ok")],
                                 "regnumber string, statecode int, year int, surname string")
    state = spark.createDataFrame([(1, "LAGOS")], "st_id int, st_name string")
    t = FrameTables(spark, candidate=cand, state=state)
    got = {(r["table"], r["rule"]): r["violations"] for r in
           model_ops.check_constraints(t, tables=["candidate", "state"]).collect()}
    assert got[("candidate", "pk(regnumber)")] == 1
    assert got[("candidate", "not_null(year)")] == 1
    assert got[("candidate", "length(surname)<=100")] == 1
    assert got[("state", "pk(st_id)")] == 0


def test_regions_json_and_rollup(spark, tmp_dir):
    p = os.path.join(tmp_dir, "regions.json")
    with open(p, "w") as f:
        json.dump(schemas.REGIONS, f)
    regions = model_ops.read_regions(spark, p)
    pairs = {(r["region"], r["st_name"]) for r in regions.collect()}
    assert len(pairs) == sum(len(v) for v in schemas.REGIONS.values())
    assert ("north_central", "NASSARAWA") in pairs        # alias applied
    cand = spark.createDataFrame([("A", 1, 100), ("B", 2, 200), ("C", 1, 101)], "regnumber string, statecode int, aggregate int")
    state = spark.createDataFrame([(1, "LAGOS"), (2, "KANO")], "st_id int, st_name string")
    out = {(r["region"], r["st_name"]): r for r in
           rows(model_ops.region_summary(FrameTables(spark, candidate=cand, state=state), regions))}
    assert out[("south_west", "LAGOS")]["candidates"] == 2 and out[("south_west", "LAGOS")]["avg_score"] == 100.5
    assert out[(None, None)]["candidates"] == 3
    # every candidate counts, also without a state or outside every region
    cand = spark.createDataFrame([("A", 1, 100), ("B", 3, 200), ("C", None, 300)], "regnumber string, statecode int, aggregate int")
    state = spark.createDataFrame([(1, "LAGOS"), (3, "FOREIGNER")], "st_id int, st_name string")
    out = {(r["level"], r["region"], r["st_name"]): r["candidates"] for r in
           rows(model_ops.region_summary(FrameTables(spark, candidate=cand, state=state), regions))}
    assert out[("total", None, None)] == 3 and out[("region", "unassigned", None)] == 2
    assert out[("state", "unassigned", "FOREIGNER")] == 1 and out[("state", "unassigned", "unassigned")] == 1


def test_constraint_rules_each_violated(spark):
    t = FrameTables(spark, candidate=spark.createDataFrame([("A", 1, 2023)], "regnumber string, statecode int, year int"),
                    state=spark.createDataFrame([(1, "LAGOS")], "st_id int, st_name string"),
                    institution=spark.createDataFrame([("I1", "U", "Uni", 1, 9)], "inid string, inabv string, inname string, inst_state_id int, affiliated_state_id int"),
                    institution_names=spark.createDataFrame([("I1", None, "x"), ("I2", "2000-01-01", None)], "inid string, effective_from string, inname string"),
                    subject=spark.createDataFrame([(1, "s" * 101)], "su_id int, su_name string"),
                    subject_mapping_2023=spark.createDataFrame([("C" * 11, 5, 1)], "csv_code string, su_id int, position int"),
                    candidate_disabilities=spark.createDataFrame([("A",), ("Z",), ("Z",)], "cand_reg_number string"),
                    candidate_exam_info=spark.createDataFrame([("A", 7)], "cand_reg_number string, mock_state_id int"),
                    course_code_mappings=spark.createDataFrame([(1, "x" * 101), (1, "y"), (None, "z")], "id int, new_course_code string"),
                    historical_course_codes=spark.createDataFrame([(1, "x"), (2, "x" * 101)], "id int, old_course_code string"))
    tables = ["course_code_mappings", "historical_course_codes", "candidate", "state", "institution", "institution_names", "subject", "subject_mapping_2023", "candidate_disabilities", "candidate_exam_info"]
    got = {(r["table"], r["rule"]): r["violations"] for r in model_ops.check_constraints(t, tables=tables).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("course_code_mappings", "pk(id)"): 1, ("course_code_mappings", "not_null(id)"): 1,
        ("course_code_mappings", "length(new_course_code)<=100"): 1, ("historical_course_codes", "length(old_course_code)<=100"): 1,
        ("institution", "fk(affiliated_state_id->state.st_id)"): 1, ("institution_names", "fk(inid->institution.inid)"): 1,
        ("institution_names", "not_null(effective_from)"): 1, ("institution_names", "not_null(inname)"): 1,
        ("subject", "length(su_name)<=100"): 1, ("subject_mapping_2023", "length(csv_code)<=10"): 1,
        ("subject_mapping_2023", "fk(su_id->subject.su_id)"): 1, ("candidate_disabilities", "pk(cand_reg_number)"): 1,
        ("candidate_disabilities", "fk(cand_reg_number->candidate.regnumber)"): 2, ("candidate_exam_info", "fk(mock_state_id->state.st_id)"): 1}


def test_negative_averages_round_away_from_zero(spark):
    from cohortlens.functions.exprs import round_avg
    df = spark.createDataFrame([(-5, 2), (5, 2), (-1, 8), (1, 8), (3, 0)], "s long, n long")
    assert [r[0] for r in df.select(round_avg("s", "n")).collect()] == [-2.5, 2.5, -0.13, 0.13, None]


def test_star_and_patterns(spark):
    cand = spark.createDataFrame([("A", 1, "C1", True), ("B", 2, "C2", False), ("C", 7, None, True)],
                                 "regnumber string, statecode int, app_course1 string, is_admitted boolean")
    state = spark.createDataFrame([(1, "LAGOS"), (2, "KANO")], "st_id int, st_name string")
    course = spark.createDataFrame([("C1", "Law", 1), ("C2", "Medicine", 1)], "course_code string, course_name string, facid int")
    t = FrameTables(spark, candidate=cand, state=state, course=course)
    star = model_ops.candidate_star(t, dims=["state", "course"],
                                    cand_cols=["regnumber", "statecode", "app_course1", "is_admitted"])
    assert star.count() == 3                               # left joins keep C
    assert {r["st_name"]: r["count"] for r in model_ops.count_by(star, "st_name", is_admitted=True).collect()} \
        == {"LAGOS": 1, None: 1}
    assert [r["regnumber"] for r in model_ops.filter_state(star, "lagos").collect()] == ["A"]
    assert {r["regnumber"] for r in model_ops.filter_course(star, names=["Law"], like="%dic%").collect()} == {"A", "B"}


def test_profiles_nested(spark):
    cand = spark.createDataFrame([("A", "Ade", "M", 200, 2023, 1, 10)],
                                 "regnumber string, surname string, gender string, aggregate int, year int, statecode int, lg_id int")
    t = FrameTables(spark, candidate=cand,
                    state=spark.createDataFrame([(1, "LAGOS")], "st_id int, st_name string"),
                    lga=spark.createDataFrame([(10, "IKEJA")], "lg_id int, lg_name string"),
                    subject=spark.createDataFrame([(1, "ENG"), (2, "MATH")], "su_id int, su_name string"),
                    candidate_disabilities=spark.createDataFrame([("A", True, False, "sight")], "cand_reg_number string, is_blind boolean, is_deaf boolean, other_challenges string"),
                    candidate_exam_info=spark.createDataFrame([("Z", "T", "C", "N", 1, False)], "cand_reg_number string, exam_town string, exam_centre string, exam_number string, mock_state_id int, is_mock_candidate boolean"),
                    candidate_scores=spark.createDataFrame([("A", 2, 2023, 70), ("A", 1, 2023, 60)],
                                                           "cand_reg_number string, subject_id int, year int, score int"))
    p = json.loads(model_ops.candidate_profiles(t).collect()[0]["profile"])
    assert p["state"]["st_name"] == "LAGOS" and p["lga"]["lg_name"] == "IKEJA"
    assert [s["su_name"] for s in p["scores"]] == ["ENG", "MATH"]
    assert p["disabilities"] == {"is_blind": True, "is_deaf": False, "other_challenges": "sight"} and p["exam_info"] is None


def lines_of(spark, path):
    return spark.read.text(path).select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_path"),
                                        F.col("_metadata.file_block_start").alias("_block"))


def test_stream_and_batch_read_headers_by_name(spark, tmp_dir):
    """Files with swapped, missing and extra columns give one table, by stream or batch."""
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    files = {"a.csv": "REGNUMBER,SURNAME,AGGREGATE\nR1,Ade,200\n", "b.csv": "surname, regnumber ,EXTRA\nObi,R2,x\n\"open,R9,x\n",
             "c.csv": "AGGREGATE,REG NUMBER\n150,R3\n"}
    for name, text in files.items():
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    opts = ingest.ImportOptions(year=2024)
    batch, stream = os.path.join(tmp_dir, "batch"), os.path.join(tmp_dir, "stream")
    ingest.run_candidate_import(spark, src, batch, batch + "-e", opts)
    incremental.start_import(spark, src, stream, stream + "-e", opts, checkpoint=os.path.join(tmp_dir, "ck")).awaitTermination(120)
    for path in (batch, stream):
        out = sorted((r["regnumber"], r["surname"], r["aggregate"]) for r in spark.read.parquet(path).collect())
        assert out == [("R1", "Ade", 200), ("R2", "Obi", None), ("R3", None, 150)]
        bad = spark.read.parquet(path + "-e").collect()
        assert len(bad) == 1 and "malformed CSV row" in bad[0]["error_message"] and bad[0]["raw"] == '"open,R9,x'


def test_streams_keep_their_own_quarantine(spark, tmp_dir):
    target, errors = os.path.join(tmp_dir, "cand"), os.path.join(tmp_dir, "errors")
    for k in (1, 2):
        src = os.path.join(tmp_dir, f"in{k}")
        os.makedirs(src)
        with open(os.path.join(src, "f.csv"), "w") as f:
            f.write(f"REGNUMBER,AGGREGATE\nR{k},x\n")
        incremental.start_import(spark, src, target, errors, ingest.ImportOptions(year=2024),
                                 checkpoint=os.path.join(tmp_dir, f"ck{k}")).awaitTermination(120)
    assert spark.read.parquet(errors).count() == 2
    with pytest.raises(ValueError):
        incremental.start_import(spark, src, target, errors, ingest.ImportOptions(year=2024))


def test_streaming_import_idempotent(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    header = ",".join(h for h, _ in schemas.CANDIDATE_CSV_MAPPING) + "\n"
    n = len(schemas.CANDIDATE_CSV_MAPPING)

    def line(reg, surname, agg):
        vals = [""] * n
        vals[0], vals[1], vals[10] = reg, surname, agg
        return ",".join(vals) + "\n"

    with open(os.path.join(src, "f1.csv"), "w") as f:
        f.write(header + line("R1", "Ade", "200") + line("R2", "Obi", "bad"))
    target, errors = os.path.join(tmp_dir, "cand"), os.path.join(tmp_dir, "errors")
    ckpt = os.path.join(tmp_dir, "ckpt")
    opts = ingest.ImportOptions(year=2024)
    q = incremental.start_import(spark, src, target, errors, opts, checkpoint=ckpt)
    q.awaitTermination(120)
    assert {r["regnumber"] for r in spark.read.parquet(target).collect()} == {"R1"}
    assert spark.read.parquet(errors).count() == 1
    with open(os.path.join(src, "f2.csv"), "w") as f:
        f.write(header + line("R1", "", "210") + line("R3", "Eze", "150"))
    q = incremental.start_import(spark, src, target, errors, opts, checkpoint=ckpt)
    q.awaitTermination(120)
    out = {r["regnumber"]: r for r in spark.read.parquet(target).collect()}
    assert set(out) == {"R1", "R3"}
    assert out["R1"]["surname"] == "Ade" and out["R1"]["aggregate"] == 210   # blank kept old
    # re-running a batch's merge gives the same table
    incremental.merge_batch(spark, lines_of(spark, os.path.join(src, "f2.csv")), 1, target, errors, opts)
    again = {r["regnumber"]: (r["surname"], r["aggregate"]) for r in spark.read.parquet(target).collect()}
    assert again == {k: (v["surname"], v["aggregate"]) for k, v in out.items()}


def test_materialize_splits_a_large_year(spark, tmp_dir):
    from cohortlens.sources.tables import materialize
    cand = spark.range(40_000).select(F.col("id").cast("string").alias("regnumber"), F.sha2(F.col("id").cast("string"), 256).alias("surname"),
                                      F.when(F.col("id") % 10 == 0, 2022).otherwise(2023).alias("year")).repartition(6)
    out = os.path.join(tmp_dir, "stored")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        materialize(FrameTables(spark, candidate=cand), out, tables=["candidate"])
    finally:
        spark.conf.set(key, before)
    files = [f for f in os.listdir(os.path.join(out, "candidate", "year=2023")) if f.endswith(".parquet")]
    assert len(files) > 1
    assert spark.read.parquet(os.path.join(out, "candidate")).where("year = 2022").count() == 4000


def test_stored_tables_prune_year_partitions(spark, tmp_dir):
    from cohortlens.operators import reports as R
    from cohortlens.sources.tables import DriverTables, StoredTables, materialize
    from conftest import SF_SMALL
    d = DriverTables(spark, SF_SMALL)
    out = os.path.join(tmp_dir, "stored")
    materialize(d, out)
    s = StoredTables(spark, out)
    for fn in (R.institution_ranking, R.regional_performance, R.year_comparison):
        a = sorted(map(tuple, fn(d).collect()))
        b = sorted(map(tuple, fn(s).collect()))
        assert a == b
    df = R.regional_performance(s)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the latest-year scalar subquery reaches the scan as a partition filter
    assert "PartitionFilters: [isnotnull(year" in plan and "= Subquery subquery" in plan


def test_institution_name_view(spark):
    inst = spark.createDataFrame([("I1", "NEW", "New Name")], "inid string, inabv string, inname string")
    names = spark.createDataFrame([("I1", "OLD", "Old Name", None, None, "merger")],
                                  "inid string, inabv string, inname string, effective_from date, "
                                  "effective_to date, change_reason string")
    r = model_ops.institution_name_view(inst, names).collect()[0]
    assert (r["current_name"], r["historical_name"], r["change_reason"]) == ("New Name", "Old Name", "merger")


def test_institution_profiles(spark):
    inst = spark.createDataFrame([("I1", "NEW", "New Name"), ("I2", "X", "Solo")],
                                 "inid string, inabv string, inname string")
    names = spark.createDataFrame([("I1", "OLD", "Old Name", "2000-01-01", "2010-01-01"),
                                   ("I1", "NEW", "New Name", "2010-01-01", None)],
                                  "inid string, inabv string, inname string, f string, t string") \
        .select("inid", "inabv", "inname", F.to_date("f").alias("effective_from"),
                F.to_date("t").alias("effective_to"))
    out = {r["inid"]: json.loads(r["profile"]) for r in model_ops.institution_profiles(inst, names).collect()}
    assert [n["inname"] for n in out["I1"]["names"]] == ["Old Name", "New Name"]
    assert out["I2"]["names"] == []


def test_stored_dimension_joins_are_broadcast(spark, tmp_dir):
    from cohortlens.operators import reports as R
    from cohortlens.sources.tables import DriverTables, StoredTables, materialize
    from conftest import SF_SMALL
    out = os.path.join(tmp_dir, "stored2")
    materialize(DriverTables(spark, SF_SMALL), out, tables=["state", "candidate"])
    df = R.state_distribution(StoredTables(spark, out, tables=["state", "candidate"]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # AQE picks a broadcast join for the measured-small state dimension
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan.split("Initial Plan")[0]
