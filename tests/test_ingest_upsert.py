"""Import pipeline and upserts: CSV edge rows, cleaning, quarantine, upsert laws."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ingest, upsert
from conftest import rows

HEADER = "REGNUMBER,SURNAME,FIRSTNAME,GENDER,AGGREGATE,STATECODE,IS_ADMITTED,IS_BLIND\n"


@pytest.fixture()
def csv_dir(tmp_dir):
    body = (
        'R1, Ade ,Bola, male ,250,1,YES,\n'
        'R2,"Obi, Jr","Say ""hi""",F,abc,2,no,1\n'        # quoted comma, embedded quote, bad int
        'R3,Short\n'                                       # too few fields
        'R4,Long,x,M,100,1,1,0,extra\n'                    # too many fields
        ',NoReg,x,Female,100,1,true,\n'                    # missing key
        'R6,Blank,,x,,,,\n'
    )
    with open(os.path.join(tmp_dir, "a.csv"), "w") as f:
        f.write(HEADER + body)
    return tmp_dir


def test_csv_read_clean_and_quarantine(spark, csv_dir):
    raw = ingest.read_candidate_csv(spark, csv_dir)
    checked = ingest.clean_candidates(ingest.map_columns(raw), ingest.ImportOptions(year=2024))
    good, bad = ingest.split_valid(checked)
    g = {r["regnumber"]: r for r in rows(good)}
    assert set(g) == {"R1", "R6"}
    assert g["R1"]["surname"] == "Ade" and g["R1"]["gender"] == "M" and g["R1"]["aggregate"] == 250
    assert g["R1"]["is_admitted"] is True and g["R1"]["is_blind"] is None and g["R1"]["year"] == 2024
    assert g["R6"]["firstname"] is None and g["R6"]["gender"] is None and g["R6"]["aggregate"] is None
    b = rows(bad)
    msgs = " | ".join(r["error_message"] for r in b)
    assert len(b) == 4
    assert "invalid integer for aggregate: 'abc'" in msgs
    assert msgs.count("malformed CSV row") == 2
    assert "missing regnumber" in msgs
    assert all(r["source_file"].endswith("a.csv") for r in b)
    # good + bad = input rows
    assert good.count() + bad.count() == raw.count()


def test_import_summary_and_empty(spark, csv_dir):
    raw = ingest.read_candidate_csv(spark, csv_dir)
    checked = ingest.clean_candidates(ingest.map_columns(raw))
    s = rows(ingest.import_summary(checked))[0]
    assert (s["total_rows"], s["success_rows"], s["failed_rows"]) == (6, 2, 4)
    assert s["success_pct"] == 33.33 and s["failed_pct"] == 66.67
    empty = rows(ingest.import_summary(checked.limit(0)))[0]
    assert empty["total_rows"] == 0 and empty["success_pct"] is None


def test_summary_is_observed_in_the_staging_write(spark, csv_dir, monkeypatch):
    checked = ingest.clean_candidates(ingest.map_columns(ingest.read_candidate_csv(spark, csv_dir)))
    want = rows(ingest.import_summary(checked))
    monkeypatch.setattr(ingest, "import_summary", None)
    group = "observed-stage"
    spark.sparkContext.setJobGroup(group, group)
    try:
        staged, _, summary = ingest.observed_stage(checked, "test-observed")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        got = rows(summary)
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert got == want and staged.count() == 6 and before >= 1
    empty = ingest.observed_stage(checked.limit(0), "test-observed")[2]
    assert rows(empty) == [{"total_rows": 0, "success_rows": 0, "success_pct": None, "failed_rows": 0, "failed_pct": None, "last_error": None}]
    target = csv_dir + "-t"
    assert rows(ingest.run_candidate_import(spark, csv_dir, target, target + "-e", ingest.ImportOptions(year=2024))) == want


def test_admission_option(spark, csv_dir):
    raw = ingest.read_candidate_csv(spark, csv_dir)
    checked = ingest.clean_candidates(ingest.map_columns(raw), ingest.ImportOptions(is_admission=True))
    assert {r["is_admitted"] for r in rows(checked)} == {True}


def test_header_matching_in_map_columns(spark):
    df = spark.createDataFrame([("1", "x")], "`Reg Number` string, ` surname ` string")
    out = ingest.map_columns(df, [ingest.ColumnMapping("REGNUMBER", "regnumber"),
                                  ingest.ColumnMapping("SURNAME", "surname", F.upper)])
    r = rows(out)[0]
    assert r == {"regnumber": "1", "surname": "X"}


TARGET = "regnumber string, surname string, aggregate int, year int"
BATCH = "regnumber string, surname string, aggregate int, year int, _seq int"


def test_upsert_blank_never_erases_and_later_wins(spark):
    target = spark.createDataFrame([("A", "Ade", 100, 2023), ("B", "Obi", 200, 2023)], TARGET)
    batch = spark.createDataFrame([
        ("A", "  ", 150, 2023, 1),       # blank surname keeps old
        ("A", None, 160, 2023, 2),       # later row wins for aggregate
        ("B", "OBI", None, None, 1),     # NULL aggregate keeps old
        ("C", "New", 300, 2024, 1),      # insert
    ], BATCH)
    out = {r["regnumber"]: r for r in rows(upsert.upsert_candidates(target, batch))}
    assert out["A"] == {"regnumber": "A", "surname": "Ade", "aggregate": 160, "year": 2023}
    assert out["B"] == {"regnumber": "B", "surname": "OBI", "aggregate": 200, "year": 2023}
    assert out["C"]["surname"] == "New"


def test_upsert_idempotent(spark):
    target = spark.createDataFrame([("A", "Ade", 100, 2023)], TARGET)
    batch = spark.createDataFrame([("A", "X", None, 2023, 1), ("B", "Y", 5, 2024, 1)], BATCH)
    once = upsert.upsert_candidates(target, batch)
    twice = upsert.upsert_candidates(once, batch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_write_upsert_rewrites_touched_partitions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "cand")
    spark.createDataFrame([("A", "Ade", 100, 2022), ("B", "Obi", 200, 2023), ("C", "Eze", 1, 2021)],
                          TARGET).write.partitionBy("year").parquet(path)
    batch = spark.createDataFrame([("A", "ADE", None, 2023, 1), ("D", "New", 5, 2023, 1)], BATCH)
    upsert.write_upsert(spark, path, batch)
    out = {r["regnumber"]: r for r in rows(spark.read.parquet(path))}
    assert set(out) == {"A", "B", "C", "D"}
    assert out["A"]["year"] == 2023 and out["A"]["surname"] == "ADE" and out["A"]["aggregate"] == 100
    assert out["C"]["year"] == 2021   # untouched partition kept


COURSE_T = "course_code string, course_name string, description string, facid int, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_course_upserts(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    target = spark.createDataFrame([("12", "Course 12", "d", 1, None, None), ("13", "Medicine", None, 2, None, None)], COURSE_T)
    batch = spark.createDataFrame([("12", "Law", "", None, 1), ("13", "Surgery", "x", None, 1),
                                   ("14", "Art", None, 3, 1), ("", "Nothing", None, 1, 1), ("15", " ", None, 1, 1)],
                                  "course_code string, course_name string, description string, facid int, _seq int")
    out = {r["course_code"]: r for r in rows(upsert.upsert_courses(target, batch, now=now))}
    assert set(out) == {"12", "13", "14"}                   # blank code / name skipped
    assert out["12"]["course_name"] == "Law" and out["12"]["description"] == "d" and out["12"]["facid"] == 1
    assert out["13"]["course_name"] == "Surgery" and out["14"]["created_at"] is not None
    names = {r["course_code"]: r["course_name"] for r in rows(
        upsert.upsert_course_names(target.select("course_code", "course_name"), batch))}
    assert names["12"] == "Law" and names["13"] == "Medicine" and names["14"] == "Art"


def test_historical_codes_and_years(spark):
    tgt = spark.createDataFrame([(2023, "X1", "I1")], "year int, old_course_code string, institution_id string")
    new = spark.createDataFrame([(2023, "X1", "I1"), (2023, "X2", "I1"), (2023, "X2", "I1")],
                                "year int, old_course_code string, institution_id string")
    out = rows(upsert.append_historical_codes(tgt, new))
    assert [(r["old_course_code"], r["reconciled"]) for r in out] == [("X2", False)]
    y21 = spark.createDataFrame([("A", 1)], "regnumber string, aggregate int")
    y22 = spark.createDataFrame([("B", "x")], "regnumber string, email string")
    c = rows(upsert.consolidate_years({2021: y21, 2022: y22}), "regnumber")
    assert [(r["regnumber"], r["year"], r["email"]) for r in c] == [("A", 2021, None), ("B", 2022, "x")]


def test_course_csv(spark, tmp_dir):
    p = os.path.join(tmp_dir, "c.csv")
    with open(p, "w") as f:
        f.write(" code ,name,faculty_id\nC1,Law,2\nC2,,3\n")
    out = rows(ingest.clean_courses(ingest.read_course_csv(spark, p)))
    assert out == [{"course_code": "C1", "course_name": "Law", "description": None, "facid": 2}]
    with open(os.path.join(tmp_dir, "bad.csv"), "w") as f:
        f.write("NAME\nx\n")
    with pytest.raises(ValueError):
        ingest.read_course_csv(spark, os.path.join(tmp_dir, "bad.csv"))


def test_write_upsert_repairs_interrupted_move(spark, tmp_dir):
    """A stale copy left by an interrupted earlier run is removed by re-running
    the same batch."""
    path = os.path.join(tmp_dir, "cand2")
    spark.createDataFrame([("A", "Ade", 100, 2022), ("A", "ADE", 100, 2023), ("B", "Obi", 200, 2023)],
                          TARGET).write.partitionBy("year").parquet(path)
    batch = spark.createDataFrame([("A", "ADE", None, 2023, 1)], BATCH)
    upsert.write_upsert(spark, path, batch)
    out = rows(spark.read.parquet(path), "regnumber")
    assert [(r["regnumber"], r["surname"], r["aggregate"], r["year"]) for r in out] == [
        ("A", "ADE", 100, 2023), ("B", "Obi", 200, 2023)]


def test_batch_import_pipeline(spark, csv_dir):
    import tempfile
    out_dir = tempfile.mkdtemp(prefix="cohortlens-test-out-")
    target, errors = os.path.join(out_dir, "t"), os.path.join(out_dir, "e")
    dry = rows(ingest.run_candidate_import(spark, csv_dir, target, errors,
                                           ingest.ImportOptions(validate_only=True)))[0]
    assert dry["total_rows"] == 6 and not os.path.exists(target)
    s = rows(ingest.run_candidate_import(spark, csv_dir, target, errors, ingest.ImportOptions(year=2024)))[0]
    assert (s["success_rows"], s["failed_rows"]) == (2, 4)
    assert {r["regnumber"] for r in spark.read.parquet(target).collect()} == {"R1", "R6"}
    assert spark.read.parquet(errors).count() == 4
    # a second load of the same files merges by key: no duplicates, also not in the quarantine
    ingest.run_candidate_import(spark, csv_dir, target, errors, ingest.ImportOptions(year=2024))
    assert spark.read.parquet(target).count() == 2 and spark.read.parquet(errors).count() == 4
    ingest.run_candidate_import(spark, csv_dir, target, errors, ingest.ImportOptions(year=2024, load_id="other"))
    assert spark.read.parquet(errors).count() == 8


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_unreadable_target_is_never_replaced(spark, csv_dir, tmp_dir):
    target = os.path.join(tmp_dir, "bad-target")
    spark.createDataFrame([("OLD1", "Ade", 1, 2024)], TARGET).coalesce(1).write.partitionBy("year").parquet(target)
    write(os.path.join(target, "year=2024", "part-broken.parquet"), "not parquet")
    before = sorted(os.listdir(os.path.join(target, "year=2024")))
    with pytest.raises(Exception):
        ingest.run_candidate_import(spark, csv_dir, target, target + "-e", ingest.ImportOptions(year=2024))
    assert sorted(os.listdir(os.path.join(target, "year=2024"))) == before
    assert not os.path.exists(target + "-e")


def test_failed_merge_can_be_retried(spark, csv_dir, tmp_dir, monkeypatch):
    target = os.path.join(tmp_dir, "t")
    ingest.run_candidate_import(spark, csv_dir, target, target + "-e", ingest.ImportOptions(year=2024))
    # The driver dies after the journal is written, before partitions are replaced.
    real = upsert.recover
    calls = []

    def dies(spark_, path, col="year"):
        calls.append(path)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(spark_, path, col)
    monkeypatch.setattr(upsert, "recover", dies)
    batch = spark.createDataFrame([("R1", "NEW", 99, 2023, 1), ("R7", "Sev", 5, 2023, 1)], BATCH)
    with pytest.raises(KeyboardInterrupt):
        upsert.write_upsert(spark, target, batch)
    monkeypatch.setattr(upsert, "recover", real)
    assert os.path.exists(os.path.join(target, upsert.JOURNAL))
    assert {r["regnumber"] for r in spark.read.parquet(target).collect()} == {"R1", "R6"}   # still the old table
    assert upsert.recover(spark, target) is True and upsert.recover(spark, target) is False
    out = {r["regnumber"]: (r["surname"], r["year"]) for r in spark.read.parquet(target).collect()}
    assert out["R1"] == ("NEW", 2023) and out["R7"] == ("Sev", 2023) and out["R6"][1] == 2024
    with pytest.raises(ValueError):
        upsert.write_upsert(spark, target, batch.withColumn("unknown_column", F.lit(1)))


def test_later_file_wins_whatever_the_label(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    write(os.path.join(src, "1.csv"), "REGNUMBER,SURNAME\nR1,First\n")
    write(os.path.join(src, "2.csv"), "SURNAME,REGNUMBER\nSecond,R1\n")
    target = os.path.join(tmp_dir, "t")
    ingest.run_candidate_import(spark, src, target, target + "-e", ingest.ImportOptions(year=2024, source_file="label"))
    assert [r["surname"] for r in spark.read.parquet(target).collect()] == ["Second"]


def test_quoted_line_breaks_and_missing_key_column(spark, tmp_dir):
    path = write(os.path.join(tmp_dir, "q.csv"), 'REGNUMBER,SURNAME,ADDRESS\nR1,Ade,"12 Road\nLagos"\nR2,Obi,x\n')
    whole = ingest.read_candidate_csv(spark, path)
    assert sorted((r["REGNUMBER"], r["ADDRESS"]) for r in whole.collect()) == [("R1", "12 Road\nLagos"), ("R2", "x")]
    bad = write(os.path.join(tmp_dir, "n.csv"), "NAME,AGE\nx,1\n")
    with pytest.raises(ValueError):
        ingest.run_candidate_import(spark, bad, os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "e"), ingest.ImportOptions(year=2024))
    twice = write(os.path.join(tmp_dir, "d.csv"), "REGNUMBER,A,a\n1,2,3\n")
    with pytest.raises(ValueError):
        ingest.read_candidate_csv(spark, twice)


def test_import_resolves_references(spark, tmp_dir):
    path = write(os.path.join(tmp_dir, "r.csv"), "REGNUMBER,STATECODE,INID,APP_COURSE1,SURNAME\nR1,lagoss,UNI,C1,Ade\nR2,2,I1,C9,Obi\nR3,nowhere,I1,C1,Eze\n"
                 f"R4,1,I7,C1,Uba\nR5,1,I1,C1,{'x' * 101}\n")
    refs = ingest.References(spark.createDataFrame([(1, "LAGOS"), (2, "KANO")], "st_id int, st_name string"),
                             spark.createDataFrame([("I1", "UNI")], "inid string, inabv string"), spark.createDataFrame([("C1",)], "course_code string"))
    target, hist = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "h")
    for _ in range(2):
        ingest.run_candidate_import(spark, path, target, target + "-e", ingest.ImportOptions(year=2024), refs=refs, historical_path=hist)
    assert sorted((r["regnumber"], r["statecode"], r["inid"]) for r in spark.read.parquet(target).collect()) == [("R1", 1, "I1"), ("R2", 2, "I1")]
    assert sorted(r["error_message"] for r in spark.read.parquet(target + "-e").collect()) == [
        "invalid institution: I7", "surname is longer than 100", "unknown state: nowhere"]
    assert [(r["old_course_code"], r["institution_id"]) for r in spark.read.parquet(hist).collect()] == [("C9", "I1")]


def test_reconcile_codes(spark):
    from cohortlens.operators import resolve
    hist = spark.createDataFrame([(2023, "X1", "I1", False), (2023, "X2", "I1", False)],
                                 "year int, old_course_code string, institution_id string, reconciled boolean")
    m = spark.createDataFrame([(2023, "X1", "C1", "I1")],
                              "year int, old_course_code string, new_course_code string, institution_id string")
    out = {r["old_course_code"]: r["reconciled"] for r in resolve.reconcile_historical_codes(hist, m).collect()}
    assert out == {"X1": True, "X2": False}
