"""Entity resolution (I2, I8-I10, D3) and question analytics (N1-N4, S4)."""

import pytest
from pyspark.sql import functions as F

from cohortlens import schemas
from cohortlens.operators import questions as Q
from cohortlens.operators import resolve
from conftest import rows


def _states(spark):
    names = ["LAGOS", "KANO", "FCT", "AKWA IBOM", "CROSS RIVER", "NASSARAWA", "FOREIGNER",
             "COTONOU", "COTE D VOIRE", "OYO", "OGUN"]
    return spark.createDataFrame(list(enumerate(names, 1)), "st_id int, st_name string")


def test_state_aliases_exact_and_fuzzy(spark):
    inputs = [(k,) for k in schemas.STATE_ALIASES] + [
        (" lagos ",), ("LAGOSS",), ("LAGXSS",), ("XX",), ("Kano",), ("OGUNN",), ("OYOO",)]
    df = spark.createDataFrame(inputs, "name string")
    out = {r["name"]: r for r in rows(resolve.resolve_states(df, "name", _states(spark)))}
    st = {r["st_name"]: r["st_id"] for r in _states(spark).collect()}
    for alias, target in schemas.STATE_ALIASES.items():
        assert out[alias]["st_id"] == st[target] and out[alias]["state_match"] == "exact"
    assert out[" lagos "]["st_id"] == st["LAGOS"] and out[" lagos "]["state_match"] == "exact"
    assert out["LAGOSS"]["state_match"] == "fuzzy" and out["LAGOSS"]["st_id"] == st["LAGOS"]  # distance 1
    assert out["LAGXSS"]["st_id"] == st["LAGOS"]       # distance 2: accepted
    assert out["XX"]["st_id"] is None                   # distance 3+: unresolved
    # OYOO: distance 1 to OYO and 2 to OGUN? nearest wins
    assert out["OYOO"]["st_id"] == st["OYO"]


def test_institution_resolution_prefers_id(spark):
    inst = spark.createDataFrame([("10", "UNILAG"), ("20", "10"), ("30", "")], "inid string, inabv string")
    df = spark.createDataFrame([(" 10 ",), ("UNILAG",), ("20",), ("nope",), ("",)], "raw string")
    out = {r["raw"]: r["resolved_inid"] for r in rows(resolve.resolve_institutions(df, "raw", inst))}
    assert out == {" 10 ": "10", "UNILAG": "10", "20": "20", "nope": None, "": None}


def test_course_code_validation_and_remap(spark):
    course = spark.createDataFrame([("C1",), ("C2",)], "course_code string")
    df = spark.createDataFrame([("a", 2023, "C1", "I1"), ("b", 2023, "OLD9", "I1"), ("c", 2022, "OLD9", "I1")],
                               "regnumber string, year int, course_code string, institution_id string")
    known, unknown = resolve.validate_course_codes(df, "course_code", course)
    assert {r["regnumber"] for r in known.collect()} == {"a"}
    assert {r["error"] for r in unknown.collect()} == {"unknown course code: OLD9"}
    mapping = spark.createDataFrame([(2023, "OLD9", "C2", "I1")],
                                    "year int, old_course_code string, new_course_code string, institution_id string")
    out = {r["regnumber"]: (r["course_code"], r["remapped"]) for r in
           resolve.remap_course_codes(df, mapping).collect()}
    assert out == {"a": ("C1", False), "b": ("C2", True), "c": ("OLD9", False)}


def test_header_matching(spark):
    headers = spark.createDataFrame([
        ("f1", 0, "Reg Number"), ("f1", 1, "surname "), ("f1", 2, "FIRST_NAME"),
        ("f2", 0, "REGNUMBER"), ("f2", 1, "SURNAM"), ("f2", 2, "SURNAMES")],
        "file string, position int, header string")
    out = {(r["file"], r["required"]): r for r in
           rows(resolve.match_schema(headers, ["REGNUMBER", "SURNAME", "FIRSTNAME", "GENDER"]))}
    assert out[("f1", "REGNUMBER")]["status"] == "exact"       # spaces ignored
    assert out[("f1", "SURNAME")]["status"] == "exact"
    assert out[("f1", "FIRSTNAME")]["status"] == "auto"        # '_' ignored -> conf 1.0
    assert out[("f1", "GENDER")]["status"] == "missing"
    assert out[("f2", "SURNAME")]["status"] == "review"        # two close candidates
    assert out[("f2", "SURNAME")]["header"] == "SURNAMES"      # 1 - 1/8 beats 1 - 1/7


def test_intents_and_years(spark):
    qs = spark.createDataFrame([
        (1, "How many students are there?"),
        (2, "How many students applied from Lagos state?"),
        (3, "Show me the top 5 courses by number of applicants"),
        (4, "What is the meaning of life?"),
        (5, "Highest score of admitted candidates in 2021 and 2020"),
        (6, "Admission list per university"),
        (7, "Disabilities by LGA in 2022"),
    ], "question_id int, question string")
    out = {r["question_id"]: (r["intent"], r["year"]) for r in
           Q.extract_year(Q.classify_intent(qs)).collect()}
    assert out[1] == ("general_stats", "2023")
    assert out[4] == ("general_stats", "2023")
    assert out[5] == ("highest_score", "2020")       # checks 2020 before 2021
    assert out[6] == ("admission_stats", "2023")
    assert out[7] == ("disability_stats", "2022")


def test_course_matching_stages(spark):
    courses = spark.createDataFrame([("Medicine and Surgery",), ("Law",), ("Computer Science",),
                                     ("Civil Engineering",), ("Nursing",), (" law ",), ("",)],
                                    "course_name string")
    names = Q.course_names(courses)
    assert {r["key"]: r["name"] for r in names.collect()} == {
        "medicine and surgery": "Medicine and Surgery", "law": "law", "computer science": "Computer Science",
        "civil engineering": "Civil Engineering", "nursing": "Nursing"}
    qs = spark.createDataFrame([
        (1, "How many applied for law?"),                 # (a) exact name
        (2, "Applicants to medical programmes"),          # (b) medicine category
        (3, "students of nursin"),                        # (c) word match
        (4, "Show me the top 5 courses by number of applicants"),  # (d) fallback
        (5, "What is the meaning of life?"),              # nothing
        (6, "civil engineering and software"),            # (a) + (b) engineering only
    ], "question_id int, question string")
    got = {}
    for r in Q.match_courses(qs, names).collect():
        got.setdefault(r["question_id"], set()).add((r["pattern"], r["stage"]))
    assert got[1] == {("'%law%'", "a")}      # greatest spelling of the key
    assert got[2] == {("'%Medicine and Surgery%'", "b")}
    assert got[3] == {("'%Nursing%'", "c")}
    assert got[4] == {("'%COURSE%'", "d")}
    assert 5 not in got
    assert got[6] == {("'%Civil Engineering%'", "a")}


def test_sql_extraction(spark):
    replies = spark.createDataFrame([
        (1, '{"thought_process": "t", "sql_query": "SELECT a\\\\nFROM   b;"}'),
        (2, '```json\n{"sql_query": "SELECT 1"}\n```'),
        (3, 'Sure: select x from y; trailing words'),
        (4, 'no query here'),
        (5, '{"sql_query": ""}'),
        (6, 'SELECT a\nFROM b;'),                      # '.' stops at the newline: no match
        (7, 'text SELECT count(*) FROM t'),            # runs to the end of text
    ], "reply_id int, reply string")
    out = {r["reply_id"]: r for r in Q.extract_sql(replies).collect()}
    assert out[1]["sql_query"] == "SELECT a FROM b;" and out[1]["thought_process"] == "t"
    assert out[2]["sql_query"] == "SELECT 1" and out[2]["error"] is None
    assert out[3]["sql_query"] == "select x from y;"
    assert out[4]["sql_query"] is None and out[4]["error"] == "failed to extract SQL query"
    assert out[5]["error"] == "no SQL query found in response"
    assert out[6]["sql_query"] is None
    assert out[7]["sql_query"] == "SELECT count(*) FROM t"


def test_state_resolution_by_distance(spark):
    from test_properties import _lev
    inputs = [*schemas.STATE_ALIASES, " lagos ", "LAGOSS", "LAGXSS", "XX", "OYOO", "O", "", "KANOXYZ", "L" * 3000, "LAGOS", "LAGOS", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, name string")
    states = {r["st_name"]: r["st_id"] for r in _states(spark).collect()}
    for k in (0, 1, 2):
        got = {r["i"]: (r["st_id"], r["state_match"]) for r in resolve.resolve_states(df, "name", _states(spark), max_distance=k).collect()}
        assert len(got) == len(inputs)
        for i, x in enumerate(inputs):
            clean = None if x is None else schemas.STATE_ALIASES.get(x.strip().upper(), x.strip().upper())
            near = sorted((_lev(clean, n), s) for n, s in states.items()) if clean is not None and len(clean) < 100 else []
            want = (near[0][1], "exact" if near[0][0] == 0 else "fuzzy") if near and near[0][0] <= k else (None, None)
            assert got[i] == want, (x, k)
    with pytest.raises(ValueError):
        resolve.resolve_states(df, "name", _states(spark), max_distance=3)


def test_question_plan_has_no_nested_loop(spark):
    names = Q.course_names(spark.createDataFrame([("Law",), ("Nursing",)], "course_name string"))
    qs = spark.createDataFrame([(1, "How many applied for law?"), (1, "law"), (2, None)], "question_id int, question string")
    out = Q.match_courses(qs, names)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [tuple(r) for r in out.collect()] == [(1, "'%Law%'", "a")]


def test_sql_extraction_of_odd_replies(spark):
    replies = {
        1: ('{"sql_query": "SELECT 1"} as asked', ("SELECT 1\"} as asked", None)),
        2: ('{"sql_query": 5}', (None, "failed to extract SQL query")),
        3: ('{"sql_query": null}', (None, "no SQL query found in response")),
        4: ('{"Sql_Query": "SELECT 2"}', ("SELECT 2", None)),
        5: ('[{"sql_query": "SELECT 3;"}]', ("SELECT 3;", None)),
        6: ("{}", (None, "no SQL query found in response")),
        7: (None, (None, None)),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in replies.items()], "reply_id int, reply string")
    out = {r["reply_id"]: (r["sql_query"], r["error"]) for r in Q.extract_sql(df).collect()}
    assert out == {k: v[1] for k, v in replies.items()}


def test_one_mapping_per_old_code(spark):
    df = spark.createDataFrame([("A", 2023, "X1", "I1"), ("B", 2023, "X2", "I1")], "regnumber string, year int, course_code string, institution_id string")
    m = spark.createDataFrame([(2023, "X1", "C1", "I1", "2024-01-01"), (2023, "X1", "C2", "I1", "2024-02-01"), (2023, "X1", "C0", "I1", None)],
                              "year int, old_course_code string, new_course_code string, institution_id string, d string") \
        .withColumn("mapping_date", F.to_timestamp_ntz("d")).drop("d")
    out = sorted((r["regnumber"], r["course_code"], r["remapped"]) for r in resolve.remap_course_codes(df, m).collect())
    assert out == [("A", "C2", True), ("B", "X2", False)]
    early = resolve.remap_course_codes(df, m, as_of=F.lit("2024-01-15").cast("timestamp_ntz")).collect()
    assert sorted((r["regnumber"], r["course_code"]) for r in early) == [("A", "C1"), ("B", "X2")]
    assert sorted(r["new_course_code"] for r in resolve.superseded_mappings(m).collect()) == ["C0", "C1"]
