"""Derived text fixtures (FIXTURES.md, "Derived text fixtures").

All are deterministic functions of the generated tables, computed by Spark
over the whole tables, so the DuckDB oracle can rebuild them in SQL. They
stand in for the CSV files, batches and question texts the reference reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import DriverTables

# Fixed cycles of raw values injected into the string fixture.
GENDER_CYCLE = ["M", " male", "F", "Female ", "x", ""]
FLAG_CYCLE = ["yes", "TRUE", "1", "no", "0", ""]
IMPORT_YEAR = 2024
FIXED_NOW = "2024-01-01 00:00:00"


def _cycle(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def raw_candidate(t: DriverTables) -> DataFrame:
    """Candidate rows as CSV strings with injected dirt: gender spellings,
    flag spellings, an uncastable aggregate and blank surnames."""
    c = t.candidate("regnumber", "surname", "firstname", "statecode", "lg_id", "inid",
                    "aggregate", "app_course1")
    k = F.col("regnumber")
    s = lambda name: F.col(name).cast("string")
    return c.select(
        s("regnumber").alias("REGNUMBER"),
        F.when(k % 10 == 0, F.lit("")).otherwise(F.col("surname")).alias("SURNAME"),
        F.col("firstname").alias("FIRSTNAME"),
        _cycle(GENDER_CYCLE, k).alias("GENDER"),
        s("statecode").alias("STATECODE"),
        s("lg_id").alias("LG_ID"),
        s("inid").alias("INID"),
        F.when(k % 97 == 0, F.lit("n/a")).otherwise(s("aggregate")).alias("AGGREGATE"),
        s("app_course1").alias("APP_COURSE1"),
        _cycle(FLAG_CYCLE, k).alias("IS_ADMITTED"),
        _cycle(FLAG_CYCLE, k + 3).alias("IS_BLIND"),
        _cycle(FLAG_CYCLE, k + 1).alias("IS_DEAF"),
        F.lit("raw_candidate").alias("source_file"))


UPSERT_COLS = ["regnumber", "surname", "gender", "aggregate", "year", "is_admitted"]


def upsert_pair(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    """(target, batch) split by order status: the target holds finished and
    open orders (gender F / M), the batch re-sends open ones and adds pending
    ones (gender M / NULL). The batch upper-cases surnames, blanks them for
    admitted candidates, raises the aggregate by 1, and sends admitted open
    candidates a second time (later) with no surname and aggregate + 2."""
    c = t.candidate(*UPSERT_COLS)
    target = c.where(F.col("gender").isin("F", "M"))
    first = c.where((F.col("gender") == "M") | F.col("gender").isNull()).select(
        "regnumber",
        F.when(F.col("is_admitted"), F.lit("")).otherwise(F.upper("surname")).alias("surname"),
        "gender", (F.col("aggregate") + 1).alias("aggregate"), "year", "is_admitted",
        F.lit(1).alias("_seq"))
    second = c.where((F.col("gender") == "M") & F.col("is_admitted")).select(
        "regnumber", F.lit(None).cast("string").alias("surname"), "gender",
        (F.col("aggregate") + 2).alias("aggregate"), "year", "is_admitted",
        F.lit(2).alias("_seq"))
    return target, first.unionByName(second)


def course_pair(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    """(target, batch) for course upserts. Target: courses of faculties up
    to 20, named 'Course <code>' for faculties up to 5, no description.
    Batch: every course with its real name and a description, faculty left
    blank for faculties above 20 (blank never erases)."""
    co = t.course
    placeholder = F.col("facid") <= 5
    target = co.where(F.col("facid") <= 20).select(
        "course_code",
        F.when(placeholder, F.concat(F.lit("Course "), F.col("course_code").cast("string")))
         .otherwise(F.col("course_name")).alias("course_name"),
        F.lit(None).cast("string").alias("description"), "facid",
        F.lit(FIXED_NOW).cast("timestamp_ntz").alias("created_at"),
        F.lit(FIXED_NOW).cast("timestamp_ntz").alias("updated_at"))
    batch = co.select(
        "course_code", "course_name",
        F.concat(F.col("course_name"), F.lit(" programme")).alias("description"),
        F.when(F.col("facid") <= 20, F.col("facid")).alias("facid"),
        F.lit(1).alias("_seq"))
    return target, batch


def historical_codes(t: DriverTables) -> DataFrame:
    """First-choice codes as imported: the recorded code is app_course1, or
    app_course1 + 1,000,000 (a code no course has) for every 50th order."""
    c = t.candidate("regnumber", "app_course1", "inid", "year").where(F.col("app_course1").isNotNull())
    code = F.when(F.col("regnumber") % 50 == 0, F.col("app_course1") + 1000000) \
        .otherwise(F.col("app_course1"))
    return c.select("regnumber", "year", code.alias("course_code"), F.col("inid").alias("institution_id"))


# One template per question intent, plus one with none; filled with a part
# name and a year.
QUESTION_TEMPLATES = [
    "Which candidate had the highest score in {name} in {year}?",
    "How many candidates were admitted to {name} in {year}?",
    "How many candidates registered for {name} in {year}?",
    "Show candidates with a disability applying for {name} in {year}",
    "What is the average subject score for {name} in {year}?",
    "List the local government areas of {name} applicants in {year}",
    "Which faculty offers {name} in {year}?",
    "Which university has the most {name} applicants in {year}?",
    "Tell me about the {name} course in {year}",
]
QUESTION_FIRST_YEAR = 2019
QUESTION_YEAR_SPAN = 5


def questions(t: DriverTables) -> DataFrame:
    """(question_id, question): one question per part, template by part key."""
    p = t.raw("part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    tmpl = _cycle(QUESTION_TEMPLATES, k)
    year = (F.lit(QUESTION_FIRST_YEAR) + (F.floor(k / len(QUESTION_TEMPLATES)) % QUESTION_YEAR_SPAN)).cast("string")
    text = F.replace(F.replace(tmpl, F.lit("{name}"), F.col("p_name")), F.lit("{year}"), year)
    return p.select(k.alias("question_id"), text.alias("question"), year.alias("asked_year"))


def replies(t: DriverTables) -> DataFrame:
    """(reply_id, reply): model replies in nine shapes -- clean JSON (with an
    escaped newline in the SQL), fenced JSON, a bare SELECT in prose, prose
    without SQL, JSON with an empty query, JSON followed by text, JSON with a
    number or null as the query, and JSON with the key in capitals."""
    q = questions(t)
    k = F.col("question_id")
    y = F.col("asked_year")
    clean = F.concat(F.lit('{"thought_process": "count rows", "sql_query": "SELECT count(*)\\\\nFROM candidate WHERE year = '),
                     y, F.lit(';"}'))
    fenced = F.concat(F.lit('```json\n{"thought_process": "by course", "sql_query": "SELECT * FROM course WHERE course_code = '),
                      k.cast("string"), F.lit('"}\n```'))
    prose = F.concat(F.lit("Here is the query: SELECT regnumber FROM candidate WHERE year = "), y,
                     F.lit("; hope this helps"))
    nosql = F.concat(F.lit("I cannot answer: "), F.col("question"))
    empty = F.lit('{"thought_process": "none", "sql_query": ""}')
    behind = F.concat(F.lit('{"sql_query": "SELECT regnumber FROM candidate WHERE year = '), y, F.lit('"} as you asked'))
    number, null = F.lit('{"thought_process": "n", "sql_query": 5}'), F.lit('{"thought_process": "n", "sql_query": null}')
    capitals = F.concat(F.lit('{"SQL_QUERY": "SELECT max(aggregate) FROM candidate WHERE year = '), y, F.lit('"}'))
    v = k % 9
    reply = (F.when(v == 0, clean).when(v == 1, fenced).when(v == 2, prose)
             .when(v == 3, nosql).when(v == 4, empty).when(v == 5, behind)
             .when(v == 6, number).when(v == 7, null).otherwise(capitals))
    return q.select(k.alias("reply_id"), reply.alias("reply"))


def raw_courses(t: DriverTables) -> DataFrame:
    """Course CSV rows as strings (CODE, NAME, DESCRIPTION, FACULTY_ID) from
    the part table: padded names, blank names for parts of size 2 or less,
    and a non-numeric faculty for parts of size 50."""
    p = t.raw("part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    name = F.when(F.col("p_size") <= 2, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("p_name")))
    fac = F.when(F.col("p_size") == 50, F.lit("n/a")).otherwise(
        F.regexp_extract("p_brand", r"(\d+)", 1))
    return p.select(F.col("p_partkey").cast("string").alias("CODE"), name.alias("NAME"),
                    F.col("p_type").alias("DESCRIPTION"), fac.alias("FACULTY_ID"))


def raw_candidate_text(t: DriverTables) -> DataFrame:
    """Candidate rows as CSV strings whose state is its region's name as
    typed, whose institution is an id or an abbreviation, some unknown, and
    whose course code is unknown for every 50th order."""
    c = t.candidate("regnumber", "surname", "statecode", "inid", "aggregate", "app_course1")
    n = t.raw("nation").select("n_nationkey", "n_regionkey")
    r = t.raw("region").select("r_regionkey", "r_name")
    j = c.join(n, F.col("statecode") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k, i = F.col("regnumber"), F.col("inid").cast("string")
    name = F.col("r_name")
    state = (F.when(k % 6 == 0, name).when(k % 6 == 1, F.concat(F.lit("  "), F.lower(name), F.lit(" ")))
             .when(k % 6 == 2, F.concat(name, F.substring(name, -1, 1))).when(k % 6 == 3, F.col("r_regionkey").cast("string"))
             .when(k % 6 == 4, F.lit("XX")).otherwise(F.lit("")))
    inst = F.when(k % 4 == 0, i).when(k % 4 == 1, F.concat(F.lit(" S"), i)).when(k % 4 == 2, F.concat(F.lit("X"), i)).otherwise(F.concat(i, F.lit(" ")))
    code = F.when(k % 50 == 0, F.col("app_course1") + 1000000).otherwise(F.col("app_course1"))
    return j.select(k.cast("string").alias("REGNUMBER"), F.col("surname").alias("SURNAME"), state.alias("STATECODE"), inst.alias("INID"),
                    F.col("aggregate").cast("string").alias("AGGREGATE"), code.cast("string").alias("APP_COURSE1"), F.lit("raw_candidate_text").alias("source_file"))


def csv_headers(t: DriverTables, names: list[str]) -> DataFrame:
    """(file, position, header): one file per nation, whose headers are
    ``names`` as typed: as they are, lower case, spaced, with a letter more,
    short of one, or something else."""
    n = t.raw("nation").select(F.col("n_name").alias("file"), "n_nationkey", F.posexplode(F.array(*map(F.lit, names))).alias("position", "name"))
    v, h = (F.col("n_nationkey") + F.col("position")) % 7, F.col("name")
    header = (F.when(v == 0, h).when(v == 1, F.lower(h)).when(v == 2, F.replace(h, F.lit("_"), F.lit(" "))).when(v == 3, F.concat(h, F.lit("S")))
              .when(v == 4, F.expr("substring(name, 1, length(name) - 1)")).when(v == 5, F.concat(F.lit("COL "), F.col("position").cast("string"))).otherwise(F.concat(F.lit(" "), h)))
    return n.select("file", "position", header.alias("header"))
