"""Registry entries for the import, upsert, resolution, question and
data-model operators, each with its DuckDB oracle SQL.

Every query reads the generated tables (through ``DriverTables`` and the
derived fixtures), over whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, model_ops, questions, resolve, upsert
from ..operators.asof import normal_periods
from ..sources import fixtures as fx
from ..sources.tables import DriverTables
from .oracle import rnd, with_base

SQL_NOW = f"TIMESTAMP '{fx.FIXED_NOW}'"
UNKNOWN_CODE_OFFSET = 1000000


def _t(spark, d):
    return DriverTables(spark, d)


def _now():
    return F.lit(fx.FIXED_NOW).cast("timestamp_ntz")


# -- import -------------------------------------------------------------------
IMPORT_OUT = ["regnumber", "surname", "firstname", "gender", "statecode", "lg_id", "inid",
              "aggregate", "app_course1", "is_admitted", "is_blind", "is_deaf", "year"]


def _checked(spark, d):
    raw = fx.raw_candidate(_t(spark, d))
    return ingest.clean_candidates(ingest.map_columns(raw), ingest.ImportOptions(year=fx.IMPORT_YEAR))


def q_import_candidates(spark, d):
    good, _ = ingest.split_valid(_checked(spark, d))
    return good.select(*IMPORT_OUT)


def q_import_quarantine(spark, d):
    _, bad = ingest.split_valid(_checked(spark, d), raw_cols=["regnumber", "surname"], now=_now())
    return bad


def q_import_summary(spark, d):
    return ingest.import_summary(_checked(spark, d))


def q_failed_import_quarantine(spark, d):
    from ..operators.reports import failed_import_analysis
    _, bad = ingest.split_valid(_checked(spark, d), now=_now())
    return failed_import_analysis(bad)


# -- upserts ------------------------------------------------------------------
def q_upsert_candidates(spark, d):
    target, batch = fx.upsert_pair(_t(spark, d))
    return upsert.upsert_candidates(target, batch)


def q_clean_courses(spark, d):
    return ingest.clean_courses(fx.raw_courses(_t(spark, d)))


def q_upsert_courses(spark, d):
    target, batch = fx.course_pair(_t(spark, d))
    return upsert.upsert_courses(target, batch, now=F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


def q_upsert_course_names(spark, d):
    target, batch = fx.course_pair(_t(spark, d))
    return upsert.upsert_course_names(target.select("course_code", "course_name"), batch)


def _unknown_codes(spark, d):
    t = _t(spark, d)
    _, unknown = resolve.validate_course_codes(fx.historical_codes(t), "course_code", t.course)
    return unknown


def q_validate_course_codes(spark, d):
    t = _t(spark, d)
    return resolve.mark_known_codes(fx.historical_codes(t), "course_code", t.course) \
        .select("regnumber", "course_code", "code_known")


def q_historical_codes(spark, d):
    unknown = _unknown_codes(spark, d).select(
        "year", F.col("course_code").alias("old_course_code"), "institution_id")
    # The earliest year's codes were recorded by a first load.
    first_load = unknown.where(F.col("year") == unknown.select(F.min("year")).scalar())
    return upsert.append_historical_codes(first_load, unknown, now=_now())


def _code_mappings(spark, d):
    """A mapping per unknown code, and for even ones an earlier one to another code."""
    unknown = _unknown_codes(spark, d).select("year", F.col("course_code").alias("old_course_code"), "institution_id").distinct()
    code = F.col("old_course_code") - UNKNOWN_CODE_OFFSET
    last = unknown.select("*", code.alias("new_course_code"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("mapping_date"))
    first = unknown.where(F.col("old_course_code") % 2 == 0).select(
        "*", (code + 1).alias("new_course_code"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("mapping_date"))
    return last.unionByName(first)


def q_remap_course_codes(spark, d):
    return resolve.remap_course_codes(fx.historical_codes(_t(spark, d)), _code_mappings(spark, d)) \
        .select("regnumber", "course_code", "remapped")


def q_remap_course_codes_asof(spark, d):
    # Every row has a date of its own: before, between and after its mappings.
    day = F.date_add(F.lit("2024-01-15").cast("date"), (F.col("regnumber") % 4 * 20).cast("int")).cast("timestamp_ntz")
    rows = fx.historical_codes(_t(spark, d)).withColumn("seen", F.when(F.col("regnumber") % 350 != 0, day))
    return resolve.remap_course_codes(rows, _code_mappings(spark, d), date_col="seen").select("regnumber", "course_code", "remapped")


def q_superseded_mappings(spark, d):
    return resolve.superseded_mappings(_code_mappings(spark, d)).select(
        "year", "old_course_code", "institution_id", "new_course_code", "used_course_code")


def q_consolidate_years(spark, d):
    t = _t(spark, d)
    rows = t.candidate("regnumber", "aggregate", "gender", "year")
    return upsert.with_year(rows.withColumnRenamed("year", "_of"), F.col("_of")).drop("_of")


# -- resolution ---------------------------------------------------------------
def _region_states(t):
    return t.raw("region").select(F.col("r_regionkey").alias("st_id"), F.col("r_name").alias("st_name"))


def raw_state_text(t):
    """Per candidate, its region's name as typed: exact, lower-case padded,
    a doubled last letter, an alias, an unknown code, one wrong letter."""
    c = t.candidate("regnumber", "statecode")
    n = t.raw("nation").select("n_nationkey", "n_regionkey")
    r = t.raw("region")
    j = c.join(n, F.col("statecode") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.col("r_name")
    v = F.col("regnumber") % 6
    raw = (F.when(v == 0, name)
           .when(v == 1, F.concat(F.lit("  "), F.lower(name), F.lit(" ")))
           .when(v == 2, F.concat(name, F.substring(name, -1, 1)))
           .when(v == 3, F.lit("West Africa"))
           .when(v == 4, F.lit("XX"))
           .otherwise(F.concat(F.expr("substring(r_name, 1, length(r_name) - 1)"), F.lit("Q"))))
    return j.select("regnumber", raw.alias("raw_state"))


def q_resolve_states(spark, d):
    t = _t(spark, d)
    return resolve.resolve_states(raw_state_text(t), "raw_state", _region_states(t))


def raw_institution_text(t):
    c = t.candidate("regnumber", "inid")
    v = F.col("regnumber") % 4
    i = F.col("inid").cast("string")
    raw = (F.when(v == 0, i).when(v == 1, F.concat(F.lit("  S"), i, F.lit(" ")))
           .when(v == 2, F.concat(F.lit("X"), i)).otherwise(F.concat(F.lit(" "), i)))
    return c.select("regnumber", raw.alias("raw_institution"))


def q_resolve_institutions(spark, d):
    t = _t(spark, d)
    return resolve.resolve_institutions(raw_institution_text(t), "raw_institution", t.institution)


def _resolved(spark, d):
    t = _t(spark, d)
    checked = ingest.clean_candidates(ingest.map_columns(fx.raw_candidate_text(t)), ingest.ImportOptions(year=fx.IMPORT_YEAR), state_names=True)
    return ingest.resolve_references(checked, ingest.References(_region_states(t), t.institution, t.course))


def q_import_resolved(spark, d):
    return _resolved(spark, d)[0].select("regnumber", "statecode", "inid", F.array_join("errors", "; ").alias("error_message"))


def q_import_historical(spark, d):
    known = spark.createDataFrame([], "year int, old_course_code string, institution_id string")
    return upsert.append_historical_codes(known, _resolved(spark, d)[1], now=_now())


def _required():
    from .. import schemas
    return [h for h, _ in schemas.CANDIDATE_CSV_MAPPING]


def q_match_schema(spark, d):
    found = resolve.match_schema(fx.csv_headers(_t(spark, d), _required()), _required())
    return found.withColumn("confidence", F.round("confidence", 6))


# -- questions ----------------------------------------------------------------
def q_classify_intent(spark, d):
    return questions.classify_intent(fx.questions(_t(spark, d))).select("question_id", "intent")


def q_extract_year(spark, d):
    return questions.extract_year(fx.questions(_t(spark, d)).drop("asked_year")).select("question_id", "year")


def q_course_names(spark, d):
    return questions.course_names(_t(spark, d).course)


def q_match_courses(spark, d):
    t = _t(spark, d)
    return questions.match_courses(fx.questions(t), questions.course_names(t.course))


def q_extract_sql(spark, d):
    return questions.extract_sql(fx.replies(_t(spark, d))).select(
        "reply_id", "sql_query", "thought_process", "error")


# -- data model ---------------------------------------------------------------
def q_candidate_star(spark, d):
    return model_ops.candidate_star(_t(spark, d))


def q_count_by(spark, d):
    star = model_ops.candidate_star(_t(spark, d), dims=["state"])
    return model_ops.count_by(star, "st_name", is_admitted=True)


def q_filter_course(spark, d):
    star = model_ops.candidate_star(_t(spark, d), dims=["course"])
    return model_ops.filter_course(star, like="%ring%").groupBy("course_name").agg(
        F.count(F.lit(1)).alias("applicants"))


def q_candidate_profiles(spark, d):
    return model_ops.candidate_profiles(_t(spark, d))


def q_institution_name_asof(spark, d):
    t = _t(spark, d)
    c = t.candidate("regnumber", "inid", "year").withColumn(
        "asof", F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    return model_ops.institution_name_asof(c, "asof", model_ops.institution_name_history(t)) \
        .select("regnumber", "name_asof", "abv_asof")


def q_institution_name_overlaps(spark, d):
    t = _t(spark, d)
    c = t.candidate("regnumber", "inid", "year").withColumn("asof", F.make_date(F.col("year"), (F.col("regnumber") % 12 + 1).cast("int"), F.lit(1)))
    return model_ops.institution_name_asof(c, "asof", model_ops.overlapping_name_history(t)).select("regnumber", "name_asof", "abv_asof")


def q_institution_name_periods(spark, d):
    names = model_ops.overlapping_name_history(_t(spark, d))
    return normal_periods(names, ["inid"], "effective_from", "effective_to", ["inname", "inabv"])


def q_institution_profiles(spark, d):
    t = _t(spark, d)
    return model_ops.institution_profiles(t.institution, model_ops.institution_name_history(t))


# The subject that the mapping lacks where unmapped codes are asked for.
UNMAPPED_SUBJECT = 6


def _wide_scores(spark, d):
    t = _t(spark, d)
    mapping = t.subject_mapping_2023
    # The wide file has one column per subject; its header comes from the mapping.
    header = [(r.csv_code, r.su_id) for r in mapping.orderBy("su_id").collect()] or [("S1", 1)]
    wide = t.candidate_scores.groupBy("cand_reg_number", "year").agg(*[
        F.max(F.when(F.col("subject_id") == i, F.col("score"))).alias(code) for code, i in header])
    return wide, mapping


def q_unpivot_scores(spark, d):
    return model_ops.unpivot_scores(*_wide_scores(spark, d))


def q_unmapped_scores(spark, d):
    wide, mapping = _wide_scores(spark, d)
    return model_ops.unmapped_scores(wide, mapping.where(F.col("su_id") != UNMAPPED_SUBJECT))


def q_check_constraints(spark, d):
    return model_ops.check_constraints(_t(spark, d))


def q_region_summary(spark, d):
    t = _t(spark, d)
    # The first region is left out, so its states are in none.
    regions = (t.raw("nation").join(t.raw("region").where("r_regionkey > 0"), F.col("n_regionkey") == F.col("r_regionkey"))
               .select(F.col("r_name").alias("region"), F.col("n_name").alias("st_name")))
    return model_ops.region_summary(t, regions)


def q_region_states(spark, d):
    """The region file's reader over a document made of the given tables."""
    t = _t(spark, d)
    pairs = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = pairs.groupBy("r_name").agg(F.collect_list("n_name").alias("states"))
    # One entry per region: a handful.
    text = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "states")))).alias("value"))
    return model_ops.parse_regions(text)


def q_filter_state(spark, d):
    star = model_ops.candidate_star(_t(spark, d), dims=["state", "institution"], cand_cols=["regnumber", "gender", "statecode", "inid", "year"])
    return model_ops.filter_state(star, "nation_7").select("regnumber", "gender", "year", "st_name", "inname")


def q_scores_of(spark, d):
    t = _t(spark, d)
    mine = t.candidate("regnumber", "year").where("regnumber = 7")
    return model_ops.scores_of(t, 7, mine.select(F.max("year")).scalar())


def q_disability_stats(spark, d):
    t = _t(spark, d)
    c = t.candidate("regnumber", "year", "statecode").join(t.candidate_disabilities, F.col("regnumber") == F.col("cand_reg_number"))
    return model_ops.disability_stats(c, by=("year", "statecode"))


def q_import_disabilities(spark, d):
    good, _ = ingest.split_valid(_checked(spark, d))
    return model_ops.disability_stats(good, by=("year", "statecode")).drop("other_challenges")


def q_star_scores(spark, d):
    star = model_ops.candidate_star(_t(spark, d), dims=["disabilities", "scores"], cand_cols=["regnumber", "aggregate", "year"])
    return star


def ops_queries():
    return {
        "import_candidates": q_import_candidates,
        "import_quarantine": q_import_quarantine,
        "import_summary": q_import_summary,
        "failed_import_quarantine": q_failed_import_quarantine,
        "upsert_candidates": q_upsert_candidates,
        "clean_courses": q_clean_courses,
        "upsert_courses": q_upsert_courses,
        "upsert_course_names": q_upsert_course_names,
        "validate_course_codes": q_validate_course_codes,
        "historical_codes": q_historical_codes,
        "remap_course_codes": q_remap_course_codes,
        "remap_course_codes_asof": q_remap_course_codes_asof,
        "superseded_mappings": q_superseded_mappings,
        "consolidate_years": q_consolidate_years,
        "resolve_states": q_resolve_states,
        "resolve_institutions": q_resolve_institutions,
        "import_resolved": q_import_resolved,
        "import_historical": q_import_historical,
        "match_schema": q_match_schema,
        "classify_intent": q_classify_intent,
        "extract_year": q_extract_year,
        "course_names": q_course_names,
        "match_courses": q_match_courses,
        "extract_sql": q_extract_sql,
        "candidate_star": q_candidate_star,
        "count_by": q_count_by,
        "filter_course": q_filter_course,
        "filter_state": q_filter_state,
        "scores_of": q_scores_of,
        "candidate_profiles": q_candidate_profiles,
        "institution_name_asof": q_institution_name_asof,
        "institution_name_overlaps": q_institution_name_overlaps,
        "institution_name_periods": q_institution_name_periods,
        "institution_profiles": q_institution_profiles,
        "unpivot_scores": q_unpivot_scores,
        "unmapped_scores": q_unmapped_scores,
        "star_scores": q_star_scores,
        "import_disabilities": q_import_disabilities,
        "check_constraints": q_check_constraints,
        "region_summary": q_region_summary,
        "region_states": q_region_states,
        "disability_stats": q_disability_stats,
    }


# ============================================================================
# Oracle SQL
# ============================================================================
def _cycle_sql(values, k):
    arr = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{arr}])[({k}) % {len(values)} + 1]"


RAW_CANDIDATE = f"""
raw_candidate AS (
  SELECT CAST(regnumber AS VARCHAR) AS REGNUMBER,
         CASE WHEN regnumber % 10 = 0 THEN '' ELSE surname END AS SURNAME,
         firstname AS FIRSTNAME,
         {_cycle_sql(fx.GENDER_CYCLE, 'regnumber')} AS GENDER,
         CAST(statecode AS VARCHAR) AS STATECODE, CAST(lg_id AS VARCHAR) AS LG_ID,
         CAST(inid AS VARCHAR) AS INID,
         CASE WHEN regnumber % 97 = 0 THEN 'n/a' ELSE CAST(aggregate AS VARCHAR) END AS AGGREGATE,
         CAST(app_course1 AS VARCHAR) AS APP_COURSE1,
         {_cycle_sql(fx.FLAG_CYCLE, 'regnumber')} AS IS_ADMITTED,
         {_cycle_sql(fx.FLAG_CYCLE, 'regnumber + 3')} AS IS_BLIND,
         {_cycle_sql(fx.FLAG_CYCLE, 'regnumber + 1')} AS IS_DEAF
  FROM candidate),
blanked AS (
  SELECT nullif(trim(REGNUMBER), '') AS regnumber, nullif(trim(SURNAME), '') AS surname,
         nullif(trim(FIRSTNAME), '') AS firstname, upper(trim(GENDER)) AS g,
         nullif(trim(STATECODE), '') AS statecode, nullif(trim(LG_ID), '') AS lg_id,
         nullif(trim(INID), '') AS inid, nullif(trim(AGGREGATE), '') AS aggregate,
         nullif(trim(APP_COURSE1), '') AS app_course1, nullif(trim(IS_ADMITTED), '') AS is_admitted,
         nullif(trim(IS_BLIND), '') AS is_blind, nullif(trim(IS_DEAF), '') AS is_deaf
  FROM raw_candidate),
checked AS (
  SELECT regnumber, surname, firstname,
         CASE WHEN g IN ('M', 'MALE') THEN 'M' WHEN g IN ('F', 'FEMALE') THEN 'F' END AS gender,
         TRY_CAST(statecode AS INTEGER) AS statecode, TRY_CAST(lg_id AS INTEGER) AS lg_id, inid,
         TRY_CAST(aggregate AS INTEGER) AS aggregate, app_course1,
         CASE WHEN is_admitted IS NULL THEN NULL ELSE lower(is_admitted) IN ('yes', 'true', '1') END AS is_admitted,
         CASE WHEN is_blind IS NULL THEN NULL ELSE lower(is_blind) IN ('yes', 'true', '1') END AS is_blind,
         CASE WHEN is_deaf IS NULL THEN NULL ELSE lower(is_deaf) IN ('yes', 'true', '1') END AS is_deaf,
         {fx.IMPORT_YEAR} AS year,
         concat_ws('; ',
           CASE WHEN regnumber IS NULL THEN 'missing regnumber' END,
           CASE WHEN statecode IS NOT NULL AND TRY_CAST(statecode AS INTEGER) IS NULL
                THEN 'invalid integer for statecode: ''' || statecode || '''' END,
           CASE WHEN lg_id IS NOT NULL AND TRY_CAST(lg_id AS INTEGER) IS NULL
                THEN 'invalid integer for lg_id: ''' || lg_id || '''' END,
           CASE WHEN aggregate IS NOT NULL AND TRY_CAST(aggregate AS INTEGER) IS NULL
                THEN 'invalid integer for aggregate: ''' || aggregate || '''' END) AS error_message
  FROM blanked)"""


def _import_sql():
    cols = ", ".join(IMPORT_OUT)
    q = {}
    q["import_candidates"] = with_base(f"SELECT {cols} FROM checked WHERE error_message = ''",
                                       RAW_CANDIDATE)
    q["import_quarantine"] = with_base(f"""
SELECT error_message, 'raw_candidate' AS source_file, {SQL_NOW} AS import_ts,
       CASE WHEN surname IS NULL THEN '{{"regnumber":"' || regnumber || '"}}'
            ELSE '{{"regnumber":"' || regnumber || '","surname":"' || surname || '"}}' END AS raw
FROM checked WHERE error_message <> ''""", RAW_CANDIDATE)
    q["import_summary"] = with_base(f"""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE error_message = '') AS success_rows,
       {rnd("count(*) FILTER (WHERE error_message = '')", 'count(*)', 100)} AS success_pct,
       count(*) FILTER (WHERE error_message <> '') AS failed_rows,
       {rnd("count(*) FILTER (WHERE error_message <> '')", 'count(*)', 100)} AS failed_pct,
       arg_max(error_message, CASE WHEN error_message <> '' THEN regnumber END) AS last_error
FROM checked""", RAW_CANDIDATE)
    q["failed_import_quarantine"] = with_base("""
SELECT error_message, count(*) AS error_count FROM checked WHERE error_message <> ''
GROUP BY error_message ORDER BY error_count DESC, error_message LIMIT 10""", RAW_CANDIDATE)
    return q


UPSERT_PAIR = """
tgt AS (SELECT regnumber, surname, gender, aggregate, year, is_admitted FROM candidate
        WHERE gender IN ('F', 'M')),
bat AS (
  SELECT regnumber, CASE WHEN is_admitted THEN '' ELSE upper(surname) END AS surname, gender,
         aggregate + 1 AS aggregate, year, is_admitted, 1 AS seq
  FROM candidate WHERE gender = 'M' OR gender IS NULL
  UNION ALL
  SELECT regnumber, NULL, gender, aggregate + 2, year, is_admitted, 2
  FROM candidate WHERE gender = 'M' AND is_admitted),
bat2 AS (SELECT regnumber, nullif(trim(surname), '') AS surname, gender, aggregate, year,
                is_admitted, seq FROM bat),
last_b AS (
  SELECT regnumber,
         arg_max(surname, CASE WHEN surname IS NOT NULL THEN seq END) AS surname,
         arg_max(gender, CASE WHEN gender IS NOT NULL THEN seq END) AS gender,
         arg_max(aggregate, CASE WHEN aggregate IS NOT NULL THEN seq END) AS aggregate,
         arg_max(year, CASE WHEN year IS NOT NULL THEN seq END) AS year,
         arg_max(is_admitted, CASE WHEN is_admitted IS NOT NULL THEN seq END) AS is_admitted
  FROM bat2 GROUP BY regnumber)"""

COURSE_PAIR = f"""
ctgt AS (
  SELECT course_code,
         CASE WHEN facid <= 5 THEN 'Course ' || CAST(course_code AS VARCHAR) ELSE course_name END AS course_name,
         CAST(NULL AS VARCHAR) AS description, facid,
         {SQL_NOW} AS created_at, {SQL_NOW} AS updated_at
  FROM course WHERE facid <= 20),
cbat AS (
  SELECT course_code, course_name, course_name || ' programme' AS description,
         CASE WHEN facid <= 20 THEN facid END AS facid
  FROM course)"""

HIST = """
hist AS (
  SELECT regnumber, year,
         CASE WHEN regnumber % 50 = 0 THEN app_course1 + 1000000 ELSE app_course1 END AS course_code,
         inid AS institution_id
  FROM candidate WHERE app_course1 IS NOT NULL),
unknown AS (SELECT h.* FROM hist h WHERE NOT EXISTS (SELECT 1 FROM course co WHERE co.course_code = h.course_code))"""


OVERLAPS = """
hist AS (
  SELECT inid, DATE '1900-01-01' AS f, make_date(CAST(1995 + inid % 7 AS INTEGER), 1, 1) + 400 AS e,
         inname || ' (old)' AS inname, inabv || '-OLD' AS inabv FROM institution
  UNION ALL SELECT inid, make_date(CAST(1995 + inid % 7 AS INTEGER), 1, 1), NULL, inname, inabv FROM institution
  UNION ALL SELECT inid, DATE '1997-06-01', DATE '1998-06-01', inname || ' (interim)', inabv || '-INT' FROM institution WHERE inid % 3 = 0
  UNION ALL SELECT inid, DATE '2001-01-01', NULL, inname, inabv FROM institution WHERE inid % 4 = 0),
-- A period ends at its own end, or where the next one starts.
cut AS (SELECT inid, f, inname, inabv, least(coalesce(e, DATE '9999-01-01'), coalesce(lead(f) OVER (PARTITION BY inid ORDER BY f), DATE '9999-01-01')) AS e
        FROM (SELECT DISTINCT * FROM hist) x)"""


def _upsert_sql():
    q = {}
    q["upsert_candidates"] = with_base("""
SELECT coalesce(b.regnumber, t.regnumber) AS regnumber, coalesce(b.surname, t.surname) AS surname,
       coalesce(b.gender, t.gender) AS gender, coalesce(b.aggregate, t.aggregate) AS aggregate,
       coalesce(b.year, t.year) AS year, coalesce(b.is_admitted, t.is_admitted) AS is_admitted
FROM tgt t FULL OUTER JOIN last_b b ON t.regnumber = b.regnumber""", UPSERT_PAIR)
    q["clean_courses"] = with_base("""
SELECT nullif(trim(CODE), '') AS course_code, nullif(trim(NAME), '') AS course_name,
       nullif(trim(DESCRIPTION), '') AS description,
       TRY_CAST(nullif(trim(FACULTY_ID), '') AS INTEGER) AS facid
FROM (SELECT CAST(p_partkey AS VARCHAR) AS CODE,
             CASE WHEN p_size <= 2 THEN '  ' ELSE ' ' || p_name END AS NAME,
             p_type AS DESCRIPTION,
             CASE WHEN p_size = 50 THEN 'n/a' ELSE regexp_extract(p_brand, '(\\d+)', 1) END AS FACULTY_ID
      FROM part) r
WHERE nullif(trim(CODE), '') IS NOT NULL AND nullif(trim(NAME), '') IS NOT NULL""")
    q["upsert_courses"] = with_base("""
SELECT coalesce(n.course_code, o.course_code) AS course_code,
       coalesce(n.course_name, o.course_name) AS course_name,
       coalesce(n.description, o.description) AS description,
       coalesce(n.facid, o.facid) AS facid,
       CASE WHEN o.course_code IS NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE o.created_at END AS created_at,
       CASE WHEN n.course_code IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE o.updated_at END AS updated_at
FROM ctgt o FULL OUTER JOIN cbat n ON o.course_code = n.course_code""", COURSE_PAIR)
    q["upsert_course_names"] = with_base("""
SELECT coalesce(o.course_code, n.course_code) AS course_code,
       CASE WHEN o.course_name LIKE 'Course%' OR o.course_code IS NULL
            THEN coalesce(n.course_name, o.course_name) ELSE o.course_name END AS course_name
FROM ctgt o FULL OUTER JOIN cbat n ON o.course_code = n.course_code""", COURSE_PAIR)
    q["validate_course_codes"] = with_base("""
SELECT h.regnumber, h.course_code, EXISTS (SELECT 1 FROM course co WHERE co.course_code = h.course_code) AS code_known
FROM hist h""", HIST)
    q["historical_codes"] = with_base(f"""
SELECT DISTINCT u.year, u.course_code AS old_course_code, u.institution_id,
       {SQL_NOW} AS import_timestamp, false AS reconciled
FROM unknown u
WHERE NOT EXISTS (SELECT 1 FROM unknown f WHERE f.year = (SELECT min(year) FROM unknown) AND f.year = u.year
                  AND f.course_code = u.course_code AND f.institution_id = u.institution_id)""", HIST)
    q["remap_course_codes"] = with_base(f"""
SELECT h.regnumber, coalesce(m.new_code, h.course_code) AS course_code, m.new_code IS NOT NULL AS remapped
FROM hist h LEFT JOIN (SELECT DISTINCT year, course_code AS old_code, course_code - {UNKNOWN_CODE_OFFSET} AS new_code,
                        institution_id FROM unknown) m
  ON h.course_code = m.old_code AND h.year = m.year AND h.institution_id = m.institution_id""", HIST)
    q["remap_course_codes_asof"] = with_base(f"""
SELECT h.regnumber, m.new_code IS NOT NULL AS remapped, coalesce(m.new_code, h.course_code) AS course_code
FROM (SELECT *, CASE WHEN regnumber % 350 <> 0 THEN DATE '2024-01-15' + CAST(regnumber % 4 * 20 AS INTEGER) END AS seen FROM hist) h
LEFT JOIN (
  SELECT DISTINCT year, course_code AS old_code, institution_id,
         CASE WHEN course_code % 2 = 0 THEN course_code - {UNKNOWN_CODE_OFFSET} + 1 ELSE NULL END AS first_code,
         course_code - {UNKNOWN_CODE_OFFSET} AS last_code FROM unknown) u
  ON h.course_code = u.old_code AND h.year = u.year AND h.institution_id = u.institution_id
CROSS JOIN LATERAL (SELECT CASE WHEN h.seen >= DATE '2024-03-01' THEN u.last_code WHEN h.seen >= DATE '2024-02-01' THEN u.first_code END AS new_code) m""", HIST)
    q["superseded_mappings"] = with_base(f"""
SELECT DISTINCT year, course_code AS old_course_code, institution_id,
       course_code - {UNKNOWN_CODE_OFFSET} + 1 AS new_course_code, course_code - {UNKNOWN_CODE_OFFSET} AS used_course_code
FROM unknown WHERE course_code % 2 = 0""", HIST)
    q["consolidate_years"] = with_base("""
SELECT regnumber, aggregate, gender, year FROM candidate""")
    return q


def _alias_case(expr):
    from .. import schemas
    arms = " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'"
                    for k, v in schemas.STATE_ALIASES.items())
    return f"coalesce(CASE {expr} {arms} END, {expr})"


def _resolve_sql():
    q = {}
    raw_state = """
rc AS (
  SELECT c.regnumber,
         CASE c.regnumber % 6 WHEN 0 THEN r.r_name
              WHEN 1 THEN '  ' || lower(r.r_name) || ' '
              WHEN 2 THEN r.r_name || right(r.r_name, 1)
              WHEN 3 THEN 'West Africa' WHEN 4 THEN 'XX'
              ELSE left(r.r_name, length(r.r_name) - 1) || 'Q' END AS raw_state
  FROM candidate c JOIN nation n ON c.statecode = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),"""
    q["resolve_states"] = with_base("""
SELECT rc.regnumber, rc.raw_state, coalesce(ex.ex_id, fz.fz_id) AS st_id,
       CASE WHEN ex.ex_id IS NOT NULL THEN 'exact' WHEN fz.fz_id IS NOT NULL THEN 'fuzzy' END AS state_match
FROM rc LEFT JOIN ex ON rc.raw_state = ex.raw_state LEFT JOIN fz ON rc.raw_state = fz.raw_state""",
        raw_state + f"""
names AS (SELECT DISTINCT raw_state, {_alias_case("upper(trim(raw_state))")} AS clean FROM rc),
ex AS (SELECT nm.raw_state, nm.clean, r.r_regionkey AS ex_id FROM names nm LEFT JOIN region r ON nm.clean = r.r_name),
fz AS (SELECT e.raw_state, first(r.r_regionkey ORDER BY levenshtein(e.clean, r.r_name), r.r_regionkey) AS fz_id
       FROM ex e JOIN region r ON levenshtein(e.clean, r.r_name) <= 2
       WHERE e.ex_id IS NULL GROUP BY e.raw_state)""")
    q["resolve_institutions"] = with_base("""
SELECT ri.regnumber, ri.raw_institution, k.inid AS resolved_inid
FROM ri LEFT JOIN keys k ON nullif(trim(ri.raw_institution), '') = k.key""", """
ri AS (
  SELECT regnumber,
         CASE regnumber % 4 WHEN 0 THEN CAST(inid AS VARCHAR)
              WHEN 1 THEN '  S' || CAST(inid AS VARCHAR) || ' '
              WHEN 2 THEN 'X' || CAST(inid AS VARCHAR)
              ELSE ' ' || CAST(inid AS VARCHAR) END AS raw_institution
  FROM candidate),
keys AS (
  SELECT key, first(inid ORDER BY p, inid) AS inid FROM (
    SELECT CAST(inid AS VARCHAR) AS key, inid, 0 AS p FROM institution
    UNION ALL
    SELECT nullif(trim(inabv), '') AS key, inid, 1 AS p FROM institution WHERE nullif(trim(inabv), '') IS NOT NULL) u
  GROUP BY key)""")
    raw_text = """
rt AS (
  SELECT CAST(c.regnumber AS VARCHAR) AS regnumber,
         CASE c.regnumber % 6 WHEN 0 THEN r.r_name WHEN 1 THEN '  ' || lower(r.r_name) || ' '
              WHEN 2 THEN r.r_name || right(r.r_name, 1) WHEN 3 THEN CAST(r.r_regionkey AS VARCHAR)
              WHEN 4 THEN 'XX' ELSE '' END AS st,
         CASE c.regnumber % 4 WHEN 0 THEN CAST(c.inid AS VARCHAR) WHEN 1 THEN ' S' || CAST(c.inid AS VARCHAR)
              WHEN 2 THEN 'X' || CAST(c.inid AS VARCHAR) ELSE CAST(c.inid AS VARCHAR) || ' ' END AS inst,
         CASE WHEN c.regnumber % 50 = 0 THEN c.app_course1 + 1000000 ELSE c.app_course1 END AS code
  FROM candidate c JOIN nation n ON c.statecode = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
tb AS (SELECT regnumber, nullif(trim(st), '') AS st, nullif(trim(inst), '') AS inst, CAST(code AS VARCHAR) AS code FROM rt),
ts AS (SELECT DISTINCT st FROM tb WHERE st IS NOT NULL AND TRY_CAST(st AS INTEGER) IS NULL),
sr AS (SELECT ts.st, first(r.r_regionkey ORDER BY levenshtein(x.clean, r.r_name), r.r_regionkey) AS st_id
       FROM ts JOIN (SELECT st AS s0, """ + _alias_case("upper(trim(st))") + """ AS clean FROM ts) x ON x.s0 = ts.st
       JOIN region r ON levenshtein(x.clean, r.r_name) <= 2 GROUP BY ts.st),
ik AS (SELECT key, first(inid ORDER BY p, inid) AS inid FROM (
    SELECT CAST(inid AS VARCHAR) AS key, inid, 0 AS p FROM institution
    UNION ALL SELECT nullif(trim(inabv), ''), inid, 1 FROM institution WHERE nullif(trim(inabv), '') IS NOT NULL) u GROUP BY key),
res AS (
  SELECT tb.regnumber, coalesce(TRY_CAST(tb.st AS INTEGER), CAST(sr.st_id AS INTEGER)) AS statecode,
         coalesce(CAST(ik.inid AS VARCHAR), tb.inst) AS inid, tb.code,
         concat_ws('; ', CASE WHEN tb.st IS NOT NULL AND TRY_CAST(tb.st AS INTEGER) IS NULL AND sr.st_id IS NULL THEN 'unknown state: ' || tb.st END,
                   CASE WHEN tb.inst IS NOT NULL AND ik.inid IS NULL THEN 'invalid institution: ' || tb.inst END) AS error_message
  FROM tb LEFT JOIN sr ON tb.st = sr.st LEFT JOIN ik ON tb.inst = ik.key)"""
    q["import_resolved"] = with_base("SELECT regnumber, statecode, inid, error_message FROM res", raw_text)
    q["import_historical"] = with_base(f"""
SELECT DISTINCT {fx.IMPORT_YEAR} AS year, code AS old_course_code, inid AS institution_id, {SQL_NOW} AS import_timestamp, false AS reconciled
FROM res WHERE error_message = '' AND code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM course co WHERE CAST(co.course_code AS VARCHAR) = res.code)""", raw_text)
    names = "[" + ", ".join(f"'{h}'" for h in _required()) + "]"
    q["match_schema"] = f"""
WITH h0 AS (SELECT n_name AS file, n_nationkey AS k, i AS position, ({names})[i + 1] AS name
            FROM nation, (SELECT unnest(range({len(_required())})) AS i) x),
h AS (SELECT file, position, CASE (k + position) % 7 WHEN 0 THEN name WHEN 1 THEN lower(name) WHEN 2 THEN replace(name, '_', ' ')
        WHEN 3 THEN name || 'S' WHEN 4 THEN left(name, length(name) - 1) WHEN 5 THEN 'COL ' || CAST(position AS VARCHAR) ELSE ' ' || name END AS header FROM h0),
p AS (SELECT h.*, r.required FROM h, (SELECT unnest({names}) AS required) r),
q AS (SELECT *, lower(trim(header)) = lower(trim(required)) OR replace(lower(trim(header)), ' ', '') = replace(lower(trim(required)), ' ', '') AS exact,
        regexp_replace(lower(trim(header)), '[_ ]', '', 'g') AS a, regexp_replace(lower(trim(required)), '[_ ]', '', 'g') AS b FROM p),
c AS (SELECT *, 1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b), 1) AS conf FROM q),
g AS (SELECT file, required, arg_min(header, CASE WHEN exact THEN position END) AS eh,
        first(header ORDER BY conf DESC, position) FILTER (WHERE conf > 0.6) AS fh, max(conf) FILTER (WHERE conf > 0.6) AS best,
        count(*) FILTER (WHERE conf > 0.6) AS n FROM c GROUP BY file, required)
SELECT file, required, coalesce(eh, fh) AS header, round(CASE WHEN eh IS NOT NULL THEN 1.0 ELSE best END, 6) AS confidence,
       CASE WHEN eh IS NOT NULL THEN 'exact' WHEN fh IS NULL THEN 'missing' WHEN n = 1 AND best > 0.8 THEN 'auto' ELSE 'review' END AS status
FROM g"""
    return q


def _questions_sql():
    from .. import schemas
    q = {}
    tmpl = _cycle_sql(fx.QUESTION_TEMPLATES, "p_partkey")
    n = len(fx.QUESTION_TEMPLATES)
    qs = f"""
qs AS (
  SELECT p_partkey AS question_id,
         replace(replace({tmpl}, '{{name}}', p_name), '{{year}}',
                 CAST({fx.QUESTION_FIRST_YEAR} + (p_partkey // {n}) % {fx.QUESTION_YEAR_SPAN} AS VARCHAR)) AS question,
         CAST({fx.QUESTION_FIRST_YEAR} + (p_partkey // {n}) % {fx.QUESTION_YEAR_SPAN} AS VARCHAR) AS asked_year
  FROM part)"""
    arms = []
    for intent, words in schemas.INTENT_RULES:
        cond = " OR ".join(f"contains(lower(question), '{w}')" for w in words)
        arms.append(f"WHEN {cond} THEN '{intent}'")
    q["classify_intent"] = with_base(
        f"SELECT question_id, CASE {' '.join(arms)} ELSE '{schemas.INTENT_DEFAULT}' END AS intent FROM qs", qs)
    yarms = " ".join(f"WHEN contains(lower(question), '{y}') THEN '{y}'" for y in schemas.QUESTION_YEARS)
    q["extract_year"] = with_base(
        f"SELECT question_id, CASE {yarms} ELSE '{schemas.QUESTION_YEAR_DEFAULT}' END AS year FROM qs", qs)
    names = """
nm AS (SELECT lower(trim(course_name)) AS key, max(trim(course_name)) AS name FROM course
       WHERE trim(course_name) <> '' GROUP BY lower(trim(course_name)))"""
    q["course_names"] = with_base("SELECT key, name FROM nm", names)
    kw_rows = ", ".join(f"('{c}', {p}, '{k}')" for p, (c, ks) in enumerate(schemas.COURSE_CATEGORIES) for k in ks)
    fallback = " OR ".join(f"contains(q, '{w}')" for w in schemas.COURSE_FALLBACK_WORDS)
    q["match_courses"] = with_base(f"""
SELECT question_id, pattern, min(stage) AS stage FROM (
  SELECT qid AS question_id, '''%' || name || '%''' AS pattern, stage FROM abc
  UNION ALL
  SELECT qq.qid, '{schemas.COURSE_FALLBACK_PATTERN.replace("'", "''")}', 'd' FROM qq
  WHERE ({fallback}) AND qq.qid NOT IN (SELECT qid FROM abc)) u
GROUP BY question_id, pattern""", qs + "," + names + f""",
qq AS (SELECT question_id AS qid, lower(question) AS q FROM qs),
kw AS (SELECT * FROM (VALUES {kw_rows}) AS v(category, priority, keyword)),
a AS (SELECT qq.qid, nm.name, 'a' AS stage FROM qq JOIN nm ON contains(qq.q, nm.key)),
fc AS (SELECT qq.qid, arg_min(kw.category, kw.priority) AS category FROM qq JOIN kw ON contains(qq.q, kw.keyword) GROUP BY qq.qid),
terms AS (SELECT category, keyword AS term FROM kw UNION ALL SELECT category, category FROM kw),
cc AS (SELECT DISTINCT t.category, nm.name FROM nm JOIN terms t ON contains(nm.key, t.term)),
b AS (SELECT fc.qid, cc.name, 'b' AS stage FROM fc JOIN cc ON fc.category = cc.category),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
words AS (SELECT qid, w FROM (SELECT qid, unnest(regexp_split_to_array(trim(q), '\\s+')) AS w FROM qq
          WHERE qid NOT IN (SELECT qid FROM ab)) x WHERE strlen(w) >= {schemas.COURSE_WORD_MIN_BYTES}),
c AS (SELECT words.qid, nm.name, 'c' AS stage FROM words JOIN nm ON contains(nm.key, words.w)),
abc AS (SELECT * FROM ab UNION ALL SELECT * FROM c)""")
    ws = "chr(10) || chr(13) || chr(9) || ' '"
    q["extract_sql"] = with_base(f"""
SELECT reply_id,
       CASE WHEN raw_sql IS NULL THEN NULL
            ELSE trim(regexp_replace(replace(raw_sql, '\\n', ' '), '\\s+', ' ', 'g')) END AS sql_query,
       CASE WHEN json_valid(r) THEN json_extract_string(r, '$.thought_process') END AS thought_process,
       CASE WHEN is_obj AND coalesce(js, '') = '' THEN 'no SQL query found in response'
            WHEN NOT is_obj AND found = '' THEN 'failed to extract SQL query' END AS error
FROM (
  SELECT reply_id, r, is_obj, js, found,
         CASE WHEN is_obj THEN CASE WHEN coalesce(js, '') <> '' THEN js END
              ELSE CASE WHEN found <> '' THEN found END END AS raw_sql
  FROM (
    SELECT reply_id, r,
           coalesce(json_valid(r) AND json_type(CASE WHEN json_valid(r) THEN r ELSE '0' END) = 'OBJECT', false)
             AND coalesce(CASE WHEN json_valid(r) THEN json_type(r, '$.sql_query') END, 'NULL') IN ('VARCHAR', 'NULL') AS is_obj,
           CASE WHEN json_valid(r) THEN coalesce(json_extract_string(r, '$.sql_query'), json_extract_string(r, '$.SQL_QUERY')) END AS js,
           regexp_extract(r, '(?i)SELECT\\s+.*?(?:;|$)', 0) AS found
    FROM (SELECT reply_id, trim(replace(replace(replace(reply, '```json', ''), '```', ''), '`', ''), {ws}) AS r
          FROM rp) x) y) z""", qs + f""",
rp AS (
  SELECT question_id AS reply_id,
         CASE question_id % 9
           WHEN 0 THEN '{{"thought_process": "count rows", "sql_query": "SELECT count(*)\\\\nFROM candidate WHERE year = ' || asked_year || ';"}}'
           WHEN 1 THEN '```json' || chr(10) || '{{"thought_process": "by course", "sql_query": "SELECT * FROM course WHERE course_code = ' || CAST(question_id AS VARCHAR) || '"}}' || chr(10) || '```'
           WHEN 2 THEN 'Here is the query: SELECT regnumber FROM candidate WHERE year = ' || asked_year || '; hope this helps'
           WHEN 3 THEN 'I cannot answer: ' || question
           WHEN 4 THEN '{{"thought_process": "none", "sql_query": ""}}'
           WHEN 5 THEN '{{"sql_query": "SELECT regnumber FROM candidate WHERE year = ' || asked_year || '"}} as you asked'
           WHEN 6 THEN '{{"thought_process": "n", "sql_query": 5}}'
           WHEN 7 THEN '{{"thought_process": "n", "sql_query": null}}'
           ELSE '{{"SQL_QUERY": "SELECT max(aggregate) FROM candidate WHERE year = ' || asked_year || '"}}' END AS reply
  FROM qs)""")
    return q


def _model_sql():
    q = {}
    q["candidate_star"] = with_base("""
SELECT c.regnumber, c.surname, c.gender, c.statecode, c.lg_id, c.aggregate, c.year, c.is_admitted,
       c.app_course1, c.inid, s.st_name, l.lg_name, co.course_name, co.facid, f.fac_name,
       i.inname, i.intyp, it.intyp_desc
FROM candidate c
LEFT JOIN state s ON c.statecode = s.st_id
LEFT JOIN lga l ON c.lg_id = l.lg_id
LEFT JOIN course co ON c.app_course1 = co.course_code
LEFT JOIN faculty f ON co.facid = f.fac_id
LEFT JOIN institution i ON c.inid = i.inid
LEFT JOIN institution_type it ON i.intyp = it.intyp_id""")
    q["count_by"] = with_base("""
SELECT s.st_name, count(*) AS count FROM candidate c LEFT JOIN state s ON c.statecode = s.st_id
WHERE c.is_admitted GROUP BY s.st_name""")
    q["filter_course"] = with_base("""
SELECT co.course_name, count(*) AS applicants FROM candidate c
LEFT JOIN course co ON c.app_course1 = co.course_code
WHERE lower(co.course_name) LIKE '%ring%' GROUP BY co.course_name""")
    q["candidate_profiles"] = with_base("""
SELECT c.regnumber,
       CAST(to_json({'regnumber': c.regnumber, 'surname': c.surname, 'gender': c.gender,
                'aggregate': c.aggregate, 'year': c.year,
                'state': {'st_id': c.statecode, 'st_name': s.st_name},
                'lga': {'lg_id': c.lg_id, 'lg_name': l.lg_name},
                'scores': coalesce(sc.scores, []),
                'disabilities': CASE WHEN cd.cand_reg_number IS NOT NULL THEN {'is_blind': cd.is_blind, 'is_deaf': cd.is_deaf, 'other_challenges': cd.other_challenges} END,
                'exam_info': CASE WHEN ce.cand_reg_number IS NOT NULL THEN {'exam_town': ce.exam_town, 'exam_centre': ce.exam_centre,
                  'exam_number': ce.exam_number, 'mock_state_id': ce.mock_state_id, 'is_mock_candidate': ce.is_mock_candidate} END}) AS VARCHAR) AS profile
FROM candidate c
LEFT JOIN state s ON c.statecode = s.st_id
LEFT JOIN lga l ON c.lg_id = l.lg_id
LEFT JOIN candidate_disabilities cd ON cd.cand_reg_number = c.regnumber
LEFT JOIN candidate_exam_info ce ON ce.cand_reg_number = c.regnumber
LEFT JOIN sc ON sc.cand_reg_number = c.regnumber""", """
sc AS (
  SELECT cs.cand_reg_number,
         list({'subject_id': cs.subject_id, 'year': cs.year, 'su_name': su.su_name, 'score': cs.score}
              ORDER BY cs.subject_id, cs.year) AS scores
  FROM candidate_scores cs JOIN subject su ON cs.subject_id = su.su_id
  GROUP BY cs.cand_reg_number)""")
    q["institution_profiles"] = with_base("""
SELECT i.inid,
       CAST(to_json({'inid': i.inid, 'inabv': i.inabv, 'inname': i.inname,
                     'names': coalesce(h.names, [])}) AS VARCHAR) AS profile
FROM institution i LEFT JOIN (
  SELECT inid, list({'effective_from': effective_from, 'effective_to': effective_to,
                     'inabv': inabv, 'inname': inname}
                    ORDER BY effective_from, effective_to NULLS FIRST, inabv, inname) AS names
  FROM hist GROUP BY inid) h ON i.inid = h.inid""", """
hist AS (
  SELECT inid, DATE '1900-01-01' AS effective_from, make_date(CAST(1995 + inid % 7 AS INTEGER), 1, 1) AS effective_to,
         inname || ' (old)' AS inname, inabv || '-OLD' AS inabv FROM institution
  UNION ALL
  SELECT inid, make_date(CAST(1995 + inid % 7 AS INTEGER), 1, 1), NULL, inname, inabv FROM institution)""")
    q["institution_name_asof"] = with_base("""
SELECT c.regnumber, h.inname AS name_asof, h.inabv AS abv_asof
FROM candidate c LEFT JOIN hist h
  ON c.inid = h.inid AND make_date(c.year, 1, 1) >= h.effective_from
 AND (h.effective_to IS NULL OR make_date(c.year, 1, 1) < h.effective_to)""", """
hist AS (
  SELECT inid, DATE '1900-01-01' AS effective_from, make_date(CAST(1995 + inid % 7 AS INTEGER), 1, 1) AS effective_to,
         inname || ' (old)' AS inname, inabv || '-OLD' AS inabv FROM institution
  UNION ALL
  SELECT inid, make_date(CAST(1995 + inid % 7 AS INTEGER), 1, 1), NULL, inname, inabv FROM institution)""")
    q["institution_name_overlaps"] = with_base("""
SELECT c.regnumber, h.inname AS name_asof, h.inabv AS abv_asof
FROM candidate c LEFT JOIN cut h ON c.inid = h.inid AND make_date(c.year, CAST(c.regnumber % 12 + 1 AS INTEGER), 1) >= h.f
 AND make_date(c.year, CAST(c.regnumber % 12 + 1 AS INTEGER), 1) < h.e""", OVERLAPS)
    q["institution_name_periods"] = with_base("""
SELECT inid, min(f) AS effective_from, nullif(max(e), DATE '9999-01-01') AS effective_to, inname, inabv
FROM (SELECT *, sum(CASE WHEN touches THEN 0 ELSE 1 END) OVER (PARTITION BY inid ORDER BY f) AS part
      FROM (SELECT *, coalesce(lag(inname) OVER (PARTITION BY inid ORDER BY f) = inname AND lag(e) OVER (PARTITION BY inid ORDER BY f) >= f, false) AS touches FROM cut) y) x
GROUP BY inid, part, inname, inabv""", OVERLAPS)
    q["unpivot_scores"] = with_base("""
SELECT cand_reg_number, year, subject_id, subject_id AS position, score FROM candidate_scores WHERE score IS NOT NULL""")
    q["unmapped_scores"] = with_base("""
SELECT cand_reg_number, year, 'S6' AS csv_code, score, 'unknown subject code: S6' AS error_message
FROM candidate_scores WHERE score IS NOT NULL AND subject_id = 6""")
    q["star_scores"] = with_base("""
SELECT c.regnumber, c.aggregate, c.year, d.is_blind, d.is_deaf, d.other_challenges, cs.year AS score_year, su.su_name, cs.score
FROM candidate c LEFT JOIN candidate_disabilities d ON c.regnumber = d.cand_reg_number
LEFT JOIN candidate_scores cs ON c.regnumber = cs.cand_reg_number LEFT JOIN subject su ON cs.subject_id = su.su_id""")
    q["import_disabilities"] = with_base("""
SELECT year, statecode, count(*) AS candidates,
       count(*) FILTER (WHERE is_blind) AS blind, count(*) FILTER (WHERE is_deaf) AS deaf
FROM checked WHERE error_message = '' GROUP BY year, statecode""", RAW_CANDIDATE)
    q["region_summary"] = with_base(f"""
SELECT region, st_name, CASE grouping(region, st_name) WHEN 0 THEN 'state' WHEN 1 THEN 'region' ELSE 'total' END AS level,
       count(*) AS candidates, {rnd('sum(aggregate)', 'count(aggregate)')} AS avg_score
FROM (SELECT coalesce(r.r_name, 'unassigned') AS region, coalesce(s.st_name, 'unassigned') AS st_name, c.aggregate
      FROM candidate c LEFT JOIN state s ON c.statecode = s.st_id
      LEFT JOIN nation n ON n.n_name = s.st_name LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey > 0) x
GROUP BY ROLLUP (region, st_name)""")
    q["region_states"] = """
SELECT r_name AS region, n_name AS st_name FROM nation JOIN region ON n_regionkey = r_regionkey"""
    q["filter_state"] = with_base("""
SELECT c.regnumber, c.gender, c.year, s.st_name, i.inname
FROM candidate c JOIN state s ON c.statecode = s.st_id LEFT JOIN institution i ON c.inid = i.inid WHERE s.st_name = 'NATION_7'""")
    q["scores_of"] = with_base("""
SELECT su.su_name, cs.score FROM candidate_scores cs JOIN subject su ON cs.subject_id = su.su_id
WHERE cs.cand_reg_number = 7 AND cs.year = (SELECT year FROM candidate WHERE regnumber = 7)""")
    q["disability_stats"] = with_base("""
SELECT c.year, c.statecode, count(*) AS candidates, count(*) FILTER (WHERE d.is_blind) AS blind,
       count(*) FILTER (WHERE d.is_deaf) AS deaf, count(d.other_challenges) AS other_challenges
FROM candidate c JOIN candidate_disabilities d ON c.regnumber = d.cand_reg_number GROUP BY c.year, c.statecode""")
    return q


def ops_oracle_sql():
    o = {}
    for f in (_import_sql, _upsert_sql, _resolve_sql, _questions_sql, _model_sql, _constraints_sql):
        o.update(f())
    return o


# Columns of the projected tables (for the constraint oracle).
PROJECTED_COLUMNS = {
    "candidate": ["regnumber", "surname", "firstname", "gender", "statecode", "lg_id", "aggregate",
                  "year", "is_admitted", "app_course1", "inid"],
    "course": ["course_code", "course_name", "facid"],
    "institution": ["inid", "inabv", "inname", "inst_state_id", "affiliated_state_id", "intyp"],
    "state": ["st_id", "st_name", "st_region"],
    "faculty": ["fac_id", "fac_name"],
    "lga": ["lg_id", "lg_st_id", "lg_name"],
    "subject": ["su_id", "su_name"],
    "institution_type": ["intyp_id", "intyp_desc"],
    "candidate_disabilities": ["cand_reg_number", "is_blind", "is_deaf", "other_challenges"],
    "candidate_exam_info": ["cand_reg_number", "exam_town", "exam_centre", "exam_number", "mock_state_id", "is_mock_candidate"],
    "institution_names": ["inid", "effective_from", "effective_to", "inname", "inabv", "change_reason"],
    "subject_mapping_2023": ["csv_code", "su_id", "position"],
    "course_code_mappings": ["id", "old_course_code", "new_course_code", "course_name"],
    "historical_course_codes": ["id", "old_course_code"],
}


def _constraints_sql():
    from .. import schemas
    parts = []
    for name, pk in schemas.PRIMARY_KEYS.items():
        keys = ", ".join(pk)
        parts.append(f"""SELECT '{name}' AS "table", 'pk({','.join(pk)})' AS rule,
  CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations
FROM (SELECT count(*) AS n FROM {name} GROUP BY {keys} HAVING count(*) > 1) d""")
        for child, col, parent, pcol in schemas.FOREIGN_KEYS:
            if child != name:
                continue
            parts.append(f"""SELECT '{child}', 'fk({col}->{parent}.{pcol})',
  CAST(count(*) AS BIGINT) FROM {child} x
WHERE x.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pcol} = x.{col})""")
        for c in schemas.NOT_NULL.get(name, []):
            parts.append(f"SELECT '{name}', 'not_null({c})', CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) FROM {name}")
        cols = PROJECTED_COLUMNS.get(name)
        for c, n in schemas.VARCHAR_LIMITS.get(name, {}).items():
            if cols is not None and c in cols:
                parts.append(f"SELECT '{name}', 'length({c})<={n}', "
                             f"CAST(count(*) FILTER (WHERE length(CAST({c} AS VARCHAR)) > {n}) AS BIGINT) FROM {name}")
    return {"check_constraints": with_base("\nUNION ALL\n".join(parts))}

