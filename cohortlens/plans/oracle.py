"""DuckDB oracle SQL for the registered queries.

Each string runs on the raw generated tables (pre-registered views) and
re-derives the admissions tables with the same projection rules as
``sources.tables.DriverTables``, written independently in SQL.
"""

from __future__ import annotations

from ..sources.tables import MARKET_SEGMENTS


def _segment(col: str) -> str:
    arms = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(MARKET_SEGMENTS))
    return f"(CASE {col} {arms} END)"


def rnd(s: str, n: str, scale: int = 1) -> str:
    """Exact half-up round(scale * s / n, 2) for non-negative integers."""
    k = 200 * scale
    return f"(CASE WHEN {n} > 0 THEN CAST((({k} * {s} + {n}) // (2 * {n})) AS DOUBLE) / 100 END)"


def pct(a: str, b: str) -> str:
    return rnd(a, b, 100)


BASE_CTES = f"""
state AS (
  SELECT n_nationkey AS st_id, n_name AS st_name, n_regionkey AS st_region FROM nation),
lga AS (
  SELECT DISTINCT CAST(c_nationkey * 10 + {_segment('c_mktsegment')} AS INTEGER) AS lg_id,
         c_nationkey AS lg_st_id, c_mktsegment AS lg_name
  FROM customer),
faculty AS (
  SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS fac_id, p_brand AS fac_name
  FROM part),
course AS (
  SELECT p_partkey AS course_code, p_name AS course_name,
         CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS facid
  FROM part),
institution AS (
  SELECT s_suppkey AS inid, 'S' || CAST(s_suppkey AS VARCHAR) AS inabv, s_name AS inname,
         s_nationkey AS inst_state_id,
         CASE WHEN s_suppkey % 10 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS affiliated_state_id,
         CAST(s_suppkey % 3 AS INTEGER) AS intyp
  FROM supplier),
institution_type AS (
  SELECT * FROM (VALUES (0, 'FEDERAL'), (1, 'STATE'), (2, 'PRIVATE')) AS v(intyp_id, intyp_desc)),
subject AS (
  SELECT CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS su_id, p_type AS su_name
  FROM (SELECT DISTINCT p_type FROM part) AS d),
line_first AS (
  SELECT l_orderkey, min(l_partkey) AS app_course1, min(l_suppkey) AS inid
  FROM lineitem GROUP BY l_orderkey),
candidate AS (
  SELECT o.o_orderkey AS regnumber, cu.c_name AS surname, cu.c_mktsegment AS firstname,
         CASE o.o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS gender,
         cu.c_nationkey AS statecode,
         CAST(cu.c_nationkey * 10 + {_segment('cu.c_mktsegment')} AS INTEGER) AS lg_id,
         CAST(floor(o.o_totalprice / 1250) AS INTEGER) AS aggregate,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         o.o_orderpriority = '1-URGENT' AS is_admitted,
         lf.app_course1, lf.inid
  FROM orders o
  LEFT JOIN customer cu ON o.o_custkey = cu.c_custkey
  LEFT JOIN line_first lf ON lf.l_orderkey = o.o_orderkey),
candidate_disabilities AS (
  SELECT o_orderkey AS cand_reg_number, o_orderkey % 3 = 0 AS is_blind, o_orderkey % 3 = 1 AS is_deaf,
         CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS other_challenges
  FROM orders WHERE o_orderpriority = '5-LOW'),
candidate_exam_info AS (
  SELECT o.o_orderkey AS cand_reg_number, cu.c_mktsegment AS exam_town, cu.c_name AS exam_centre,
         'E' || CAST(o.o_orderkey AS VARCHAR) AS exam_number, cu.c_nationkey AS mock_state_id,
         o.o_orderstatus = 'P' AS is_mock_candidate
  FROM orders o LEFT JOIN customer cu ON o.o_custkey = cu.c_custkey),
institution_names AS (
  SELECT inid, DATE '1900-01-01' AS effective_from, make_date(CAST(1995 + inid % 7 AS INTEGER), 1, 1) AS effective_to,
         inname || ' (old)' AS inname, inabv || '-OLD' AS inabv, 'renamed' AS change_reason FROM institution
  UNION ALL
  SELECT inid, make_date(CAST(1995 + inid % 7 AS INTEGER), 1, 1), NULL, inname, inabv, NULL FROM institution),
subject_mapping_2023 AS (
  SELECT 'S' || CAST(su_id AS VARCHAR) AS csv_code, su_id, su_id AS position FROM subject),
historical_course_codes AS (
  SELECT min(regnumber) AS id, year, app_course1 + 1000000 AS old_course_code, inid AS institution_id
  FROM candidate WHERE regnumber % 50 = 0 AND app_course1 IS NOT NULL GROUP BY year, app_course1, inid),
course_code_mappings AS (
  SELECT 2 * id AS id, old_course_code, old_course_code - 1000000 AS new_course_code,
         'Course ' || CAST(old_course_code - 1000000 AS VARCHAR) AS course_name FROM historical_course_codes
  UNION ALL
  SELECT 2 * id + 1, old_course_code, old_course_code - 999999, 'Course ' || CAST(old_course_code - 999999 AS VARCHAR)
  FROM historical_course_codes WHERE old_course_code % 2 = 0),
candidate_scores AS (
  SELECT li.l_orderkey AS cand_reg_number, su.su_id AS subject_id,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         max(CAST(floor(li.l_quantity) AS INTEGER)) AS score
  FROM lineitem li
  JOIN part p ON li.l_partkey = p.p_partkey
  JOIN subject su ON p.p_type = su.su_name
  JOIN orders o ON o.o_orderkey = li.l_orderkey
  GROUP BY 1, 2, 3),
import_errors AS (
  SELECT props AS error_message, 'events' AS source_file, props AS raw, ts AS import_ts
  FROM events WHERE event_type = 'error')"""

LATEST = "(SELECT max(year) FROM candidate)"


def with_base(body: str, extra: str = "") -> str:
    ctes = BASE_CTES + ("," + extra if extra else "")
    return f"WITH {ctes}\n{body}"


def report_sql(p: dict) -> dict[str, str]:
    """Oracle SQL for the reports, given the registry parameters ``p``."""
    q: dict[str, str] = {}
    term = p["search_term"].replace("'", "''")
    q["search_candidates"] = with_base(f"""
SELECT regnumber, surname, firstname, gender, aggregate FROM candidate
WHERE CAST(regnumber AS VARCHAR) LIKE '%{term}%' OR lower(surname) LIKE lower('%{term}%')
ORDER BY regnumber LIMIT {p['search_limit']}""")
    q["top_performers"] = with_base(f"""
SELECT CAST(row_number() OVER (ORDER BY aggregate DESC, regnumber) AS INTEGER) AS rank, regnumber,
       concat_ws(' ', coalesce(surname, 'N/A'), coalesce(firstname, 'N/A')) AS name, aggregate
FROM candidate WHERE aggregate IS NOT NULL
ORDER BY aggregate DESC, regnumber LIMIT {p['top_performers']}""")
    q["failed_import_analysis"] = with_base(f"""
SELECT error_message, count(*) AS error_count FROM import_errors
GROUP BY error_message ORDER BY error_count DESC, error_message LIMIT {p['failed_imports']}""")
    q["gender_stats"] = with_base("""
SELECT gender, count(*) AS count FROM candidate WHERE gender IS NOT NULL GROUP BY gender""")
    q["state_distribution"] = with_base(f"""
SELECT s.st_name, count(*) AS count FROM candidate c JOIN state s ON c.statecode = s.st_id
GROUP BY s.st_name ORDER BY count DESC, st_name LIMIT {p['state_distribution']}""")
    q["top_subjects"] = with_base(f"""
SELECT su_name, count(*) AS total_candidates, {rnd('sum(score)', 'count(score)')} AS avg_score
FROM ranked WHERE score_rank = 1 GROUP BY su_name
ORDER BY total_candidates DESC, su_name LIMIT {p['top_subjects']}""", extra=f"""
ranked AS (
  SELECT s.su_name, cs.score, cs.cand_reg_number,
         rank() OVER (PARTITION BY cs.cand_reg_number ORDER BY cs.score DESC NULLS FIRST) AS score_rank
  FROM candidate c
  JOIN candidate_scores cs ON c.regnumber = cs.cand_reg_number AND c.year = cs.year
  JOIN subject s ON cs.subject_id = s.su_id
  WHERE c.year = {LATEST}
  GROUP BY s.su_name, cs.score, cs.cand_reg_number)""")
    q["course_analysis"] = with_base(f"""
SELECT co.course_name, count(ca.regnumber) AS applicants,
       {rnd('sum(ca.aggregate)', 'count(ca.aggregate)')} AS avg_score, f.fac_name AS faculty
FROM course co
LEFT JOIN candidate ca ON co.course_code = ca.app_course1
LEFT JOIN faculty f ON co.facid = f.fac_id
GROUP BY co.course_name, f.fac_name
ORDER BY applicants DESC, course_name NULLS LAST, faculty NULLS LAST LIMIT {p['course_analysis']}""")
    q["institution_stats"] = with_base(f"""
SELECT i.inname, count(c.regnumber) AS applicants,
       {rnd('sum(c.aggregate)', 'count(c.aggregate)')} AS avg_score, it.intyp_desc AS institution_type
FROM institution i
LEFT JOIN candidate c ON i.inid = c.inid
LEFT JOIN institution_type it ON i.intyp = it.intyp_id
GROUP BY i.inname, it.intyp_desc
ORDER BY applicants DESC, inname NULLS LAST, institution_type NULLS LAST LIMIT {p['institution_stats']}""")
    q["faculty_performance"] = with_base(f"""
SELECT f.fac_name AS name, count(c.regnumber) AS applicants,
       {rnd('sum(c.aggregate)', 'count(c.aggregate)')} AS avg_score
FROM faculty f
JOIN course co ON f.fac_id = co.facid
LEFT JOIN candidate c ON co.course_code = c.app_course1
GROUP BY f.fac_name ORDER BY avg_score DESC NULLS FIRST, name""")
    q["geographic_analysis"] = with_base(f"""
SELECT s.st_name AS state, l.lg_name AS lga, count(c.regnumber) AS candidates,
       {rnd('sum(c.aggregate)', 'count(c.aggregate)')} AS avg_score
FROM state s JOIN lga l ON s.st_id = l.lg_st_id JOIN candidate c ON l.lg_id = c.lg_id
GROUP BY s.st_name, l.lg_name HAVING count(c.regnumber) > {p['geographic_min']}
ORDER BY candidates DESC, state, lga LIMIT {p['geographic_n']}""")
    q["year_comparison"] = with_base(f"""
SELECT year, count(*) AS total_candidates, {rnd('sum(aggregate)', 'count(aggregate)')} AS avg_score,
       count(CASE WHEN gender = 'F' THEN 1 END) AS female_candidates,
       count(CASE WHEN gender = 'M' THEN 1 END) AS male_candidates
FROM candidate GROUP BY year ORDER BY year""")
    q["score_distribution"] = with_base("""
SELECT CASE WHEN aggregate >= 300 THEN '300+' WHEN aggregate >= 250 THEN '250-299'
            WHEN aggregate >= 200 THEN '200-249' WHEN aggregate >= 150 THEN '150-199'
            ELSE 'Below 150' END AS "range",
       count(*) AS count
FROM candidate WHERE aggregate IS NOT NULL GROUP BY 1 ORDER BY 1 DESC""")
    q["admission_trends"] = with_base(f"""
SELECT co.course_name, count(*) AS applicants,
       round(CAST(quantile_cont(ca.aggregate, {p['trends_quantile']}) AS DOUBLE), 2) AS cutoff_score
FROM course co JOIN candidate ca ON co.course_code = ca.app_course1
GROUP BY co.course_name HAVING count(*) > {p['trends_min']}
ORDER BY applicants DESC, course_name LIMIT {p['trends_n']}""")
    q["performance_metrics"] = with_base(f"""
SELECT year, count(*) AS total_candidates,
       coalesce({rnd('sum(aggregate)', 'count(aggregate)')}, 0.0) AS average_score,
       coalesce(round(CAST(quantile_cont(aggregate, 0.5) AS DOUBLE), 2), 0.0) AS median_score,
       coalesce(round(stddev_samp(aggregate), 2), 0.0) AS standard_deviation
FROM candidate WHERE aggregate > 0 GROUP BY year ORDER BY year DESC""")
    q["institution_ranking"] = with_base(f"""
SELECT institution_name, abbreviation, total_applicants, admitted_count,
       coalesce({rnd('s', 'n')}, 0.0) AS average_score,
       {pct('admitted_count', 'total_applicants')} AS admission_rate
FROM stats ORDER BY s / n DESC NULLS FIRST, institution_name, abbreviation LIMIT {p['ranking_n']}""",
        extra=f"""
stats AS (
  SELECT i.inname AS institution_name, i.inabv AS abbreviation,
         count(c.regnumber) AS total_applicants,
         count(CASE WHEN c.is_admitted THEN 1 END) AS admitted_count,
         sum(c.aggregate) AS s, count(c.aggregate) AS n
  FROM institution i LEFT JOIN candidate c ON i.inid = c.inid
  WHERE c.year = {LATEST} AND c.aggregate IS NOT NULL AND c.aggregate > 0
  GROUP BY i.inname, i.inabv HAVING count(c.regnumber) > {p['ranking_min']})""")
    anchor = p["correlation_anchor"].replace("'", "''")
    r = "(cov / (sdx * sdy))"
    q["subject_correlation"] = with_base(f"""
SELECT '{anchor}' AS subject1, subject2, round({r}, 3) AS correlation, sample_size,
       {rnd('sx', 'cx')} AS avg_score1, {rnd('sy', 'cy')} AS avg_score2,
       round(sdx, 2) AS stddev1, round(sdy, 2) AS stddev2
FROM stats WHERE {r} IS NOT NULL ORDER BY abs({r}) DESC, subject2""", extra=f"""
sc AS (
  SELECT cs.cand_reg_number, s.su_name, cs.score FROM candidate_scores cs
  JOIN subject s ON cs.subject_id = s.su_id WHERE cs.year = {LATEST}),
stats AS (
  SELECT o.su_name AS subject2, count(*) AS sample_size, covar_samp(e.score, o.score) AS cov,
         sum(e.score) AS sx, count(e.score) AS cx, sum(o.score) AS sy, count(o.score) AS cy,
         stddev_samp(e.score) AS sdx, stddev_samp(o.score) AS sdy
  FROM sc e JOIN sc o ON e.cand_reg_number = o.cand_reg_number
  WHERE e.su_name = '{anchor}' AND o.su_name <> '{anchor}'
  GROUP BY o.su_name
  HAVING count(*) >= {p['correlation_min']} AND stddev_samp(e.score) > 0 AND stddev_samp(o.score) > 0)""")
    q["regional_performance"] = with_base(f"""
SELECT state_name, total_candidates, coalesce({rnd('s', 'n')}, 0.0) AS average_score,
       admitted_count, {pct('f', 'total_candidates')} AS female_percentage
FROM rs ORDER BY total_candidates DESC, state_name""", extra=f"""
rs AS (
  SELECT s.st_name AS state_name, count(c.regnumber) AS total_candidates,
         sum(c.aggregate) AS s, count(c.aggregate) AS n,
         count(CASE WHEN c.is_admitted THEN 1 END) AS admitted_count,
         count(CASE WHEN c.gender = 'F' THEN 1 END) AS f
  FROM candidate c JOIN state s ON c.statecode = s.st_id
  WHERE c.year = {LATEST} AND c.aggregate IS NOT NULL AND c.aggregate > 0
  GROUP BY s.st_name)""")
    q["course_competitiveness"] = with_base(f"""
SELECT course_code, course_name, total_applicants,
       coalesce(CAST(mn AS DOUBLE), 0.0) AS minimum_score,
       coalesce(CAST(mx AS DOUBLE), 0.0) AS maximum_score,
       coalesce({rnd('s', 'n')}, 0.0) AS average_score,
       {pct('adm', 'total_applicants')} AS admission_rate
FROM cs ORDER BY s / n DESC NULLS FIRST, course_code LIMIT {p['competitiveness_n']}""", extra=f"""
cs AS (
  SELECT c.app_course1 AS course_code, co.course_name, count(c.regnumber) AS total_applicants,
         min(c.aggregate) AS mn, max(c.aggregate) AS mx, sum(c.aggregate) AS s,
         count(c.aggregate) AS n, count(CASE WHEN c.is_admitted THEN 1 END) AS adm
  FROM candidate c JOIN course co ON c.app_course1 = co.course_code
  WHERE c.year = {LATEST} AND c.aggregate IS NOT NULL AND c.aggregate > 0
  GROUP BY c.app_course1, co.course_name HAVING count(c.regnumber) > {p['competitiveness_min']})""")
    return q
