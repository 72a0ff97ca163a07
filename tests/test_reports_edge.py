"""Reports on hand-made edge tables (FIXTURES.md part C)."""

import pytest

from cohortlens.operators import reports as R
from cohortlens.sources.tables import FrameTables
from conftest import rows

CAND_SCHEMA = ("regnumber string, surname string, firstname string, gender string, "
               "statecode int, lg_id int, aggregate int, year int, is_admitted boolean, "
               "app_course1 string, inid string")


@pytest.fixture(scope="module")
def t(spark):
    cand = [
        # reg, surname, first, gender, state, lga, agg, year, admitted, course, inid
        ("R01", "Ade", "Bola", "M", 1, 10, 300, 2023, True, "C1", "I1"),
        ("R02", "Obi", None, "F", 1, 10, 299, 2023, False, "C1", "I1"),
        ("R03", "ade", "Chi", "F", 2, 20, 250, 2023, True, "C2", "I1"),
        ("R04", None, "Dayo", "M", 2, 20, 249, 2023, False, "C2", "I2"),
        ("R05", "Eze", "Femi", None, 1, 11, 200, 2023, False, "C1", "I2"),
        ("R06", "Ola", "Gbenga", "F", 1, 11, 199, 2022, True, "C1", "I1"),
        ("R07", "Uche", "Hauwa", "M", 2, 20, 150, 2022, False, "C2", "I2"),
        ("R08", "Zed", "Ife", "F", 1, 10, 149, 2022, False, "C2", "I1"),
        ("R09", "Null", "Agg", "M", 1, 10, None, 2023, False, "C1", "I1"),
        ("R10", "Zero", "Agg", "F", 2, 20, 0, 2023, True, "C2", "I2"),
        ("r_11", "Solo", "Year", "F", 1, 10, 180, 2021, False, "C1", "I1"),
        ("R%12", "Pct", "Sign", "M", 3, 30, 300, 2023, False, None, None),
    ]
    state = spark.createDataFrame([(1, "LAGOS"), (2, "KANO"), (3, "OYO")], "st_id int, st_name string")
    lga = spark.createDataFrame([(10, 1, "IKEJA"), (11, 1, "EPE"), (20, 2, "DALA"), (30, 3, "IBADAN")],
                                "lg_id int, lg_st_id int, lg_name string")
    course = spark.createDataFrame([("C1", "MEDICINE", 1), ("C2", "LAW", 2), ("C3", "ART", 3), ("C4", "LAW", 2)],
                                   "course_code string, course_name string, facid int")
    faculty = spark.createDataFrame([(1, "HEALTH"), (2, "LAW"), (3, "ARTS"), (4, "EMPTY")],
                                    "fac_id int, fac_name string")
    inst = spark.createDataFrame([("I1", "UNILAG", "Uni Lagos", 0), ("I2", "BUK", "Bayero", 1),
                                  ("I3", "NONE", "No Applicants", 2)],
                                 "inid string, inabv string, inname string, intyp int")
    itype = spark.createDataFrame([(0, "FEDERAL"), (1, "STATE"), (2, "PRIVATE")], "intyp_id int, intyp_desc string")
    subject = spark.createDataFrame([(1, "ENG"), (2, "MATH"), (3, "BIO")], "su_id int, su_name string")
    scores = spark.createDataFrame([
        ("R01", 1, 2023, 90), ("R01", 2, 2023, 90), ("R01", 3, 2023, 50),   # tie for best
        ("R02", 1, 2023, 40), ("R02", 2, 2023, 70), ("R02", 3, 2023, 10),
        ("R03", 1, 2023, 60), ("R03", 2, 2023, 60), ("R03", 3, 2023, 60),   # zero variance pairs
        ("R06", 1, 2022, 99),                                              # other year
    ], "cand_reg_number string, subject_id int, year int, score int")
    return FrameTables(spark, candidate=spark.createDataFrame(cand, CAND_SCHEMA), state=state, lga=lga,
                       course=course, faculty=faculty, institution=inst, institution_type=itype,
                       subject=subject, candidate_scores=scores)


def test_search_wildcards_and_case(t):
    got = [r["regnumber"] for r in rows(R.search_candidates(t, "ADE"))]
    assert got == ["R01", "R03"]            # surname matched case-insensitively
    assert [r["regnumber"] for r in rows(R.search_candidates(t, "r_1"))] == ["r_11"]
    # '%' in the term is a wildcard: matches everything, still capped at limit
    assert len(rows(R.search_candidates(t, "%", limit=5))) == 5
    # '_' matches any single character: 'R_1' matches R01? no (R0 then 1 needs R?1)
    assert {r["regnumber"] for r in rows(R.search_candidates(t, "R_1", limit=20))} >= {"R01", "R%12"}


def test_top_performers_ties_and_names(t):
    got = rows(R.top_performers(t, n=3))
    assert [r["rank"] for r in got] == [1, 2, 3]
    assert [r["regnumber"] for r in got] == ["R%12", "R01", "R02"]  # 300, 300 (tie by reg), 299
    assert got[2]["name"] == "Obi N/A"


def test_score_distribution_bounds(t):
    got = {r["range"]: r["count"] for r in rows(R.score_distribution(t))}
    assert got == {"300+": 2, "250-299": 2, "200-249": 2, "150-199": 3, "Below 150": 2}
    order = [r["range"] for r in R.score_distribution(t).collect()]
    assert order == sorted(order, reverse=True) and order[0] == "Below 150"


def test_gender_and_year(t):
    assert {r["gender"]: r["count"] for r in rows(R.gender_stats(t))} == {"M": 5, "F": 6}
    yc = {r["year"]: r for r in rows(R.year_comparison(t))}
    assert yc[2021]["total_candidates"] == 1 and yc[2021]["avg_score"] == 180.0
    assert yc[2023]["female_candidates"] == 3


def test_performance_metrics_single_row_std_zero(t):
    pm = {r["year"]: r for r in rows(R.performance_metrics(t))}
    assert pm[2021]["standard_deviation"] == 0.0     # one row: stddev NULL -> 0
    assert pm[2021]["median_score"] == 180.0
    assert pm[2023]["total_candidates"] == 6          # 0 and NULL excluded


def test_course_analysis_empty_course_and_name_merge(t):
    got = {(r["course_name"], r["faculty"]): r for r in rows(R.course_analysis(t))}
    assert got[("ART", "ARTS")]["applicants"] == 0 and got[("ART", "ARTS")]["avg_score"] is None
    assert got[("LAW", "LAW")]["applicants"] == 5   # C2 and C4 merge by name


def test_faculty_nulls_first(t):
    got = R.faculty_performance(t).collect()
    assert got[0]["name"] == "ARTS" and got[0]["avg_score"] is None


def test_institution_stats_left_join(t):
    got = {r["inname"]: r for r in rows(R.institution_stats(t))}
    assert got["No Applicants"]["applicants"] == 0
    assert got["Uni Lagos"]["institution_type"] == "FEDERAL"


def test_rounding_half_up(t, spark):
    # avg of 1 and 2 with 2 decimals -> 1.5; avg(0, 1, 1) = 0.666.. -> 0.67; 1/8 = .125 -> 0.13
    cand = spark.createDataFrame(
        [("A", 2023, 1), ("B", 2023, 0), ("C", 2023, 0), ("D", 2023, 0), ("E", 2023, 0),
         ("F", 2023, 0), ("G", 2023, 0), ("H", 2023, 0)], "regnumber string, year int, aggregate int")
    tt = FrameTables(spark, candidate=cand.withColumn("gender", cand.regnumber.substr(0, 0)))
    r = rows(R.year_comparison(tt))[0]
    assert r["avg_score"] == 0.13


def test_top_subjects_ties_kept(t):
    got = {r["su_name"]: r for r in rows(R.top_subjects(t))}
    # R01 best: ENG and MATH (tie), R02: MATH, R03: all three
    assert got["ENG"]["total_candidates"] == 2
    assert got["MATH"]["total_candidates"] == 3
    assert got["BIO"]["total_candidates"] == 1


def test_subject_correlation_zero_variance_dropped(t):
    out = rows(R.subject_correlation(t, anchor="ENG", min_sample=1))
    # anchor scores in 2023: 90, 40, 60 -> variance > 0; BIO vs ENG: (50,10,60)
    names = {r["subject2"] for r in out}
    assert names == {"MATH", "BIO"}
    # zero variance on the other side must be dropped, never raise
    only_r03 = FrameTables(t.spark, candidate=t.candidate(), subject=t.subject,
                           candidate_scores=t.candidate_scores.where("cand_reg_number = 'R03'"))
    assert rows(R.subject_correlation(only_r03, anchor="ENG", min_sample=1)) == []


def test_ranking_and_competitiveness(t):
    rk = rows(R.institution_ranking(t, min_applicants=1))
    assert {r["institution_name"] for r in rk} == {"Uni Lagos", "Bayero"}
    ul = [r for r in rk if r["institution_name"] == "Uni Lagos"][0]
    assert ul["total_applicants"] == 3 and ul["admitted_count"] == 2 and ul["admission_rate"] == 66.67
    cc = rows(R.course_competitiveness(t, min_applicants=0))
    assert cc[0]["average_score"] >= cc[-1]["average_score"]


def test_regional_and_geographic(t):
    reg = {r["state_name"]: r for r in rows(R.regional_performance(t))}
    assert reg["LAGOS"]["female_percentage"] == 33.33
    geo = rows(R.geographic_analysis(t, min_candidates=1))
    assert ("LAGOS", "IKEJA") in {(r["state"], r["lga"]) for r in geo}
    assert rows(R.geographic_analysis(t, min_candidates=1000)) == []


def test_admission_trends_percentile(t):
    got = {r["course_name"]: r for r in rows(R.admission_trends(t, min_applicants=0))}
    # MEDICINE aggregates: 300, 299, 200, 199, NULL, 180 -> p75 over 5 values = 299
    assert got["MEDICINE"]["cutoff_score"] == 299.0


def test_subject_correlation_pairs_like_a_self_join(spark):
    # candidate R1 has a NULL anchor score: it still pairs (count), as in a join
    subject = spark.createDataFrame([(1, "ENG"), (2, "MATH")], "su_id int, su_name string")
    cand = spark.createDataFrame([(f"R{i}", 2023) for i in range(5)], "regnumber string, year int")
    scores = spark.createDataFrame(
        [("R0", 1, 2023, None), ("R0", 2, 2023, 5)]
        + [(f"R{i}", s, 2023, v) for i in range(1, 5) for s, v in ((1, 10 * i), (2, i * i))],
        "cand_reg_number string, subject_id int, year int, score int")
    t = FrameTables(spark, candidate=cand, subject=subject, candidate_scores=scores)
    r = rows(R.subject_correlation(t, anchor="ENG", min_sample=1))[0]
    assert r["sample_size"] == 5          # the NULL-anchor pair counts in COUNT(*)
    assert r["avg_score1"] == 25.0        # AVG over the 4 non-null anchor scores


def test_admission_trends_approximate_close_to_exact(t):
    exact = {r["course_name"]: r["cutoff_score"] for r in rows(R.admission_trends(t, min_applicants=0))}
    approx = {r["course_name"]: r["cutoff_score"] for r in
              rows(R.admission_trends(t, min_applicants=0, approximate=True))}
    assert set(exact) == set(approx)
    assert all(abs(exact[k] - approx[k]) <= 50 for k in exact)


def test_scores_of(t):
    from cohortlens.operators import model_ops
    got = {r["su_name"]: r["score"] for r in model_ops.scores_of(t, "R02", 2023).collect()}
    assert got == {"ENG": 40, "MATH": 70, "BIO": 10}
