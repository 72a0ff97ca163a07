"""Analytical reports, one DataFrame function each.

Conventions shared by every report:

* Ties at a LIMIT are broken by the group key / registration number, so a
  top-n result is deterministic.
* Averages of the integer score columns are carried as (sum, count) and
  rounded exactly (``functions.exprs.round_avg``); groups are rolled up from
  those partial sums, never by averaging averages.
* Facts are pre-aggregated on their join key *before* joining a dimension,
  so only the small per-key aggregate crosses the join; Spark's partial
  (map-side) aggregation absorbs a hot key before the shuffle.
* Dimensions are not hinted: AQE turns a join into a broadcast join when
  the measured side is small, and keeps a shuffle join when it is not.
* "Latest year" is a scalar subquery, evaluated once per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.exprs import count_if, pct, round_avg, score_band
from ..sources.tables import Tables

D = schemas.REPORT_DEFAULTS


def _top(df: DataFrame, n: int | None, *order) -> DataFrame:
    df = df.orderBy(*order)
    return df.limit(n) if n is not None else df


# R1 -------------------------------------------------------------------------
def search_candidates(t: Tables, term: str, limit: int = D["search_limit"], among: DataFrame | None = None) -> DataFrame:
    """regnumber LIKE %term% OR lower(surname) LIKE lower(%term%); ``%``/``_``
    in the term act as wildcards. Ordered by regnumber, first ``limit``.
    ``among``: the (regnumber, year) that can match, if an index knows them
    (``search.search_candidates``)."""
    pattern = f"%{term}%"
    cols = ["regnumber", "surname", "firstname", "gender", "aggregate"]
    c = t.candidate(*cols)
    if among is not None:
        c = t.candidate(*cols, "year").join(among, ["regnumber", "year"], "left_semi").select(*cols)
    hit = (F.col("regnumber").cast("string").like(pattern)
           | F.lower("surname").like(pattern.lower()))
    return _top(c.where(hit), limit, F.col("regnumber").asc())


# R2 -------------------------------------------------------------------------
def top_performers(t: Tables, n: int = D["top_performers"]) -> DataFrame:
    """Highest aggregates first, display rank 1..n, name 'surname firstname'."""
    c = t.candidate("regnumber", "surname", "firstname", "aggregate")
    top = _top(c.where(F.col("aggregate").isNotNull()), n,
               F.col("aggregate").desc(), F.col("regnumber").asc())
    # The window sees only the n kept rows.
    w = Window.orderBy(F.col("aggregate").desc(), F.col("regnumber").asc())
    return top.select(
        F.row_number().over(w).alias("rank"),
        "regnumber",
        F.concat_ws(" ", F.coalesce("surname", F.lit("N/A")),
                    F.coalesce("firstname", F.lit("N/A"))).alias("name"),
        "aggregate")


# R3 -------------------------------------------------------------------------
def failed_import_analysis(errors: DataFrame, n: int = D["failed_imports"]) -> DataFrame:
    """Most frequent import error messages."""
    agg = errors.groupBy("error_message").agg(F.count(F.lit(1)).alias("error_count"))
    return _top(agg, n, F.col("error_count").desc(), F.col("error_message").asc_nulls_last())


# R4 -------------------------------------------------------------------------
def gender_stats(t: Tables) -> DataFrame:
    c = t.candidate("gender")
    return (c.where(F.col("gender").isNotNull()).groupBy("gender")
            .agg(F.count(F.lit(1)).alias("count")))


# R5 -------------------------------------------------------------------------
def state_distribution(t: Tables, n: int = D["state_distribution"]) -> DataFrame:
    per_code = (t.candidate("statecode").groupBy("statecode")
                .agg(F.count(F.lit(1)).alias("n")))
    joined = per_code.join(t.state.select("st_id", "st_name"),
                           F.col("statecode") == F.col("st_id"))
    agg = joined.groupBy("st_name").agg(F.sum("n").alias("count"))
    return _top(agg, n, F.col("count").desc(), F.col("st_name").asc())


# R6 -------------------------------------------------------------------------
def top_subjects(t: Tables, n: int = D["top_subjects"]) -> DataFrame:
    """Per subject, the candidates for whom it is a best subject (ties kept),
    latest year only."""
    latest = t.latest_year()
    cand = t.candidate("regnumber", "year").where(F.col("year") == latest)
    scores = t.candidate_scores.where(F.col("year") == latest)
    # Both sides are filtered to the same year, so (reg, year) = (reg). One
    # hash partitioning on the registration number serves the dedupe
    # (a superset key) and the per-candidate rank window; stored facts have
    # it already.
    j = (scores.join(cand.drop("year"), F.col("cand_reg_number") == F.col("regnumber"))
         .join(t.subject, F.col("subject_id") == F.col("su_id"))
         .select("cand_reg_number", "su_name", "score"))
    j = (j if t.co_partitioned else j.repartition("cand_reg_number")).dropDuplicates(["su_name", "score", "cand_reg_number"])
    w = Window.partitionBy("cand_reg_number").orderBy(F.col("score").desc_nulls_first())
    best = j.withColumn("score_rank", F.rank().over(w)).where(F.col("score_rank") == 1)
    agg = best.groupBy("su_name").agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.sum("score").alias("_s"), F.count("score").alias("_c"))
    out = agg.select("su_name", "total_candidates", round_avg("_s", "_c").alias("avg_score"))
    return _top(out, n, F.col("total_candidates").desc(), F.col("su_name").asc())


# R7 -------------------------------------------------------------------------
def _applicant_sums(t: Tables, key: str) -> DataFrame:
    """candidate -> (key, applicants, sum aggregate, count aggregate)."""
    return (t.candidate(key, "regnumber", "aggregate").where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.count("regnumber").alias("_n"), F.sum("aggregate").alias("_s"),
                 F.count("aggregate").alias("_c")))


def course_analysis(t: Tables, n: int = D["course_analysis"]) -> DataFrame:
    """Per (course name, faculty): first-choice applicants and average
    aggregate; courses without applicants count 0."""
    per_course = _applicant_sums(t, "app_course1")
    j = (t.course.select("course_code", "course_name", "facid")
         .join(per_course, F.col("course_code") == F.col("app_course1"), "left")
         .join(t.faculty.select("fac_id", "fac_name"), F.col("facid") == F.col("fac_id"), "left"))
    agg = j.groupBy("course_name", F.col("fac_name").alias("faculty")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("applicants"),
        F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    out = agg.select("course_name", "applicants", round_avg("_s", "_c").alias("avg_score"), "faculty")
    return _top(out, n, F.col("applicants").desc(), F.col("course_name").asc_nulls_last(),
                F.col("faculty").asc_nulls_last())


# R8 -------------------------------------------------------------------------
def institution_stats(t: Tables, n: int = D["institution_stats"]) -> DataFrame:
    per_inst = _applicant_sums(t, "inid").withColumnRenamed("inid", "_inid")
    j = (t.institution.select("inid", "inname", "intyp")
         .join(per_inst, F.col("inid") == F.col("_inid"), "left")
         .join(t.institution_type.select("intyp_id", "intyp_desc"),
               F.col("intyp") == F.col("intyp_id"), "left"))
    agg = j.groupBy("inname", F.col("intyp_desc").alias("institution_type")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("applicants"),
        F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    out = agg.select("inname", "applicants", round_avg("_s", "_c").alias("avg_score"),
                     "institution_type")
    return _top(out, n, F.col("applicants").desc(), F.col("inname").asc_nulls_last(),
                F.col("institution_type").asc_nulls_last())


# R9 -------------------------------------------------------------------------
def faculty_performance(t: Tables) -> DataFrame:
    """Per faculty name: applicants and average, highest average first
    (faculties with no applicants have a NULL average and sort first)."""
    per_course = _applicant_sums(t, "app_course1")
    j = (t.faculty.select("fac_id", "fac_name")
         .join(t.course.select("course_code", "facid"), F.col("fac_id") == F.col("facid"))
         .join(per_course, F.col("course_code") == F.col("app_course1"), "left"))
    agg = j.groupBy("fac_name").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("applicants"),
        F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    out = agg.select(F.col("fac_name").alias("name"), "applicants",
                     round_avg("_s", "_c").alias("avg_score"))
    return out.orderBy(F.col("avg_score").desc_nulls_first(), F.col("name").asc())


# R10 ------------------------------------------------------------------------
def geographic_analysis(t: Tables, min_candidates: int = D["geographic_min"],
                        n: int = D["geographic_n"]) -> DataFrame:
    """Per (state, LGA) through the LGA's own state; groups above a floor."""
    per_lga = (t.candidate("lg_id", "regnumber", "aggregate").where(F.col("lg_id").isNotNull())
               .groupBy("lg_id")
               .agg(F.count("regnumber").alias("_n"), F.sum("aggregate").alias("_s"),
                    F.count("aggregate").alias("_c"))
               .withColumnRenamed("lg_id", "_lg"))
    j = (t.state.select("st_id", "st_name")
         .join(t.lga.select("lg_id", "lg_st_id", "lg_name"), F.col("st_id") == F.col("lg_st_id"))
         .join(per_lga, F.col("lg_id") == F.col("_lg")))
    agg = (j.groupBy(F.col("st_name").alias("state"), F.col("lg_name").alias("lga"))
           .agg(F.sum("_n").alias("candidates"), F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
           .where(F.col("candidates") > min_candidates))
    out = agg.select("state", "lga", "candidates", round_avg("_s", "_c").alias("avg_score"))
    return _top(out, n, F.col("candidates").desc(), F.col("state").asc(), F.col("lga").asc())


# R11 ------------------------------------------------------------------------
def year_comparison(t: Tables) -> DataFrame:
    c = t.candidate("year", "aggregate", "gender")
    agg = c.groupBy("year").agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.sum("aggregate").alias("_s"), F.count("aggregate").alias("_c"),
        count_if(F.col("gender") == "F").alias("female_candidates"),
        count_if(F.col("gender") == "M").alias("male_candidates"))
    return (agg.select("year", "total_candidates", round_avg("_s", "_c").alias("avg_score"),
                       "female_candidates", "male_candidates")
            .orderBy("year"))


# R12 ------------------------------------------------------------------------
def score_distribution(t: Tables, bands=None) -> DataFrame:
    """Counts per aggregate band, ordered by the band label descending."""
    c = t.candidate("aggregate").where(F.col("aggregate").isNotNull())
    return (c.groupBy(score_band(F.col("aggregate"), bands).alias("range"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("range").desc()))


# R13 ------------------------------------------------------------------------
def admission_trends(t: Tables, q: float = D["trends_quantile"],
                     min_applicants: int = D["trends_min"], n: int = D["trends_n"],
                     approximate: bool = False) -> DataFrame:
    """Per course name: applicants and the interpolated q-quantile of the
    aggregate as an estimated cut-off.

    Candidates are first counted per (course code, aggregate) -- at most
    one row per code and score value -- and only that crosses the join;
    the exact percentile then weights each value by its count. Exact by
    default; ``approximate=True`` switches to ``percentile_approx``."""
    c = t.candidate("app_course1", "aggregate").where(F.col("app_course1").isNotNull())
    if approximate:
        j = c.join(t.course.select("course_code", "course_name"),
                   F.col("app_course1") == F.col("course_code"))
        agg = j.groupBy("course_name").agg(F.count(F.lit(1)).alias("applicants"),
                                           F.percentile_approx("aggregate", q, 10000).alias("_p"))
    else:
        per_value = c.groupBy("app_course1", "aggregate").agg(F.count(F.lit(1)).alias("_k"))
        j = per_value.join(t.course.select("course_code", "course_name"),
                           F.col("app_course1") == F.col("course_code"))
        # NULL aggregates count as applicants but not as percentile input.
        agg = j.groupBy("course_name").agg(
            F.sum("_k").alias("applicants"),
            F.percentile(F.col("aggregate"), F.lit(q), F.col("_k")).alias("_p"))
    agg = agg.where(F.col("applicants") > min_applicants)
    out = agg.select("course_name", "applicants",
                     F.round(F.col("_p").cast("double"), 2).alias("cutoff_score"))
    return _top(out, n, F.col("applicants").desc(), F.col("course_name").asc())


#: Size of a quantile sketch, and its error: the value given for q has a rank
#: within RANK_ERROR of q (99 % of the time), merged from however many parts.
SKETCH_K, RANK_ERROR = 200, 0.0165


def quantile_states(t: Tables, by=("app_course1", "year"), k: int = SKETCH_K) -> DataFrame:
    """Mergeable quantile state of the aggregate: one row per ``by`` with
    applicants, scored (those with an aggregate) and sketch (a KLL sketch of
    the aggregates, some kilobytes). Written once per load, e.g. partitioned
    by year, so that later quantiles over any years or courses merge sketches
    and read no candidate."""
    c = t.candidate(*by, "aggregate")
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("applicants"), F.count("aggregate").alias("scored"),
                              F.kll_sketch_agg_bigint(F.col("aggregate").cast("long"), F.lit(k)).alias("sketch"))


def merged_quantiles(states: DataFrame, by: list[str], q: float, out: str, k: int = SKETCH_K) -> DataFrame:
    """(by, applicants, ``out``): the q-quantile of the merged states, a value
    that occurs, of rank q within ``RANK_ERROR``; null where none is scored."""
    merged = states.groupBy(*by).agg(F.sum("applicants").alias("applicants"), F.sum("scored").alias("_scored"),
                                     F.kll_merge_agg_bigint(F.when(F.col("scored") > 0, F.col("sketch")), F.lit(k)).alias("_sketch"))
    value = F.when(F.col("_scored") > 0, F.kll_sketch_get_quantile_bigint("_sketch", F.lit(q)))
    return merged.select(*by, "applicants", value.alias(out))


def admission_trends_of(states: DataFrame, course: DataFrame, q: float = D["trends_quantile"],
                        min_applicants: int = D["trends_min"], n: int = D["trends_n"]) -> DataFrame:
    """``admission_trends`` from stored ``quantile_states``: the same courses
    and applicants, the cut-off of rank q within ``RANK_ERROR``."""
    named = states.join(course.select("course_code", "course_name"), F.col("app_course1") == F.col("course_code"))
    agg = merged_quantiles(named, ["course_name"], q, "cutoff_score").where(F.col("applicants") > min_applicants)
    out = agg.select("course_name", "applicants", F.col("cutoff_score").cast("double").alias("cutoff_score"))
    return _top(out, n, F.col("applicants").desc(), F.col("course_name").asc())


# R14 ------------------------------------------------------------------------
def performance_metrics(t: Tables) -> DataFrame:
    c = t.candidate("year", "aggregate").where(F.col("aggregate") > 0)
    agg = c.groupBy("year").agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.sum("aggregate").alias("_s"), F.count("aggregate").alias("_c"),
        F.percentile("aggregate", F.lit(0.5)).alias("_m"),
        F.stddev_samp("aggregate").alias("_sd"))
    zero = F.lit(0.0)
    return (agg.select(
        "year", "total_candidates",
        F.coalesce(round_avg("_s", "_c"), zero).alias("average_score"),
        F.coalesce(F.round("_m", 2), zero).alias("median_score"),
        F.coalesce(F.round("_sd", 2), zero).alias("standard_deviation"))
        .orderBy(F.col("year").desc()))


# R15 ------------------------------------------------------------------------
def institution_ranking(t: Tables, min_applicants: int = D["ranking_min"],
                        n: int = D["ranking_n"]) -> DataFrame:
    """Latest-year ranking of institutions by average aggregate (> 0)."""
    latest = t.latest_year()
    c = (t.candidate("inid", "regnumber", "aggregate", "is_admitted", "year")
         .where((F.col("year") == latest) & (F.col("aggregate") > 0))
         .groupBy("inid")
         .agg(F.count("regnumber").alias("_n"),
              count_if(F.col("is_admitted")).alias("_adm"),
              F.sum("aggregate").alias("_s"), F.count("aggregate").alias("_c"))
         .withColumnRenamed("inid", "_inid"))
    j = t.institution.select("inid", "inname", "inabv").join(c, F.col("inid") == F.col("_inid"))
    agg = (j.groupBy(F.col("inname").alias("institution_name"), F.col("inabv").alias("abbreviation"))
           .agg(F.sum("_n").alias("total_applicants"), F.sum("_adm").alias("admitted_count"),
                F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
           .where(F.col("total_applicants") > min_applicants))
    out = agg.select(
        "institution_name", "abbreviation", "total_applicants", "admitted_count",
        F.coalesce(round_avg("_s", "_c"), F.lit(0.0)).alias("average_score"),
        pct("admitted_count", "total_applicants").alias("admission_rate"),
        (F.col("_s") / F.col("_c")).alias("_avg"))
    return (_top(out, n, F.col("_avg").desc_nulls_first(), F.col("institution_name").asc(),
                 F.col("abbreviation").asc())
            .drop("_avg"))


# R16 ------------------------------------------------------------------------
def subject_correlation(t: Tables, anchor: str = D["correlation_anchor"],
                        min_sample: int = D["correlation_min"]) -> DataFrame:
    """Correlation of the anchor subject's score with every other subject's,
    per candidate, latest year; only groups with enough rows and non-zero
    spread on both sides.

    corr is computed as covar_samp / (sd1 * sd2) with ``try_divide`` so a
    zero-variance group yields NULL (then dropped) instead of raising under
    ANSI mode before HAVING runs."""
    latest = t.latest_year()
    s = (t.candidate_scores.where(F.col("year") == latest)
         .join(t.subject.select("su_id", "su_name"), F.col("subject_id") == F.col("su_id"))
         .select("cand_reg_number", "su_name", "score"))
    # Self-join on the candidate without deriving the scores twice: one
    # partitioning by candidate collects that candidate's anchor scores
    # (structs, so a NULL score still pairs) and each other-subject row is
    # paired with each of them -- the join's rows, from a single shuffle.
    # A candidate has a handful of scores per year, so the lists are tiny.
    w = Window.partitionBy("cand_reg_number")
    anchor_scores = F.collect_list(
        F.when(F.col("su_name") == anchor, F.struct(F.col("score").alias("x")))).over(w)
    j = (s.withColumn("_xs", anchor_scores)
         .where(F.col("su_name") != anchor)
         .select(F.col("su_name").alias("subject2"), F.col("score").alias("y"),
                 F.explode("_xs").alias("_a"))
         .select("subject2", "y", F.col("_a.x").alias("x")))
    agg = j.groupBy("subject2").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.covar_samp("x", "y").alias("_cov"),
        F.sum("x").alias("_sx"), F.count("x").alias("_cx"),
        F.sum("y").alias("_sy"), F.count("y").alias("_cy"),
        F.stddev_samp("x").alias("_sdx"), F.stddev_samp("y").alias("_sdy"))
    agg = agg.where((F.col("sample_size") >= min_sample) & (F.col("_sdx") > 0)
                    & (F.col("_sdy") > 0))
    corr = F.try_divide(F.col("_cov"), F.col("_sdx") * F.col("_sdy"))
    out = (agg.withColumn("_r", corr).where(F.col("_r").isNotNull())
           .select(F.lit(anchor).alias("subject1"), "subject2",
                   F.round("_r", 3).alias("correlation"), "sample_size",
                   round_avg("_sx", "_cx").alias("avg_score1"),
                   round_avg("_sy", "_cy").alias("avg_score2"),
                   F.round("_sdx", 2).alias("stddev1"), F.round("_sdy", 2).alias("stddev2"),
                   F.abs("_r").alias("_abs")))
    return out.orderBy(F.col("_abs").desc(), F.col("subject2").asc()).drop("_abs")


# R17 ------------------------------------------------------------------------
def regional_performance(t: Tables) -> DataFrame:
    latest = t.latest_year()
    per_code = (t.candidate("statecode", "regnumber", "aggregate", "is_admitted", "gender", "year")
                .where((F.col("year") == latest) & (F.col("aggregate") > 0))
                .groupBy("statecode")
                .agg(F.count("regnumber").alias("_n"), F.sum("aggregate").alias("_s"),
                     F.count("aggregate").alias("_c"),
                     count_if(F.col("is_admitted")).alias("_adm"),
                     count_if(F.col("gender") == "F").alias("_f")))
    j = per_code.join(t.state.select("st_id", "st_name"), F.col("statecode") == F.col("st_id"))
    agg = j.groupBy(F.col("st_name").alias("state_name")).agg(
        F.sum("_n").alias("total_candidates"), F.sum("_s").alias("_s"),
        F.sum("_c").alias("_c"), F.sum("_adm").alias("admitted_count"),
        F.sum("_f").alias("_f"))
    out = agg.select("state_name", "total_candidates",
                     F.coalesce(round_avg("_s", "_c"), F.lit(0.0)).alias("average_score"),
                     "admitted_count", pct("_f", "total_candidates").alias("female_percentage"))
    return out.orderBy(F.col("total_candidates").desc(), F.col("state_name").asc())


# R18 ------------------------------------------------------------------------
def course_competitiveness(t: Tables, min_applicants: int = D["competitiveness_min"],
                           n: int = D["competitiveness_n"]) -> DataFrame:
    latest = t.latest_year()
    c = (t.candidate("app_course1", "regnumber", "aggregate", "is_admitted", "year")
         .where((F.col("year") == latest) & (F.col("aggregate") > 0))
         .groupBy("app_course1")
         .agg(F.count("regnumber").alias("total_applicants"),
              F.min("aggregate").alias("_min"), F.max("aggregate").alias("_max"),
              F.sum("aggregate").alias("_s"), F.count("aggregate").alias("_c"),
              count_if(F.col("is_admitted")).alias("_adm"))
         .where(F.col("total_applicants") > min_applicants))
    j = c.join(t.course.select("course_code", "course_name"),
               F.col("app_course1") == F.col("course_code"))
    out = j.select(
        "course_code", "course_name", "total_applicants",
        F.coalesce(F.col("_min").cast("double"), F.lit(0.0)).alias("minimum_score"),
        F.coalesce(F.col("_max").cast("double"), F.lit(0.0)).alias("maximum_score"),
        F.coalesce(round_avg("_s", "_c"), F.lit(0.0)).alias("average_score"),
        pct("_adm", "total_applicants").alias("admission_rate"),
        (F.col("_s") / F.col("_c")).alias("_avg"))
    return (_top(out, n, F.col("_avg").desc_nulls_first(), F.col("course_code").asc())
            .drop("_avg"))
