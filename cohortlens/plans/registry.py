"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Parameters follow the reference defaults except where the generated data is
too small for them (FIXTURES.md, "Thresholds to pass for fixtures").
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators import reports as R
from ..sources.tables import ANCHOR_SUBJECT, DriverTables
from . import oracle
from .ops_registry import ops_oracle_sql, ops_queries

# Registry parameters: reference defaults, with the fixture thresholds.
PARAMS = dict(schemas.REPORT_DEFAULTS)
PARAMS.update({
    "search_term": "77",
    "geographic_min": 150,
    "trends_min": 100,
    "ranking_min": 20,
    "competitiveness_min": 2,
    "correlation_min": 100,
    "correlation_anchor": ANCHOR_SUBJECT,
})

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str) -> DriverTables:
    return DriverTables(spark, sf_dir)


def report_queries(p: dict = PARAMS) -> dict[str, Query]:
    return {
        "search_candidates": lambda s, d: R.search_candidates(_t(s, d), p["search_term"], p["search_limit"]),
        "top_performers": lambda s, d: R.top_performers(_t(s, d), p["top_performers"]),
        "failed_import_analysis": lambda s, d: R.failed_import_analysis(_t(s, d).import_errors, p["failed_imports"]),
        "gender_stats": lambda s, d: R.gender_stats(_t(s, d)),
        "state_distribution": lambda s, d: R.state_distribution(_t(s, d), p["state_distribution"]),
        "top_subjects": lambda s, d: R.top_subjects(_t(s, d), p["top_subjects"]),
        "course_analysis": lambda s, d: R.course_analysis(_t(s, d), p["course_analysis"]),
        "institution_stats": lambda s, d: R.institution_stats(_t(s, d), p["institution_stats"]),
        "faculty_performance": lambda s, d: R.faculty_performance(_t(s, d)),
        "geographic_analysis": lambda s, d: R.geographic_analysis(_t(s, d), p["geographic_min"], p["geographic_n"]),
        "year_comparison": lambda s, d: R.year_comparison(_t(s, d)),
        "score_distribution": lambda s, d: R.score_distribution(_t(s, d)),
        "admission_trends": lambda s, d: R.admission_trends(_t(s, d), p["trends_quantile"], p["trends_min"], p["trends_n"]),
        "performance_metrics": lambda s, d: R.performance_metrics(_t(s, d)),
        "institution_ranking": lambda s, d: R.institution_ranking(_t(s, d), p["ranking_min"], p["ranking_n"]),
        "subject_correlation": lambda s, d: R.subject_correlation(_t(s, d), p["correlation_anchor"], p["correlation_min"]),
        "regional_performance": lambda s, d: R.regional_performance(_t(s, d)),
        "course_competitiveness": lambda s, d: R.course_competitiveness(_t(s, d), p["competitiveness_min"], p["competitiveness_n"]),
    }


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q.update(report_queries())
    q.update(ops_queries())
    return q


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o.update(oracle.report_sql(PARAMS))
    o.update(ops_oracle_sql())
    return o
