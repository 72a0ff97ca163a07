"""Entity resolution for imports.

Pattern: resolve the *distinct* input values once (small), then join the
answer back to the rows. Identifier lookups are equi-joins. State names are
matched in one edit-distance pass (an exact match is distance 0) that emits
only pairs within the bound: an exact deletion-neighbourhood equi-join over
distinct names (``theta.edit_distance_pairs``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.exprs import blank_to_null, trim_all
from .asof import asof_join
from .theta import edit_distance_pairs


def _alias_map(aliases: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])


# I8 -------------------------------------------------------------------------
def clean_state_name(col: Column, aliases: dict[str, str] = schemas.STATE_ALIASES) -> Column:
    """upper(trim(name)) then the alias table."""
    u = F.upper(trim_all(col))
    return F.coalesce(F.element_at(_alias_map(aliases), u), u)


def resolve_states(df: DataFrame, col: str, state: DataFrame,
                   max_distance: int = schemas.STATE_MAX_DISTANCE,
                   aliases: dict[str, str] = schemas.STATE_ALIASES) -> DataFrame:
    """Adds ``st_id`` and ``state_match`` (exact / fuzzy / NULL = unresolved).

    Exact match after cleaning and aliases; otherwise the nearest state name
    by Levenshtein distance, accepted at distance <= ``max_distance`` (0, 1
    or 2); among equally near names the smallest st_id wins."""
    st = state.select(F.col("st_id"), F.col("st_name"))
    names = (df.select(F.col(col).alias("_raw")).where(F.col("_raw").isNotNull()).distinct()
             .withColumn("_clean", clean_state_name(F.col("_raw"), aliases)))
    # An exact match is distance 0, so one pass over the pairs within the
    # bound resolves both: the nearest state by (distance, st_id).
    near = edit_distance_pairs(names, "_clean", st, "st_name", max_distance)
    resolved = (near.groupBy("_raw")
                .agg(F.min_by("st_id", F.struct("_dist", "st_id")).alias("st_id"),
                     F.min("_dist").alias("_d"))
                .select("_raw", "st_id",
                        F.when(F.col("_d") == 0, F.lit("exact")).otherwise(F.lit("fuzzy"))
                        .alias("state_match")))
    return df.join(resolved, F.col(col) == F.col("_raw"), "left").drop("_raw")


# I9 -------------------------------------------------------------------------
def institution_keys(inst: DataFrame) -> DataFrame:
    """key text -> inid: every id, and every non-empty abbreviation. When an
    abbreviation equals another institution's id, the id wins."""
    ids = inst.select(F.col("inid").cast("string").alias("key"), F.col("inid"), F.lit(0).alias("_p"))
    abv = (inst.select(blank_to_null(F.col("inabv")).alias("key"), F.col("inid"), F.lit(1).alias("_p"))
           .where(F.col("key").isNotNull()))
    return (ids.unionByName(abv).groupBy("key")
            .agg(F.min_by("inid", F.struct("_p", "inid")).alias("inid")))


def resolve_institutions(df: DataFrame, col: str, inst: DataFrame) -> DataFrame:
    """Adds ``resolved_inid`` (NULL = invalid institution) for the trimmed
    text in ``col``."""
    keys = institution_keys(inst).withColumnRenamed("inid", "resolved_inid")
    return (df.withColumn("_key", blank_to_null(F.col(col)))
            .join(keys, F.col("_key") == F.col("key"), "left").drop("_key", "key"))


# I10 ------------------------------------------------------------------------
def validate_course_codes(df: DataFrame, col: str, course: DataFrame):
    """-> (rows with a known code, rows with an unknown code + error)."""
    codes = course.select(F.col("course_code").alias("_code"))
    known = df.join(codes, F.col(col) == F.col("_code"), "left_semi")
    unknown = (df.join(codes, F.col(col) == F.col("_code"), "left_anti")
               .withColumn("error", F.concat(F.lit("unknown course code: "), F.col(col).cast("string"))))
    return known, unknown


def mark_known_codes(df: DataFrame, col: str, course: DataFrame) -> DataFrame:
    """Single pass variant: adds boolean ``code_known``."""
    codes = course.select(F.col("course_code").alias("_code")).distinct()
    return (df.join(codes, F.col(col) == F.col("_code"), "left")
            .withColumn("code_known", F.col("_code").isNotNull()).drop("_code"))


# D3 -------------------------------------------------------------------------
def current_mappings(mapping: DataFrame) -> DataFrame:
    """One mapping per (year, old code, institution): the latest
    ``mapping_date`` (then the smallest new code); without that column, or
    where it is NULL, a mapping counts as the earliest."""
    date = F.col("mapping_date") if "mapping_date" in mapping.columns else F.lit(None).cast("timestamp_ntz")
    rank = F.struct(date.isNotNull().alias("known"), date.alias("date"))
    best = mapping.groupBy("year", "old_course_code", "institution_id").agg(F.max(rank).alias("_r"), F.collect_set(
        F.struct(date.isNotNull().alias("known"), date.alias("date"), F.col("new_course_code").alias("code"))).alias("_all"))
    latest = F.filter("_all", lambda x: F.struct(x.known.alias("known"), x.date.alias("date")).eqNullSafe(F.col("_r")))
    return best.select("year", "old_course_code", "institution_id", F.array_min(F.transform(latest, lambda x: x.code)).alias("new_course_code"))


def superseded_mappings(mapping: DataFrame) -> DataFrame:
    """Mappings that ``current_mappings`` does not use: same (year, old code,
    institution) as another one, with another new code."""
    keep = current_mappings(mapping).select("year", "old_course_code", "institution_id", F.col("new_course_code").alias("used_course_code"))
    return mapping.join(keep, ["year", "old_course_code", "institution_id"]).where(~F.col("new_course_code").eqNullSafe(F.col("used_course_code")))


def remap_course_codes(df: DataFrame, mapping: DataFrame, code_col: str = "course_code",
                       year_col: str = "year", inst_col: str = "institution_id",
                       as_of: Column | None = None, date_col: str | None = None) -> DataFrame:
    """Replace an old course code by its new one for the same (year,
    institution); codes without a mapping stay. Adds ``remapped``.

    One mapping per key is used (``current_mappings``), so rows are never
    multiplied; ``as_of`` leaves out mappings dated later. With ``date_col``
    every row has a date of its own, and the mapping that was the latest on
    that date counts (one without a date is older than all); a row without a
    date is not remapped."""
    if as_of is not None:
        mapping = mapping.where(F.col("mapping_date").isNull() | (F.col("mapping_date") <= as_of))
    if date_col is not None:
        dated = mapping.groupBy("year", "old_course_code", "institution_id", "mapping_date").agg(F.min("new_course_code").alias("new_course_code"))
        j = asof_join(df, dated, [(code_col, "old_course_code"), (year_col, "year"), (inst_col, "institution_id")], F.col(date_col), "mapping_date", None,
                      {"new_course_code": "_new"})
        return (j.withColumn("remapped", F.col("_new").isNotNull())
                .withColumn(code_col, F.coalesce(F.col("_new"), F.col(code_col))).drop("_new"))
    m = current_mappings(mapping).select(F.col("old_course_code").alias("_old"), F.col("year").alias("_y"),
                                         F.col("institution_id").alias("_i"), F.col("new_course_code").alias("_new"))
    j = df.join(m, (F.col(code_col) == F.col("_old")) & (F.col(year_col) == F.col("_y"))
                & (F.col(inst_col) == F.col("_i")), "left")
    return (j.withColumn("remapped", F.col("_new").isNotNull())
            .withColumn(code_col, F.coalesce(F.col("_new"), F.col(code_col)))
            .drop("_old", "_y", "_i", "_new"))


# I2 -------------------------------------------------------------------------
def _norm_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim_all(c)), "[_ ]", "")


def match_schema(headers: DataFrame, required: list[str],
                 min_conf: float = schemas.HEADER_MIN_CONFIDENCE,
                 auto: float = schemas.HEADER_AUTO_ACCEPT) -> DataFrame:
    """Map each required column to a header of each file.

    ``headers``: (file, position, header), one row per header of each file;
    ``required``: the required column names (the import's mapping, a fixed
    configuration list). Exact: equal after lower+trim, or also ignoring
    spaces; the first header by position wins. Otherwise fuzzy: confidence
    = 1 - lev/max(len) over names without '_' and spaces, kept above
    ``min_conf``; the best header (then lowest position) is proposed; status
    'auto' when it is the only candidate above ``min_conf`` and lies above
    ``auto``, else 'review'. Unmatched -> 'missing'.
    Output: file, required, header, confidence, status.
    """
    req_arr = F.array(*[F.lit(r) for r in required])
    # Each header row is expanded by the fixed required list (linear).
    pairs = headers.select("file", "position", "header", F.explode(req_arr).alias("required"))
    h, r = F.lower(trim_all(F.col("header"))), F.lower(trim_all(F.col("required")))
    is_exact = (h == r) | (F.regexp_replace(h, " ", "") == F.regexp_replace(r, " ", ""))
    a, b = _norm_header(F.col("header")), _norm_header(F.col("required"))
    conf = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    scored = pairs.select("file", "position", "header", "required",
                          is_exact.alias("_exact"), conf.alias("confidence"))
    per = scored.groupBy("file", "required").agg(
        F.min_by("header", F.when(F.col("_exact"), F.col("position"))).alias("_exact_header"),
        F.max_by("header", F.when(F.col("confidence") > min_conf,
                                  F.struct("confidence", -F.col("position")))).alias("_fuzzy_header"),
        F.max(F.when(F.col("confidence") > min_conf, F.col("confidence"))).alias("_best"),
        F.count(F.when(F.col("confidence") > min_conf, 1)).alias("_n"))
    status = (F.when(F.col("_exact_header").isNotNull(), F.lit("exact"))
              .when(F.col("_fuzzy_header").isNull(), F.lit("missing"))
              .when((F.col("_n") == 1) & (F.col("_best") > auto), F.lit("auto"))
              .otherwise(F.lit("review")))
    return per.select(
        "file", "required",
        F.coalesce("_exact_header", "_fuzzy_header").alias("header"),
        F.when(F.col("_exact_header").isNotNull(), F.lit(1.0)).otherwise(F.col("_best")).alias("confidence"),
        status.alias("status"))


def reconcile_historical_codes(hist: DataFrame, mapping: DataFrame) -> DataFrame:
    """Set ``reconciled`` on historical codes that now have a mapping for
    the same (year, old code, institution)."""
    m = (mapping.select(F.col("year").alias("_y"), F.col("old_course_code").alias("_old"),
                        F.col("institution_id").alias("_i"))
         .distinct().withColumn("_hit", F.lit(True)))
    j = hist.join(m, (F.col("year") == F.col("_y")) & (F.col("old_course_code") == F.col("_old"))
                  & (F.col("institution_id") == F.col("_i")), "left")
    return (j.withColumn("reconciled", F.coalesce(F.col("reconciled"), F.lit(False)) | F.col("_hit").isNotNull())
            .drop("_y", "_old", "_i", "_hit"))
