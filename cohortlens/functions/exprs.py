"""Reusable Column expressions. All JVM-side; no Python UDFs.

Rounding: the reports round averages and percentages half away from zero
on exact decimals. For integer inputs that is done exactly in
integer arithmetic from (sum, count) -- ``half_up_ratio`` -- so results do
not depend on floating-point summation order, at any row count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def half_up_ratio(num: str, den: str, scale: int = 1, digits: int = 2) -> Column:
    """round(scale * num / den, digits), half away from zero, NULL when den is
    0 or NULL. ``num`` and ``den`` name integer (long) columns, ``den`` not
    negative. Uses integral ``div`` on |num|:
    sign(num) * floor((2*scale*10^d*|num| + den) / (2*den)) / 10^d.
    """
    m = 10 ** digits
    k = 2 * scale * m
    n, d = _q(num), _q(den)
    return F.expr(
        f"CASE WHEN {d} > 0 THEN CASE WHEN {n} < 0 THEN -1 ELSE 1 END * CAST((({k} * abs({n}) + {d}) div (2 * {d})) AS DOUBLE) / {m} END")


def round_avg(sum_col: str, cnt_col: str, digits: int = 2) -> Column:
    """Exact half-up rounded average from a pre-aggregated (sum, count)."""
    return half_up_ratio(sum_col, cnt_col, scale=1, digits=digits)


def pct(part_col: str, total_col: str, digits: int = 2) -> Column:
    """Exact half-up rounded percentage part/total*100."""
    return half_up_ratio(part_col, total_col, scale=100, digits=digits)


def count_if(cond: Column) -> Column:
    """COUNT(CASE WHEN cond THEN 1 END)."""
    return F.count(F.when(cond, F.lit(1)))


def score_band(col: Column, bands=None, floor_label: str | None = None) -> Column:
    bands = bands or schemas.SCORE_BANDS
    floor_label = floor_label or schemas.SCORE_BAND_FLOOR_LABEL
    expr = None
    for lo, label in bands:
        expr = F.when(col >= lo, F.lit(label)) if expr is None else expr.when(col >= lo, F.lit(label))
    return expr.otherwise(F.lit(floor_label))


# Whitespace trimmed by the import: ASCII whitespace and the Unicode space
# characters (fixed list).
WHITESPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
              "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def trim_all(col: Column) -> Column:
    """Trim ASCII and Unicode whitespace from both ends (btrim over a
    character set: no regular expression)."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    """Trim; an empty result becomes NULL."""
    return F.nullif(trim_all(col), F.lit(""))


def norm_gender(col: Column) -> Column:
    """M/MALE -> M, F/FEMALE -> F (any case, trimmed), else NULL."""
    u = F.upper(trim_all(col))
    males = [k for k, v in schemas.GENDER_VALUES.items() if v == "M"]
    females = [k for k, v in schemas.GENDER_VALUES.items() if v == "F"]
    return F.when(u.isin(*males), F.lit("M")).when(u.isin(*females), F.lit("F"))


def parse_flag(col: Column) -> Column:
    """yes/true/1 (any case) -> true; other non-blank -> false; blank -> NULL."""
    return flag_value(blank_to_null(col))


def flag_value(blanked: Column) -> Column:
    """parse_flag for a column already trimmed with blanks as NULL."""
    return F.when(blanked.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.lower(blanked).isin(*schemas.FLAG_TRUE_VALUES))

