"""As-of joins: the value that was valid for a key at each row's own date.

``normal_periods`` makes the periods of a key disjoint; ``asof_join`` carries
the last period that began forward to the rows behind it, in one sort of the
union of both, so a key with many periods costs no more than their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the rows of a key are dealt to; each gets the key's periods.
SPREAD = 8


def _later(end: str) -> Column:
    """Order of period ends: an open one is the latest."""
    return F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("end"))


def normal_periods(periods: DataFrame, key: list[str], start: str, end: str, values: list[str]) -> DataFrame:
    """(key, start, end, values): periods [start, end) of a key that don't
    overlap. A null end is open, a null start is before all dates.

    Periods of equal values that overlap or touch become one. A period ends
    where the next one starts: a new value replaces the old one for good. Of
    several with one start the one that ends last counts (then the greatest
    values). Empty periods and those without a key are left out."""
    known = [F.col(k).isNotNull() for k in key]
    real = periods.select(*key, start, end, *values).where(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < F.col(end)))
    for k in known:
        real = real.where(k)
    one = real.groupBy(*key, start).agg(F.max(F.struct(_later(end).alias("_till"), F.struct(*values).alias("_v"))).alias("_x"))
    one = one.select(*key, start, F.col("_x._till").alias("_till"), F.col("_x._v").alias("_v"))
    order = Window.partitionBy(*key).orderBy(F.asc_nulls_first(start))
    other = ~F.col("_v").eqNullSafe(F.lag("_v").over(order)) | (F.row_number().over(order) == 1)
    one = one.withColumn("_run", F.sum(F.when(other, 1).otherwise(0)).over(order))
    run = Window.partitionBy(*key, "_run").orderBy(F.asc_nulls_first(start))
    seen = F.max("_till").over(run.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("_gap", F.when(~seen["open"] & (seen["end"] < F.col(start)), 1).otherwise(0))
    one = one.withColumn("_part", F.sum("_gap").over(run))
    first = F.min(F.struct(F.col(start).isNotNull().alias("known"), F.col(start).alias("start")))["start"]
    whole = one.groupBy(*key, "_run", "_part").agg(first.alias(start), F.max("_till")["end"].alias(end), F.first("_v").alias("_v"))
    following = F.lead(start).over(order)
    cut = F.when(F.col(end).isNull() | (following < F.col(end)), F.coalesce(following, F.col(end))).otherwise(F.col(end))
    return whole.withColumn(end, cut).select(*key, start, end, *[F.col(f"_v.{v}").alias(v) for v in values])


def asof_join(rows: DataFrame, periods: DataFrame, on: list[tuple[str, str]], date: Column, start: str, end: str | None,
              values: dict[str, str], spread: int = SPREAD) -> DataFrame:
    """``rows`` with the values (period column -> new name) of the period that
    holds ``date``: the last that started by then, unless it has ended.

    ``on``: pairs (row column, period column), equal and not null. Every row
    stays, once, with nulls where no period holds its date, its date or a key
    is null. Of periods with one start any may be taken; give each start once
    (``normal_periods``). Rows and periods are sorted together by (key, part,
    date), the rows of a key being dealt to ``spread`` parts by their content,
    so that a hot key is no single task's."""
    keys = [f"_k{i}" for i in range(len(on))]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if not t.startswith(("map", "variant"))]), F.lit(spread)).cast("int")
    mine = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *[F.col(f"`{r}`").alias(k) for k, (r, _) in zip(keys, on)], date.alias("_t"), salt.alias("_salt"))
    kind = mine.schema["_t"].dataType
    held = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(values)], (F.col(end).cast(kind) if end else F.lit(None).cast(kind)).alias("till"))
    theirs = periods.select(*[F.col(p).alias(k) for k, (_, p) in zip(keys, on)], F.col(start).cast(kind).alias("_t"), held.alias("_v"),
                            F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_salt")).dropna(subset=keys)
    both = mine.withColumn("_is", F.lit(1)).unionByName(theirs.withColumn("_is", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_salt").orderBy(F.asc_nulls_first("_t"), "_is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_is = 1")
    valid = F.col("_t").isNotNull() & (F.col("_v.till").isNull() | (F.col("_t") < F.col("_v.till")))
    return found.select(*[F.col("_row")[c].alias(c) for c in rows.columns], *[F.when(valid, F.col(f"_v.v{i}")).alias(n) for i, n in enumerate(values.values())])
