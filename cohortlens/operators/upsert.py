"""Keyed upserts without a table format.

An upsert here is: collapse the batch to one row per key (per column, the
last non-null value by a load sequence), full-outer-join it with the target
on the key, coalesce new over old. Both sides are unique on the key, so the
join has no hot keys; a key repeated many times in one batch is collapsed by
a partial (map-side) aggregate before the shuffle.

``write_upsert`` applies a merge to a stored table and reads and rewrites
only the partitions (a key bucket of a year) that the batch touches.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import schemas
from ..functions.exprs import blank_to_null


def last_non_null(batch: DataFrame, key: list[str], cols: list[str], seq: str) -> DataFrame:
    """One row per key; each column = its value on the highest ``seq`` row
    where it is not NULL."""
    return batch.groupBy(*key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols])


def _blank_strings(df: DataFrame, cols) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(*[blank_to_null(F.col(c)).alias(c) if types.get(c) == "string" and c in cols
                       else F.col(c) for c in df.columns])


# S6 -------------------------------------------------------------------------
def upsert_candidates(target: DataFrame, batch: DataFrame, key: str = "regnumber",
                      seq: str = "_seq") -> DataFrame:
    """Insert new keys; for existing keys each column takes the batch value
    when it is non-blank, else keeps the old one (blank never erases).
    Within the batch, later rows (higher ``seq``) win per column."""
    cols = [c for c in target.columns if c != key and c in batch.columns]
    b = _blank_strings(batch, cols)
    b = last_non_null(b, [key], cols, seq)
    o, n = target.alias("o"), b.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    out = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    for c in target.columns:
        if c == key:
            continue
        out.append((F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in cols
                    else F.col(f"o.{c}")).alias(c))
    return j.select(*out)


JOURNAL, LAYOUT, STAGE = "_merge_journal", "_layout", "_merge_stage"    # names that Spark's readers skip
BUCKET, BUCKETS = "reg_bucket", 64


@dataclass(frozen=True)
class Layout:
    """How a stored table is laid out: by ``partition_col`` and the hash
    bucket of ``key``; its schema, so that no file is opened to learn it."""
    key: str
    partition_col: str
    buckets: int
    schema: StructType

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")


def layout_of(spark: SparkSession, path: str) -> Layout | None:
    """The layout of a table made by ``create_table``, None for any other."""
    text = _read_text(spark, f"{path.rstrip('/')}/{LAYOUT}")
    if text is None:
        return None
    d = json.loads(text)
    return Layout(d["key"], d["partition_col"], d["buckets"], StructType.fromJson(d["schema"]))


def create_table(df: DataFrame, path: str, key: str = "regnumber", partition_col: str = "year", buckets: int = BUCKETS) -> None:
    """Write ``df`` as a new table in (partition_col, bucket of key) folders.
    A key stays in its bucket in every year, so a merge looks for the old
    versions of its keys in their buckets only."""
    schema = StructType([f for f in df.schema if f.name != partition_col] + [df.schema[partition_col], StructField(BUCKET, IntegerType())])
    layout = Layout(key, partition_col, buckets, schema)
    # The layout comes first: without a data file the table counts as missing, and is created again.
    _write_text(df.sparkSession, f"{path.rstrip('/')}/{LAYOUT}", json.dumps(
        {"key": key, "partition_col": partition_col, "buckets": buckets, "schema": schema.jsonValue()}))
    (df.withColumn(BUCKET, layout.bucket(F.col(key))).hint("rebalance", partition_col, BUCKET)
     .write.mode("append").partitionBy(partition_col, BUCKET).parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table, with its bucket column if it has one."""
    layout = layout_of(spark, path)
    return (spark.read.schema(layout.schema) if layout else spark.read).parquet(path)


def _touched(target: DataFrame, batch: DataFrame, key: str, partition_col: str, layout: Layout | None) -> tuple[list[tuple], bool]:
    """(partitions that hold an old version of a batch key or receive a row,
    whether a batch key stands twice in the table). Reads keys only, and with
    a layout those of the batch's buckets only."""
    keys = last_non_null(batch, [key], [partition_col] if partition_col in batch.columns else [], "_at").withColumnRenamed(partition_col, "_new")
    old = target.select(F.col(key).alias("_key"), F.col(partition_col).alias("_old"))
    bucket = F.lit(0)
    if layout:
        bucket = layout.bucket(F.col(key))
        mine = [r[0] for r in keys.select(bucket.alias("b")).distinct().collect()]
        old = target.where(F.col(BUCKET).isin(mine)).select(F.col(key).alias("_key"), F.col(partition_col).alias("_old"))
    if "_new" not in keys.columns:
        keys = keys.withColumn("_new", F.lit(None).cast(target.schema[partition_col].dataType))
    both = keys.join(old, F.col(key) == F.col("_key"), "left").groupBy(key).agg(
        F.count("_old").alias("n"), F.array_union(F.collect_set("_old"), F.array(F.coalesce(F.max("_new"), F.max("_old")))).alias("_parts"))
    found = both.select(F.explode("_parts").alias("part"), bucket.alias("bucket"), "n").groupBy("part", "bucket").agg(F.max("n").alias("n")).collect()
    if any(r["part"] is None for r in found):
        raise ValueError(f"rows without a {partition_col} can't be stored")
    return sorted((r["part"], r["bucket"]) if layout else (r["part"],) for r in found), any(r["n"] > 1 for r in found)


def write_upsert(spark: SparkSession, target_path: str, batch: DataFrame,
                 key: str = "regnumber", seq: str = "_seq", partition_col: str = "year") -> None:
    """Merge ``batch`` into the Parquet table at ``target_path``, reading and
    rewriting only touched partitions.

    A touched partition is one holding an old version of a batch key or
    receiving a merged row (a key whose year changes moves partition, so
    both are rewritten); in a table made by ``create_table`` that is a key
    bucket of a year, in others (partitioned by ``partition_col`` alone) the
    year. Touched partitions are merged and written once, beside the table; a
    journal then names the copy and the partitions, and only then are folders
    moved into place. If the driver dies between, ``recover`` (run by every
    merge) finishes the move. A batch column that the table lacks is refused
    rather than dropped; rows without a key are left out.
    """
    recover(spark, target_path, partition_col)
    layout = layout_of(spark, target_path)
    target = read_table(spark, target_path)
    extra = [c for c in batch.columns if c not in target.columns and c != seq]
    if extra:
        raise ValueError(f"the table at {target_path} has no columns {extra}")
    batch = batch.where(F.col(key).isNotNull())
    touched, twice = _touched(target, batch.withColumnRenamed(seq, "_at"), key, partition_col, layout)
    if not touched:
        return
    parts = [partition_col, BUCKET] if layout else [partition_col]
    per: dict = {}
    for value, *bucket in touched:
        per.setdefault(value, []).extend(bucket)
    mine = reduce(lambda a, b: a | b, [(F.col(partition_col) == v) & F.col(BUCKET).isin(b) if layout else F.col(partition_col) == v for v, b in per.items()])
    rows = target.where(mine).drop(BUCKET)
    if twice:
        # One old row per key. A table written by others may hold a key twice;
        # the row of the greatest (partition, content) counts, a fixed choice.
        ours = batch.select(key).distinct()
        rest = [c for c in rows.columns if c not in (key, partition_col)]
        one = rows.join(ours, key, "left_semi").groupBy(key).agg(F.max(F.struct(partition_col, *rest)).alias("_o"))
        rows = rows.join(ours, key, "left_anti").unionByName(one.select(key, F.col(f"_o.{partition_col}").alias(partition_col), *[F.col(f"_o.{c}").alias(c) for c in rest]))
    merged = upsert_candidates(rows, batch, key, seq)
    if layout:
        merged = merged.withColumn(BUCKET, layout.bucket(F.col(key)))
    staged = f"{target_path.rstrip('/')}/{STAGE}-{uuid.uuid4().hex}"
    merged.select(*target.columns).hint("rebalance", *parts).write.partitionBy(*parts).parquet(staged)
    folders = [_folder(spark, dict(zip(parts, t))) for t in touched]
    written = [f for f in folders if _exists(spark, f"{staged}/{f}")]
    _write_text(spark, f"{target_path.rstrip('/')}/{JOURNAL}", json.dumps(
        {"staged": staged, "written": written, "emptied": sorted(set(folders) - set(written))}))
    recover(spark, target_path, partition_col)


def recover(spark: SparkSession, target_path: str, partition_col: str = "year") -> bool:
    """Finish a merge whose journal is still there; True if there was one.

    Repeating it gives the same table: a partition of the journal is replaced
    by its staged folder as long as that is there (moved, it isn't), those
    that the merge empties are removed, then the journal and the stage."""
    base = target_path.rstrip("/")
    path = f"{base}/{JOURNAL}"
    text = _read_text(spark, path)
    if text is None:
        return False
    job = json.loads(text)
    for folder in job["written"]:
        if _exists(spark, f"{job['staged']}/{folder}"):
            _delete_path(spark, f"{base}/{folder}")
            fs, to = _hadoop(spark, f"{base}/{folder}")
            fs.mkdirs(to.getParent())
            if not fs.rename(_hadoop(spark, f"{job['staged']}/{folder}")[1], to):
                raise OSError(f"cannot move {folder} into {base}")
    for folder in job["emptied"]:
        _delete_path(spark, f"{base}/{folder}")
    _delete_path(spark, path)
    _delete_path(spark, job["staged"])
    return True


def _folder(spark: SparkSession, values: dict) -> str:
    """A partition's folder below its table, as Spark names it."""
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join(name(c, str(v)) for c, v in values.items())


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole, in place of any: under another name first, then renamed."""
    fs, part = _hadoop(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    _delete_path(spark, path)
    if not fs.rename(part, _hadoop(spark, path)[1]):
        raise OSError(f"cannot write {path}")


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


# S8 -------------------------------------------------------------------------
def upsert_courses(target: DataFrame, batch: DataFrame, now: Column | None = None,
                   seq: str = "_seq") -> DataFrame:
    """Course upsert: blank code/name rows are skipped; on conflict the name
    is replaced, description and faculty keep the old value when the new one
    is blank, updated_at = now. New codes get created_at = updated_at = now."""
    now = now if now is not None else F.localtimestamp()
    b = _blank_strings(batch, ["course_code", "course_name", "description"])
    b = b.where(F.col("course_code").isNotNull() & F.col("course_name").isNotNull())
    b = last_non_null(b, ["course_code"], ["course_name", "description", "facid"], seq)
    o, n = target.alias("o"), b.alias("n")
    j = o.join(n, F.col("o.course_code") == F.col("n.course_code"), "full")
    hit = F.col("n.course_code").isNotNull()
    return j.select(
        F.coalesce(F.col("n.course_code"), F.col("o.course_code")).alias("course_code"),
        F.coalesce(F.col("n.course_name"), F.col("o.course_name")).alias("course_name"),
        F.coalesce(F.col("n.description"), F.col("o.description")).alias("description"),
        F.coalesce(F.col("n.facid"), F.col("o.facid")).alias("facid"),
        F.when(F.col("o.course_code").isNull(), now.cast("timestamp_ntz"))
         .otherwise(F.col("o.created_at")).alias("created_at"),
        F.when(hit, now.cast("timestamp_ntz")).otherwise(F.col("o.updated_at")).alias("updated_at"))


# S7 -------------------------------------------------------------------------
def upsert_course_names(target: DataFrame, batch: DataFrame,
                        placeholder_like: str = schemas.COURSE_PLACEHOLDER_LIKE) -> DataFrame:
    """Insert unknown codes; replace a known code's name only while the
    current name is a placeholder (LIKE 'Course%'). Unchanged rows are a
    no-op. The batch keeps one name per code (the greatest, for a fixed
    choice)."""
    b = (batch.select("course_code", blank_to_null(F.col("course_name")).alias("course_name"))
         .where(F.col("course_code").isNotNull())
         .groupBy("course_code").agg(F.max("course_name").alias("course_name")))
    o, n = target.alias("o"), b.alias("n")
    j = o.join(n, F.col("o.course_code") == F.col("n.course_code"), "full")
    replace = F.col("o.course_name").like(placeholder_like) | F.col("o.course_code").isNull()
    name = F.when(replace, F.coalesce(F.col("n.course_name"), F.col("o.course_name"))) \
        .otherwise(F.col("o.course_name"))
    return j.select(F.coalesce(F.col("o.course_code"), F.col("n.course_code")).alias("course_code"),
                    name.alias("course_name"))


# S11 ------------------------------------------------------------------------
def append_historical_codes(target: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows to append: distinct (year, old_course_code, institution_id) not
    yet in ``target``, stamped with ``now`` and reconciled = false."""
    now = now if now is not None else F.localtimestamp()
    triple = ["year", "old_course_code", "institution_id"]
    fresh = new.select(*triple).dropDuplicates(triple).join(target.select(*triple), triple, "left_anti")
    return fresh.select(*triple, now.cast("timestamp_ntz").alias("import_timestamp"),
                        F.lit(False).alias("reconciled"))


# S12 ------------------------------------------------------------------------
def with_year(rows: DataFrame, year: Column) -> DataFrame:
    """``rows`` with their year, which is NOT NULL: a row without one fails
    the load."""
    return rows.withColumn("year", F.coalesce(year.cast("int"), F.raise_error(F.lit("every row of a yearly table needs its year")).cast("int")))


def consolidate_years(frames: dict[int, DataFrame]) -> DataFrame:
    """Yearly tables -> one table with a ``year`` column; columns missing in
    a year become NULL. The year is NOT NULL: a frame without one (key None)
    is refused."""
    if None in frames:
        raise ValueError("every yearly table needs its year")
    parts = [df.withColumn("year", F.lit(int(y))) for y, df in sorted(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Types that a yearly table may have in place of a wider one, as Parquet files are read in the wider one.
WIDER = {("int", "bigint"), ("int", "double"), ("float", "double"), ("smallint", "int"), ("smallint", "bigint"), ("tinyint", "int"), ("tinyint", "bigint"), ("date", "timestamp_ntz")}


def read_years(spark: SparkSession, paths: list[str], pattern: str = r"(\d{4})(?=[^/]*/[^/]*$)") -> DataFrame:
    """Yearly Parquet folders (candidates_2021, candidates_2022, ...) as one
    table, in one scan: columns missing in a year are NULL, a column has the
    widest of its types, the year is the ``pattern``'s in a file's path.

    Columns whose types don't widen into each other are refused, with both
    types; so is a file whose path names no year, when it is read. Schemas
    come from the files' footers, one per folder; nothing else is read until
    the result is."""
    found: dict[str, str] = {}
    fields: dict = {}
    for path in paths:
        for f in spark.read.parquet(path).schema:
            old, new = found.get(f.name), f.dataType.simpleString()
            if old is None or (old, new) in WIDER:
                found[f.name], fields[f.name] = new, StructField(f.name, f.dataType, True)
            elif old != new and (new, old) not in WIDER:
                raise ValueError(f"column {f.name} is {old} in one year and {new} in another")
    if "year" in fields:
        raise ValueError("a yearly table has a year column already")
    rows = spark.read.schema(StructType(list(fields.values()))).parquet(*paths)
    year = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return with_year(rows.select("*", F.nullif(year, F.lit("")).alias("_year")), F.col("_year")).drop("_year")
