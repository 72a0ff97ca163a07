"""Table access for the reports.

``Tables`` is what every operator receives. Two implementations:

* ``DriverTables`` -- the canonical admissions tables derived, as lazy
  DataFrames, from the generated star-schema tables in a folder of Parquet
  files (the projection rules are in FIXTURES.md section B).
* ``FrameTables`` -- tables given directly as DataFrames (stored Parquet
  tables of a deployment, or hand-made edge tables in tests).

``candidate(*cols)`` takes the columns the caller needs, so a projection
joins only the sources those columns come from (a report on year and
aggregate never touches the customer table).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the projection (FIXTURES.md section B).
MARKET_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
INSTITUTION_TYPES = [(0, "FEDERAL"), (1, "STATE"), (2, "PRIVATE")]
ORDER_STATUS_GENDER = {"F": "F", "O": "M"}  # P -> NULL
ADMITTED_PRIORITY = "1-URGENT"
DISABLED_PRIORITY = "5-LOW"
AGGREGATE_DIVISOR = 1250
UNKNOWN_CODES = 1_000_000     # added to a course code that no course has
ANCHOR_SUBJECT = "STANDARD"
#: Lines of a task that joins or groups facts by registration number, and those that need no dealing.
TASK_LINES, FEW_LINES = 1 << 19, 1 << 22

DRIVER_TABLE_NAMES = ["region", "nation", "customer", "supplier", "part",
                      "orders", "lineitem", "events", "documents", "embeddings",
                      "pages", "benchmark", "labels", "conversations"]

CUSTOMER_COLUMNS = {"surname", "firstname", "statecode", "lg_id"}
LINE_COLUMNS = {"app_course1", "inid"}
CANDIDATE_COLUMNS = ["regnumber", "surname", "firstname", "gender", "statecode",
                     "lg_id", "aggregate", "year", "is_admitted", "app_course1",
                     "inid"]


class Tables:
    """Interface: one DataFrame per canonical table."""

    spark: SparkSession
    #: Whether the facts lie in buckets of the registration number.
    co_partitioned = False

    def candidate(self, *cols: str) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    def table(self, name: str) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def dealt(self, name: str, df: DataFrame) -> DataFrame:
        """Rows of a fact, dealt to tasks by registration number where a task might get too many."""
        return df

    def latest_year(self) -> Column:
        """Scalar subquery ``(SELECT max(year) FROM candidate)``."""
        return self.candidate("year").select(F.max("year")).scalar()


class FrameTables(Tables):
    def __init__(self, spark: SparkSession, **frames: DataFrame):
        self.spark = spark
        self._frames = frames

    def table(self, name: str) -> DataFrame:
        try:
            return self._frames[name]
        except KeyError:
            raise AttributeError(f"no table {name!r}") from None

    def candidate(self, *cols: str) -> DataFrame:
        df = self._frames["candidate"]
        return df.select(*cols) if cols else df


def segment_index(col: Column) -> Column:
    """Position of a market segment in MARKET_SEGMENTS (NULL if unknown)."""
    expr = None
    for i, seg in enumerate(MARKET_SEGMENTS):
        expr = (F.when(col == seg, F.lit(i)) if expr is None
                else expr.when(col == seg, F.lit(i)))
    return expr


def brand_number(col: Column) -> Column:
    return F.regexp_extract(col, r"(\d+)", 1).cast("int")


class DriverTables(Tables):
    """Admissions tables projected from the generated Parquet tables."""

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark = spark
        self.base_dir = base_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self._lines: int | None = None

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.base_dir}/{name}.parquet")
        return self._cache[name]

    def _deal(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` in as many partitions by ``key`` as the lines need, so that
        sorts and hash tables of a task stay small at any input size (adaptive
        execution packs partitions by compressed bytes, of which keys need few)."""
        if self._lines is None:
            self._lines = self.raw("lineitem").count()     # of the files' footers
        if self._lines <= FEW_LINES:
            return df
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(max(width, -(-self._lines // TASK_LINES)), key)

    def dealt(self, name: str, df: DataFrame) -> DataFrame:
        # Scores are dealt where they are made.
        return df if name == "candidate_scores" else self._deal(df, CO_PARTITIONED[name])

    # -- dimensions --------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        fn = getattr(self, f"_t_{name}", None)
        if fn is None:
            if name in DRIVER_TABLE_NAMES:
                return self.raw(name)
            raise AttributeError(f"no table {name!r}")
        return fn()

    def _t_state(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("st_id"),
            F.col("n_name").alias("st_name"),
            F.col("n_regionkey").alias("st_region"))

    def _t_region(self) -> DataFrame:
        return self.raw("region")

    def _t_lga(self) -> DataFrame:
        return (self.raw("customer").select("c_nationkey", "c_mktsegment").distinct()
                .select((F.col("c_nationkey") * 10 + segment_index(F.col("c_mktsegment")))
                        .cast("int").alias("lg_id"),
                        F.col("c_nationkey").alias("lg_st_id"),
                        F.col("c_mktsegment").alias("lg_name")))

    def _t_faculty(self) -> DataFrame:
        return (self.raw("part").select("p_brand").distinct()
                .select(brand_number(F.col("p_brand")).alias("fac_id"),
                        F.col("p_brand").alias("fac_name")))

    def _t_course(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("course_code"),
            F.col("p_name").alias("course_name"),
            brand_number(F.col("p_brand")).alias("facid"))

    def _t_institution(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("inid"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("inabv"),
            F.col("s_name").alias("inname"),
            F.col("s_nationkey").alias("inst_state_id"),
            # (a state no table has, for every 10th supplier)
            F.when(F.col("s_suppkey") % 10 == 0, F.col("s_nationkey") + 100).otherwise(F.col("s_nationkey")).alias("affiliated_state_id"),
            (F.col("s_suppkey") % 3).cast("int").alias("intyp"))

    def _t_institution_type(self) -> DataFrame:
        return self.spark.createDataFrame(INSTITUTION_TYPES, "intyp_id int, intyp_desc string")

    def _t_subject(self) -> DataFrame:
        # One row per distinct part type; ids follow the sorted type names.
        # The window sees only the distinct types (a small domain).
        from pyspark.sql import Window
        return (self.raw("part").select(F.col("p_type").alias("su_name")).distinct()
                .select(F.row_number().over(Window.orderBy("su_name")).cast("int").alias("su_id"),
                        "su_name"))

    def _t_import_errors(self) -> DataFrame:
        return (self.raw("events").where(F.col("event_type") == "error")
                .select(F.col("props").alias("error_message"),
                        F.lit("events").alias("source_file"),
                        F.col("props").alias("raw"),
                        F.col("ts").alias("import_ts")))

    # -- facts -------------------------------------------------------------
    def candidate(self, *cols: str, orders_filter: Column | None = None) -> DataFrame:
        """``orders_filter``: an optional predicate on the raw orders columns
        (e.g. an o_orderdate range), applied at the scan where Parquet can
        use it, before any join."""
        want = list(cols) if cols else list(CANDIDATE_COLUMNS)
        o = self.raw("orders")
        if orders_filter is not None:
            o = o.where(orders_filter)
        df = o.select(
            F.col("o_orderkey").alias("regnumber"),
            F.col("o_custkey"),
            F.when(F.col("o_orderstatus") == "F", F.lit("F"))
             .when(F.col("o_orderstatus") == "O", F.lit("M")).alias("gender"),
            F.floor(F.col("o_totalprice") / AGGREGATE_DIVISOR).cast("int").alias("aggregate"),
            F.year("o_orderdate").alias("year"),
            (F.col("o_orderpriority") == ADMITTED_PRIORITY).alias("is_admitted"))
        if CUSTOMER_COLUMNS & set(want):
            # c_custkey is the customer key: a left join keeps every order
            # and adds at most one customer row, so it can be left out when
            # no customer column is asked for.
            c = self.raw("customer").select(
                "c_custkey",
                F.col("c_name").alias("surname"),
                F.col("c_mktsegment").alias("firstname"),
                F.col("c_nationkey").alias("statecode"),
                (F.col("c_nationkey") * 10 + segment_index(F.col("c_mktsegment")))
                .cast("int").alias("lg_id"))
            df = df.join(c, df.o_custkey == c.c_custkey, "left")
        if LINE_COLUMNS & set(want):
            # One row per order (map-side partial aggregate, then a shuffle on
            # the order key, which the join with orders reuses).
            li = (self.raw("lineitem").groupBy("l_orderkey")
                  .agg(F.min("l_partkey").alias("app_course1"),
                       F.min("l_suppkey").alias("inid")))
            df = self._deal(df, "regnumber")
            df = df.join(li, df.regnumber == li.l_orderkey, "left")
        return df.select(*want)

    def _t_candidate(self) -> DataFrame:
        return self.candidate()

    def _t_candidate_disabilities(self) -> DataFrame:
        # Low-priority orders; the kind follows the order key.
        k = F.col("o_orderkey") % 3
        return self.raw("orders").where(F.col("o_orderpriority") == DISABLED_PRIORITY).select(
            F.col("o_orderkey").alias("cand_reg_number"), (k == 0).alias("is_blind"), (k == 1).alias("is_deaf"),
            F.when(k == 2, F.col("o_orderpriority")).alias("other_challenges"))

    def _t_candidate_exam_info(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
        return (self.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
                .join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
                .select(F.col("o_orderkey").alias("cand_reg_number"), F.col("c_mktsegment").alias("exam_town"),
                        F.col("c_name").alias("exam_centre"), F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("exam_number"),
                        F.col("c_nationkey").alias("mock_state_id"), (F.col("o_orderstatus") == "P").alias("is_mock_candidate")))

    def _t_institution_names(self) -> DataFrame:
        from ..operators.model_ops import institution_name_history
        return institution_name_history(self)

    def _t_subject_mapping_2023(self) -> DataFrame:
        return self.table("subject").select(F.concat(F.lit("S"), F.col("su_id").cast("string")).alias("csv_code"),
                                            "su_id", F.col("su_id").alias("position"))

    def _t_historical_course_codes(self) -> DataFrame:
        # Every 50th order has a code that no course has; an entry per (year, code, institution).
        c = self.candidate("regnumber", "year", "app_course1", "inid").where((F.col("regnumber") % 50 == 0) & F.col("app_course1").isNotNull())
        return (c.groupBy("year", (F.col("app_course1") + UNKNOWN_CODES).alias("old_course_code"), F.col("inid").alias("institution_id"))
                .agg(F.min("regnumber").alias("id"))
                .select("id", "year", "old_course_code", "institution_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("import_timestamp"),
                        (F.col("id") % 3 == 0).alias("reconciled")))

    def _t_course_code_mappings(self) -> DataFrame:
        # The code without the offset from March on, for even codes another one from February.
        h = self.table("historical_course_codes")
        code, both = F.col("old_course_code") - UNKNOWN_CODES, F.col("old_course_code") % 2 == 0
        rows = F.array_compact(F.array(
            F.struct((F.col("id") * 2).alias("id"), code.alias("code"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("on")),
            F.when(both, F.struct((F.col("id") * 2 + 1).alias("id"), (code + 1).alias("code"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("on")))))
        h = h.select("year", "old_course_code", "institution_id", F.explode(rows).alias("m"))
        return h.select("m.id", "year", "old_course_code", F.col("m.code").alias("new_course_code"),
                        F.concat(F.lit("Course "), F.col("m.code").cast("string")).alias("course_name"), "institution_id", F.col("m.on").alias("mapping_date"))

    def _t_candidate_scores(self) -> DataFrame:
        # Orders are joined before aggregating: the aggregate's keys
        # (order, subject, year) are then satisfied by the join's partitioning
        # on the order key, and a year filter prunes orders before the join.
        part_subject = (self.raw("part").select("p_partkey", "p_type")
                        .join(self._t_subject(), F.col("p_type") == F.col("su_name"))
                        .select("p_partkey", "su_id"))
        years = self.raw("orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
        lines = (self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
                 .join(part_subject, F.col("l_partkey") == F.col("p_partkey")))
        lines = self._deal(lines, "l_orderkey").join(years, F.col("l_orderkey") == F.col("o_orderkey"))
        return (lines.groupBy(F.col("l_orderkey").alias("cand_reg_number"),
                              F.col("su_id").alias("subject_id"), "year")
                .agg(F.max(F.floor("l_quantity").cast("int")).alias("score")))


# -- stored tables -------------------------------------------------------------
CANONICAL_TABLES = ["state", "lga", "faculty", "course", "institution", "institution_type", "institution_names",
                    "subject", "subject_mapping_2023", "course_code_mappings", "historical_course_codes", "candidate", "candidate_scores", "candidate_disabilities", "candidate_exam_info"]
YEAR_PARTITIONED = {"candidate", "candidate_scores"}
#: Facts by registration number: stored in buckets of it, as many each, so that joins of them and windows per candidate need no exchange.
CO_PARTITIONED = {"candidate": "regnumber", "candidate_scores": "cand_reg_number",
                  "candidate_disabilities": "cand_reg_number", "candidate_exam_info": "cand_reg_number"}
BUCKETS = "_buckets"     # a name that Spark's readers skip


def _write_bucketed(df: DataFrame, path: str, key: str, years: bool, buckets: int, mode: str) -> None:
    """Write a fact in ``buckets`` buckets of ``key``, sorted by it, within
    each year. A task holds one bucket, so a year has a file per bucket."""
    from ..operators.upsert import _write_text
    spark = df.sparkSession
    # The catalog is needed to write buckets only; the files stay when the entry is dropped.
    name = f"cohortlens_write_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).option("path", path)
    (writer.partitionBy("year") if years else writer).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    schema = [f for f in df.schema if not (years and f.name == "year")] + ([df.schema["year"]] if years else [])
    _write_text(spark, f"{path}/{BUCKETS}", json.dumps({"key": key, "years": years, "buckets": buckets, "schema": T.StructType(schema).jsonValue()}))


def _read_bucketed(spark: SparkSession, path: str) -> DataFrame | None:
    """A fact written by ``_write_bucketed``, known to Spark by its buckets;
    None for any other folder."""
    from ..operators.upsert import _read_text
    text = _read_text(spark, f"{path}/{BUCKETS}")
    if text is None:
        return None
    d = json.loads(text)
    name = f"cohortlens_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(d["schema"]))
    years = "PARTITIONED BY (year)" if d["years"] else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {years} CLUSTERED BY ({d['key']}) SORTED BY ({d['key']}) INTO {d['buckets']} BUCKETS LOCATION '{path}'")
    if d["years"]:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def materialize(t: Tables, out_dir: str, tables=CANONICAL_TABLES, mode: str = "overwrite", buckets: int | None = None) -> None:
    """Write the canonical tables as Parquet under ``out_dir/<name>``: facts
    partitioned by year, so a latest-year report reads one partition, and in
    ``buckets`` buckets of the registration number (default: the session's
    shuffle width), so that per-candidate work needs no exchange. Run once
    per load; reports then read the stored tables."""
    buckets = buckets or int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    for name in tables:
        df = t.candidate() if name == "candidate" else t.table(name)
        path = f"{out_dir.rstrip('/')}/{name}"
        if name in CO_PARTITIONED:
            _write_bucketed(df, path, CO_PARTITIONED[name], name in YEAR_PARTITIONED, buckets, mode)
        else:
            df.write.mode(mode).parquet(path)


class StoredTables(FrameTables):
    """Canonical tables read from ``base_dir/<name>`` Parquet folders. Facts
    in buckets are entered in the session's catalog under names of their own,
    as external tables: their files are never touched."""

    def __init__(self, spark: SparkSession, base_dir: str, tables=CANONICAL_TABLES):
        base = base_dir.rstrip("/")
        bucketed = {n: _read_bucketed(spark, f"{base}/{n}") for n in tables if n in CO_PARTITIONED}
        super().__init__(spark, **{n: spark.read.parquet(f"{base}/{n}") if (b := bucketed.get(n)) is None else b for n in tables})
        self.co_partitioned = bool(bucketed) and None not in bucketed.values()
