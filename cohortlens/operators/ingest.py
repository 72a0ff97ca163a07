"""CSV import as distributed Spark jobs.

Pipeline for candidates:
  read_candidate_csv (S1) -> map_columns (I7) -> clean_candidates (I3-I6, I12)
  -> split_valid (S9) -> upsert (operators.upsert, S6) -> import_summary (S15)

Every row carries an ``errors`` array; a row is good when it is empty.
Nothing is collected to the driver: bad rows are a DataFrame written to the
quarantine table next to the good rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.exprs import blank_to_null, flag_value, norm_gender, trim_all
from ..sources import csv_records
from ..sources.csv_records import PLACE

CORRUPT = "_corrupt_record"

# Typed target columns of the candidate import and their SQL types.
CANDIDATE_TYPES = {
    "regnumber": "string", "surname": "string", "firstname": "string",
    "middlename": "string", "gender": "string", "email": "string", "gsmno": "string",
    "statecode": "int", "lg_id": "int", "inid": "string", "aggregate": "int",
    "app_course1": "string", "is_admitted": "boolean", "is_direct_entry": "boolean",
    "is_blind": "boolean", "is_deaf": "boolean", "is_mock_candidate": "boolean",
    "maritalstatus": "string", "address": "string", "noofsittings": "int",
    "malpractice": "string",
}


# S1 / S2 --------------------------------------------------------------------
REQUIRED = ("REGNUMBER",)


def match_headers(heads: DataFrame, sources: list[str]) -> DataFrame:
    """(_head_id, _found: source -> the header's own name) of header lines
    (_head_id, _names), by ``resolve.match_schema`` (I2): exact and
    automatically accepted matches; a name stands for one source."""
    from .resolve import match_schema
    rows = heads.select(F.col("_head_id").cast("string").alias("file"), F.posexplode("_names").alias("position", "header"))
    found = match_schema(rows, sources).where(F.col("status").isin("exact", "auto"))
    one = found.groupBy("file", "header").agg(F.min(F.struct(F.when(F.col("status") == "exact", 0).otherwise(1), "required"))["required"].alias("required"))
    return one.groupBy(F.col("file").cast("long").alias("_head_id")).agg(F.map_from_entries(F.collect_list(F.struct("required", "header"))).alias("_found"))


def _columns(records: csv_records.Records, sources: list[str] | None, required: tuple[str, ...]) -> tuple[list[str], DataFrame]:
    """(column names, (_head_id, _at: position of each column or null, _width)).

    Headers are told apart by their lines only, so thousands of them are rows
    of one small table, stored once. One that lacks a required source is
    refused."""
    heads = records.heads
    if sources is None:
        own = F.transform("_names", lambda n, i: F.when(n == "", F.concat(F.lit("_c"), i.cast("string"))).otherwise(n))
        heads = heads.withColumn("_names", own)
        columns = [r[0] for r in heads.select(F.posexplode("_names").alias("i", "name")).groupBy("name").agg(F.min("i").alias("i")).orderBy("i", "name").collect()]
        at = [F.array_position("_names", F.lit(c)) for c in columns]
    else:
        columns = sources
        heads = heads.join(match_headers(heads, sources), "_head_id", "left").withColumn("_found", F.coalesce("_found", F.create_map().cast("map<string,string>")))
        at = [F.array_position("_names", F.element_at("_found", F.lit(c))) for c in columns]
    known = records.keep(heads.select("_head_id", "_names", F.array(*[(F.nullif(a, F.lit(0)) - 1).cast("int") for a in at]).alias("_at"), F.size("_names").alias("_width")), "heads")
    absent = [F.get("_at", F.lit(columns.index(c))).isNull() for c in required]
    for r in known.where(F.greatest(F.lit(False), *absent)).limit(1).collect() if required else ():
        raise ValueError(f"CSV lacks required columns {[c for c in required if r['_at'][columns.index(c)] is None]}; its header is {r['_names']}")
    return columns, known.drop("_names")


def parse_lines(lines: DataFrame, sources: list[str] | None = None, required: tuple[str, ...] = (), scratch: list[str] | None = None) -> DataFrame:
    """CSV lines (``csv_records.text_lines``) -> all-string columns by name,
    ``_corrupt_record``, ``source_file`` and the place.

    Each file is read by its own header (matched to ``sources``, if given:
    then these are the columns), so files may order, add or leave out
    columns; all are read in one pass. Quoted values may hold line breaks. A
    record whose field count differs from its header's, that has text beside
    its quotes, or that the file leaves open is corrupt, never a good row.
    The path of the stored summary of splits is added to ``scratch``."""
    records = csv_records.Records(lines)
    if scratch is not None:
        scratch.append(records.scratch)
    columns, heads = _columns(records, sources, required)
    broken = csv_records.broken()
    rows = records.rows.join(heads, "_head_id").withColumn("_values", F.when(~broken, csv_records.values(F.col("_line"))))
    rows = rows.withColumn("_values", F.when(F.size("_values") == F.col("_width"), F.col("_values")))
    cols = [F.get("_values", F.get("_at", F.lit(i))).alias(c) for i, c in enumerate(columns)]
    return rows.select(*cols, F.when(F.col("_values").isNull(), F.col("_line")).alias(CORRUPT), F.col("_path").alias("source_file"), *PLACE)


def _read(spark: SparkSession, paths, sources: list[str] | None = None, required: tuple[str, ...] = (), scratch: list[str] | None = None) -> DataFrame:
    return parse_lines(csv_records.text_lines(spark.read, paths), sources, required, scratch)


def read_candidate_csv(spark: SparkSession, paths, mapping=None, scratch: list[str] | None = None) -> DataFrame:
    """Candidate CSV files -> all-string columns under the mapping's source
    names (each file's own header, matched by I2), ``_corrupt_record``,
    ``source_file`` and the place of each row. A file without REGNUMBER is
    refused. Files are split and read in parallel, wherever their values
    break lines."""
    return _read(spark, paths, [m.source for m in (mapping or DEFAULT_CANDIDATE_MAPPING)], REQUIRED, scratch)


def read_course_csv(spark: SparkSession, paths) -> DataFrame:
    """Course CSV: headers upper-cased and trimmed, read by name; any
    malformed row fails the read, as one bad line aborts a course import."""
    df = _read(spark, paths)
    for c in df.columns:
        if c not in (CORRUPT, "source_file", *PLACE):
            df = df.withColumnRenamed(c, c.strip().upper())
    missing = [c for c in ("CODE", "NAME") if c not in df.columns]
    if missing:
        raise ValueError(f"course CSV lacks required columns {missing}")
    for c in schemas.COURSE_CSV_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    bad = F.raise_error(F.concat(F.lit("malformed course CSV row: "), F.col(CORRUPT)))
    return df.withColumn("CODE", F.when(F.col(CORRUPT).isNotNull(), bad.cast("string")).otherwise(F.col("CODE"))).drop(CORRUPT, *PLACE)


# I7 -------------------------------------------------------------------------
@dataclass(frozen=True)
class ColumnMapping:
    """source header -> destination column, with an optional Column hook."""
    source: str
    dest: str
    transform: Callable[[Column], Column] | None = None


DEFAULT_CANDIDATE_MAPPING = [ColumnMapping(s, d) for s, d in schemas.CANDIDATE_CSV_MAPPING]


def map_columns(df: DataFrame, mapping=None, keep=("source_file", CORRUPT, *PLACE)) -> DataFrame:
    """Select mapped columns under their destination names. Headers match
    case-insensitively after trimming; also ignoring spaces. A missing
    source column becomes NULL; unmapped columns are dropped."""
    mapping = mapping or DEFAULT_CANDIDATE_MAPPING
    norm = {c.strip().lower(): c for c in df.columns}
    nospace = {c.strip().lower().replace(" ", ""): c for c in df.columns}
    cols = []
    for m in mapping:
        key = m.source.strip().lower()
        src = norm.get(key) or nospace.get(key.replace(" ", ""))
        c = F.col(f"`{src}`") if src else F.lit(None).cast("string")
        if m.transform is not None:
            c = m.transform(c)
        cols.append(c.alias(m.dest))
    cols += [F.col(k) for k in keep if k in df.columns]
    return df.select(*cols)


# I3-I6, I12 -----------------------------------------------------------------
@dataclass(frozen=True)
class ImportOptions:
    year: int | None = None          # stamped on every row (year is NOT NULL)
    is_admission: bool = False       # admission list: every row is admitted
    validate_only: bool = False      # dry run: summary only, no write
    source_file: str | None = None   # label for source_file; the load order keeps the real path
    load_id: str | None = None       # quarantine partition; default: a hash of the input files
    buckets: int = 64                # key buckets of a year in a new table; a merge rewrites whole ones


def _err(cond: Column, msg: Column) -> Column:
    return F.when(cond, msg)


def clean_candidates(df: DataFrame, opts: ImportOptions = ImportOptions(), state_names: bool = False) -> DataFrame:
    """Mapped string columns -> typed candidate columns + ``errors`` array.

    Text is trimmed with blanks as NULL; gender is normalised; flags parse
    yes/true/1; integers use try_cast and a non-blank value that does not
    cast is an error on the row (not an exception).

    Two projections: every source column is trimmed once into ``_b_<col>``;
    typed values and error messages are then computed from those columns
    (Catalyst keeps the projections apart instead of repeating the trim).
    With ``state_names`` a statecode that is no integer is kept as
    ``state_name``, to be resolved against the state table (I8)."""
    present = [n for n in CANDIDATE_TYPES if n in df.columns]
    keep = [c for c in ("source_file", CORRUPT, *PLACE) if c in df.columns]
    blanked = df.select(*keep, *[blank_to_null(F.col(n)).alias(f"_b_{n}") for n in present])
    out, errs = [], []
    for name, typ in CANDIDATE_TYPES.items():
        if name not in present:
            out.append(F.lit(None).cast(typ).alias(name))
            continue
        b = F.col(f"_b_{name}")
        if name == "gender":
            v = norm_gender(b)
        elif typ == "boolean":
            v = flag_value(b)
        elif typ == "int":
            v = b.try_cast("int")
            if name == "statecode" and state_names:
                out += [v.alias(name), F.when(v.isNull(), b).alias("state_name")]
                continue
            errs.append(_err(b.isNotNull() & v.isNull(),
                             F.concat(F.lit(f"invalid integer for {name}: '"), b, F.lit("'"))))
        else:
            v = b
            if most := schemas.VARCHAR_LIMITS["candidate"].get(name):
                errs.append(_err(F.length(b) > most, F.lit(f"{name} is longer than {most}")))
        out.append(v.alias(name))
    reg = F.col("_b_regnumber") if "regnumber" in present else F.lit(None)
    errs.insert(0, _err(reg.isNull(), F.lit("missing regnumber")))
    if CORRUPT in df.columns:
        errs.insert(0, _err(F.col(CORRUPT).isNotNull(), F.lit("malformed CSV row")))
    typed = blanked.select(*out, *keep,
                           F.array_compact(F.array(*errs)).alias("errors"))
    if opts.is_admission:
        typed = typed.withColumn("is_admitted", F.lit(True))
    if opts.year is not None:
        typed = typed.withColumn("year", F.lit(int(opts.year)))
    if opts.source_file is not None:
        typed = typed.withColumn("source_file", F.lit(opts.source_file))
    return typed


# S9 -------------------------------------------------------------------------
def split_valid(df: DataFrame, raw_cols=None, now: Column | None = None):
    """-> (good rows without ``errors``, quarantine rows).

    Quarantine schema: error_message, source_file, raw, import_ts. ``raw``
    is the corrupt line when there is one, else the row as JSON."""
    now = now if now is not None else F.localtimestamp()
    good = df.where(F.size("errors") == 0).drop("errors", CORRUPT, *PLACE)
    data_cols = [c for c in (raw_cols or df.columns)
                 if c not in ("errors", CORRUPT, "source_file", *PLACE)]
    raw = F.to_json(F.struct(*data_cols))
    if CORRUPT in df.columns:
        raw = F.coalesce(F.col(CORRUPT), raw)
    bad = df.where(F.size("errors") > 0).select(
        F.array_join("errors", "; ").alias("error_message"),
        (F.col("source_file") if "source_file" in df.columns
         else F.lit(None).cast("string")).alias("source_file"),
        raw.alias("raw"), now.cast("timestamp_ntz").alias("import_ts"))
    return good, bad


# S15 ------------------------------------------------------------------------
def _summary_columns() -> list[Column]:
    failed = F.size("errors") > 0
    return [F.count(F.lit(1)).alias("total_rows"), F.count(F.when(~failed, 1)).alias("success_rows"), F.count(F.when(failed, 1)).alias("failed_rows"),
            F.max_by(F.array_join("errors", "; "), F.when(failed, F.struct(F.col("source_file"), F.col("regnumber")))).alias("last_error")]


def _with_shares(counts: DataFrame) -> DataFrame:
    from ..functions.exprs import pct
    return counts.select("total_rows", "success_rows", pct("success_rows", "total_rows").alias("success_pct"),
                         "failed_rows", pct("failed_rows", "total_rows").alias("failed_pct"), "last_error")


def import_summary(checked: DataFrame) -> DataFrame:
    """One row: total, successful and failed counts with percentages and the
    last error message (by source file, then message). Empty input gives
    NULL percentages, not a division error."""
    return _with_shares(checked.agg(*_summary_columns()))


def observed_stage(checked: DataFrame, name: str) -> tuple[DataFrame, str, DataFrame]:
    """(``checked`` staged, path, its import summary): the counts are observed
    on the rows as they are written, so the summary costs no pass of its own.
    The write is the plan's last stage, whose tasks count once however often
    they are tried."""
    seen = Observation()
    staged, path = stage(checked.observe(seen, *_summary_columns()), name)
    counts = seen.get
    row = checked.sparkSession.createDataFrame(
        [tuple(counts[c] for c in ("total_rows", "success_rows", "failed_rows", "last_error"))],
        "total_rows long, success_rows long, failed_rows long, last_error string")
    return staged, path, _with_shares(row)


# I13 / course cleaning ------------------------------------------------------
def clean_courses(df: DataFrame) -> DataFrame:
    """Course CSV rows -> (course_code, course_name, description, facid);
    rows with a blank code or name are skipped (I13)."""
    out = df.select(
        blank_to_null(F.col("CODE")).alias("course_code"),
        blank_to_null(F.col("NAME")).alias("course_name"),
        blank_to_null(F.col("DESCRIPTION")).alias("description"),
        blank_to_null(F.col("FACULTY_ID")).try_cast("int").alias("facid"))
    return valid_courses(out)


def valid_courses(df: DataFrame) -> DataFrame:
    return df.where(F.col("course_code").isNotNull() & F.col("course_name").isNotNull()
                    & (trim_all(F.col("course_code")) != "") & (trim_all(F.col("course_name")) != ""))


# Batch import: S1 -> I2 -> I7 -> I3-I6/I12 -> I8-I10 -> S9 -> S6 -> S11 -> S15 ----
@dataclass(frozen=True)
class References:
    """Tables that an import resolves against; each may be left out."""
    state: DataFrame | None = None           # st_id, st_name
    institution: DataFrame | None = None     # inid, inabv
    course: DataFrame | None = None          # course_code


def resolve_references(checked: DataFrame, refs: References) -> tuple[DataFrame, DataFrame | None]:
    """Resolve state names (I8), institutions (I9) and course codes (I10) of
    checked rows -> (rows, unknown codes or None).

    A state given as text becomes its id, an institution id or abbreviation
    the id; what can't be resolved is an error of the row. An unknown course
    code is no error: the row stays, and (year, old_course_code,
    institution_id) goes to the historical codes (S11)."""
    from . import resolve
    out, unknown = checked, None
    if refs.state is not None and "state_name" in out.columns:
        out = resolve.resolve_states(out, "state_name", refs.state)
        lost = F.col("state_name").isNotNull() & F.col("st_id").isNull() & F.col("statecode").isNull()
        out = out.withColumn("errors", F.when(lost, F.array_append("errors", F.concat(F.lit("unknown state: "), F.col("state_name")))).otherwise(F.col("errors")))
        out = out.withColumn("statecode", F.coalesce(F.col("statecode"), F.col("st_id").cast("int"))).drop("state_name", "st_id", "state_match")
    if refs.institution is not None:
        out = resolve.resolve_institutions(out, "inid", refs.institution)
        lost = F.col("inid").isNotNull() & F.col("resolved_inid").isNull()
        out = out.withColumn("errors", F.when(lost, F.array_append("errors", F.concat(F.lit("invalid institution: "), F.col("inid")))).otherwise(F.col("errors")))
        out = out.withColumn("inid", F.coalesce(F.col("resolved_inid").cast("string"), F.col("inid"))).drop("resolved_inid")
    if refs.course is not None:
        codes = refs.course.select(F.col("course_code").cast("string").alias("course_code"))
        good = out.where((F.size("errors") == 0) & F.col("app_course1").isNotNull())
        _, unknown = resolve.validate_course_codes(good, "app_course1", codes)
        unknown = unknown.select("year", F.col("app_course1").alias("old_course_code"), F.col("inid").alias("institution_id"))
    return out, unknown


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a Parquet file. Any trouble in reading the
    folder is raised: it never counts as a missing table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return False
    files = fs.listFiles(p, True)
    while files.hasNext():
        f = files.next().getPath().toString()
        if f.endswith(".parquet") and "/_temporary/" not in f:
            return True
    return False


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(``df`` written to the shared checkpoint folder and read back, path)."""
    import uuid
    from ..session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_quarantine(bad: DataFrame, errors_path: str, **partition: str) -> None:
    """Write bad rows to the partition of their load, which a retry of the
    same load overwrites; other loads' partitions are not touched."""
    out = bad
    for k, v in partition.items():
        out = out.withColumn(k, F.lit(str(v)))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition).parquet(errors_path))


def load_checked(spark: SparkSession, checked: DataFrame, target_path: str, errors_path: str, opts: ImportOptions,
                 partition: dict[str, str], refs: References | None = None, historical_path: str | None = None) -> DataFrame:
    """Resolve, quarantine and merge checked rows; returns the summary, which
    is observed while they are staged.

    The checked rows feed several outputs; they are staged once in the
    shared checkpoint folder, so a lost executor recomputes from that copy.
    The merge comes first and can be repeated: if it fails, neither the
    quarantine nor the historical codes have changed."""
    from . import upsert
    checked = checked.withColumn("_seq", F.struct(*PLACE))
    unknown = None
    if refs is not None:
        checked, unknown = resolve_references(checked, refs)
    staged, path, summary = observed_stage(checked, "import-checked")
    if unknown is not None:
        _, unknown = resolve_references(staged, References(course=refs.course))
    try:
        good = staged.where(F.size("errors") == 0).drop("errors", CORRUPT, "source_file", *PLACE)
        if table_exists(spark, target_path):
            upsert.write_upsert(spark, target_path, good, key="regnumber", seq="_seq")
        else:
            # No data file is there; appending can't replace anything.
            merged = upsert.upsert_candidates(good.drop("_seq").limit(0), good, key="regnumber", seq="_seq")
            upsert.create_table(merged, target_path, "regnumber", "year", opts.buckets)
        _, bad = split_valid(staged.drop("_seq"))
        write_quarantine(bad, errors_path, **partition)
        if unknown is not None and historical_path:
            schema = "year int, old_course_code string, institution_id string, import_timestamp timestamp_ntz, reconciled boolean"
            known = (spark.read.parquet(historical_path) if table_exists(spark, historical_path)
                     else spark.createDataFrame([], schema))
            upsert.append_historical_codes(known, unknown).write.mode("append").parquet(historical_path)
    finally:
        upsert._delete_path(spark, path)
    return summary


def run_candidate_import(spark: SparkSession, paths, target_path: str, errors_path: str,
                         opts: ImportOptions, mapping=None, refs: References | None = None,
                         historical_path: str | None = None) -> DataFrame:
    """Import candidate CSV files into the table at ``target_path``, laid out
    by year and key bucket; bad rows go to ``errors_path``, in a partition of this
    load (``load_id``) that a retry replaces; unknown course codes to
    ``historical_path``. Returns the one-row import summary. With
    ``opts.validate_only`` nothing is written. A load whose files lack the
    REGNUMBER column fails before anything is written."""
    if opts.year is None and not opts.validate_only:
        raise ValueError("a candidate import needs ImportOptions.year (year is NOT NULL)")
    from . import upsert
    scratch: list[str] = []
    try:
        raw = read_candidate_csv(spark, paths, mapping, scratch)
        checked = clean_candidates(map_columns(raw, mapping), opts, state_names=refs is not None and refs.state is not None)
        if opts.validate_only:
            summary = import_summary(checked)
            return spark.createDataFrame(summary.collect(), summary.schema)
        load_id = opts.load_id
        if load_id is None:
            import hashlib
            files = sorted(spark.read.text(paths).inputFiles())
            load_id = hashlib.sha256("\n".join([*files, str(opts.year)]).encode()).hexdigest()[:16]
        return load_checked(spark, checked, target_path, errors_path, opts, {"load_id": load_id}, refs, historical_path)
    finally:
        for path in scratch:
            upsert._delete_path(spark, path)
