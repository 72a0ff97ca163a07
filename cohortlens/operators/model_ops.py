"""Data-model operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.exprs import count_if, round_avg
from ..sources.tables import CO_PARTITIONED, Tables
from .asof import asof_join, normal_periods

STAR_DIMS = ["state", "lga", "course", "faculty", "institution", "institution_type"]


# N6 -------------------------------------------------------------------------
def candidate_star(t: Tables, dims=STAR_DIMS, cand_cols=None) -> DataFrame:
    """Candidate with its documented dimensions joined on canonical keys
    (left joins, so no candidate is lost to a missing dimension row)."""
    cand_cols = cand_cols or ["regnumber", "surname", "gender", "statecode", "lg_id",
                              "aggregate", "year", "is_admitted", "app_course1", "inid"]
    df = t.candidate(*cand_cols)
    if "state" in dims:
        df = df.join(t.state.select("st_id", "st_name"), F.col("statecode") == F.col("st_id"), "left").drop("st_id")
    if "lga" in dims:
        df = df.join(t.lga.select(F.col("lg_id").alias("_lg"), "lg_name"),
                     F.col("lg_id") == F.col("_lg"), "left").drop("_lg")
    if "course" in dims:
        df = df.join(t.course.select("course_code", "course_name", "facid"),
                     F.col("app_course1") == F.col("course_code"), "left").drop("course_code")
    if "faculty" in dims:
        df = df.join(t.faculty.select("fac_id", "fac_name"), F.col("facid") == F.col("fac_id"), "left").drop("fac_id")
    if "institution" in dims:
        df = df.join(t.institution.select(F.col("inid").alias("_inid"), "inname", "intyp"),
                     F.col("inid") == F.col("_inid"), "left").drop("_inid")
    if "institution_type" in dims:
        df = df.join(t.institution_type.select("intyp_id", "intyp_desc"),
                     F.col("intyp") == F.col("intyp_id"), "left").drop("intyp_id")
    if "disabilities" in dims:
        df = df.join(t.candidate_disabilities.select(F.col("cand_reg_number").alias("_cd"), "is_blind", "is_deaf", "other_challenges"),
                     F.col("regnumber") == F.col("_cd"), "left").drop("_cd")
    if "scores" in dims:
        # One row per subject score; a candidate without scores keeps one row.
        scores = t.candidate_scores.join(t.subject, F.col("subject_id") == F.col("su_id"), "left").select(
            F.col("cand_reg_number").alias("_cs"), F.col("year").alias("score_year"), "su_name", "score")
        df = df.join(scores, F.col("regnumber") == F.col("_cs"), "left").drop("_cs")
    return df


# N7 -------------------------------------------------------------------------
def scores_of(t: Tables, regnumber, year) -> DataFrame:
    """One candidate's subject scores in a year (a value, or a scalar subquery)."""
    s = t.candidate_scores.where((F.col("cand_reg_number") == F.lit(regnumber)) & (F.col("year") == year))
    return s.join(t.subject, F.col("subject_id") == F.col("su_id")).select("su_name", "score")


def filter_state(df: DataFrame, name: str, col: str = "st_name") -> DataFrame:
    return df.where(F.upper(F.col(col)) == name.upper())


def filter_course(df: DataFrame, names=None, like: str | None = None, col: str = "course_name") -> DataFrame:
    cond = F.lit(False)
    if names:
        cond = cond | F.col(col).isin(*names)
    if like:
        cond = cond | F.lower(F.col(col)).like(like.lower())
    return df.where(cond)


def count_by(df: DataFrame, dim: str, **filters) -> DataFrame:
    """COUNT(*) per ``dim`` after equality filters."""
    for k, v in filters.items():
        df = df.where(F.col(k) == F.lit(v))
    return df.groupBy(dim).agg(F.count(F.lit(1)).alias("count"))


# D1 -------------------------------------------------------------------------
def candidate_profiles(t: Tables) -> DataFrame:
    """Nested profile per candidate: state, LGA, disabilities and exam
    structs and the sorted list of subject scores, as JSON. Scores are grouped
    per candidate first (a candidate has few scores), then joined by key."""
    scores = (t.candidate_scores.join(t.subject, F.col("subject_id") == F.col("su_id"))
              .groupBy("cand_reg_number")
              .agg(F.sort_array(F.collect_list(F.struct("subject_id", "year", "su_name", "score")))
                   .alias("scores")))
    c = (t.candidate("regnumber", "surname", "gender", "aggregate", "year", "statecode", "lg_id")
         .join(t.state.select("st_id", "st_name"), F.col("statecode") == F.col("st_id"), "left")
         .join(t.lga.select(F.col("lg_id").alias("_lg"), "lg_name"), F.col("lg_id") == F.col("_lg"), "left")
         .join(scores, F.col("regnumber") == F.col("cand_reg_number"), "left").drop("cand_reg_number"))
    for name, cols in (("candidate_disabilities", ["is_blind", "is_deaf", "other_challenges"]),
                       ("candidate_exam_info", ["exam_town", "exam_centre", "exam_number", "mock_state_id", "is_mock_candidate"])):
        own = t.table(name).select(F.col("cand_reg_number").alias("_k"), F.struct(*cols).alias(name))
        c = c.join(own, F.col("regnumber") == F.col("_k"), "left").drop("_k")
    prof = F.struct(
        "regnumber", "surname", "gender", "aggregate", "year",
        F.struct(F.col("statecode").alias("st_id"), "st_name").alias("state"),
        F.struct("lg_id", "lg_name").alias("lga"),
        F.coalesce("scores", F.array().cast("array<struct<subject_id:int,year:int,su_name:string,score:int>>"))
        .alias("scores"), F.col("candidate_disabilities").alias("disabilities"), F.col("candidate_exam_info").alias("exam_info"))
    # Null fields are kept so every profile has the same keys.
    return c.select("regnumber", F.to_json(prof, {"ignoreNullFields": "false"}).alias("profile"))


def institution_profiles(institution: DataFrame, names: DataFrame) -> DataFrame:
    """Institution with its sorted list of name periods, as JSON. Names are
    grouped per institution first (a handful of renames each)."""
    hist = (names.groupBy(F.col("inid").alias("_inid"))
            .agg(F.sort_array(F.collect_list(F.struct("effective_from", "effective_to", "inabv", "inname")))
                 .alias("names")))
    j = institution.join(hist, F.col("inid") == F.col("_inid"), "left")
    prof = F.struct("inid", "inabv", "inname", F.coalesce("names", F.array().cast(
        "array<struct<effective_from:date,effective_to:date,inabv:string,inname:string>>")).alias("names"))
    return j.select("inid", F.to_json(prof, {"ignoreNullFields": "false"}).alias("profile"))


# D2 -------------------------------------------------------------------------
def institution_name_asof(df: DataFrame, date_col: str, names: DataFrame,
                          inst_col: str = "inid") -> DataFrame:
    """Name of the institution valid on ``date_col`` (name_asof, abv_asof):
    effective_from <= d < effective_to, open end when effective_to is NULL.
    Overlapping periods are cut and merged first (``asof.normal_periods``),
    so every row stays once."""
    periods = normal_periods(names, ["inid"], "effective_from", "effective_to", ["inname", "inabv"])
    return asof_join(df, periods, [(inst_col, "inid")], F.col(date_col), "effective_from", "effective_to", {"inname": "name_asof", "inabv": "abv_asof"})


def institution_name_view(institution: DataFrame, names: DataFrame) -> DataFrame:
    """Current and historical names side by side: one row per name period
    of each institution, with the institution's current name next to it."""
    i = institution.select("inid", F.col("inabv").alias("current_abv"),
                           F.col("inname").alias("current_name"))
    h = names.select(F.col("inid").alias("_inid"), F.col("inabv").alias("historical_abv"),
                     F.col("inname").alias("historical_name"), "effective_from", "effective_to",
                     "change_reason")
    return i.join(h, F.col("inid") == F.col("_inid")).drop("_inid")


def institution_name_history(t: Tables, change_year_base: int = 1995) -> DataFrame:
    """Name history per institution (fixture): the name before the change
    year carries an '(old)' suffix; the current name has an open end."""
    i = t.institution
    change = F.make_date(F.lit(change_year_base) + (F.col("inid") % 7).cast("int"), F.lit(1), F.lit(1))
    old = i.select("inid", F.lit("1900-01-01").cast("date").alias("effective_from"),
                   change.alias("effective_to"), F.concat("inname", F.lit(" (old)")).alias("inname"),
                   F.concat("inabv", F.lit("-OLD")).alias("inabv"), F.lit("renamed").alias("change_reason"))
    cur = i.select("inid", change.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"),
                   "inname", "inabv", F.lit(None).cast("string").alias("change_reason"))
    return old.unionByName(cur)


def overlapping_name_history(t: Tables) -> DataFrame:
    """Name history whose periods overlap and touch (fixture): the old name
    runs on into the current one, every third institution has an interim name
    inside, every fourth the current name in two touching periods."""
    plain = institution_name_history(t)
    late = F.date_add("effective_to", 400)
    out = plain.withColumn("effective_to", F.when(F.col("effective_to").isNotNull(), late))
    interim = t.institution.where(F.col("inid") % 3 == 0).select(
        "inid", F.lit("1997-06-01").cast("date").alias("effective_from"), F.lit("1998-06-01").cast("date").alias("effective_to"),
        F.concat("inname", F.lit(" (interim)")).alias("inname"), F.concat("inabv", F.lit("-INT")).alias("inabv"), F.lit("merger").alias("change_reason"))
    again = plain.where(F.col("effective_to").isNull() & (F.col("inid") % 4 == 0)).withColumn("effective_from", F.lit("2001-01-01").cast("date"))
    return out.unionByName(interim).unionByName(again)


# D4 -------------------------------------------------------------------------
def _long_scores(wide: DataFrame, mapping: DataFrame, id_cols, code_cols) -> DataFrame:
    code_cols = code_cols or [c for c in wide.columns if c not in id_cols]
    long = wide.unpivot(list(id_cols), list(code_cols), "csv_code", "score").where(F.col("score").isNotNull())
    m = mapping.select(F.col("csv_code").alias("_code"), F.col("su_id").alias("subject_id"), "position")
    return long.join(m, F.col("csv_code") == F.col("_code"), "left").drop("_code")


def unpivot_scores(wide: DataFrame, mapping: DataFrame, id_cols=("cand_reg_number", "year"),
                   code_cols=None) -> DataFrame:
    """Wide rows (one score column per CSV subject code) -> (ids, subject_id,
    position, score) rows; NULL scores are skipped. ``position`` is the
    subject's place in the file (of the mapping). ``code_cols`` are the score
    columns (the file's header). Codes without a mapping: ``unmapped_scores``."""
    return _long_scores(wide, mapping, id_cols, code_cols).where(F.col("subject_id").isNotNull()).select(
        *id_cols, "subject_id", "position", "score")


def unmapped_scores(wide: DataFrame, mapping: DataFrame, id_cols=("cand_reg_number", "year"),
                    code_cols=None) -> DataFrame:
    """Scores whose code has no mapping, for the quarantine: (ids, csv_code,
    score, error_message)."""
    return _long_scores(wide, mapping, id_cols, code_cols).where(F.col("subject_id").isNull()).select(
        *id_cols, "csv_code", "score", F.concat(F.lit("unknown subject code: "), F.col("csv_code")).alias("error_message"))


# D5 -------------------------------------------------------------------------
def check_constraints(t: Tables, tables=None) -> DataFrame:
    """(table, rule, violations) for primary keys, foreign keys, NOT NULL
    and VARCHAR lengths.

    A table is read once: a row gives one entry for its key, one for every
    reference, and, if it breaks NOT NULL or length rules, one that says
    which, as bits. One grouped sum of all tables' entries by (key domain,
    value) then shows keys that stand twice and references without a key;
    hot values collapse before the shuffle. The facts' own keys, and their
    references to candidates, are grouped and joined by the registration
    number itself: without an exchange where they are stored in its buckets."""
    want = [n for n in schemas.PRIMARY_KEYS if not tables or n in tables]
    frames = {n: t.candidate() if n == "candidate" else t.table(n) for n in want}
    links = [(child, col, parent, pcol) for child, col, parent, pcol in schemas.FOREIGN_KEYS
             if child in want and parent in want and col in frames[child].columns]
    by_number = [x for x in links if CO_PARTITIONED.get(x[0]) == x[1] and CO_PARTITIONED.get(x[2]) == x[3]]
    grouped = [x for x in links if x not in by_number]
    keys = [(n, tuple(schemas.PRIMARY_KEYS[n])) for n in want if n not in CO_PARTITIONED]
    domains = {key: i for i, key in enumerate(dict.fromkeys([*keys, *((p, (c,)) for _, _, p, c in grouped)]))}

    def part(name, cols):
        """Only some columns, so that a projected table joins less."""
        return t.candidate(*cols) if name == "candidate" else frames[name].select(*cols)

    def value(cols):
        if len(cols) == 1:
            return F.col(cols[0]).cast("string")
        each = [F.col(c).cast("string") for c in cols]
        return F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in each])

    def entry(domain, v, slot):
        return F.struct(F.lit(domain).alias("domain"), v.alias("value"), F.lit(slot).alias("slot"))

    rules, entries, parts, slots = [], [], [], {}
    for i, name in enumerate(want):
        pk, df = schemas.PRIMARY_KEYS[name], frames[name]
        own, used = [], []
        for (table, cols), domain in domains.items():
            if table == name:
                own.append(entry(domain, value(cols), 0))
                used += cols
                if cols == tuple(pk):
                    rules.append((name, f"pk({','.join(pk)})", domain, 0))
        for child, col, parent, pcol in grouped:
            if child == name:
                domain = domains[parent, (pcol,)]
                slots[domain] = slots.get(domain, 0) + 1
                own.append(F.when(F.col(col).isNotNull(), entry(domain, F.col(col).cast("string"), slots[domain])))
                used.append(col)
                rules.append((name, f"fk({col}->{parent}.{pcol})", domain, slots[domain]))
        broken = [(f"not_null({c})", c, F.col(c).isNull()) for c in schemas.NOT_NULL.get(name, []) if c in df.columns]
        broken += [(f"length({c})<={n}", c, F.length(F.col(c).cast("string")) > n)
                   for c, n in schemas.VARCHAR_LIMITS.get(name, {}).items() if c in df.columns]
        if broken:
            bits = functools.reduce(Column.__add__, [F.when(e, F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, (_, _, e) in enumerate(broken)])
            own.append(F.when(bits != 0, entry(len(domains) + i, bits.cast("string"), 0)))
            used += [c for _, c, _ in broken]
            rules += [(name, rule, len(domains) + i, -1 - j) for j, (rule, _, _) in enumerate(broken)]
        if own:
            entries.append(part(name, list(dict.fromkeys(used))).select(F.explode(F.array(*own)).alias("e")).where("e is not null").select("e.*"))
        if name in CO_PARTITIONED:
            parts.append(_by_number(name, pk, CO_PARTITIONED[name], [x for x in by_number if x[0] == name],
                                    lambda name, cols: t.dealt(name, part(name, cols))))
    most = max(slots.values(), default=0)
    counts = _union_all(entries).groupBy("domain", "value").agg(
        *[F.count(F.when(F.col("slot") == s, 1)).alias(f"n{s}") for s in range(most + 1)])
    bits = F.when(F.col("domain") >= len(domains), F.col("value").cast("long"))
    # A few rows a domain: repeats of keys, rows with these bits, references without a key.
    sums = counts.groupBy("domain", bits.alias("bits")).agg(
        F.sum("n0").alias("rows"), F.sum(F.greatest(F.col("n0") - 1, F.lit(0))).alias("r0"),
        *[F.sum(F.when(F.col("n0") == 0, F.col(f"n{s}"))).alias(f"r{s}") for s in range(1, most + 1)])
    found = F.when(F.col("slot") < 0, F.when(F.expr("shiftright(bits, -1 - slot) & 1") == 1, F.col("rows")))
    for s in range(most + 1):
        found = found.when(F.col("slot") == s, F.col(f"r{s}"))
    rules = t.spark.createDataFrame(rules, "`table` string, rule string, domain int, slot int")
    parts.append(rules.join(sums, "domain", "left").groupBy("table", "rule").agg(F.coalesce(F.sum(found), F.lit(0)).alias("violations")))
    return _union_all(parts)


def _by_number(name, pk, key, links, part) -> DataFrame:
    """The primary key of a fact and its references by registration number."""
    df = part(name, pk).groupBy(*pk).agg(F.count(F.lit(1)).alias("_n")).select(F.col(key).alias("_key"), "_n", (F.col("_n") - 1).alias("_more"))
    if list(pk) != [key]:
        df = df.groupBy("_key").agg(F.sum("_n").alias("_n"), F.sum("_more").alias("_more"))
    found = [(f"pk({','.join(pk)})", F.sum("_more"))]
    for j, (_, col, parent, pcol) in enumerate(links):
        owners = part(parent, [pcol]).where(F.col(pcol).isNotNull()).groupBy(F.col(pcol).alias(f"_p{j}")).agg(F.lit(True).alias(f"_has{j}"))
        mine, theirs = F.col("_key"), F.col(f"_p{j}")
        if df.schema["_key"].dataType != owners.schema[f"_p{j}"].dataType:
            mine, theirs = mine.cast("string"), theirs.cast("string")
        df = df.join(owners, mine == theirs, "left")
        found.append((f"fk({col}->{parent}.{pcol})", F.sum(F.when(F.col("_key").isNotNull() & F.col(f"_has{j}").isNull(), F.col("_n")))))
    each = df.agg(*[F.coalesce(e, F.lit(0)).alias(f"v{i}") for i, (_, e) in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations")) for i, (rule, _) in enumerate(found)])
    return each.select(F.lit(name).alias("table"), F.explode(rows).alias("r")).select("table", "r.rule", "r.violations")


def _union_all(parts: list[DataFrame]) -> DataFrame:
    """Union in pairs: a plan of small depth, analysed once per level."""
    while len(parts) > 1:
        parts = [a.union(b[0]) if (b := parts[i + 1:i + 2]) else a for i, a in enumerate(parts) if i % 2 == 0]
    return parts[0]


# S5 / D6 --------------------------------------------------------------------
def parse_regions(documents: DataFrame) -> DataFrame:
    """JSON objects {region: [state, ...]} (column value) -> (region,
    st_name), with the state-name aliases applied so spellings meet the state
    table."""
    from .resolve import clean_state_name
    pairs = documents.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("region", "states"))
    return pairs.select("region", F.explode("states").alias("st_name")).select("region", clean_state_name(F.col("st_name")).alias("st_name"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """The region file, one JSON object in all -> (region, st_name)."""
    return parse_regions(spark.read.text(path, wholetext=True))


UNASSIGNED = "unassigned"


def region_summary(t: Tables, regions: DataFrame) -> DataFrame:
    """Candidates and average aggregate per (region, state), with region
    subtotals and a grand total (ROLLUP). ``level``: state, region or total.

    Every candidate counts: one without a known state, or whose state is in
    no region, is in 'unassigned'. Candidates are pre-aggregated per state
    code before the joins."""
    per_code = (t.candidate("statecode", "aggregate").groupBy("statecode")
                .agg(F.count(F.lit(1)).alias("_n"), F.sum("aggregate").alias("_s"),
                     F.count("aggregate").alias("_c")))
    of = regions.groupBy(F.col("st_name").alias("_st")).agg(F.min("region").alias("region"))
    j = (per_code.join(t.state.select("st_id", "st_name"), F.col("statecode") == F.col("st_id"), "left")
         .join(of, F.col("st_name") == F.col("_st"), "left")
         .select(F.coalesce("region", F.lit(UNASSIGNED)).alias("region"),
                 F.coalesce("st_name", F.lit(UNASSIGNED)).alias("st_name"), "_n", "_s", "_c"))
    agg = j.rollup("region", "st_name").agg(
        F.grouping_id().alias("_g"), F.sum("_n").alias("candidates"), F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    level = F.when(F.col("_g") == 0, "state").when(F.col("_g") == 1, "region").otherwise("total")
    return agg.select("region", "st_name", level.alias("level"), "candidates", round_avg("_s", "_c").alias("avg_score"))


# D7 -------------------------------------------------------------------------
def disability_stats(df: DataFrame, by=("year", "statecode")) -> DataFrame:
    """Blind / deaf / other-challenge counts per group."""
    if "other_challenges" not in df.columns:
        df = df.withColumn("other_challenges", F.lit(None).cast("string"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidates"),
        count_if(F.col("is_blind")).alias("blind"),
        count_if(F.col("is_deaf")).alias("deaf"),
        count_if(F.col("other_challenges").isNotNull()).alias("other_challenges"))
