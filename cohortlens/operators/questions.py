"""Bulk analytics over question and reply text columns.

The keyword and category tables are data (schemas.py); classification is a
CASE chain, matching is a set of equi-joins over distinct texts. No per-row
Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.exprs import trim_all
from . import theta


# N1 -------------------------------------------------------------------------
def intent_expr(col: Column, rules=schemas.INTENT_RULES, default=schemas.INTENT_DEFAULT) -> Column:
    q = F.lower(col)
    expr = None
    for intent, words in rules:
        cond = None
        for w in words:
            c = q.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(intent)) if expr is None else expr.when(cond, F.lit(intent))
    return expr.otherwise(F.lit(default))


def classify_intent(df: DataFrame, col: str = "question") -> DataFrame:
    return df.withColumn("intent", intent_expr(F.col(col)))


# N2 -------------------------------------------------------------------------
def year_expr(col: Column, years=schemas.QUESTION_YEARS, default=schemas.QUESTION_YEAR_DEFAULT) -> Column:
    q = F.lower(col)
    expr = None
    for y in years:
        expr = F.when(q.contains(y), F.lit(y)) if expr is None else expr.when(q.contains(y), F.lit(y))
    return expr.otherwise(F.lit(default))


def extract_year(df: DataFrame, col: str = "question") -> DataFrame:
    return df.withColumn("year", year_expr(F.col(col)))


# S4 -------------------------------------------------------------------------
def course_names(df: DataFrame, col: str = "course_name") -> DataFrame:
    """Distinct course names keyed by lower(name): trimmed, blanks skipped;
    one spelling per key (the greatest, a fixed choice)."""
    n = df.select(trim_all(F.col(col)).alias("name")).where(F.col("name") != "")
    return n.groupBy(F.lower("name").alias("key")).agg(F.max("name").alias("name"))


def read_course_names(spark: SparkSession, path: str) -> DataFrame:
    """Line-per-name text file -> (key, name)."""
    return course_names(spark.read.text(path), "value")


# N3 -------------------------------------------------------------------------
def _contains_any(col: Column, terms: list[str]) -> Column:
    cond = F.lit(False)
    for t in terms:
        cond = cond | col.contains(t)
    return cond


def _category_table(categories) -> Column:
    """The keyword table as one constant, so that plans and generated code don't grow with it."""
    return F.array(*[F.struct(F.lit(cat).alias("category"), F.array(*map(F.lit, kws)).alias("words")) for cat, kws in categories])


def first_category(q: Column, categories=schemas.COURSE_CATEGORIES) -> Column:
    """First category (declaration order) with a keyword in ``q``, or NULL."""
    return F.get(F.filter(_category_table(categories), lambda c: F.exists(c["words"], lambda w: F.contains(q, w))), F.lit(0))["category"]


def name_categories(key: Column, categories=schemas.COURSE_CATEGORIES) -> Column:
    """Array of the categories whose name or a keyword ``key`` contains."""
    named = [(cat, [cat, *kws]) for cat, kws in categories]
    return F.transform(F.filter(_category_table(named), lambda c: F.exists(c["words"], lambda w: F.contains(key, w))), lambda c: c["category"])


def match_courses(questions: DataFrame, names: DataFrame, id_col: str = "question_id",
                  col: str = "question") -> DataFrame:
    """SQL LIKE patterns for the courses a question mentions.

    (a) every course whose lower-cased name occurs in the question;
    (b) plus, for the first category (declaration order) with a keyword in
        the question, every course whose name contains the category name or
        one of its keywords;
    (c) only when (a)+(b) found nothing: courses containing a question word
        of at least 3 bytes;
    (d) only when still nothing and the question says course/program: the
        literal fallback pattern.
    ``names`` is (key, name) from ``course_names``, one row a key. Distinct
    question texts are cut into keys once: grams of ``theta``, the first
    category, and one of their own. These meet the names' anchors and
    categories in one join; where the results of a question come together,
    those left without any go on with their words, which meet the names'
    grams in a second one. Every predicate is verified.
    Output: (question_id, pattern, stage) with unique patterns per question.
    """
    rows = questions.select(F.col(id_col).alias("qid"), F.lower(F.col(col)).alias("q")).where(F.col("q").isNotNull())
    q = rows.select("q").distinct()
    nm = names.select("key", "name").where(F.length("key") > 0)
    own, category = F.lit("\x00"), lambda c: F.concat(F.lit("\x00"), c)

    # (a), (b): one anchor per name, and its categories.
    known = theta.anchors(nm.select(F.col("key").alias("_p"), "name"))
    keys = F.concat(F.array("_g"), F.transform(name_categories(F.col("_p")), category))
    known = known.select("_p", "name", F.posexplode(keys).alias("_i", "_k"))
    asked = q.select("q", F.explode(F.array_compact(F.concat(theta.text_keys(F.col("q")), F.array(category(first_category(F.col("q"))), own)))).alias("_k"))
    met = asked.join(known, "_k", "left").where((F.col("_k") == own) | (F.col("_i") > 0) | F.contains(F.col("q"), F.col("_p")))
    met = met.select("q", "name", F.when(F.col("_k") == own, "q").when(F.col("_i") > 0, "b").otherwise("a").alias("stage"))
    met = met.withColumn("_first", F.min("stage").over(Window.partitionBy("q")))

    # What a row goes on with: a name found, or, of a question without any, its words and the fallback.
    item = lambda name, word, stage: F.struct(name.alias("name"), word.alias("w"), F.lit(stage).alias("stage"))
    nothing = F.lit(None).cast("string")
    words = F.filter(F.array_distinct(F.split(trim_all(F.col("q")), r"\s+")), lambda w: F.octet_length(w) >= schemas.COURSE_WORD_MIN_BYTES)
    fallback = F.when(_contains_any(F.col("q"), schemas.COURSE_FALLBACK_WORDS), F.array(item(nothing, nothing, "d"))).otherwise(F.array().cast("array<struct<name:string,w:string,stage:string>>"))
    found = F.array(F.struct(F.col("name").alias("name"), nothing.alias("w"), F.col("stage").alias("stage")))
    todo = F.when(F.col("stage") != "q", found).when(F.col("_first") == "q", F.concat(F.transform(words, lambda w: item(nothing, w, "c")), fallback))
    todo = met.select("q", F.explode(todo).alias("x")).select("q", "x.*")

    # (c): a word meets the names that have its first gram.
    of_names = nm.select("key", F.col("name").alias("_hit"), F.explode(theta.text_keys(F.col("key"))).alias("_k"))
    todo = todo.withColumn("_k", F.substring("w", 1, theta.GRAM))
    todo = todo.join(of_names, "_k", "left").where(F.col("w").isNull() | F.contains(F.col("key"), F.col("w")))
    pattern = F.when(F.col("stage") == "d", schemas.COURSE_FALLBACK_PATTERN).otherwise(F.concat(F.lit("'%"), F.coalesce("name", "_hit"), F.lit("%'")))
    first = F.min("stage").over(Window.partitionBy("q"))
    found = todo.select("q", pattern.alias("pattern"), "stage", first.alias("_first")).where((F.col("stage") != "d") | (F.col("_first") == "d")) \
        .groupBy("q", "pattern").agg(F.min("stage").alias("stage"))
    return rows.join(found, "q").select(F.col("qid").alias(id_col), "pattern", "stage").groupBy(id_col, "pattern").agg(
        F.min("stage").alias("stage"))


# N4 -------------------------------------------------------------------------
# RE2 semantics written for Java: '.' excludes only '\n', '$' is end of text.
SQL_IN_TEXT = r"(?i)SELECT\s+[^\n]*?(?:;|\z)"


def clean_reply(col: Column) -> Column:
    s = col
    for m in schemas.REPLY_STRIP_MARKERS:
        s = F.replace(s, F.lit(m), F.lit(""))
    return trim_all(s)


def clean_sql(col: Column) -> Column:
    """Literal backslash-n -> space; whitespace runs collapsed; trimmed."""
    s = F.replace(col, F.lit("\\n"), F.lit(" "))
    return trim_all(F.regexp_replace(s, r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def _field(reply: Column, name: str) -> tuple[Column, Column]:
    """(text, is of another type) of a JSON object's field; keys are matched
    ignoring case, the last one counts, and null is no value."""
    keys = F.filter(F.json_object_keys(reply), lambda k: F.lower(k) == name)
    values = F.transform(keys, lambda k: F.element_at(F.from_json(reply, "map<string,variant>"), k))
    kinds = F.transform(values, lambda v: F.schema_of_variant(v))
    texts = F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    text = F.try_element_at(texts, F.lit(-1))
    return text, F.exists(kinds, lambda k: ~k.isin("STRING", "VOID"))


def extract_sql(df: DataFrame, col: str = "reply") -> DataFrame:
    """Adds sql_query, thought_process and error for each model reply.

    A reply that is one JSON object (nothing behind it) whose ``sql_query``
    (any case of the key) is text or null yields that; empty, null or
    missing -> error, no fallback. Any other reply -- text, JSON followed by
    text, a sql_query of another type -- yields the first SELECT ... ; (or to
    the end) found in it; none -> error."""
    r = clean_reply(F.col(col))
    # Spark's parser stops at the end of the first value; in brackets, text
    # behind it is an error or a second element.
    only = F.try_parse_json(F.concat(F.lit("["), r, F.lit("]")))
    one = F.try_variant_get(only, "$[1]", "variant").isNull() & only.isNotNull() & F.try_parse_json(r).isNotNull()
    rows = df.select("*", r.alias("_r"), F.coalesce(one & F.json_object_keys(r).isNotNull(), F.lit(False)).alias("_one"))
    text, other = _field(F.when(F.col("_one"), F.col("_r")), "sql_query")
    thought, odd = _field(F.when(F.col("_one"), F.col("_r")), "thought_process")
    rows = rows.select("*", text.alias("_js"), (F.col("_one") & ~F.coalesce(other, F.lit(False))).alias("_obj"),
                       F.when(~F.coalesce(odd, F.lit(False)), thought).alias("_thought"))
    found = F.regexp_extract("_r", SQL_IN_TEXT, 0)
    has = F.coalesce("_js", F.lit("")) != ""
    raw_sql = F.when(F.col("_obj"), F.when(has, F.col("_js"))).otherwise(F.when(found != "", found))
    err = (F.when(F.col("_obj") & ~has, F.lit("no SQL query found in response"))
           .when(~F.col("_obj") & (found == ""), F.lit("failed to extract SQL query")))
    return rows.select(*df.columns, clean_sql(raw_sql).alias("sql_query"), F.col("_thought").alias("thought_process"), err.alias("error"))
