"""Candidate search by an index of character trigrams.

The index is written with the table: postings (gram, field, regnumber, year)
in folders by the gram's hash. A search reads the folders of its own grams
only, keeps the candidates that have all of them, and verifies the predicate
of ``reports.search_candidates`` on these; candidates are found in their
years, so the other years' files are not opened.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables
from . import reports

GRAM, FOLDERS = 3, 64
NUMBER, SURNAME = 0, 1
FOLDER = "gram_folder"


def _folder(gram):
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def postings(t: Tables) -> DataFrame:
    """One row per candidate, field and distinct trigram of it."""
    def grams(text):
        last = F.length(text) - GRAM + 1
        return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: text.substr(i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))
    c = t.candidate("regnumber", "surname", "year")
    fields = F.concat(F.transform(F.coalesce(grams(F.col("regnumber").cast("string")), F.array()), lambda g: F.struct(F.lit(NUMBER).alias("field"), g.alias("gram"))),
                      F.transform(F.coalesce(grams(F.lower("surname")), F.array()), lambda g: F.struct(F.lit(SURNAME).alias("field"), g.alias("gram"))))
    return c.select("regnumber", "year", F.explode(fields).alias("x")).select("x.*", "regnumber", "year")


def write_index(t: Tables, path: str, mode: str = "overwrite") -> None:
    """Write the index of the candidates of ``t``; again after every load."""
    rows = postings(t).withColumn(FOLDER, _folder(F.col("gram")))
    (rows.hint("rebalance", FOLDER).sortWithinPartitions(FOLDER, "field", "gram")
     .write.mode(mode).partitionBy(FOLDER).parquet(path))


def term_grams(term: str) -> list[str]:
    """Trigrams that every match of LIKE '%term%' has: those of the runs
    between its wildcards (an escaped character ends a run, too)."""
    runs = re.split(r"\\.|[%_]", term, flags=re.S)
    return sorted({run[i:i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def search_candidates(spark: SparkSession, t: Tables, index_path: str, term: str, limit: int = 10) -> DataFrame:
    """The rows of ``reports.search_candidates``, by the index. A term without
    three characters in a row has no gram, and is looked for by the scan."""
    wanted = {NUMBER: term_grams(term), SURNAME: term_grams(term.lower())}
    if not all(wanted.values()):
        return reports.search_candidates(t, term, limit)
    index = spark.read.parquet(index_path)
    folders = [r[0] for r in spark.createDataFrame([(g,) for gs in wanted.values() for g in gs], "g string").select(_folder(F.col("g"))).distinct().collect()]
    mine = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("gram").isin(gs) for f, gs in wanted.items()])
    hits = index.where(F.col(FOLDER).isin(folders) & mine).groupBy("regnumber", "year", "field").agg(F.count(F.lit(1)).alias("n"))
    need = F.when(F.col("field") == NUMBER, len(wanted[NUMBER])).otherwise(len(wanted[SURNAME]))
    hits = hits.where(F.col("n") == need).select("regnumber", "year").distinct()
    return reports.search_candidates(t, term, limit, among=hits)
