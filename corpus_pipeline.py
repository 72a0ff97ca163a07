"""The corpus pipeline: documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet to the shared checkpoint folder and reads again for the
next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm import language_id
from cohortlens.llm.bpe import encode_digests
from cohortlens.llm.common import discard, stored, table
from cohortlens.llm.line_dedup import line_dedup
from cohortlens.llm.mixing import mix
from cohortlens.llm.registry import TOKENIZER
from cohortlens.llm.simhash import simhash_groups


# Stages hold a document's columns in one struct beside their own, so that no
# column of the table can clash with theirs, and write short lists of rows
# before they join them: Spark then knows their size, and broadcasts them.

def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def _whole(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _hash(docs: DataFrame) -> Column:
    """A hash of a whole row: equal rows fare alike in every stage."""
    return F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in docs.columns])


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with the columns of ``docs``.

    The likelihoods are fitted on all of them. A document without letters is
    kept if its label or source tell a language, else dropped; null labels or
    sources are no evidence; equal rows fare alike and stay as often; an
    empty table gives an empty one; texts count whole; equal scores go to the
    first language by name."""
    mark = lambda lang: F.xxhash64(F.col("doc_id"), _text("text"), lang, _text("source"))
    own = docs.select("doc_id", "text", "lang", "source")
    evidence = language_id.document_evidence(own)
    names, likelihoods = language_id.fit_likelihoods(own.select(F.col("doc_id").alias("id"), "text", language_id.primary_tag(F.col("lang")).alias("language")))
    found = language_id.identify(evidence.withColumn("mark", F.xxhash64("doc_id", "text", "declared", "host")), names, likelihoods)
    rejected = stored(found.where(~F.col("accepted")).select("mark").distinct(), "rejected")
    rows = docs.select(_whole(docs), mark(language_id.primary_tag(F.col("lang"))).alias("mark"))
    return rows.join(rejected, "mark", "left_anti").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate in their source, with
    the columns of ``docs``; n_chars follows a changed text. Null texts and
    texts of a null source stay as they are, as in ``line_dedup``."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col("source"), F.col("text"))
    out = line_dedup(rows, "source", "text")
    size = F.when(F.col("dropped_lines") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, with the columns of ``docs``: the
    one of the smallest id (with an id, if any has one; then by a hash of the
    row). Of equal rows one stays. Null and empty texts are one group. An
    empty table gives an empty one; texts count whole."""
    own = docs.select("doc_id", "text", _hash(docs).alias("mark"))
    groups = stored(simhash_groups(own, shingle=4, radius=4, mark=F.col("mark")).select("doc_id", "group", "mark"), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))["mark"].alias("first"))
    marks = groups.groupBy("group", "mark").agg(F.count("*").alias("n")).join(first, "group")
    dropped = stored(marks.where("mark != first").select("mark"), "dropped")
    twice = stored(marks.where("mark = first and n > 1").select("mark"), "twice")
    rows = docs.select(_whole(docs), _hash(docs).alias("mark")).join(dropped, "mark", "left_anti")
    if twice.isEmpty():
        return rows.select("row.*")
    again = rows.join(twice, "mark", "left_semi").dropDuplicates(["mark"])
    return rows.join(twice, "mark", "left_anti").unionByName(again).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the columns of ``docs``.

    A source's stream of words is taken from its start as far as its target,
    in turns, so all of its documents are taken whole but the one where the
    target ends: that one comes once more with the words up to there (its
    text and n_chars cut), so that every source gives its target's words and
    none is lost. Documents without words are not taken. Null sources are one
    source; equal rows share what is taken of them; an empty table gives an
    empty one."""
    taken = mix(docs.select("doc_id", "text", "source")).groupBy("mark", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("key")).agg(
        F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("n")).where("size > 0 and taken > 0")
    rows = docs.select(_whole(docs), F.xxhash64("doc_id", "text").alias("mark"), F.coalesce(F.concat(F.lit("s"), _text("source")), F.lit("t")).alias("key"))
    both = rows.join(taken, ["mark", "key"])
    one = both.where("n = 1").withColumn("i", F.lit(0))
    # Equal rows (all of one id and text) are told apart only to share their turns.
    equal = both.where("n > 1").withColumn("i", F.row_number().over(Window.partitionBy("mark", "key").orderBy("mark")) - 1)
    both = one.unionByName(equal) if taken.where("n > 1").limit(1).count() else one
    turns = F.expr("taken div size div n") + (F.col("i") < F.expr("taken div size % n")).cast("long")
    rest = F.when(F.col("i") == 0, F.col("taken") % F.col("size")).otherwise(0)
    turn = F.explode(F.concat(F.array_repeat(F.lit(0), turns.cast("int")), F.when(rest > 0, F.array(rest.cast("int"))).otherwise(F.array().cast("array<int>"))))
    out = both.select("row", turn.alias("words"))
    runs = F.regexp_extract_all(F.col("row.text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(F.col("words") == 0, F.col("row.text")).otherwise(F.array_join(F.slice(runs, F.lit(1), F.greatest("words", F.lit(1))), ""))
    out = out.withColumn("text", text)
    size = F.when(F.col("words") == 0, F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    return out.select(*[F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each document's ids and decoded text
    (see ``bpe_encode``); other columns are left out."""
    return encode_digests(docs.select("doc_id", "text"), TOKENIZER)


STAGES = [("language ID", languages), ("line dedup", lines), ("SimHash near-dedup", near_duplicates),
          ("mixing sources", mixed), ("BPE encoding", tokens)]

#: The stages' models and chains of links are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        last, docs = docs, stored(stage(spark, docs, sf_dir), "stage")
        if i:
            discard(last)
    return docs
