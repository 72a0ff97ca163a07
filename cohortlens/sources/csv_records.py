"""CSV records of split text files.

A quoted value may hold line breaks, so where a record ends depends on all
text before it, while files are read in splits. Every line is therefore a
function of one bit (is a quote open at its start?); the functions of a
split's lines compose to that of the split, a running composition over the
splits of a file (one row each) gives the bit at the start of every split,
and records are then cut exactly, the same for any split size.

Lines are split at line feeds; a carriage return before one is not part of
the line. A quote opens a value only at its start; text after a closing
quote, or a quote inside an unquoted value, ends the record as a bad one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

PLACE = ["_path", "_block", "_pos"]      # file, block start, row within it: the load order

# A value without line breaks of its own; what stands in an open quote; possessive, so that nothing is tried twice.
_VALUE = r'(?:[^",]++|"[^"]*+(?:""[^"]*+)*+")?+'
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_WHOLE = rf"\A{_VALUE}(?:,{_VALUE})*+\z"
_OPENS = rf'\A(?:{_VALUE},)*+"{_INSIDE}\z'
_STAYS = rf"\A{_INSIDE}\z"
_REOPENS = rf'\A{_INSIDE}"(?:,{_VALUE}(?=,|\z))*+,"{_INSIDE}\z'


def text_lines(reader, paths) -> DataFrame:
    """Lines of text files with their file and split: _line, _path, _block.
    ``reader``: spark.read or spark.readStream."""
    return reader.option("lineSep", "\n").text(paths).select(
        F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with their place in the split and, by the bit before them, the
    bit after them (_t0, _t1: after a line that starts outside, inside)."""
    line = F.regexp_replace("_line", r"\r\z", "")
    lines = lines.withColumn("_line", F.when(F.endswith(F.col("_line"), F.lit("\r")), line).otherwise(F.col("_line"))).withColumn("_pos", F.monotonically_increasing_id())
    quoted = F.contains(F.col("_line"), F.lit('"'))
    return lines.select("_line", *PLACE, F.when(~quoted, False).otherwise(F.col("_line").rlike(_OPENS)).alias("_t0"),
                        F.when(~quoted, True).otherwise(F.col("_line").rlike(_STAYS) | F.col("_line").rlike(_REOPENS)).alias("_t1"))


def _bit_before(start: Column, t0: Column, t1: Column, window) -> Column:
    """Running composition: the bit before each row of the window, given the
    bit before its first. A function of one bit is constant, the identity or
    a flip, so the last constant and the flips since then tell."""
    flip = F.when(t0 & ~t1, 1).otherwise(0)
    flips = F.sum(flip).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    set_to = F.when(t0 == t1, F.struct(t0.cast("int").alias("bit"), flips.alias("flips")))
    last = F.last(set_to, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return (F.coalesce(last["bit"], start.cast("int")) + flips - flip - F.coalesce(last["flips"], F.lit(0))) % 2 == 1


def splits(lines: DataFrame) -> DataFrame:
    """One row per split of placed lines, in one pass over them: _path,
    _block, _start (is a quote open at its start?), _end, _carry (the split
    where a record that is open at its start began), _cut (whether lines
    join into records there), _lost (the split where the record began that
    the file's end leaves open, else null), _head, _head_pos (the file's first
    line that is not blank, in its first split), _head_id (of the file).

    A split's lines are all in one task, so only its summary is shuffled: the
    last line that sets the bit, and the places of lines that flip it (those
    that open a value), which a value with a line break has one of."""
    t0, t1 = F.col("_t0"), F.col("_t1")
    per = lines.groupBy("_path", "_block").agg(F.max(F.when(t0 == t1, F.struct("_pos", "_t0"))).alias("_set"), F.collect_list(F.when(t0 & ~t1, F.col("_pos"))).alias("_flips"),
                                              F.bool_or(t0).alias("_opens"), F.bool_or(~t1).alias("_closes"),
                                              F.min(F.when((F.col("_block") == 0) & (F.trim("_line") != ""), F.struct("_pos", "_line"))).alias("_first"))
    flips = F.size(F.filter("_flips", lambda x: x > F.coalesce(F.col("_set._pos"), F.lit(-1))))
    after = lambda bit: (F.coalesce(F.col("_set._t0"), F.lit(bit)).cast("int") + flips) % 2 == 1
    per = per.select("_path", "_block", "_opens", "_closes", F.col("_first._line").alias("_head"), F.col("_first._pos").alias("_head_pos"),
                     after(False).alias("_end0"), after(True).alias("_end1"))
    # A file has a row per split here: few, whatever its size.
    order = Window.partitionBy("_path").orderBy("_block")
    per = per.withColumn("_start", _bit_before(F.lit(False), F.col("_end0"), F.col("_end1"), order))
    per = per.withColumn("_end", F.when(F.col("_start"), F.col("_end1")).otherwise(F.col("_end0")))
    # From inside, only a line that ends there can be before one where a record begins.
    began = F.when(F.col("_end") & (~F.col("_start") | F.col("_closes")), F.col("_block"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_carry", F.when(F.col("_start"), F.last(began, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    lost = F.when(F.last("_end").over(whole), F.last(began, ignorenulls=True).over(whole))
    return per.select("_path", "_block", "_start", "_end", "_carry", (F.col("_start") | F.col("_opens")).alias("_cut"), lost.alias("_lost"),
                      "_head", "_head_pos", F.xxhash64(F.max("_head").over(whole)).alias("_head_id"))


def _headless(lines: DataFrame, known: DataFrame) -> DataFrame:
    return lines.join(known.drop("_head"), ["_path", "_block"]).where(F.col("_head_pos").isNull() | (F.col("_pos") != F.col("_head_pos")))


def _joined(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Records of the splits in which lines join. A record that reaches into
    later splits is the tail of the split where it began; one that the file
    leaves open is bad, and kept as its first line."""
    lines = _headless(lines, known.where("_cut"))
    order = Window.partitionBy("_path", "_block").orderBy("_pos")
    lines = lines.withColumn("_inside", _bit_before(F.col("_start"), F.col("_t0"), F.col("_t1"), order))
    lines = lines.withColumn("_nth", F.count_if(~F.col("_inside")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.col("_nth") == F.max("_nth").over(Window.partitionBy("_path", "_block"))
    tail = (F.col("_nth") == 0) | (last & F.col("_end"))
    lines = lines.withColumn("_of", F.when(F.col("_nth") == 0, F.col("_carry")).otherwise(F.col("_block"))).withColumn("_nth", F.when(tail, -1).otherwise(F.col("_nth")))
    lost = (F.col("_nth") == -1) & F.coalesce(F.col("_of") == F.col("_lost"), F.lit(False))
    lines = lines.withColumn("_open", lost).where(~(F.col("_open") & F.col("_inside")))
    whole = lines.groupBy("_path", "_of", "_nth").agg(F.sort_array(F.collect_list(F.struct("_block", "_pos", "_line"))).alias("_all"), F.bool_or("_open").alias("_open"),
                                                       F.first("_head_id").alias("_head_id"))
    return whole.select(F.array_join(F.transform("_all", lambda x: x["_line"]), "\n").alias("_line"), "_path", F.col("_all")[0]["_block"].alias("_block"),
                        F.col("_all")[0]["_pos"].alias("_pos"), "_open", "_head_id")


def values(record: Column) -> Column:
    """Values of a well-formed record; unquoted empty ones are null."""
    plain = F.transform(F.split(record, ","), lambda v: F.nullif(v, F.lit("")))
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_VALUE})"), F.lit(1))
    quoted = F.transform(raw, lambda v: F.when(F.startswith(v, F.lit('"')), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"')))
                         .otherwise(F.nullif(v, F.lit(""))))
    return F.when(F.contains(record, F.lit('"')), quoted).otherwise(plain)


def names(header: Column) -> Column:
    """Trimmed names of a header line; a byte order mark is left out."""
    return F.transform(values(F.regexp_replace(header, "^﻿", "")), lambda v: F.coalesce(F.trim(v), F.lit("")))


class Records:
    """The records of CSV files: ``rows`` (_line, _path, _block, _pos, _head_id,
    and _open: bad, because the file ends in its quote) without header lines,
    and ``heads`` (_head_id, _head, _names), the distinct header lines.
    ``scratch`` is the folder of the stored summary, one row per split, that
    both read; delete it when they are done with."""

    def __init__(self, lines: DataFrame):
        spark = lines.sparkSession
        lines = _placed(lines)
        self.scratch = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
        known = self.keep(splits(lines), "splits")
        self.heads = known.where("_head is not null").select("_head_id", "_head").distinct().withColumn("_names", names(F.col("_head")))
        named = F.filter(names(F.col("_head")), lambda n: n != "")
        odd, twice, cut = known.agg(F.min(F.when(~F.col("_head").rlike(_WHOLE), F.col("_head"))),
                                    F.min(F.when(F.size(F.array_distinct(F.transform(named, F.lower))) < F.size(named), F.col("_head"))), F.bool_or("_cut")).first()
        if odd:
            raise ValueError(f"a header line is no CSV record of its own: {odd}")
        if twice:
            raise ValueError(f"a CSV header repeats columns: {twice}")
        one = _headless(lines, known.where(~F.col("_cut"))).select("_line", *PLACE, F.lit(False).alias("_open"), "_head_id")
        # Where no split has a value with a line break, lines are read without the second branch.
        rows = one.unionByName(_joined(lines, known)) if cut else one
        self.rows = rows.where(F.col("_open") | (F.trim("_line") != ""))

    def keep(self, table: DataFrame, name: str) -> DataFrame:
        """``table`` written once to the scratch folder."""
        path = f"{self.scratch}/{name}"
        table.write.parquet(path)
        return table.sparkSession.read.schema(table.schema).parquet(path)


def broken() -> Column:
    """Whether a record of ``Records.rows`` is not well-formed."""
    return F.col("_open") | ~F.col("_line").rlike(_WHOLE)
