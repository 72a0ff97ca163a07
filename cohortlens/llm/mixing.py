"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Words of a block.
BLOCK_WORDS = 256
#: Slots or documents that a task orders at once.
CHUNK = 1 << 14
#: Points are the multiples of an odd number near golden ratio * RING, modulo RING.
RING = 1 << 31
STEP = 1327217885


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def _running(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each one, by
    ``order`` within ``keys``. ``chunk`` ascends with ``order``: a window
    holds one chunk's rows, a second one a key's chunk totals."""
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_own"))
    sums = sums.withColumn("_sum", F.coalesce(F.sum("_own").over(before), F.lit(0))).drop("_own")
    here = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_here", F.sum(value).over(here) - value).join(sums, [*keys, chunk])
    return df.withColumn(out, F.col("_here") + F.col("_sum")).drop("_here", "_sum")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(key, source_size, target, lo, hi) per source of ``sizes`` (key, size).

    Keys in code-point order get the weights in turn. Targets share the size
    of all by weight; one above ``limit`` times its source's size stops
    there, and the excess is shared again until none is above. lo..hi is the
    source's part of [0, 1). Ranks and sums run over ranges of keys, so the
    number of sources is not bounded by a task."""
    s = sizes.groupBy("key").agg(F.sum("size").alias("source_size")).repartitionByRange("key")
    s = stored(s.withColumn("part", F.spark_partition_id()), "sources")
    s = _running(s, [], "part", ["key"], F.lit(1), "rank")
    s = stored(s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "weights")
    total, free = s.agg(F.sum("source_size"), F.sum("weight")).first()
    total, share, capped = total or 0, (total or 0) / (free or 1), 0
    over = lambda: F.col("weight") * F.lit(float(share)) > limit * F.col("source_size")
    while True:
        n, full, free = s.agg(F.count_if(over()), F.sum(F.when(over(), limit * F.col("source_size"))), F.sum(F.when(~over(), F.col("weight")))).first()
        if n == capped or not free:
            break
        share, capped = (total - full) / free, n
    s = s.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), (limit * F.col("source_size")).cast("double")))
    s = _running(s, [], "part", ["key"], F.col("target"), "before")
    part = F.lit(float(total or 1))
    return s.select("key", "source_size", "target", (F.col("before") / part).alias("lo"), ((F.col("before") + F.col("target")) / part).alias("hi"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, key, rank, words): which source's next block fills each slot.

    Slot i belongs to the source whose part of [0, 1) holds the i-th golden
    ratio point, and its rank among that source's slots is the block that it
    takes. Blocks beyond a target are not taken; the few that the points
    leave short follow as a tail. A source's last block is cut at its target."""
    spark = targets.sparkSession
    need = F.ceil(F.round("target") / block_words).cast("long")
    n_sources, total = targets.agg(F.count("*"), F.sum("target")).first()
    cells = 1024 + n_sources
    parts = targets.withColumn("need", need).where("need > 0")
    by_cell = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    n_slots = -(-int(round(total or 0)) // block_words)
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"), ((F.col("id") % RING) * STEP % RING / float(RING)).alias("x"))
    placed = slots.withColumn("cell", F.floor(F.col("x") * cells)).join(by_cell, "cell").where("x >= lo and x < hi")
    placed = _running(placed.select("slot", "chunk", "key", "need", "target"), ["key"], "chunk", ["slot"], F.lit(1), "rank")
    placed = stored(placed.select("slot", "key", "rank", "need", "target"), "slots")
    got = placed.groupBy("key").agg(F.count("*").alias("n"))
    tail = parts.join(got, "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < need").select(
        "key", "need", "target", F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("rank"))
    tail = tail.select((F.col("rank") + n_slots).alias("slot"), "key", "rank", "need", "target")
    words = F.least(F.lit(block_words), F.round("target").cast("long") - F.col("rank") * block_words)
    return placed.where("rank < need").union(tail).select("slot", "key", "rank", words.alias("words"))


def _streams(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, key, mark, size, start): documents in a shuffled order that
    depends on id and text only, with their first word's place in the source."""
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"),
                       F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("key"),  # "t": null comes last
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark"), word_count(F.col(text_col)).alias("size"))
    rows = stored(rows, "sizes")
    n = rows.count()
    chunks = max(1, -(-n // CHUNK))
    place = F.shiftrightunsigned("mark", 33)
    rows = rows.withColumn("chunk", F.shiftright(place * chunks, 31)).withColumn("place", F.shiftrightunsigned("mark", 1))
    return stored(_running(rows, ["key"], "chunk", ["place", "id", "size"], F.col("size"), "start").drop("chunk", "place"), "streams")


def mix_spans(streams: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, key, rank, start, from_word, to_word): the words of the document
    at ``start`` of its source's stream that a slot takes. A stream ends where
    it began: a block beyond its end goes on at its first word."""
    at = schedule(targets, block_words).join(targets.select("key", "source_size"), "key").withColumn("p", F.col("rank") * block_words)
    size = F.col("source_size")
    at = at.withColumn("turn", F.explode(F.sequence(F.expr("p div source_size"), F.expr("(p + words - 1) div source_size"))))
    at = at.select("slot", "key", "rank", F.greatest(F.col("p") - F.col("turn") * size, F.lit(0)).alias("p"),
                   F.least(F.col("p") + F.col("words") - F.col("turn") * size, size).alias("q"))
    at = at.withColumn("cell", F.explode(F.sequence(F.expr(f"p div {block_words}"), F.expr(f"(q - 1) div {block_words}"))))
    own = streams.where("size > 0").select("key", "start", "size", F.explode(F.sequence(
        F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("cell"))
    first = F.greatest("p", "start", F.col("cell") * block_words)
    last = F.least("q", F.col("start") + F.col("size"), (F.col("cell") + 1) * block_words)
    both = at.join(own, ["key", "cell"]).select("slot", "key", "rank", "start", (first - F.col("start")).alias("from_word"), (last - F.col("start")).alias("to_word"))
    return both.where("from_word < to_word")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, block_words: int = BLOCK_WORDS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How much of every document a mix takes: ``id_col``, source, mark (hash
    of id and text), size, source_size, target, taken (words, repeats counted).

    A source's documents, shuffled by a hash, make a stream of words cut into
    equal blocks; slots of a low-discrepancy schedule take a source's blocks
    in turn, and start again at the stream's end. A source gives its target's
    words, so no document more than ``limit`` times its size. The same rows
    give the same mix in any partitioning.

    Null text: size 0, nothing taken. Null sources are one source, the last.
    Null ids and repeated rows stay (equal rows share places in any order);
    other columns are ignored; an empty table gives an empty result."""
    streams = _streams(docs, id_col, text_col, source_col)
    targets = stored(source_targets(streams, weights, limit), "targets")
    taken = mix_spans(streams, targets, block_words).groupBy("key", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    rows = streams.join(targets.select("key", "source_size", "target"), "key").join(taken, ["key", "start"], "left")
    return rows.select(F.col("id").alias(id_col), "source", "mark", "size", "source_size", "target",
                       F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))
