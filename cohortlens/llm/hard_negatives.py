"""Hard negatives by a vertical scan of columns (BOND)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import frugal, pack, unpack
from .common import discard, shuffle_width, stored

#: Rows of a block of candidates, and anchors of a block; a task compares two blocks at a time.
ROWS, ANCHORS = 2048, 4096
#: Blocks of candidates that one task reads in turn for a block of anchors, carrying the best so far.
RUN = 4
#: Dimensions read between two cuts of the candidate bitmap.
STRIDE = 8
#: Components become floor(SCALE * x).
SCALE = 256
#: Positives of an anchor, negatives of a positive, and their window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90

_LEAST = np.iinfo(np.int64).min


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, all components finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def prepared(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """(id, label, x) of the rows that take part: labels moved on by one mod
    ``labels`` where the id is divisible by ``every``, components as whole
    numbers. Rows that are the same in all three count once."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    # floor() ends at the ends of a long; _fits refuses products of such.
    whole = F.transform(x, lambda v: F.floor(v * SCALE).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("id"), moved.alias("label"), whole.alias("x")).distinct()


def _columns(batch: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    """The vectors of a batch, one dimension a row of the result; shorter ones end in zeros."""
    lists = batch.column("x")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((width, len(lengths)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = lists.flatten().to_numpy()
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def column_blocks(rows: DataFrame, size: int, width: int, name: str) -> DataFrame:
    """``rows`` (id, label, x) in (``name``, n, ids, labels, columns) rows of about
    ``size`` vectors, stored dimension by dimension. Blocks are a power of
    two, so that some more rows don't deal all anew."""
    blocks = 1 << (max(1, -(-rows.count() // size)) - 1).bit_length()
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks)).cast("int"))

    def to_columns(key, table):
        table = table.sort_by([("label", "ascending"), ("id", "ascending")])
        numbers = [pack(table.column(c).to_numpy()) for c in ("id", "label")]
        return pa.table({name: pa.array([key[0].as_py()], pa.int32()), "n": pa.array([table.num_rows], pa.int32()), "ids": pa.array([numbers[0]], pa.binary()), "labels": pa.array([numbers[1]], pa.binary()),
                         "columns": pa.array([[pack(_narrow(c)) for c in _columns(table, width)]], pa.list_(pa.binary()))})

    return stored(dealt.groupBy(name).applyInArrow(to_columns, f"{name} int, n int, ids binary, labels binary, columns array<binary>"), "columns")


def _pairs(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of anchors with every block of rows: the anchors' side is
    copied to each run of ``RUN`` row blocks, the rows' side to each anchor
    block; they meet by an equi-join on (a, run). A task has its runs in
    order."""
    a_blocks, b_blocks = (d.agg(F.max(c)).first()[0] or 0 for d, c in ((anchors, "a"), (rows, "b")))
    tasks = shuffle_width(rows.sparkSession)
    left = anchors.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(b_blocks // RUN)))).withColumnsRenamed({c: f"anchor_{c}" for c in ("ids", "labels", "columns")})
    right = rows.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a_blocks)))).withColumn("run", F.floor(F.col("b") / RUN).cast("int"))
    left, right = left.drop("n"), right.drop("n")
    both = left.repartition(tasks, "a", "run").join(right.repartition(tasks, "a", "run"), ["a", "run"])
    return both.sortWithinPartitions("a", "run", "b")


class Block:
    """A block of candidates, dimension by dimension."""

    def __init__(self, ids: bytes, labels: bytes, columns: list[bytes]):
        self.ids, self.labels = unpack(ids)[0], unpack(labels)[0]
        self.x = np.array([unpack(c)[0] for c in columns], np.int64).reshape(len(columns), len(self.ids))
        self.low, self.high = self.x.min(axis=1), self.x.max(axis=1)
        self.most = np.maximum(np.abs(self.low.astype(float)), np.abs(self.high.astype(float)))


class Windows:
    """The best ``k`` rows so far in each of an anchor's score windows
    [low, high], equal scores by smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = [np.zeros(0, np.int64)] * len(low)
        self.id = [np.zeros(0, np.int64)] * len(low)

    def floor(self) -> np.ndarray:
        """Scores that a row must reach to matter to each window."""
        kth = np.array([s[-1] if len(s) == self.k else _LEAST for s in self.score], np.int64)
        return np.maximum(self.low, kth)

    def take(self, score: np.ndarray, ids: np.ndarray) -> None:
        for j, (low, high) in enumerate(zip(self.floor(), self.high)):
            own = (score >= low) & (score <= high)
            if own.any():
                s, i = np.concatenate([self.score[j], score[own]]), np.concatenate([self.id[j], ids[own]])
                order = np.lexsort((i, -s))[:self.k]
                self.score[j], self.id[j] = s[order], i[order]


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, windows: Windows) -> int:
    """Read the block's columns in the order of the anchor's magnitudes and
    put what is in a window to it; returns the components read.

    ``alive`` is the bitmap of candidates. After some dimensions a row's score
    lies between its partial sum plus the least and plus the most that the
    unread dimensions can add, which the columns' minima and maxima bound. A
    row whose range meets no window above what the window holds already is
    cleared; so is one below the k-th best lower bound of rows that are sure
    to end in the window. What is left at the end has exact scores."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    order = order[anchor[order] != 0]
    a = anchor[order]
    least = np.minimum(a * block.low[order], a * block.high[order])
    most = np.maximum(a * block.low[order], a * block.high[order])
    # What is unread after the first i dimensions adds this much, at least and at most.
    least, most = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (least, most))
    rows = np.flatnonzero(alive)
    partial = np.zeros(len(rows), np.int64)
    floor, ceiling, read = windows.floor(), windows.high, 0
    for at in range(0, len(order), STRIDE):
        if not len(rows):
            return read
        dims = order[at:at + STRIDE]
        read += len(dims) * len(rows)
        partial = partial + a[at:at + STRIDE] @ (block.x[dims] if len(rows) == block.x.shape[1] else block.x[np.ix_(dims, rows)])
        done = min(at + STRIDE, len(order))
        low, high = partial + least[done], partial + most[done]
        fine = np.zeros(len(rows), bool)
        for j in range(len(floor)):
            within = (high >= floor[j]) & (low <= ceiling[j])
            if done < len(order):
                sure = low[within & (low >= floor[j]) & (high <= ceiling[j])]
                if len(sure) >= windows.k:
                    floor[j] = np.partition(sure, -windows.k)[-windows.k]
                    within &= high >= floor[j]
            fine |= within
        if not fine.all():
            rows, partial = rows[fine], partial[fine]
    windows.take(partial, block.ids[rows])
    return read


def _fits(anchor: np.ndarray, block: Block) -> None:
    if np.abs(anchor.astype(float)) @ block.most >= 2.0 ** 62:
        raise OverflowError("an inner product of these vectors may not fit a long")


def _search(k: int, positives: bool):
    """Pairs of blocks in runs to the best ``k`` rows of every window of a run:
    (a, at, nth, score, id), ``at`` being the anchor's place in its block.
    For positives there is one window, of all scores, and rows of the
    anchor's label count; else windows come with the anchors' block."""

    def start(batch, i, n) -> list[Windows]:
        if positives:
            return [Windows(np.array([_LEAST]), np.array([np.iinfo(np.int64).max]), k) for _ in range(n)]
        ends, low, high = unpack(batch.column("windows")[i].as_py())
        return [Windows(low[x:y], high[x:y], k) for x, y in zip(ends[:-1], ends[1:])]

    def results(a: int, ids: np.ndarray, windows: list[Windows]) -> pa.RecordBatch:
        parts = [(i, j, w.score[j], w.id[j]) for i, w in enumerate(windows) for j in range(len(w.low)) if len(w.score[j])]
        sizes = [len(p[2]) for p in parts]
        at, nth = (np.repeat(np.array([p[c] for p in parts], np.int32), sizes) for c in (0, 1))
        score, own = (np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)]) for c in (2, 3))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), a, np.int32)), pa.array(at), pa.array(ids[at]), pa.array(nth), pa.array(score), pa.array(own)],
                                          names=["a", "at", "anchor_id", "nth", "score", "id"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]):
        now, ids, labels, x, windows = None, None, None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("a")[i].as_py(), batch.column("run")[i].as_py()
                if key != now:
                    if now is not None:
                        yield results(now[0], ids, windows)
                    ids, labels = (unpack(batch.column(f"anchor_{c}")[i].as_py())[0] for c in ("ids", "labels"))
                    x = np.array([unpack(c)[0] for c in batch.column("anchor_columns")[i].as_py()], np.int64).reshape(-1, len(ids))
                    now, windows = key, start(batch, i, len(ids))
                block = Block(*(batch.column(c)[i].as_py() for c in ("ids", "labels", "columns")))
                for n, w in enumerate(windows):
                    if not (w.low <= w.high).any():
                        continue
                    _fits(x[:, n], block)
                    alive = (block.labels == labels[n]) == positives
                    if positives:
                        # The anchor itself is no positive of its own; another row of its id is.
                        for own in np.flatnonzero(alive & (block.ids == ids[n])):
                            alive[own] = (block.x[:, own] != x[:, n]).any()
                    scan(block, x[:, n], alive, w)
        if now is not None:
            yield results(now[0], ids, windows)

    return run


_FOUND = "a int, at int, anchor_id long, nth int, score long, id long"


def _ranked(found: DataFrame, k: int, *window: str) -> DataFrame:
    """The first ``k`` of all runs, with their rank."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*window).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _window_blocks(positives: DataFrame, anchors: DataFrame, low: int, high: int) -> DataFrame:
    """``anchors`` with the score windows that their positives set."""

    def to_windows(key, table):
        table = table.sort_by([("at", "ascending"), ("rank", "ascending")])
        at, scores = table.column("at").to_numpy(), table.column("score").to_pylist()
        size = int(table.column("n")[0].as_py())
        ends = np.searchsorted(at, np.arange(size + 1)).astype(np.int64)
        least, most = (np.array(x, np.int64) for x in ([-(-low * s // 100) for s in scores], [high * s // 100 for s in scores]))
        return pa.table({"_a": pa.array([key[0].as_py()], pa.int32()), "windows": pa.array([pack(ends, least, most)], pa.binary())})

    sizes = anchors.select(F.col("a").alias("_b"), "n")
    windows = positives.join(sizes, F.col("a") == F.col("_b")).groupBy("a").applyInArrow(to_windows, "_a int, windows binary")
    return anchors.join(windows, F.col("a") == F.col("_a")).drop("_a", "n")


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the rows (id, label, x: array<long>) that ``anchors``
    picks: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    An anchor's positives are its first ``positives`` other rows of its
    label by inner product. For each, the first ``negatives`` rows of other
    labels with low * positive <= 100 * score <= high * positive. Higher
    scores come first, ties by smaller id. Blocks of anchors and blocks of
    rows meet in tasks, twice: for the positives, then for the windows that
    these set. A task reads a run of row blocks column by column (``scan``)
    and returns its best of each window, so a hot label or many equal scores
    never make more than k rows per (window, run).

    Equal rows count once; rows of one id that differ are rows each. Empty
    vectors and those shorter than others count as followed by zeros. A
    window of a negative score is empty. No anchors, or an empty table: an
    empty result. Scores must fit a long, else the job fails; nothing is
    rounded."""
    rows = stored(rows.select("id", "label", "x").distinct(), "rows")
    width = max(1, rows.agg(F.max(F.size("x"))).first()[0] or 0)
    blocks = column_blocks(rows, ROWS, width, "b")
    own = column_blocks(rows.where(anchors), ANCHORS, width, "a")
    discard(rows)
    best = _ranked(_pairs(own, blocks).mapInArrow(_search(positives, True), _FOUND), positives, "a", "at")
    best = stored(best.select("a", "at", "anchor_id", "rank", "score", "id"), "positives")
    found = _pairs(_window_blocks(best, own, low, high), blocks).mapInArrow(_search(negatives, False), _FOUND)
    found = _ranked(found, negatives, "a", "at", "nth").select("a", "at", (F.col("nth") + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    given = best.select("a", "at", F.col("rank").alias("nth"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(given, ["a", "at", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def embedding_negatives(vectors: DataFrame) -> DataFrame:
    """Hard negatives in ``embeddings`` (vec_id, embedding, label) for the rows
    whose vec_id is divisible by 100, after ``prepared``."""
    return hard_negatives(prepared(vectors), F.col("id") % 100 == 0)


ORACLE = f"""
with r as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, cast(list_dot_product(a.q, r.q) as bigint) as score
  from r a join r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES})
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as int) as rank,
       s.id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 100 * s.score between {LOW} * p.positive_score and {HIGH} * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) <= {NEGATIVES}
"""
