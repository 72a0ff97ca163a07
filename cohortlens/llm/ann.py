"""Approximate nearest neighbours with a forest of random-projection trees."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import frugal
from .common import stored

#: Rows that trees are fitted on (those of the smallest id hashes), trees, and sample rows of a leaf.
SAMPLE, TREES, LEAF = 16_384, 8, 64
#: Distinct vectors that the leaves of a query hold, one counted once a tree, as a share of all rows.
SEARCH = 1.5
#: Distinct vectors of a leaf that a task scores at once; a larger leaf is dealt to several.
PART = 4096


@dataclass
class Tree:
    """Inner node i sends x to left[i] if x . normal[i] < offset[i], else to
    right[i]; a negative child -1 - k is leaf k."""

    normal: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        at = np.zeros(len(rows), np.int64) if len(self.left) else np.full(len(rows), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[inner]):
                own = inner[at[inner] == node]
                at[own] = np.where(rows[own] @ self.normal[node] < self.offset[node], self.left[node], self.right[node])
        return -1 - at


def grow(sample: np.ndarray, leaf: int, seed: int) -> Tree:
    """A tree whose nodes halve the sample between two random rows of theirs:
    the split is at right angles to their difference, at the median."""
    rng = np.random.default_rng(seed)
    normal, offset, children, leaves = [], [], [], 0
    todo = [(np.arange(len(sample)), None, 0)]
    while todo:
        own, parent, side = todo.pop()
        direction = None
        for _ in range(4 if len(own) > leaf else 0):
            a, b = sample[rng.choice(own, 2, replace=False)]
            if (norm := np.linalg.norm(b - a)) > 0:
                direction = (b - a) / norm
                height = sample[own] @ direction
                middle = float(np.median(height))
                below = height < middle
                if below.any() and not below.all():
                    break
                direction = None
        if direction is None:
            name, leaves = -1 - leaves, leaves + 1
        else:
            name = len(normal)
            normal.append(direction)
            offset.append(middle)
            children.append([0, 0])
            todo += [(own[below], name, 0), (own[~below], name, 1)]
        if parent is not None:
            children[parent][side] = name
    kids = np.array(children, np.int64).reshape(-1, 2)
    return Tree(np.array(normal).reshape(-1, sample.shape[1]), np.array(offset), kids[:, 0], kids[:, 1], leaves)


def visit(margins: list[np.ndarray], forest: list[Tree], sizes: list[np.ndarray], search: int) -> list[tuple[int, int]]:
    """Leaves in the order of one queue that all trees share: a node waits with
    the least margin on its path, by which the query lies on its side."""
    queue = [(-np.inf, t, 0 if len(forest[t].left) else -1) for t in range(len(forest))]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < search:
        lead, t, node = heapq.heappop(queue)
        if node < 0:
            if sizes[t][-1 - node]:
                out.append((t, -1 - node))
                held += int(sizes[t][-1 - node])
            continue
        m, tree = margins[t][node], forest[t]
        heapq.heappush(queue, (max(lead, m), t, int(tree.left[node])))
        heapq.heappush(queue, (max(lead, -m), t, int(tree.right[node])))
    return out


def usable(vector: Column) -> Column:
    """Not null, of finite components, and not zero."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit_forest(rows: DataFrame, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF) -> tuple[list[Tree], float]:
    """(trees, greatest norm) of rows (id, x). Only the bounded sample comes to the driver.

    For the largest inner product, every row gets one more component that
    brings it to the greatest norm; a query, stretched to that norm, gets 0
    there: the nearest rows are then those of the largest product."""
    top = rows.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))).first()[0] or 0.0
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not some:
        return [], top
    points = lifted(np.array([r.x for r in some]), top)
    return [grow(points, leaf, seed) for seed in range(trees)], top


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))])


_DDL = "tree int, leaf int, part int, kind int, cid long, ids array<long>, x array<double>"
_NAMES = ["tree", "leaf", "part", "kind", "cid", "ids", "x"]


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _batch(tree, leaf, part, kind, cids, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(np.broadcast_to(v, len(cids)).astype(np.int32)) for v in (tree, leaf, part, kind)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(cids, pa.int64()), ids, _lists(x)], names=_NAMES)


def classes_of(rows: DataFrame, n: int) -> DataFrame:
    """(cid, ids, x): the distinct vectors of rows (id, x), each with its ``n``
    smallest ids. Each batch names n ids of a vector at most, so one that
    fills a third of all rows never brings them all to one task."""

    @frugal
    def smallest(batches):
        for b in batches:
            if b.num_rows:
                x, ids = np.ascontiguousarray(_matrix(b.column("x"))), b.column("id").to_numpy()
                _, first, own = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
                order = np.lexsort((ids, own))
                starts = np.searchsorted(own[order], np.arange(len(first)))
                keep = order[np.arange(len(order)) - starts[own[order]] < n]
                ends = np.concatenate([[0], np.cumsum(np.bincount(own[keep], minlength=len(first)))])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[keep])), _lists(x[first])], names=["ids", "x"])

    some = rows.select("id", "x").mapInArrow(smallest, "ids array<long>, x array<double>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, n)
    return stored(some.groupBy("x").agg(ids.alias("ids")).select(F.monotonically_increasing_id().alias("cid"), "ids", "x"), "classes")


def forest_search(rows: DataFrame, every: int = 20, k: int = 20, search: float = SEARCH, sample: int = SAMPLE, trees: int = TREES,
                  leaf: int = LEAF, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, ``id_col``, score: the ``k`` rows of largest inner
    product found for each query (ids divisible by ``every``) among all other
    rows, ties to the smaller id.

    Equal vectors are one class: trees are fitted on a bounded sample of the
    classes, then index each class once. The class of a query goes down all
    trees with one priority queue until its leaves hold, in classes, ``search``
    times the number of rows; the candidates in them are scored exactly, in double
    precision, on the original vectors. A class stands for its k + 1 smallest
    ids (ties go to them, and the query may be one). A leaf of many classes
    (near copies) is dealt to several tasks by a hash of the class.

    Rows with null ids, null, zero or non-finite vectors, or another length
    than the most frequent one take no part. Rows that repeat an id and
    vector are one candidate; of an id with several vectors the best counts.
    Other columns are ignored; an empty table gives an empty result."""
    spark = rows.sparkSession
    good = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + F.lit(0.0)).alias("x")).distinct()
    length = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = stored(good.where(F.size("x") == (length.n if length else 0)), "vectors")
    classes = classes_of(good, k + 1)
    forest, top = fit_forest(classes.select(F.col("ids")[0].alias("id"), "x"), sample, trees, leaf)

    @frugal
    def index(batches):
        for b in batches:
            if b.num_rows:
                x, cids = _matrix(b.column("x")), b.column("cid").to_numpy()
                points = lifted(x, top)
                for t, tree in enumerate(forest):
                    yield _batch(t, tree.leaf(points), 0, 0, cids, b.column("ids"), x)

    indexed = stored(classes.mapInArrow(index, _DDL), "index")
    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in indexed.groupBy("tree", "leaf").count().collect():  # at most trees * sample rows
        sizes[r.tree][r.leaf] = r["count"]
    enough = search * good.count()
    parts = spark.createDataFrame([(t, i, int(-(-n // PART))) for t, s in enumerate(sizes) for i, n in enumerate(s.tolist()) if n > PART],
                                  "tree int, leaf int, parts int")

    @frugal
    def route(batches):
        for b in batches:
            cids, x = b.column("cid").to_numpy(), _matrix(b.column("x"))
            for start in range(0, len(cids), 256):
                own = x[start:start + 256]
                reach = top / np.sqrt((own * own).sum(axis=1, keepdims=True))
                margins = [np.column_stack([own * reach, np.zeros(len(own))]) @ t.normal.T - t.offset for t in forest]
                for i in range(len(own)):
                    found = np.array(visit([m[i] for m in margins], forest, sizes, enough), np.int64).reshape(-1, 2)
                    if len(found):
                        yield _batch(found[:, 0], found[:, 1], 0, 1, np.full(len(found), cids[start + i]), pa.nulls(len(found), pa.list_(pa.int64())), np.tile(own[i], (len(found), 1)))

    # Queries of equal vectors are asked once, as their class.
    queries = good.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "x")
    queries = stored(queries.join(classes.select("cid", "x"), "x").select("query_id", "cid"), "queries")
    asked = classes.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "x").mapInArrow(route, _DDL)
    dealt = indexed.join(parts, ["tree", "leaf"], "left").withColumn("part", F.when(
        F.col("parts").isNotNull(), F.pmod(F.xxhash64("cid"), F.col("parts"))).otherwise(0).cast("int")).select(*_NAMES)
    spread = asked.join(parts, ["tree", "leaf"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).select(*_NAMES)

    @frugal
    def score(batches):
        """Members of a leaf's part come first, then its queries, in blocks."""
        key, ids, held = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("tree", "leaf", "part", "kind")], 1)
            cids, x = b.column("cid").to_numpy(), _matrix(b.column("x"))
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if keys[i, :3].tolist() != key:
                    key, ids, held = keys[i, :3].tolist(), [], []
                if keys[i, 3] == 0:
                    ids += b.column("ids").slice(i, j - i).to_pylist()
                    held.append(x[i:j])
                elif ids:
                    held = [np.concatenate(held)]
                    # Columns of the part's ids, in order; of an id with several vectors the best one counts.
                    every_id, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(c) for c in ids])
                    order = np.argsort(every_id, kind="stable")
                    owner, (one, first) = owner[order], np.unique(every_id[order], return_index=True)
                    step = max(1, min(512, (2 << 20) // len(owner)))
                    for at in range(i, j, step):
                        q, some = cids[at:min(j, at + step)], (x[at:min(j, at + step)] @ held[0].T)[:, owner]
                        if len(one) < len(owner):
                            some = np.maximum.reduceat(some, first, axis=1)
                        n = min(k + 1, len(one))
                        best = np.argsort(-some, axis=1, kind="stable")[:, :n]  # ties to the smaller id
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, n)), pa.array(one[best].ravel()), pa.array(np.take_along_axis(some, best, 1).ravel())],
                                                         names=["cid", "id", "score"])

    both = dealt.union(spread).repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part", "kind")
    first_by = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))
    found = both.mapInArrow(score, "cid long, id long, score double").groupBy("cid", "id").agg(F.max("score").alias("score"))
    found = found.withColumn("_place", first_by("cid")).where(F.col("_place") <= k + 1).drop("_place")
    # Each query of a class, without itself.
    found = queries.join(found, "cid").where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", first_by("query_id")).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")
