"""Embedding near-duplicates by an exact metric range join."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ann import _matrix, usable
from .blocks import frugal
from .common import discard, stored
from .components import connected_components
from .pitman_yor import _free

#: A cell of more vectors is split by pivots, as long as that makes it smaller ...
CELL_MAX = 2048
#: ... into so many cells at most, so many times at most ...
PIVOTS, LEVELS = 32, 4
#: ... and while all its cells together hold so many times its own vectors at most.
GROWTH = 1.5
#: Vectors of a sample that tells whether pivots make a cell smaller.
TRIAL = 512
#: Vectors of a block, and bytes of them as doubles; a task compares two blocks of a cell.
BLOCK, BLOCK_BYTES = 1 << 15, 16 << 20
#: A cell's blocks lie apart in space by so many halvings at most, fitted on so many of its vectors.
DEPTH, SAMPLE = 8, 4096
#: Directions that vectors are held against each other in first, rows and columns compared at once.
AXES, LEAF, COLUMNS = 14, 512, 2048
#: Bytes of a packed piece's vectors, and bytes that a packing task gathers.
PIECE, HELD = 2 << 20, 16 << 20
#: Rows that a job may deal, however few there are.
FEW = 1 << 20
#: Added to the radius against rounding; links are decided by cosine.
SLACK = 1e-6

_PACKED = "cell long, own int, blocks int, rows long, cids binary, n binary, home binary, x binary"


def _rows(rows: DataFrame) -> str:
    """Schema of the rows of cells; vectors keep their type until they are compared."""
    return f"cell long, cid long, n long, home boolean, x {rows.schema['x'].dataType.simpleString()}"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def _groups(batch: pa.RecordBatch, name: str):
    """(value, row numbers) per value of a column of a batch."""
    keys = batch.column(name).to_numpy()
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=np.nan if not len(keys) else keys[order[0]] - 1))
    for i, j in zip(cuts, [*cuts[1:], len(keys)]):
        yield keys[order[i]], order[i:j]


def _sides(x: np.ndarray, p: np.ndarray, radius: float):
    """(nearest pivot of every row, row, pivot): the cells that rows go to."""
    side = x @ p.T
    near = side.argmax(axis=1)
    gap = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(axis=2), 0))
    # Distance to the bisector of the nearest pivot and each other one.
    away = (side[np.arange(len(x)), near][:, None] - side) / np.maximum(gap[near], 1e-300)
    return near, *np.nonzero((away <= radius + SLACK) | (np.arange(len(p)) == near[:, None]))


def _apart(p: np.ndarray, gap: float) -> np.ndarray:
    """Pivots no two of which are nearer than ``gap``: between near ones only copies are made."""
    kept: list[int] = []
    for i in range(len(p)):
        if all(((p[i] - p[j]) ** 2).sum() > gap * gap for j in kept):
            kept.append(i)
    return p[kept]


def cell_pivots(rows: DataFrame, radius: float, level: int) -> DataFrame:
    """(cell, pivots) of the oversize cells that pivots make smaller: a sample
    of the cell tells, before anything is copied, how many comparisons are
    left, and how many copies there would be. Near copies go to every pivot's
    cell; theirs stay whole."""
    homes = rows.groupBy("cell").agg(F.count_if("home").alias("size"), F.count("*").alias("members"))
    large = stored(homes.where(F.col("size") > CELL_MAX).withColumn("k", F.least(F.lit(PIVOTS), F.ceil(F.col("size") / (CELL_MAX // 2))).cast("int")), "sizes")
    mark = F.xxhash64(F.lit(level), "cid")
    some = rows.where("home").join(large, "cell").where(F.pmod(mark, F.greatest(F.lit(1), F.floor(F.col("size") / (8 * F.col("k"))))) == 0)
    first = Window.partitionBy("cell").orderBy("_mark", "cid")
    some = some.withColumn("_mark", mark).withColumn("_i", F.row_number().over(first)).where("_i <= k")
    pivots = some.groupBy("cell").agg(F.collect_list("x").alias("pivots"))
    thin = F.greatest(F.lit(1), F.floor(F.col("members") / (2 * TRIAL)))
    trial = rows.join(large, "cell").withColumn("_mark", F.xxhash64(F.lit(~level), "cid")).where(F.pmod("_mark", thin) == 0)
    trial = trial.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= TRIAL).groupBy("cell").agg(F.collect_list("x").alias("trial"))

    @frugal
    def useful(batches):
        for b in batches:
            for i in range(b.num_rows):
                p, x = (_unit(np.array(b.column(c)[i].as_py())) for c in ("pivots", "trial"))
                p = _apart(p, 2 * radius)
                near, _, to = _sides(x, p, radius)
                # Share of the cell's comparisons (homes x members) that its new cells make.
                fewer = (np.bincount(near, minlength=len(p)) * np.bincount(to, minlength=len(p))).sum() < 0.9 * len(x) ** 2
                if fewer and len(to) / len(x) * b.column("members")[i].as_py() <= GROWTH * b.column("size")[i].as_py():
                    yield pa.RecordBatch.from_arrays([b.column("cell").slice(i, 1), pa.array([p.tolist()], pa.list_(pa.list_(pa.float64())))], names=["cell", "pivots"])

    return (pivots.join(trial, "cell").join(large, "cell").select("cell", "pivots", "trial", "size", "members")
            .mapInArrow(useful, "cell long, pivots array<array<double>>"))


def split_cells(rows: DataFrame, pivots: DataFrame, radius: float, level: int) -> DataFrame:
    """Rows of cells with pivots in the cells of these, others as they are.

    A vector's home is the cell of the nearest pivot p. It also goes, as a
    guest, to every cell of a pivot q whose bisector with p is within the
    radius: by the triangle inequality a vector within the radius of one at
    home with q is no farther than that from q's side. So every vector meets
    all vectors within the radius in its own home cell."""

    @frugal
    def assign(batches):
        for b in batches:
            for cell, own in _groups(b, "cell"):
                part = b.take(pa.array(own))
                x, p = _unit(_matrix(part.column("x"))), _matrix(pa.array(part.column("pivots")[0].as_py(), pa.list_(pa.float64())))
                home = part.column("home").to_numpy(zero_copy_only=False)
                near, row, to = _sides(x, p, radius)
                names = np.array([hash((int(cell), level, int(q))) for q in range(len(p))], np.int64)
                at = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(names[to]), at.column("cid"), at.column("n"), pa.array(home[row] & (to == near[row])), at.column("x")],
                                                 names=["cell", "cid", "n", "home", "x"])

    with_pivots = rows.join(pivots, "cell", "left")
    moved = with_pivots.where("pivots is not null").mapInArrow(assign, _rows(rows))
    return with_pivots.where("pivots is null").drop("pivots").select("cell", "cid", "n", "home", "x").union(moved)


def _marked(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the marks of a matrix that has few: looked for eight at a time."""
    flat = np.ascontiguousarray(marks).ravel()
    head = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:head].view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).ravel()
    at = np.append(at, np.arange(head, len(flat)))
    return np.divmod(at[flat[at]], marks.shape[1])


def _directions(u: np.ndarray) -> np.ndarray:
    """Directions at right angles along which vectors spread most, largest first."""
    some = u[::max(1, len(u) // 1024)]
    some = some - some.mean(axis=0)
    if u.shape[1] <= 256:
        return np.ascontiguousarray(np.linalg.eigh(some.T @ some)[1].T[::-1][:AXES])
    return np.linalg.svd(some[:256], full_matrices=False)[2][:AXES]


def _halvings(z: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) of every inner node of a tree that halves the rows ``depth`` times; a null cut where no axis does."""
    axes, cuts = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.nan)
    own = [np.arange(len(z))]
    for level in range(depth):
        below = []
        for node, rows in enumerate(own, (1 << level) - 1):
            side = np.arange(len(rows)) % 2 == 1
            for axis in np.roll(np.arange(z.shape[1]), -level) if len(rows) > 1 else ():
                high = z[rows, axis] >= (cut := np.median(z[rows, axis]))
                if 0.4 <= high.mean() <= 0.6:
                    axes[node], cuts[node], side = axis, cut, high
                    break
            below += [rows[~side], rows[side]]
        own = below
    return axes, cuts


def _block(z: np.ndarray, cids: np.ndarray, depth: int, deep: int, axes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Block of every row of a cell of several blocks."""
    mark = cids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mark ^= mark >> np.uint64(29)
    mark *= np.uint64(0xBF58476D1CE4E5B9)
    mark ^= mark >> np.uint64(32)
    node = np.zeros(len(z), np.int64)
    for level in range(depth):
        high = np.where(np.isnan(cuts[node]), (mark >> np.uint64(level)) & np.uint64(1) == 1, z[np.arange(len(z)), axes[node]] >= cuts[node])
        node = 2 * node + 1 + high
    return (node - ((1 << depth) - 1)) * deep + ((mark >> np.uint64(DEPTH)) % np.uint64(deep)).astype(np.int64)


def cell_frames(rows: DataFrame) -> dict[int, tuple]:
    """cell -> (directions, halvings, blocks of a part, axes, cuts) of the
    cells of several blocks: a few KB for each of them, on the driver.

    A cell is halved along the directions of its largest spread, as a sample
    tells, so that its blocks lie apart; where no direction halves it, and
    below ``DEPTH`` halvings, rows are dealt by their number."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("members"), F.max(F.size("x")).alias("size"))
    per = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size")))))
    many = stored(sizes.withColumn("parts", F.ceil(F.col("members") / per)).where("parts > 1"), "sizes")
    some = rows.join(many, "cell").withColumn("_mark", F.xxhash64(F.lit("f"), "cid"))
    some = some.where(F.pmod("_mark", F.greatest(F.lit(1), F.floor(F.col("members") / (2 * SAMPLE)))) == 0)
    some = some.withColumn("_i", F.row_number().over(Window.partitionBy("cell").orderBy("_mark", "cid"))).where(F.col("_i") <= SAMPLE)
    some = some.groupBy("cell", "parts").agg(F.collect_list("x").alias("xs"))

    @frugal
    def fit(batches):
        for b in batches:
            for i in range(b.num_rows):
                u, parts = _unit(_matrix(b.column("xs").slice(i, 1).flatten())), b.column("parts")[i].as_py()
                depth = min(DEPTH, parts.bit_length() - 1)
                basis = _directions(u)
                parts = [depth, -(-parts >> depth), len(basis)]
                yield pa.RecordBatch.from_arrays([b.column("cell").slice(i, 1), pa.array([parts], pa.list_(pa.int32())),
                                                  *(pa.array([v.tobytes()], pa.binary()) for v in (basis, *_halvings(u @ basis.T, depth)))],
                                                 names=["cell", "parts", "basis", "axes", "cuts"])

    found = some.mapInArrow(fit, "cell long, parts array<int>, basis binary, axes binary, cuts binary").collect()
    return {r.cell: (np.frombuffer(r.basis).reshape(r.parts[2], -1), *r.parts[:2], np.frombuffer(r.axes, np.int64), np.frombuffer(r.cuts)) for r in found}


def pack_cells(rows: DataFrame, frames: dict[int, tuple]) -> DataFrame:
    """The rows of cells as pieces of blocks: a row for each (task, cell, block)."""
    names = ("cids", "n", "home", "x")

    @frugal
    def pack(batches):
        held, size = [], 0

        def pieces():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for cell, own in _groups(rows, "cell"):
                part = rows.take(pa.array(own))
                x, cids = _matrix(part.column("x")), part.column("cid").to_numpy()
                basis, *tree = frames.get(int(cell), (None, 0, 1, None, None))
                blocks = (1 << tree[0]) * tree[1]
                block = np.zeros(len(cids), np.int64) if basis is None else _block(_unit(x) @ basis.T, cids, *tree)
                cols = (cids, part.column("n").to_numpy(), part.column("home").to_numpy(zero_copy_only=False), x)
                order, step = np.argsort(block, kind="stable"), max(1, PIECE // x[0].nbytes)
                for j in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                    for k in range(0, len(j), step):
                        at = j[k:k + step]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(cell)], pa.int64()), pa.array([int(block[at[0]])], pa.int32()), pa.array([blocks], pa.int32()),
                             pa.array([len(at)], pa.int64()), *(pa.array([c[at].tobytes()], pa.binary()) for c in cols)],
                            names=["cell", "own", "blocks", "rows", *names])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= HELD:
                yield from pieces()
                held, size = [], 0
        if held:
            yield from pieces()

    return rows.mapInArrow(pack, _PACKED)


class _Links:
    """Links of the rows of one block with each other, or with those of another."""

    def __init__(self, x: np.ndarray, n: np.ndarray, threshold: float, basis: np.ndarray | None):
        self.x, self.n, self.threshold = x, n, threshold
        self.roots, self.links = np.arange(len(x)), np.zeros(len(x), np.int64)
        self.pairs, self.held, self.u = [], 0, None
        u = self.units(np.arange(len(x)))
        z = (u @ (_directions(u) if basis is None else basis).T).astype(np.float32)
        half = (z * z).sum(axis=1, keepdims=True) / -2
        one = np.ones_like(half)
        self.z, self.f, self.g = z, np.hstack([z, half, one]), np.hstack([z, one, half])
        # The squared distance in some directions, which is no larger than that in all.
        self.near = max(0.0, 2 - 2 * threshold) + 1e-5

    def units(self, rows: np.ndarray) -> np.ndarray:
        return _unit(self.x[rows]) if self.u is None else self.u[rows]

    def leaves(self, rows: np.ndarray) -> list[np.ndarray]:
        """The rows in parts that lie apart."""
        todo, found = [rows], []
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                found.append(own)
            else:
                z = self.z[own]
                order = np.argpartition(z[:, np.ptp(z, axis=0).argmax()], len(own) // 2)
                todo += [own[order[:len(own) // 2]], own[order[len(own) // 2:]]]
        return found

    def reach(self, part: np.ndarray, cols: np.ndarray, zt: np.ndarray) -> np.ndarray:
        """Those of ``cols`` that may link with one of a part's rows."""
        low, high = self.z[part].min(axis=0), self.z[part].max(axis=0)
        far, close = np.zeros(len(cols), np.float32), np.arange(len(cols))
        for k in range(len(low)):
            z = zt[k] if k < 6 else zt[k, close]
            gap = z - np.clip(z, low[k], high[k])
            gap *= gap
            far += gap
            if k in (5, len(low) - 1):
                few = np.flatnonzero(far <= self.near)
                far, close = far[few], close[few]
        return cols[close]

    def compare(self, part: np.ndarray, cols: np.ndarray, same: bool) -> None:
        """Links of rows with others; ``same``: ``part`` heads ``cols``, and a pair counts once."""
        may = self.f[part] @ self.g[cols].T >= -self.near / 2
        if same:
            may[:, :len(part)] &= np.tri(len(part), k=-1, dtype=bool).T
        count = np.count_nonzero(may)
        if not count:
            return
        if count * 64 > may.size:
            if self.u is None:
                self.u = self.units(np.arange(len(self.x)))
            cos = self.u[part] @ self.u[cols].T
            hit = may & (cos >= self.threshold)
            # At the threshold the last bit decides: in one fixed order of sums.
            i, j = _marked(may & (np.abs(cos - self.threshold) < 1e-12))
            hit[i, j] = self.cosines(part[i], cols[j]) >= self.threshold
            i, j = _marked(hit)
        else:
            i, j = _marked(may)
            hit = self.cosines(part[i], cols[j]) >= self.threshold
            i, j = i[hit], j[hit]
        if not len(i):
            return
        np.add.at(self.links, part[i], self.n[cols[j]])
        np.add.at(self.links, cols[j], self.n[part[i]])
        apart = self.roots[part[i]] != self.roots[cols[j]]
        self.pairs.append((part[i][apart], cols[j][apart]))
        self.held += int(apart.sum())
        if self.held > 1 << 19:
            self.unite()

    def cosines(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0)]
        for at in range(0, len(a), COLUMNS):
            parts.append((self.units(a[at:at + COLUMNS]) * self.units(b[at:at + COLUMNS])).sum(axis=1))
        return np.concatenate(parts)

    def unite(self) -> None:
        """Gives the rows of pairs one root, a row that they reach."""
        if self.pairs:
            a, b = (self.roots[np.concatenate(side)] for side in zip(*self.pairs))
            while (apart := a != b).any():
                a, b = a[apart], b[apart]
                up = np.arange(len(self.roots))
                up[np.maximum(a, b)] = np.minimum(a, b)
                while (up[up] != up).any():
                    up = up[up]
                self.roots, a, b = up[self.roots], up[a], up[b]
        self.pairs, self.held = [], 0

    def run(self, rows: np.ndarray, cols: np.ndarray | None) -> None:
        """Links of rows with columns, or of the rows with each other."""
        parts = self.leaves(rows)
        if same := cols is None:
            cols = np.concatenate(parts)
            self.links += self.n
        zt, at = np.ascontiguousarray(self.z[cols].T), 0
        for part in parts:
            found = self.reach(part, cols[at + len(part):] if same else cols, zt[:, at + len(part):] if same else zt)
            if same:
                self.compare(part, part, True)
            for k in range(0, len(found), COLUMNS):
                self.compare(part, found[k:k + COLUMNS], False)
            at += len(part)
        self.unite()


def compare_blocks(dealt: DataFrame, threshold: float, frames: dict[int, tuple], kind: type) -> DataFrame:
    """(cid, links, other) of pairs (a, b) of blocks of a cell."""

    @frugal
    def run(batches):
        key, held = None, []

        def flush():
            # Blocks a and b, or one of them.
            cids, n, home = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            left, x = np.concatenate([h[0] for h in held]), np.concatenate([h[4] for h in held])
            held.clear()
            # A guest may come from several cells of the level before.
            _, one = np.unique(cids * 2 + ~home, return_index=True)
            one = one[np.diff(cids[one], prepend=cids[one[0]] - 1) != 0]
            if len(one) < len(cids):
                cids, n, home, left, x = (v[one] for v in (cids, n, home, left, x))
            same = key[1] == key[2]
            if home.any() and (same or not (left.all() or not left.any())):
                found = _Links(x, n, threshold, frames[key[0]][0] if key[0] in frames else None)
                found.run(np.flatnonzero(left | same), None if same else np.flatnonzero(~left))
                # (A class is home in one block of one cell, whose own task always reports it.)
                told, lead = np.flatnonzero(home & (same | (found.links > 0))), found.roots != np.arange(len(cids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([cids[told], cids[lead]])), pa.array(np.concatenate([found.links[told] - int(same), np.zeros(lead.sum(), np.int64)])),
                     pa.array(np.concatenate([cids[told], cids[found.roots[lead]]]))], names=["cid", "links", "other"])

        for b in batches:
            for row in range(b.num_rows):
                at = [b.column(c)[row].as_py() for c in ("cell", "a", "b")]
                if at != key and held:
                    yield from flush()
                key = at
                count = b.column("rows")[row].as_py()
                cols = [np.frombuffer(b.column(c)[row].as_buffer(), t) for c, t in (("cids", np.int64), ("n", np.int64), ("home", bool), ("x", kind))]
                held.append((np.full(count, b.column("own")[row].as_py() == key[1]), *cols[:3], cols[3].reshape(count, -1)))
        if held:
            yield from flush()

    return dealt.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b").mapInArrow(run, "cid long, links long, other long")


def _union(tables: list[DataFrame]) -> DataFrame:
    """Union in pairs: a plan of small depth."""
    while len(tables) > 1:
        tables = [functools.reduce(DataFrame.union, tables[i:i + 2]) for i in range(0, len(tables), 2)]
    return tables[0]


def _merged(found: DataFrame) -> DataFrame:
    """One row of links for every vector, and a star of edges for what they join."""
    links = found.where("cid = other").groupBy("cid").agg(F.sum("links").alias("links")).select("cid", "links", F.col("cid").alias("other"))
    hung = connected_components(found.where("cid <> other"), "cid", "other").where("node <> component")
    new = stored(links.union(hung.select("node", F.lit(0).cast("long"), "component")), "links")
    discard(found)
    return new


def join_cells(rows: DataFrame, threshold: float) -> DataFrame:
    """(cid, links, other): for every home vector the number of vectors linked
    to it, and edges (cid, other) that join what a task's links join.

    Each two blocks of a cell meet in a task of their own, in turns: in turn t
    of a cell of n blocks, block i meets block (t - i) mod n, so that a turn
    sends a block once. Only as many turns are on disk at a time as send the
    rows once. (Rows stored as cells are deleted when they are packed.)"""
    spark = rows.sparkSession
    frames = cell_frames(rows)
    kind = np.float32 if rows.schema["x"].dataType.elementType == T.FloatType() else np.float64
    packed = stored(pack_cells(rows, frames), "packed")
    if all("/llm-cells-" in f for f in rows.inputFiles()):
        discard(rows)
    _free(spark=spark)
    sizes = [(r.blocks, r.rows) for r in packed.groupBy("blocks").agg(F.sum("rows").alias("rows")).collect()]
    turns, total = max((b for b, _ in sizes), default=0), sum(n for _, n in sizes)
    found, lines, at = [spark.createDataFrame([], "cid long, links long, other long")], 0, 0
    while at < turns:
        to, load = at, 0
        while to < turns and (to == at or load + sum(n for b, n in sizes if b > to) <= max(total, FEW)):
            load += sum(n for b, n in sizes if b > to)
            to += 1
        dealt = packed.where(F.col("blocks") > at).withColumn("turn", F.explode(F.sequence(F.lit(at), F.least(F.lit(to), "blocks") - 1)))
        dealt = dealt.withColumn("met", F.pmod(F.col("turn") - F.col("own"), F.col("blocks"))).drop("turn", "blocks")
        dealt = dealt.withColumn("a", F.least("own", "met")).withColumn("b", F.greatest("own", "met")).drop("met")
        found.append(stored(compare_blocks(dealt, threshold, frames, kind), "links"))
        lines, at = lines + found[-1].count(), to
        if lines > 4 * total:
            found = [_merged(_union(found))]
            lines = found[0].count()
        _free(spark=spark)
    discard(packed)
    return _union(found)


def cosine_groups(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                  label_col: str = "label") -> DataFrame:
    """Groups of vectors of equal label linked by cosine >= ``threshold``.

    One row per input row: ``id_col``, n_links (other rows linked directly),
    component_id (the smallest id that links reach, its own included), kept
    (id = component_id). Equal vectors are one class with a count. Classes go
    to the cells of pivots and are copied over the borders as far as the
    triangle inequality asks; cells are then joined on their own. A cell
    returns counts and a forest of edges, never its pairs.

    Null labels, and vectors that are null, zero, empty or hold null or
    non-finite components, link with nothing; nor do vectors of different
    lengths. Null ids take part, but name no group (a group of null ids only
    has a null component_id). Repeated rows link to each other; other columns
    are ignored; an empty table gives an empty result."""
    # Single floats stay so: they need half the room.
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("x"), F.col(label_col).alias("label"))
    rows = rows.withColumn("fine", F.col("label").isNotNull() & usable(F.col("x")))
    # (-0.0 becomes 0.0, so that equal vectors are equal keys: two hashes, 128 bits)
    rows = rows.withColumn("x", F.when(F.col("fine"), F.transform("x", lambda v: v + F.lit(0.0).cast(kind))))
    rows = rows.select("*", *[F.xxhash64(F.lit(i), F.size("x"), "x").alias(f"k{i}") for i in (1, 2)], F.monotonically_increasing_id().alias("row"))
    rows, key = stored(rows, "rows"), ["label", "k1", "k2"]
    names = stored(rows.where("fine").groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("row").alias("cid")), "names")
    # Vectors stay where they are, less the repetitions of equal ones.
    many = stored(names.where("n > 1").select(*key, "cid", "n"), "many")
    again = stored(rows.where("fine").join(many, key).where("row <> cid").select("row"), "again")
    cells = rows.where("fine").join(again, "row", "left_anti").join(many.select(F.col("cid").alias("row"), "n"), "row", "left")
    cells = stored(cells.select(F.xxhash64("label", F.size("x")).alias("cell"), F.col("row").alias("cid"), F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.lit(True).alias("home"), "x"), "cells")
    ids = stored(rows.select("id", "fine", *key), "ids")
    _free(rows, many, again)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    for level in range(LEVELS):
        pivots = stored(cell_pivots(cells, radius, level), "pivots")
        if pivots.isEmpty():
            break  # what is left can't be told apart by pivots, and is joined in blocks
        last, cells = cells, stored(split_cells(cells, pivots, radius, level), "cells")
        _free(last, pivots)
    found = join_cells(cells, threshold)
    links = found.where("cid = other").groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("cid <> other"), "cid", "other").withColumnRenamed("node", "cid")
    named = names.join(links, "cid").join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select(*key, "links", "component_id")
    linked = ids.where("fine").join(named, key).select("id", F.col("links").alias("n_links"), "component_id")
    alone = ids.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
