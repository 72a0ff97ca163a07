"""Block-wise keyed exchange.

Texts hold many more key occurrences (words, chunks, n-grams) than a row per
occurrence could carry through a shuffle. Here a task cuts its input into
blocks of bounded size, reduces each block to its distinct keys, and sends
one packed row per (block, bucket of keys) through the shuffle:

    split   block of rows    -> packed distinct keys of each bucket
    serve   bucket           -> an answer for every block that asked
    finish  answers of block -> rows of the result

A key that fills a third of all rows arrives once per block, so no bucket
grows with a hot key. Every block counts the rows that it sent; ``finish``
raises an error if one is missing, so that recomputing a lost task over
input in another order can't give partial results unnoticed.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of a block: bounds a task's memory at any input size.
BLOCK_BYTES = 8 << 20

_ROW = pa.schema([("slot", pa.int32()), ("bucket", pa.int32()), ("block", pa.binary()),
                  ("rows", pa.int32()), ("head", pa.binary()), ("body", pa.binary())])
_ROW_DDL = "slot int, bucket int, block binary, rows int, head binary, body binary"

Split = Callable[[pa.Table, int], tuple[bytes, Iterable[tuple[int, bytes]]]]
Serve = Callable[[list[bytes]], Iterable[bytes]]
Finish = Callable[[bytes, list[bytes]], pa.RecordBatch]


def frugal(run):
    """A mapInArrow function that gives freed memory back when it ends: Spark
    keeps Python workers for later tasks, and the allocators what they held."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def pack(*parts: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed byte string; integers by byte position, so
    that the zero high bytes of small numbers stand together."""
    out = [struct.pack("<I", len(parts))]
    for a in parts:
        a = np.ascontiguousarray(a)
        out.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        out.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, parts = zstandard.ZstdDecompressor().decompress(blob), []
    n, at = struct.unpack_from("<I", data)[0], 4
    for _ in range(n):
        code, size = struct.unpack_from("<2sQ", data, at)
        kind, at = np.dtype(code.decode()), at + 10
        raw = np.frombuffer(data, np.uint8, size * kind.itemsize, at)
        parts.append(np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel())
        at += size * kind.itemsize
    return parts


def pack_strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bytes) of a string or binary array without nulls."""
    values = values.cast(pa.large_binary())
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(values) else np.zeros(0, np.uint8)
    return np.diff(at).astype(np.uint32), raw


def strings(lengths: np.ndarray, raw: np.ndarray) -> pa.Array:
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths),
                                            [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of several ranges, one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def cut(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Tables of at most ``limit`` bytes of ``column``, one longer row alone."""
    held, size = [], 0
    for batch in batches:
        at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(at):
            before = at[start - 1] if start else 0
            stop = int(np.searchsorted(at, before + limit - size, side="right"))
            if stop == start and not held:
                stop += 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(at[stop - 1] - before)
                start = stop
            if start < len(at):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def exchange(df: DataFrame, column: str, width: int, split: Split, serve: Serve, finish: Finish,
             schema: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """Apply split, serve and finish (above) to the rows of ``df``."""

    @frugal
    def to_rows(batches):
        part = TaskContext.get().partitionId()
        for k, block in enumerate(cut(batches, column, limit)):
            head, bodies = split(block, width)
            bodies = list(bodies) or [(part % width, b"")]
            name = xxhash.xxh3_128_digest(head + struct.pack("<II", part, k))
            n = len(bodies)
            for i, (bucket, body) in enumerate(bodies):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part + k) % width], pa.int32()), pa.array([bucket], pa.int32()),
                     pa.array([name], pa.binary()), pa.array([n], pa.int32()),
                     pa.array([None if i else head], pa.binary()), pa.array([body], pa.binary())], schema=_ROW)

    @frugal
    def to_answers(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        for _, own in itertools.groupby(sorted(range(rows.num_rows), key=rows["bucket"].to_pylist().__getitem__),
                                        rows["bucket"].to_pylist().__getitem__):
            own = list(own)
            asked = [i for i in own if rows["body"][i].as_py()]
            answers = iter(serve([rows["body"][i].as_py() for i in asked]))
            for i in own:
                body = next(answers) if rows["body"][i].as_py() else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[c][i].as_py()], _ROW.field(c).type) for c in _ROW.names[:-1]] + [pa.array([body], pa.binary())], schema=_ROW)

    @frugal
    def to_result(batches):
        each = (row for b in batches for row in b.to_pylist())
        for _, rows in itertools.groupby(each, lambda r: r["block"]):
            rows = list(rows)
            head = [r["head"] for r in rows if r["head"] is not None]
            if len(head) != 1 or len(rows) != rows[0]["rows"]:
                raise RuntimeError("a block is incomplete: its input changed while a lost task was run again")
            yield finish(head[0], [r["body"] for r in rows if r["body"]])

    return (df.mapInArrow(to_rows, _ROW_DDL)
            .repartitionById(width, F.col("bucket")).mapInArrow(to_answers, _ROW_DDL)
            .repartitionById(width, F.col("slot")).sortWithinPartitions("block")
            .mapInArrow(to_result, schema))
