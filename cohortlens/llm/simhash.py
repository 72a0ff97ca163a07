"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import frugal
from .common import stored
from .components import connected_components

SEED = 42
#: Members of a bucket that a task compares directly; larger ones are split.
BUCKET_MAX = 1 << 14


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the XXH64 hashes of all word shingles of ``text``."""
    words = text.lower().split()  # of bytes: A-Z and the six white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:len(words) - k] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1:].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 20_000):
        part = hashes[i:i + 20_000]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """(id, mark, fp): the 64-bit fingerprint as a signed long, one row per
    input row; ``mark`` (a long) goes along."""

    @frugal
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            made = np.array([fingerprint(x.as_py() or b"", shingle) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(made.view(np.int64))], names=["id", "mark", "fp"])

    mark = F.lit(0) if mark is None else mark
    return docs.select(F.col(id_col).cast("long").alias("id"), mark.cast("long").alias("mark"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, mark long, fp long")


def covering_masks(radius: int, seed: int, bits: int = 64) -> list[int]:
    """Bit masks of which one misses any ``radius`` (or fewer) positions.

    Every position holds a vector over GF(2) of radius + 1 dimensions, and
    each nonzero vector v makes a mask of the positions whose vector has an
    odd product with v. Up to ``radius`` vectors leave some v orthogonal to
    all of them, whose mask misses their positions: values that differ
    nowhere else agree under it."""
    n = (1 << radius + 1) - 1
    held = 1 + np.random.default_rng(seed).permutation(bits) % n
    return [sum(1 << i for i, a in enumerate(held.tolist()) if (a & v).bit_count() % 2) for v in range(1, n + 1)]


def _keyed(df: DataFrame, fp: str, masks: list[int], table: str, key: str) -> DataFrame:
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return df.select("*", F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m)) for m in signed])).alias(table, key))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def linked(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join the members of a bucket as their links do: from every
    value reached, those not yet reached within the radius are taken away."""
    edges, rest = [], np.unique(values)
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                edges += [(int(root), int(x)) for x in found]
                queue += list(found)
    return edges


def _bucket_edges(members: DataFrame, keys: list[str], radius: int) -> DataFrame:
    @frugal
    def run(batches):
        held_key, held = None, []

        def flush():
            edges = linked(np.concatenate(held).view(np.uint64), radius) if held else []
            at = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["a", "b"])

        for batch in batches:
            cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], 1)
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            edges = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1).tolist(), len(fps)]
            for i, j in zip(edges, edges[1:]):
                if (key := cols[i].tolist()) != held_key:
                    if len(held):
                        yield flush()
                    held_key, held = key, []
                held.append(fps[i:j])
        if len(held):
            yield flush()

    return members.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def fingerprint_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column fp that join
    all within ``radius`` bits; per bucket a forest, not all pairs.

    Two fingerprints within the radius agree under a covering mask, so they
    share that table's bucket: no link is lost. A bucket of more than
    BUCKET_MAX goes through a second set of masks inside the bucket, which
    again loses none; what is left open by both is about 16 bits, which
    bounds a bucket."""
    masks = covering_masks(radius, 1)
    keyed = _keyed(distinct.select("fp"), "fp", masks, "t", "k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = stored(sizes, "buckets")
    pairs = sizes.where((F.col("n") == 2) & (_distance("a", "b") <= radius)).select("a", "b")
    members = keyed.join(sizes.where("n > 2").select("t", "k", "n"), ["t", "k"])
    small = _bucket_edges(members.where(F.col("n") <= BUCKET_MAX), ["t", "k"], radius)
    split = _keyed(members.where(F.col("n") > BUCKET_MAX), "fp", covering_masks(radius, 2), "t2", "k2")
    large = _bucket_edges(split, ["t", "k", "t2", "k2"], radius)
    return pairs.union(small).union(large)


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text",
                   mark: Column | None = None) -> DataFrame:
    """Groups of documents whose fingerprints link, directly or by a chain.

    Equal fingerprints are one class, so copies meet only in counts. One row
    per input row: ``id_col``, fingerprint (16 hex digits), component_id (the
    smallest id of the group), group (the group's smallest fingerprint as a
    long, also for groups without ids) and, if given, ``mark``. Null and
    wordless texts have fingerprint 0 and link like any other. Null ids take
    part; a group of null ids only has a null component_id. Repeated rows
    stay, other columns are ignored, and an empty table gives an empty
    result."""
    made = stored(fingerprints(docs, shingle, id_col, text_col, mark), "fingerprints")
    classes = made.groupBy("fp").agg(F.min("id").alias("first"))
    parts = connected_components(fingerprint_links(classes, radius), "a", "b")
    labelled = classes.join(parts.select(F.col("node").alias("fp"), F.col("component").alias("group")), "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    smallest = labelled.groupBy("group").agg(F.min("first").alias("component_id"))
    named = labelled.join(smallest, "group").select("fp", "group", "component_id")
    marks = [] if mark is None else ["mark"]
    return made.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group", *marks)
