"""Hierarchical Pitman-Yor language model, sampled over the whole corpus.

Words after the same word are customers of that context's restaurant; its
tables are customers of the one parent restaurant that all contexts share,
whose base is uniform over the vocabulary. Gibbs rounds alternate between
the two levels:

    up      tables of each word, summed over its contexts   -> parent
    parent  tables of each word in the parent restaurant, sampled
    down    the parent's counts of each word -> contexts, whose tables are
            sampled given the parent's predictive probabilities

Predictive probabilities are averaged over the rounds after burn-in.

Spark holds the state in packed rows: a row per bucket of contexts, with the
word pairs of the whole corpus that fall to it, and which documents of which
block they score. A context with very many words is dealt in sections to
several buckets; sections share its table count each round.
"""

from __future__ import annotations

import gc
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .blocks import pack, unpack
from .common import discard, shuffle_width, stored

#: Strengths of the two levels; rounds, and those of them before averaging.
STRENGTH, ROUNDS, BURN_IN = 1.0, 3, 1
#: Customers of one word in one restaurant whose table count is drawn exactly.
EXACT = 64
#: Passes of a round over a restaurant's words; its table count is renewed between them.
PASSES = 4
_WORD_BITS = np.uint64(40)
#: Text bytes of a block: bounds a task's memory.
BLOCK = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit integer hash (splitmix64's finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Sections:
    """How many buckets each frequent context is dealt to; others have one."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.counts = ids[order].astype(np.uint64), counts[order].astype(np.uint64)

    def of(self, u: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.ones(len(u), np.uint64)
        at = np.minimum(np.searchsorted(self.ids, u), len(self.ids) - 1)
        return np.where(self.ids[at] == u, self.counts[at], np.uint64(1))

    def route(self, u: np.ndarray, w: np.ndarray, width: int) -> np.ndarray:
        section = _mix(w + np.uint64(1)) % self.of(u)
        return (_mix(_mix(u) + section * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(width)).astype(np.int64)


def stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """log S[c, t]: generalised Stirling numbers, the weight of all seatings of
    c customers at t tables."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, n + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - 1 - t * discount, 0.0)) + s[c - 1, 1:c + 1]
        s[c, 1:c + 1] = np.logaddexp(s[c - 1, :c], stay)
    return s


def seat(c: np.ndarray, rest: np.ndarray, base: np.ndarray, discount: float, strength: float, log_s: np.ndarray,
         rng: np.random.Generator) -> np.ndarray:
    """Tables of each word, drawn given all other seating of its restaurant.

    c: the word's customers; rest: the restaurant's tables of other words;
    base: the parent's probability of the word. Up to EXACT customers the
    count is drawn from its exact conditional, all the word's customers
    unseated at once. Later customers sit down in turn after those, in steps
    of a thirty-second of those seated (each, below 32 of them)."""
    t = np.minimum(c, 1).astype(np.int64)
    first = np.minimum(c, EXACT)
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(2, EXACT + 2))
    for k in range(2, EXACT + 1):
        own = order[cuts[k - 2]:cuts[k - 1]]
        for some in np.array_split(own, max(1, len(own) * k >> 20)) if len(own) else ():
            j = np.arange(k)
            # Opening the (j + 1)-th table of the word: (strength + discount * tables so far) * base.
            grow = np.log(strength + discount * (rest[some][:, None] + j)) + np.log(base[some])[:, None]
            logs = np.cumsum(grow, axis=1) + log_s[k, 1:k + 1]
            p = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            t[some] = 1 + (p < rng.random((len(some), 1)) * p[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    many = many[np.argsort(-c[many], kind="stable")]
    ends, done = c[many], EXACT
    while len(many):
        live = int(np.searchsorted(-ends, -done))  # those with more customers to come
        if not live:
            break
        own = many[:live]
        step = np.minimum(max(1, done // 32), ends[:live] - done)
        new = (strength + discount * (rest[own] + t[own])) * base[own]
        t[own] += rng.binomial(step, np.clip(new / (new + np.maximum(done - discount * t[own], 0.0)), 0, 1))
        done += max(1, done // 32)
    return t


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: their words' hashes and each token's place among them."""
    key = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(key.alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))

    @blocks.frugal
    def run(batches):
        part = TaskContext.get().partitionId()
        for k, block in enumerate(blocks.cut(batches, "text", BLOCK)):
            ids = block["id"].combine_chunks()
            texts = pc.ascii_lower(pc.fill_null(block["text"], "").combine_chunks().cast(pa.large_string()))
            lists = pc.ascii_split_whitespace(texts)
            at = lists.offsets.to_numpy()
            words = lists.values.slice(at[0], at[-1] - at[0])
            owner = np.repeat(np.arange(len(texts)), np.diff(at))
            some = pc.not_equal(words, "")
            owner, words = owner[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
            known = words.dictionary.cast(pa.large_binary()).to_pylist()
            # Two words of one 64-bit hash would be one word; the end of a text is 0.
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) or 1 for w in known), np.uint64, len(known))
            keys, place = np.unique(np.append(hashes, np.uint64(0)), return_inverse=True)
            codes = place[words.indices.to_numpy(zero_copy_only=False)]
            n = np.bincount(owner, minlength=len(texts)) + 1
            tokens = np.zeros(n.sum(), np.uint32)  # the end's place is 0
            ends = np.cumsum(n) - 1
            inside = np.ones(len(tokens), bool)
            inside[ends] = False
            tokens[inside] = codes
            # Frequent words get small numbers, which take little room.
            order = np.argsort(-np.bincount(tokens, minlength=len(keys)), kind="stable")
            rank = np.empty(len(keys), np.uint32)
            rank[order] = np.arange(len(keys))
            keys, tokens = keys[order], rank[tokens]
            null, out = ids.is_null().to_numpy(zero_copy_only=False), block["held"].to_numpy()
            train = np.bincount(tokens[~np.repeat(out, n)], minlength=len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k]), pa.array([int(train.sum())]),
                 pa.array([pack(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), null.astype(np.uint8), out.astype(np.uint8), n.astype(np.uint32))], pa.binary()),
                 pa.array([pack(keys, train.astype(np.uint32))], pa.binary()), pa.array([pack(tokens, level=3)], pa.binary())],
                names=["block", "train", "docs", "words", "tokens"])

    return rows.mapInArrow(run, "block long, train long, docs binary, words binary, tokens binary")


def _parts(bucket: np.ndarray) -> dict[int, np.ndarray]:
    """Row numbers by bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, first[1:]), strict=True)) if len(found) else {}


def _word_parts(keys: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """Places of the words of each bucket, by hash."""
    return {b: own[np.argsort(keys[own])] for b, own in _parts(keys % np.uint64(width)).items()}


def _by_bucket(rows: DataFrame, width: int, column: str, *order: str) -> DataFrame:
    return rows.repartitionById(width, F.col(column).cast("int")).sortWithinPartitions(column, *order)


def _grouped(batches, column: str):
    for key, rows in itertools.groupby((r for b in batches for r in b.to_pylist()), lambda r: r[column]):
        yield key, list(rows)


def number_words(texts: DataFrame, width: int, total: int) -> DataFrame:
    """Ids and training counts of each block's words, per (block, bucket of
    words); frequent words of a bucket and its number of words in training
    come in rows of block -1. A word's id is its place in its bucket times the
    width, plus the bucket."""

    @blocks.frugal
    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                keys, train = unpack(r["words"])
                for i, own in _word_parts(keys, width).items():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([r["block"]]),
                                                      pa.array([pack(np.diff(keys[own], prepend=np.uint64(0)), train[own])], pa.binary())], names=["bucket", "block", "body"])

    @blocks.frugal
    def answer(batches):
        for i, rows in _grouped(batches, "bucket"):
            asked = [unpack(r["body"]) for r in rows]
            keys, place = np.unique(np.concatenate([np.cumsum(a[0]) for a in asked]), return_inverse=True)
            count = np.bincount(place, weights=np.concatenate([a[1] for a in asked])).astype(np.int64)
            at = 0
            for r, a in zip(rows, asked, strict=True):
                own = place[at:at + len(a[0])]
                at += len(a[0])
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([i], pa.int32()),
                                                  pa.array([pack(np.diff(own, prepend=0).astype(np.uint32), count[own])], pa.binary())], names=["block", "bucket", "body"])
            often = np.flatnonzero(count * 4 * width >= max(1, total))
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([i], pa.int32()),
                                              pa.array([pack(often * width + i, count[often], np.array([(count > 0).sum(), len(count)]))], pa.binary())], names=["block", "bucket", "body"])

    asked = texts.select("block", "words").mapInArrow(ask, "bucket int, block long, body binary")
    return _by_bucket(asked, width, "bucket").mapInArrow(answer, "block long, bucket int, body binary")


def pair_rows(texts: DataFrame, numbered: DataFrame, width: int, sections: Sections, total: int, vocabulary: int) -> DataFrame:
    """Per (bucket, block): the block's distinct word pairs of that bucket, how
    often training documents hold them, and which documents they score."""
    both = texts.select("block", F.lit(-1).alias("bucket"), "docs", "words", "tokens").unionByName(
        numbered.where("block >= 0").select("block", "bucket", F.col("body").alias("words")), allowMissingColumns=True)
    both = both.withColumn("slot", F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF), F.lit(width)).cast("int"))

    @blocks.frugal
    def run(batches):
        rows = (r for b in batches for r in b.to_pylist())
        for _, own in itertools.groupby(rows, lambda r: r["block"]):
            yield from one(list(own))

    def one(own):
        me = own[0]
        ids, null, held, n = unpack(me["docs"])
        keys = unpack(me["words"])[0]
        parts = _word_parts(keys, width)
        number, count = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64)
        for r in own[1:]:
            at = parts[r["bucket"]]
            place, c = unpack(r["words"])
            number[at], count[at] = np.cumsum(place.astype(np.uint64)) * np.uint64(width) + np.uint64(r["bucket"]), c
        if len(own) - 1 != len(parts):
            raise RuntimeError("words of a block are missing")
        tokens = unpack(me["tokens"])[0]
        doc = np.repeat(np.arange(len(n)), n)
        base = np.add.reduceat(np.log10((count + 1) / (total + vocabulary + 1))[tokens], np.cumsum(n.astype(np.int64)) - n) if len(n) else np.zeros(0)
        known = np.bincount(doc, weights=count[tokens] > 0, minlength=len(n))
        head = pack(ids, null, held, n, known.astype(np.uint32), base)
        before = np.append(tokens[-1:], tokens[:-1]).astype(np.int64)  # an end stands before each text
        pair = before * len(keys) + tokens
        # Distinct pairs, and the documents of each, in one order: pairs by
        # bucket, context, word; then documents.
        pairs, place = np.unique(pair, return_inverse=True)
        u, w = number[pairs // len(keys)], number[pairs % len(keys)]
        to = sections.route(u, w, width)
        order = np.lexsort((w, u, to))
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        uses, times = np.unique(rank[place] * len(n) + doc, return_counts=True)
        of, by = uses // len(n), uses % len(n)
        u, w, to = u[order], w[order], to[order]
        learnt = np.bincount(of, weights=times * (held[by] == 0), minlength=len(pairs)).astype(np.uint32)
        n_uses = np.bincount(of, minlength=len(pairs))
        start = np.cumsum(n_uses) - n_uses
        found, first = np.unique(to, return_index=True)
        for i, (b, lo, hi) in enumerate(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(to)])):
            lo2, hi2 = start[lo], start[hi - 1] + n_uses[hi - 1]
            body = pack(np.diff(u[lo:hi], prepend=np.uint64(0)), w[lo:hi], learnt[lo:hi], n_uses[lo:hi].astype(np.uint32),
                        np.diff(by[lo2:hi2], prepend=0).astype(np.int32), times[lo2:hi2].astype(np.uint32), level=3)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([me["block"]]), pa.array([len(found)], pa.int32()),
                                              pa.array([None if i else head], pa.binary()), pa.array([body], pa.binary())], names=["bucket", "block", "rows", "head", "body"])

    return both.repartitionById(width, F.col("slot")).sortWithinPartitions("block", "bucket").mapInArrow(
        run, "bucket int, block long, rows int, head binary, body binary")


_USES = "array<struct<block: bigint, rows: int, head: binary, body: binary>>"
_STATE = "bucket int, pairs binary, tables binary, kept binary, ones long, twos long, hot binary"
_STATE_NAMES = ["bucket", "pairs", "tables", "kept", "ones", "twos", "hot"]


def _state_row(bucket: int, pairs: bytes, tables: np.ndarray, kept: bytes, ones: int, twos: int, hot: np.ndarray) -> list:
    return [pa.array([bucket], pa.int32()), pa.array([pairs], pa.binary()), pa.array([pack(tables.astype(np.uint32))], pa.binary()), pa.array([kept], pa.binary()),
            pa.array([ones], pa.int64()), pa.array([twos], pa.int64()), pa.array([pack(hot.ravel())], pa.binary())]


class Bucket:
    """The word pairs of a bucket: contexts us, pairs (us[at], w) and counts c."""

    def __init__(self, pairs: bytes):
        step, sizes, self.w, c = unpack(pairs)
        self.us, self.c = np.cumsum(step), c.astype(np.int64)
        self.at = np.repeat(np.arange(len(self.us)), sizes)
        self.words, self.word_at = np.unique(self.w, return_inverse=True)

    def frequent(self, tables: np.ndarray, sections: Sections) -> np.ndarray:
        """(context, tables) of the contexts that other buckets hold too."""
        own = np.flatnonzero(sections.of(self.us) > 1)
        t = np.bincount(self.at, weights=tables, minlength=len(self.us)).astype(np.int64)
        return np.stack([self.us[own].astype(np.int64), t[own]], 1)


def gather(pairs: DataFrame, width: int, sections: Sections) -> DataFrame:
    """A row per bucket: its pairs over all blocks, each word of a restaurant
    at one table, and, for scoring, the uses of pairs by blocks."""

    @blocks.frugal
    def run(batches):
        for bucket, rows in _grouped(batches, "bucket"):
            asked = [unpack(r["body"]) for r in rows]
            u = np.concatenate([np.cumsum(a[0]) for a in asked])
            us, at = np.unique(u, return_inverse=True)
            key, place = np.unique(at.astype(np.uint64) << _WORD_BITS | np.concatenate([a[1] for a in asked]), return_inverse=True)
            at, w = (key >> _WORD_BITS).astype(np.int64), key & (np.uint64(1) << _WORD_BITS) - np.uint64(1)
            c = np.bincount(place, weights=np.concatenate([a[2] for a in asked])).astype(np.int64)
            packed, tables = pack(np.diff(us, prepend=np.uint64(0)), np.bincount(at).astype(np.uint32), w, c.astype(np.uint32), level=3), np.minimum(c, 1)
            uses, lo = [], 0
            for r, a in zip(rows, asked, strict=True):
                own = place[lo:lo + len(a[0])]
                lo += len(a[0])
                uses.append({"block": r["block"], "rows": r["rows"], "head": r["head"], "body": pack(np.diff(own, prepend=0).astype(np.int32), *a[3:], level=3)})
            kind = pa.list_(pa.struct([("block", pa.int64()), ("rows", pa.int32()), ("head", pa.binary()), ("body", pa.binary())]))
            state = _state_row(bucket, packed, tables, b"", int((c == 1).sum()), int((c == 2).sum()), Bucket(packed).frequent(tables, sections))
            yield pa.RecordBatch.from_arrays([*state, pa.array([uses], kind)], names=[*_STATE_NAMES, "uses"])

    return _by_bucket(pairs, width, "bucket").mapInArrow(run, f"{_STATE}, uses {_USES}")


def parent_round(state: DataFrame, seats: DataFrame | None, width: int, tables: int, base: float, discount: float, seed: int) -> DataFrame:
    """Seats the parent restaurant: per (bucket of contexts, bucket of words)
    each word's customers and tables there; totals come in rows of bucket -1,
    all words' tables in rows of bucket -2. ``seats``: those rows of the last
    round (at first, each word has one table). A word is drawn given the
    tables of all others: of its bucket, in passes, and of the other buckets
    as of the last round."""

    @blocks.frugal
    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                me = Bucket(r["pairs"])
                t = np.bincount(me.word_at, weights=unpack(r["tables"])[0], minlength=len(me.words)).astype(np.uint32)
                for i, own in _parts(me.words % np.uint64(width)).items():
                    body = pack(np.diff(me.words[own] // np.uint64(width), prepend=np.uint64(0)).astype(np.uint32), t[own])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([r["bucket"]], pa.int32()), pa.array([body], pa.binary())], names=["word_bucket", "bucket", "body"])

    @blocks.frugal
    def answer(batches):
        for i, rows in _grouped(batches, "word_bucket"):
            last = unpack(rows.pop(0)["body"])[0].astype(np.int64) if rows[0]["bucket"] == -2 else None
            asked = [unpack(r["body"]) for r in rows]
            places = [np.cumsum(a[0].astype(np.int64)) for a in asked]
            c = np.zeros(max(p[-1] for p in places) + 1, np.int64)
            for p, a in zip(places, asked, strict=True):
                np.add.at(c, p, a[1])
            one = np.minimum(c, 1)
            last = one if last is None else last
            elsewhere, s = max(tables - last.sum(), 0), np.clip(last, one, c)
            rng, log_s = np.random.default_rng([seed, i]), stirling(discount)
            turn = rng.integers(0, PASSES, len(c))
            for k in range(PASSES):
                own = np.flatnonzero((turn == k) & (c > 1))
                s[own] = seat(c[own], elsewhere + s.sum() - s[own], np.full(len(own), base), discount, STRENGTH, log_s, rng)
            for r, p in zip(rows, places, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([i], pa.int32()),
                                                  pa.array([pack(c[p].astype(np.uint64), s[p].astype(np.uint64))], pa.binary())], names=["bucket", "word_bucket", "body"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([i], pa.int32()), pa.array([pack(np.array([c.sum(), s.sum()]))], pa.binary())],
                                             names=["bucket", "word_bucket", "body"])
            yield pa.RecordBatch.from_arrays([pa.array([-2], pa.int32()), pa.array([i], pa.int32()), pa.array([pack(s.astype(np.uint32))], pa.binary())],
                                             names=["bucket", "word_bucket", "body"])

    asked = state.select("bucket", "pairs", "tables").mapInArrow(ask, "word_bucket int, bucket int, body binary")
    if seats is not None:
        asked = asked.unionByName(seats)
    return _by_bucket(asked, width, "word_bucket", "bucket").mapInArrow(answer, "bucket int, word_bucket int, body binary")


def context_round(state: DataFrame, parent: DataFrame, width: int, sections: Sections, hot: dict[int, int], customers: int, tables: int,
                  base: float, discount: float, seed: int, keep: bool) -> DataFrame:
    """Seats the context restaurants given the parent's. If ``keep``, the round's
    tables and parent probabilities join those that scores are averaged over."""
    both = state.select(*_STATE_NAMES, F.lit(-1).alias("word_bucket")).unionByName(
        parent.where("bucket >= 0").select("bucket", "word_bucket", F.col("body").alias("pairs")), allowMissingColumns=True)
    shared_ids = np.array(sorted(hot), np.uint64)
    shared = np.array([hot[int(i)] for i in shared_ids], np.int64)

    @blocks.frugal
    def run(batches):
        for bucket, rows in _grouped(batches, "bucket"):
            me, r = Bucket(rows[0]["pairs"]), rows[0]
            parts, above = _parts(me.words % np.uint64(width)), np.zeros(len(me.words))
            for a in rows[1:]:
                c, s = unpack(a["pairs"])
                above[parts[a["word_bucket"]]] = (c - discount * s + (STRENGTH + discount * tables) * base) / (STRENGTH + customers)
            if not (above > 0).all():
                raise RuntimeError("answers of the parent are missing")
            t = unpack(r["tables"])[0].astype(np.int64)
            rng, log_s, p = np.random.default_rng([seed, bucket]), stirling(discount), above[me.word_at]
            mine = np.bincount(me.at, weights=t, minlength=len(me.us)).astype(np.int64)
            elsewhere = np.zeros(len(me.us), np.int64)  # tables of a context in other sections, as of the last round
            if len(shared_ids):
                at = np.minimum(np.searchsorted(shared_ids, me.us), len(shared_ids) - 1)
                elsewhere = np.where(shared_ids[at] == me.us, shared[at] - mine, 0)
            turn = rng.integers(0, PASSES, len(t))
            open_ = np.flatnonzero(me.c > 1)
            for k in range(PASSES):
                own = open_[turn[open_] == k]
                total = elsewhere + np.bincount(me.at, weights=t, minlength=len(me.us)).astype(np.int64)
                t[own] = seat(me.c[own], total[me.at[own]] - t[own], p[own], discount, STRENGTH, log_s, rng)
            kept = r["kept"] or b""
            if keep:
                kept = pack(*(unpack(kept) if kept else []), t.astype(np.uint32), above)
            yield pa.RecordBatch.from_arrays(_state_row(bucket, r["pairs"], t, kept, r["ones"], r["twos"], me.frequent(t, sections)), names=_STATE_NAMES)

    return _by_bucket(both, width, "bucket", "word_bucket").mapInArrow(run, _STATE)


@dataclass
class Model:
    """The sampled model over the pairs that training and scoring ask for."""

    state: DataFrame
    uses: DataFrame
    width: int
    sections: Sections
    frequent: dict[int, int]
    totals: list[dict[int, int]]
    train_tokens: int
    vocabulary: int
    discount: float


class Predictive:
    """Probability of each pair's word in its context, averaged over the kept rounds."""

    def __init__(self, model: Model):
        self.sections, self.frequent, self.totals, self.discount = model.sections, model.frequent, model.totals, model.discount

    def __call__(self, me: Bucket, kept: list[np.ndarray]) -> np.ndarray:
        n = np.bincount(me.at, weights=me.c, minlength=len(me.us))  # customers of each context
        dealt = np.flatnonzero(self.sections.of(me.us) > 1)
        n[dealt] = [self.frequent[u] for u in me.us[dealt].tolist()]
        p = np.zeros(len(me.w))
        for t, above, whole in zip(kept[::2], kept[1::2], self.totals, strict=True):
            total = np.bincount(me.at, weights=t, minlength=len(me.us))
            total[dealt] = [whole[u] for u in me.us[dealt].tolist()]
            p += (me.c - self.discount * t + (STRENGTH + self.discount * total)[me.at] * above[me.word_at]) / (STRENGTH + n)[me.at]
        return p / len(self.totals)


def fit(docs: DataFrame, rounds: int = ROUNDS, burn_in: int = BURN_IN, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Samples the model; what comes to the driver is bounded by the number of buckets."""
    width = shuffle_width(docs.sparkSession)
    texts = stored(tokenised(docs, id_col, text_col), "texts")
    total = texts.agg(F.sum("train")).first()[0] or 0
    numbered = stored(number_words(texts, width, total), "numbered")
    ids, counts, vocabulary = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for r in numbered.where("block < 0").collect():  # at most 4 * width frequent words in all
        number, count, sizes = unpack(bytes(r.body))
        ids.append(number)
        counts.append(count)
        vocabulary += int(sizes[0])
    number, count = np.concatenate(ids), np.concatenate(counts)
    _free(spark=docs.sparkSession)
    sections = Sections(number, np.minimum(width, np.maximum(1, -(-count * 4 * width // max(1, total)))))
    # Written between the two exchanges, so that only one of them and its input lie on disk at a time.
    asked = stored(pair_rows(texts, numbered, width, sections, total, vocabulary), "asked")
    _free(texts, numbered)
    uses = stored(gather(asked, width, sections), "pairs")
    _free(asked)
    ones, twos = (x or 0 for x in uses.agg(F.sum("ones"), F.sum("twos")).first())
    discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
    base, tables, state, totals = 1 / (vocabulary + 1), vocabulary, uses.select(*_STATE_NAMES), []
    hot, seats = _totals(state), None
    for i in range(rounds):
        parent = stored(parent_round(state, seats, width, tables, base, discount, seed * 1000 + 2 * i), "parent")
        customers, tables = np.sum([unpack(bytes(r.body))[0] for r in parent.where("bucket = -1").select("body").collect()] or [[0, 0]], axis=0).tolist()
        before, state = state, stored(context_round(state, parent, width, sections, hot, customers, tables, base, discount, seed * 1000 + 2 * i + 1, i >= burn_in), "state")
        old, seats = seats, stored(parent.where("bucket = -2"), "seats") if i + 1 < rounds else None
        _free(parent, *([before] if i else []), *([old] if i else []))
        hot = _totals(state)
        if i >= burn_in:
            totals.append(hot)
    return Model(state, uses, width, sections, dict(zip(number.tolist(), count.tolist(), strict=True)), totals, total, vocabulary, discount)


def _totals(state: DataFrame) -> dict[int, int]:
    """Tables of the frequent contexts over their sections: at most 8 * width numbers."""
    out: dict[int, int] = {}
    for r in state.select("hot").collect():
        for u, t in unpack(bytes(r.hot))[0].reshape(-1, 2).tolist():
            out[u] = out.get(u, 0) + t
    return out


def score_rows(model: Model) -> DataFrame:
    """Sums of log10 probabilities per (block, bucket)."""
    both = model.state.select("bucket", "pairs", "kept").unionByName(model.uses.select("bucket", "uses"), allowMissingColumns=True)
    width, predictive = model.width, Predictive(model)

    @blocks.frugal
    def run(batches):
        for _, rows in _grouped(batches, "bucket"):
            r = next(x for x in rows if x["pairs"] is not None)
            log_p = np.log10(predictive(Bucket(r["pairs"]), unpack(r["kept"])))
            for x in next(x for x in rows if x["uses"] is not None)["uses"]:
                place, n_uses, step, times = unpack(x["body"])
                own = log_p[np.repeat(np.cumsum(place.astype(np.int64)), n_uses)] * times
                part = np.bincount(np.cumsum(step.astype(np.int64)), weights=own)
                some = np.flatnonzero(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(((x["block"] >> 32) + (x["block"] & 0xFFFFFFFF)) % width)], pa.int32()), pa.array([r["bucket"]], pa.int32()), pa.array([x["block"]]), pa.array([x["rows"]], pa.int32()),
                     pa.array([x["head"]], pa.binary()), pa.array([pack(np.diff(some, prepend=0).astype(np.uint32), part[some])], pa.binary())],
                    names=["slot", "bucket", "block", "rows", "head", "body"])

    return _by_bucket(both, width, "bucket").mapInArrow(run, "slot int, bucket int, block long, rows int, head binary, body binary")


def document_scores(docs: DataFrame, rounds: int = ROUNDS, burn_in: int = BURN_IN, seed: int = 1, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Scores of all whole texts by the model and by add-one unigrams.

    The model learns from documents whose crc32(id as text) mod 7 is not 2.
    Tokens are words in lower case (A-Z), then one end; a text starts in the
    context of an end. One row per input row: ``id_col``, held_out, n_tokens,
    n_known (tokens seen in training), train_tokens (in all), base_score
    (log10, add-one unigrams), score (log10, averaged over the kept rounds).
    Perplexity is 10 ** (-score / n_tokens).

    A null text counts as empty (its end only). Null ids are learnt from and
    stay null; repeated rows count and stay; other columns are ignored; an
    empty table gives an empty result. The same rows in the same files give
    the same scores; another partitioning draws other samples."""
    model = fit(docs, rounds, burn_in, seed, id_col, text_col)
    total = model.train_tokens

    @blocks.frugal
    def finish(batches):
        for _, rows in _grouped(batches, "block"):
            head = [r["head"] for r in rows if r["head"] is not None]
            if len(head) != 1 or len(rows) != rows[0]["rows"]:
                raise RuntimeError("scores of a block are missing")
            ids, null, held, n, known, base_score = unpack(head[0])
            score = np.zeros(len(ids))
            for r in rows:
                step, part = unpack(r["body"])
                score[np.cumsum(step.astype(np.int64))] += part
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                 pa.array(np.full(len(ids), total, np.int64)), pa.array(base_score), pa.array(score)],
                names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score_rows(model).repartitionById(model.width, F.col("slot")).sortWithinPartitions("block", "bucket").mapInArrow(
        finish, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _free(*tables: DataFrame, spark: SparkSession | None = None) -> None:
    """Deletes tables that are read no more; a collection of the driver's
    garbage lets Spark drop the shuffle files behind them."""
    for t in tables:
        discard(t)
    gc.collect()  # plans that Python still holds keep their shuffles
    (spark or tables[0].sparkSession)._jvm.System.gc()
