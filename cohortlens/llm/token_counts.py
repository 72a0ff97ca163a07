"""Token counts of texts from the pieces of their distinct pre-tokens."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import shuffle_width

#: White space for the tokenizer or for Python; more of it only joins pre-tokens.
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each pre-token, pre-tokens) of large_string ``texts``.

    A byte-level pre-tokenizer always cuts before a space that follows a
    character other than white space, and looks only forward from there, so
    texts cut at all such places give the same pieces."""
    awkward = pc.match_substring_regex(texts, f"{_SPACE} ").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    at = lists.offsets.to_numpy()
    words, row = lists.values, np.repeat(np.arange(len(texts)), np.diff(at))
    words = words.slice(at[0], at[-1] - at[0]) if len(texts) else words
    first = np.zeros(len(row), bool)
    first[(at[:-1] - at[0])[np.diff(at) > 0]] = True
    # Every word but a text's first is led by the space that it was split at.
    lead = pc.if_else(pa.array(first), "", " ").cast(pa.large_string())
    words = pc.binary_join_element_wise(lead, words.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    if awkward.any():
        keep = ~awkward[row]
        odd = np.flatnonzero(awkward)
        parts = [_BEFORE_SPACE.split(texts[int(i)].as_py()) for i in odd]
        row = np.concatenate([row[keep], np.repeat(odd, [len(p) for p in parts])])
        words = pa.concat_arrays([words.filter(pa.array(keep)),
                                  pa.array([w for p in parts for w in p], pa.large_string())])
    some = pc.not_equal(words, "")
    return row[some.to_numpy(zero_copy_only=False)], words.filter(some)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Token count of every whole text under a byte-level BPE tokenizer file.

    Per block of rows, pre-tokens are reduced to distinct ones with their
    frequency per document. Buckets of pre-tokens merge the distinct ones of
    all blocks, have the library count the pieces of each once, and join the
    counts to the frequencies; a block then sums its documents' shares. Ids
    are never kept.

    One row per input row (repeated rows and ids stay): ``id_col``, n_bytes
    (UTF-8), n_tokens, over_limit (n_tokens > ``limit``). A null text counts
    as empty: 0 bytes, 0 tokens. Null ids stay null; other columns are
    ignored; an empty table gives an empty result."""

    def split(block: pa.Table, width: int):
        ids = block["id"].combine_chunks()
        texts = pc.fill_null(block["text"], "").combine_chunks().cast(pa.large_string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        head = blocks.pack(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), null, sizes)
        row, words = pre_tokens(texts)
        if not len(row):
            return head, []
        coded = words.dictionary_encode()
        codes, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        pair, freq = np.unique(codes * len(texts) + row, return_counts=True)
        code, doc = pair // len(texts), pair % len(texts)
        start = np.searchsorted(code, np.arange(len(known)))
        n_docs = np.diff(np.append(start, len(code)))
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known.cast(pa.large_binary()).to_pylist()),
                             np.uint64, len(known)) % np.uint64(width)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(width + 1).astype(np.uint64))

        def bodies():
            for b in np.flatnonzero(np.diff(ends)):
                own = order[ends[b]:ends[b + 1]]
                at = blocks.ranges(start[own], n_docs[own])
                step = np.diff(doc[at], prepend=0)
                yield int(b), blocks.pack(*blocks.pack_strings(known.take(pa.array(own))), n_docs[own].astype(np.uint32),
                                          step.astype(np.int32), freq[at].astype(np.uint32))

        return head, bodies()

    def serve(bodies):
        parts = [blocks.unpack(b) for b in bodies]
        if not parts:
            return []
        words = pa.chunked_array([blocks.strings(p[0], p[1]) for p in parts]).dictionary_encode().unify_dictionaries()
        known = words.chunk(0).dictionary.cast(pa.large_string())
        t, pieces = _tokenizer(tokenizer), np.zeros(len(known), np.int64)
        for i in range(0, len(known), 20_000):
            batch = known.slice(i, 20_000).to_pylist()
            pieces[i:i + len(batch)] = [len(e) for e in t.encode_batch_fast(batch, add_special_tokens=False)]

        def answers():
            for p, own in zip(parts, words.chunks, strict=True):
                n_docs, step, freq = p[2:]
                each = np.repeat(pieces[own.indices.to_numpy(zero_copy_only=False)], n_docs)
                doc = np.cumsum(step.astype(np.int64))
                yield blocks.pack(np.bincount(doc, weights=each * freq).astype(np.int64))

        return answers()

    def finish(head, bodies):
        ids, null, sizes = blocks.unpack(head)
        total = np.zeros(len(ids), np.int64)
        for b in bodies:
            part = blocks.unpack(b)[0]
            total[:len(part)] += part
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(sizes), pa.array(total),
                                           pa.array(total > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return blocks.exchange(rows, "text", shuffle_width(docs.sparkSession), split, serve, finish,
                           f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
