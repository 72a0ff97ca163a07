"""Byte-level BPE encoding with content-defined chunk reuse, and decoding."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import shuffle_width

#: A chunk ends where the rolling hash of so many bytes falls in one of 2**CHUNK_BITS classes.
WINDOW, CHUNK_BITS = 16, 10
#: Least and greatest bytes of a chunk.
CHUNK_MIN, CHUNK_MAX = 256, 1 << 16
_FACTOR = 0x9E3779B1
#: Compression of chunks and ids on their way: they are most of what is shuffled.
LEVEL = 6


class Vocabulary:
    """The parts of a byte-level BPE tokenizer file that encoding needs."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), spec["normalizer"]) != ("ByteLevel", False, True, None):
            raise ValueError("not a plain byte-level BPE tokenizer")
        # Byte-level vocabularies write each byte as a printable character.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(map(as_byte.__getitem__, w)): i for w, i in model["vocab"].items()}
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            if model["vocab"][a + b] != 256 + i:
                raise ValueError("ids do not follow the order of the merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {w: i for w, i in ranks.items() if i not in set(self.special.values())}
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for w, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes[i] = w
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        mark = "|".join(map(regex.escape, self.special)) or "(?!)"
        # The fixed pre-token pattern of byte-level BPE ...
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        # ... and the same where special strings end the text before them.
        # (\s of the tokenizer is Unicode's White_Space; Python's has more.)
        ws = r"\p{White_Space}"
        self.pieces = regex.compile(
            rf"{mark}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{mark})[^{ws}\p{{L}}\p{{N}}])+"
            rf"|{ws}+(?={mark})|{ws}+(?![^{ws}])|{ws}+")
        # A piece looks at no more than so many characters behind its end.
        self.ahead = max([3, *map(len, self.special)])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def chunk_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the content-defined chunks of texts at starts..ends of UTF-8 ``data``."""
    h = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)[data]
    step, power = 1, _FACTOR
    while step < WINDOW:
        h[step:] += h[:-step] * np.uint32(power)
        step, power = 2 * step, power * power % (1 << 32)
    hits = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    first = np.searchsorted(hits, starts)
    last = np.searchsorted(hits, ends)
    out = []
    for start, end, i, j in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
        own, at = [], start
        for cut in [*hits[i:j].tolist(), end]:
            while cut - at > CHUNK_MAX:
                forced = at + CHUNK_MAX
                while data[forced] & 0xC0 == 0x80:
                    forced -= 1
                own.append(forced)
                at = forced
            while cut < end and data[cut] & 0xC0 == 0x80:
                cut += 1
            if cut == end or cut - at >= CHUNK_MIN:
                if cut > at:
                    own.append(cut)
                at = cut
            if cut == end:
                break
        out.append(own)
    return out


class _Chunk:
    """A chunk's ids, text and a place near its end where its pieces surely end."""

    def __init__(self, ids: np.ndarray, v: Vocabulary):
        self.ids, self.v = ids, v
        self.text = b"".join(map(v.bytes.__getitem__, ids.tolist())).decode()
        self.at = np.cumsum(v.lengths[ids])
        limit = len(self.text) - v.ahead
        j = self.text.rfind(" ", max(0, limit - 200), limit + 1) if limit > 0 else -1
        while j > 0 and self.text[j - 1].isspace():
            j = self.text.rfind(" ", max(0, limit - 200), j)
        if j <= 0:
            j = 0
            for m in v.pieces.finditer(self.text):
                if m.end() > limit:
                    break
                j = m.end()
        self.tail = j

    def token(self, char: int, from_end: bool = False) -> int:
        """Number of ids before character ``char``, where a piece ends."""
        if char == 0:
            return 0
        n = self.at[-1] - len(self.text[char:].encode()) if from_end else len(self.text[:char].encode())
        return int(np.searchsorted(self.at, n)) + 1


def join_chunks(chunks: list[_Chunk], v: Vocabulary) -> np.ndarray:
    """Ids of the text that the chunks make up.

    Encoding stops at piece ends and a piece depends only on the text from
    its start, so two encodings agree from the first place where both end a
    piece. Each join is encoded again, from the last sure piece end before
    it, until the new pieces and those of the next chunk end in one place."""
    if len(chunks) == 1:
        return chunks[0].ids
    first = chunks[0]
    out, pending = [first.ids[:first.token(first.tail, True)]], first.text[first.tail:]
    for k, chunk in enumerate(chunks[1:], 2):
        text, shift = pending + chunk.text, len(pending)
        sure = len(text) - (0 if k == len(chunks) else v.ahead)
        own, x = v.pieces.finditer(chunk.text), shift
        agreed, new = -1, []
        for m in v.pieces.finditer(text):
            if m.end() > sure:
                break
            new.append(m.group())
            if m.end() < shift:
                continue
            while x < m.end():
                x = shift + next(own).end()
            if x == m.end():
                agreed = x
                break
        if agreed < 0:
            pending = text
            continue
        # Piece by piece: cut off here, white space would meet an end of text.
        out.extend(map(v.encode, new))
        tail = max(chunk.tail, agreed - shift)
        stop = len(chunk.ids) if k == len(chunks) else chunk.token(tail, True)
        out.append(chunk.ids[chunk.token(agreed - shift):stop])
        pending = "" if k == len(chunks) else chunk.text[tail:]
    if pending:
        out.append(v.encode(pending))
    return np.concatenate(out)


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text, as the tokenizers library gives them
    without added special tokens (special strings inside texts are matched).

    Texts are cut into content-defined chunks. A bucket gathers the distinct
    chunks of all blocks and encodes each once; a block puts its documents
    together from them and encodes each join again until both sides agree.

    One row per input row: ``id_col``, n_tokens, ids (binary, little-endian
    unsigned 32-bit). A null text counts as empty and gives no ids; null ids
    and repeated rows stay; other columns are ignored; an empty table gives
    an empty result. A text longer than a block is a block of its own."""

    def split(block: pa.Table, width: int):
        ids = block["id"].combine_chunks()
        texts = pc.fill_null(block["text"], "").combine_chunks().cast(pa.large_string())
        null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        size, data = blocks.pack_strings(texts)
        ends = np.cumsum(size.astype(np.int64))
        cuts = chunk_ends(data, ends - size, ends)
        head = blocks.pack(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), null,
                           np.array([len(c) for c in cuts], np.uint32), ends)
        raw, found = data.tobytes(), {}
        for doc, (start, own) in enumerate(zip((ends - size).tolist(), cuts, strict=True)):
            for k, end in enumerate(own):
                found.setdefault(raw[start:end], []).append((doc, k))
                start = end
        buckets: dict[int, list[bytes]] = {}
        for chunk in found:
            buckets.setdefault(xxhash.xxh3_64_intdigest(chunk) % width, []).append(chunk)

        def bodies():
            for b, own in buckets.items():
                places = np.array([p for c in own for p in found[c]], np.uint32).reshape(-1, 2)
                yield b, blocks.pack(np.array([len(c) for c in own], np.uint32), np.frombuffer(b"".join(own), np.uint8),
                                     np.array([len(found[c]) for c in own], np.uint32),
                                     np.ascontiguousarray(places[:, 0]), np.ascontiguousarray(places[:, 1]), level=LEVEL)

        return head, bodies()

    def serve(bodies):
        v, known = vocabulary(tokenizer), {}
        kind = np.uint16 if v.size <= 1 << 16 else np.uint32
        for body in bodies:
            size, data, n_places, doc, place = blocks.unpack(body)
            raw, at, ids = data.tobytes(), 0, []
            for n in size.tolist():
                chunk = raw[at:at + n]
                if (got := known.get(chunk)) is None:
                    got = known[chunk] = v.encode(chunk.decode()).astype(kind)
                ids.append(got)
                at += n
            # (as bytes: pairs of ids repeat, which planes of their bytes would hide)
            yield blocks.pack(np.array([len(x) for x in ids], np.uint32), np.concatenate(ids).view(np.uint8), n_places, doc, place, level=LEVEL)

    def finish(head, bodies):
        v = vocabulary(tokenizer)
        ids, null, n_chunks, _ = blocks.unpack(head)
        docs: list[list] = [[None] * n for n in n_chunks.tolist()]
        for body in bodies:
            size, data, n_places, doc, place = blocks.unpack(body)
            at = np.concatenate([[0], np.cumsum(size.astype(np.int64))]).tolist()
            data = data.view(np.uint16 if v.size <= 1 << 16 else np.uint32).astype(np.uint32)
            owner = np.repeat(np.arange(len(size)), n_places).tolist()
            for c, d, p in zip(owner, doc.tolist(), place.tolist(), strict=True):
                docs[d][p] = data[at[c]:at[c + 1]]
        done, made = [], {}
        for d, own in enumerate(docs):
            if len(own) > 1:
                # Chunks that a block's documents share are views of the same ids.
                own = [made.get(key := (x.__array_interface__["data"][0], len(x))) or made.setdefault(key, _Chunk(x, v)) for x in own]
                done.append(join_chunks(own, v).astype("<u4").tobytes())
            else:
                done.append(own[0].astype("<u4").tobytes() if own else b"")
            docs[d] = None
            if len(made) > 5000:
                made.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null.astype(bool)), pa.array([len(x) // 4 for x in done], pa.int64()), pa.array(done, pa.binary())],
            names=[id_col, "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return blocks.exchange(rows, "text", shuffle_width(docs.sparkSession), split, serve, finish,
                           f"`{id_col}` long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids (binary, as from ``bpe_encode``);
    bytes that are not UTF-8 become U+FFFD, null ids give a null text."""
    names = [c for c in encoded.columns if c != out_col]

    @blocks.frugal
    def decode(batches):
        v = vocabulary(tokenizer)
        flat = np.frombuffer(b"".join(v.bytes), np.uint8)
        start = np.cumsum(v.lengths) - v.lengths
        for batch in batches:
            out = []
            for x in batch.column(ids_col):
                raw = x.as_buffer()
                if raw is None:
                    out.append(None)
                    continue
                ids = np.frombuffer(raw, "<u4")
                out.append(flat[blocks.ranges(start[ids], v.lengths[ids])].tobytes().decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out_col)
    return encoded.mapInArrow(decode, f"{fields}, `{out_col}` string")


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of each document's ids and of the text decoded from them."""
    out = bpe_decode(bpe_encode(docs, tokenizer), tokenizer)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
