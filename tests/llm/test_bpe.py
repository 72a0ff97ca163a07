import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cohortlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def awkward(n=400, seed=3, length=60):
    r = random.Random(seed)
    parts = ["a", "The", " ", "  ", "   ", "\n", "\t", " ", "　", "\x85", "\x1c", "don't", "'", "'l", "l", "'ve", "é",
             "漢字漢", "123", "<|endoftext|>", "<|endof", "text|>", ".", "!!", "\r\n", "🙂", "x" * 50, "\x00", "word " * 9]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, length))) for _ in range(n)]


def test_joins_of_any_chunks_agree():
    v, r = bpe.vocabulary(PATH), random.Random(9)
    texts = awkward() + ["漢字" * 300, "x" * 500, " " * 200, "'" * 100]
    for text, want in zip(texts, library(texts)):
        cuts = sorted(r.sample(range(1, len(text)), min(len(text) - 1, r.randint(0, 8)))) if len(text) > 1 else []
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        if text:
            got = bpe.join_chunks([bpe._Chunk(v.encode(p), v) for p in parts], v)
            assert got.tolist() == want, (parts,)


def test_chunks_cover_texts_and_follow_content():
    r = random.Random(1)
    shared = "".join(r.choice("abcdefgh é漢 ") for _ in range(20_000))
    texts = [shared, "other start " * 40 + shared, "", "é" * 100_000]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(x) for x in raw])
    cuts = bpe.chunk_ends(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)
    chunks = []
    for x, end, own in zip(raw, ends.tolist(), cuts):
        at = [end - len(x), *own]
        chunks.append([b"".join(raw)[a:b] for a, b in zip(at, own)])
        assert b"".join(chunks[-1]) == x
        for c in chunks[-1]:
            c.decode()
            assert len(c) <= bpe.CHUNK_MAX
    assert len(set(chunks[0]) & set(chunks[1])) >= len(chunks[0]) - 3


def test_encode_and_decode(spark):
    r = random.Random(4)
    texts = awkward(300, 8) + [None, "", " ", "漢字" * 60_000, "x" * 200_000, "same " * 4000, "same " * 4000]
    texts += ["".join(r.choice(["the ", "of ", "erand ", "\n", "tion. "]) for _ in range(60_000))]
    rows = [(i, t, i, "c") for i, t in enumerate(texts)] + [(None, "no id", 0, "c"), (0, texts[0], 0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string").repartition(6)
    got = sorted(((g.doc_id, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in bpe.encode_digests(df, PATH).collect()), key=str)
    want = []
    for (i, t, _, _), ids in zip(rows, library([x[1] for x in rows])):
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_decode_matches_library(spark):
    r, t = random.Random(2), Tokenizer.from_file(PATH)
    ids = [[r.randrange(50257) for _ in range(r.randint(0, 30))] for _ in range(100)]
    df = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)] + [(100, None)], "doc_id long, ids binary")
    got = {g.doc_id: g.decoded for g in bpe.bpe_decode(df, PATH).collect()}
    assert got == {i: t.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)} | {100: None}


def test_empty_table(spark):
    assert bpe.encode_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
