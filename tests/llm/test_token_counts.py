import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlens.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_counts_match_library(spark):
    r = random.Random(5)
    parts = ["a", "The", " ", "  ", "   ", "\n", "\t", " ", "　", "\x85", "\x1c", "don't", "'ll", "é", "漢字", "123",
             "<|endoftext|>", "<|endof", "text|>", ".", "!!", "\r\n", "🙂", " ", "x" * 300, "\x00", "​"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(600)]
    texts += [None, "", " ", "\n\n", "word " * 30_000, "same text", "same text", " lead", "trail "]
    rows = [(i, x, 1, True) for i, x in enumerate(texts)] + [(None, "no id", 1, True), (3, texts[3], 1, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, over_limit boolean").repartition(5)
    got = token_counts(df, PATH).collect()
    want = sorted(zip([x[0] for x in rows], [len((x[1] or "").encode()) for x in rows], expected([x[1] for x in rows])), key=str)
    assert sorted([(g.doc_id, g.n_bytes, g.n_tokens) for g in got], key=str) == want
    assert all(g.over_limit == (g.n_tokens > 512) for g in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(df, PATH).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], expected([r.text for r in rows])))
