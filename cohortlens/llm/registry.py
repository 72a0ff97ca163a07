"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import hard_negatives, line_dedup
from .ann import forest_search
from .bpe import encode_digests
from .common import table
from .conversations import conversation_repair
from .language_id import corpus_languages
from .metric_join import cosine_groups
from .mixing import mix
from .pitman_yor import document_scores
from .simhash import simhash_groups
from .token_counts import token_counts
from .toxicity import document_toxicity
from .wrappers import page_texts

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _mixed(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def queries() -> dict[str, Query]:
    return {
        "op1_pitman_yor": lambda s, d: document_scores(table(s, d, "documents")),
        "op2_metric_join": lambda s, d: cosine_groups(table(s, d, "embeddings"), threshold=0.98),
        "op3_toxicity": lambda s, d: document_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op4_bpe_encoding": lambda s, d: encode_digests(table(s, d, "documents"), TOKENIZER),
        "op5_source_mixing": lambda s, d: _mixed(table(s, d, "documents")),
        "op6_forest_search": lambda s, d: forest_search(table(s, d, "embeddings"), every=20, k=20),
        "op7_simhash": lambda s, d: simhash_groups(table(s, d, "documents"), shingle=4, radius=4).select("doc_id", "fingerprint", "component_id"),
        "op8_line_dedup": lambda s, d: line_dedup.page_line_dedup(table(s, d, "pages")),
        "op9_token_counts": lambda s, d: token_counts(table(s, d, "documents"), TOKENIZER),
        "op10_language_id": lambda s, d: corpus_languages(table(s, d, "documents"), table(s, d, "pages")),
        "op11_wrapper_induction": lambda s, d: page_texts(table(s, d, "pages")),
        "op12_hard_negatives": lambda s, d: hard_negatives.embedding_negatives(table(s, d, "embeddings")),
        "op13_conversation_repair": lambda s, d: conversation_repair(table(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": line_dedup.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
