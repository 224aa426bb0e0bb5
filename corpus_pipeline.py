"""The document pipeline: each stage takes the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chunk_codec import encode_and_decode
from lodestone.llm.decontaminate import find_contamination
from lodestone.llm.language_id import identify_languages, train
from lodestone.llm.near_dedup import drop_near_duplicates
from lodestone.llm.queries import table, tokenizer_file
from lodestone.materialize import materialize

#: A document is rejected if no language has at least this score.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; texts that are null, without letters or of no clear language go."""
    return identify_languages(docs, train(docs), min_score=MIN_LANGUAGE_SCORE)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit_spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the documents and the text that they decode to."""
    return encode_and_decode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: Models and hashes take part in the stages: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of ``sf_dir``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
