"""A corpus pipeline of five stages: language ID, line dedup, near-duplicate removal, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents. Every stage works on all rows that its predecessor kept.

A document without a text, with an empty one or without a letter has no language and goes in
the first stage; given to a later one, it has no lines, is a near duplicate of other such
documents only (one stays), matches no item and has no tokens. Rows that repeat an id and a text
share each decision; rows that share an id only are decided by their texts. Null ids are ids like
any other, and stay only where no other row of a class has one. Further columns stay as they
are. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, language_id, line_dedup, order_minhash, sentencepiece_codec
from millrace.llm.shared import stored, table

#: Score that a document's nearest language needs: the least of a labelled document is 0.366 (sf0.1), samples of other Latin-script languages and of junk have at most 0.268.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or nearer to nothing than to any learned language, go."""
    return language_id.keep_known(docs, language_id.learn(docs), LEAST_SCORE)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted from the texts; documents that nothing is left of go."""
    return line_dedup.drop_lines(docs, chars_col="n_chars")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return order_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each text and their number."""
    import public_tokenizers

    rows = sentencepiece_codec.with_ids(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("order_minhash", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: SQL can express neither the profiles nor the sketches nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
