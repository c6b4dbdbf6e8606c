"""Exact deduplication by progressive refinement, in DataFrame operations only.

Texts are equal when identical after A-Z became a-z. Rows are first grouped by
length; rows of a length that occurs once are out. The others are grouped by length
and a hash of their first characters, and rows alone in such a group are out. Only
what is left is grouped by the SHA-256 of the whole normalised text. Each stage
counts narrow rows with partial aggregation, so a group that holds a third of all
rows is added up where it lies; the joins back are plain equi-joins between shuffled
sides, which adaptive execution splits when one key is hot. keepers() hashes whole texts
of surviving groups only; to know them before a whole text is read again, texts are
shuffled once, along with their prefix hash. exact_dedup() also gives the hash of
every other text, each text being hashed once.

Defined results: null counts as empty. Of equal texts the largest id stays; rows with
a null id stay only where no other row of the group has an id. Rows that repeat an id
share its decision. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import split_join, stored, texts

#: Characters that the second stage hashes.
PREFIX = 64


def fold(text: Column) -> Column:
    """A-Z to a-z, all else as it is. lower() does just that, and faster, where each character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _fronts(rows: DataFrame, prefix: int) -> tuple[DataFrame, Column]:
    """The prefix hashes that several rows have, of those whose length several rows have; and the hash itself."""
    size = F.octet_length("text").alias("size")
    front = F.xxhash64(F.octet_length("text"), fold(F.substring("text", 1, prefix))).alias("front")
    several = F.col("n") > 1
    sizes = rows.select(size).groupBy("size").agg(F.count("*").alias("n")).filter(several).select("size")
    return split_join(rows.select(size, front), sizes, ["size"], "left_semi").groupBy("front").agg(F.count("*").alias("n")).filter(several).select("front"), front


def hashes(rows: DataFrame, prefix: int = PREFIX, every: bool = False) -> DataFrame:
    """(doc_id, again, text_sha256) of rows (doc_id, text); the hash is null for rows out by length or prefix (again: false), unless every is set."""
    fronts, front = _fronts(rows, prefix)
    whole = F.sha2(fold(F.col("text")).cast("binary"), 256)
    again = F.coalesce("again", F.lit(False))
    marked = split_join(rows.select("doc_id", front, "text"), fronts.withColumn("again", F.lit(True)), ["front"], "left")
    return marked.select("doc_id", again.alias("again"), (whole if every else F.when(again, whole)).alias("text_sha256"))


def _decided(hashed: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of what hashes() gives; rows that are out keep themselves."""
    groups = hashed.filter("again").groupBy("text_sha256").agg(F.max("doc_id").alias("most"), F.count("*").alias("n")).filter(F.col("n") > 1)
    return (
        split_join(hashed, groups, ["text_sha256"], "left")
        .select(
            "doc_id",
            F.coalesce("most", "doc_id").alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
            F.coalesce(F.col("doc_id") == F.col("most"), F.col("most").isNull()).alias("kept"),
            "text_sha256",
        )
    )


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) for each row. No text is hashed whole but those of surviving groups."""
    hashed = stored(hashes(texts(docs, id_col, text_col), prefix), "hashes")
    alone = hashed.filter(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    return _decided(hashed.filter("again")).drop("text_sha256").union(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row."""
    return _decided(stored(hashes(texts(docs, id_col, text_col), prefix, every=True), "hashes"))
