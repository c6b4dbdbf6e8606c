"""Deduplication of runs of lines, in DataFrame operations only.

A document is the sequence of ids of its lines that aren't blank. Names for windows of
1, 2, 4 ... lines come from prefix doubling over all documents (prefix_doubling), up to
`min_lines` and no further: no suffix array and no LCP values are computed. Suffixes of one
name at that length are those of a longest-common-prefix interval: repeats of that many
lines or more. The copy
with the smallest (id, line) stays, the windows of later ones are deleted; windows that
overlap or adjoin make up the maximal runs. A single line counts as a run from
`min_words` words on: shorter ones (headings, list signs, closing words) recur for other
reasons than copying, and are deleted only with their neighbours.

Shuffled are line ids (16 bytes), and once the texts, to delete lines from them. The
count of ids comes first, so lines that occur once are dropped before anything else. A
line that very many documents share meets its name in an equi-join that adaptive
execution can split.

Defined results: a null or empty text has no lines and stays (a null stays null). Lines
end at \\n; blank lines are left as they are and don't interrupt a run. Rows that repeat
both id and text are one document with one decision; rows that share an id only are
different documents. Null ids sort first. An empty table gives an empty result. Other
columns stay as they are in drop_lines(), and don't appear in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.prefix_doubling import double, first_names
from millrace.llm.shared import split_join, stored

MIN_LINES, MIN_WORDS = 2, 4
KEY = ["_doc", "_of"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _identity(id_col: Column, text: Column) -> list[Column]:
    """A document is known by its id and a hash of its text; a null id counts as the smallest."""
    return [F.coalesce(id_col.cast("bigint"), F.lit(-(2**63))).alias("_doc"), F.xxhash64(text).alias("_of")]


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(_doc, _of, removed, n_runs): the lines to delete of each document that has any, by their number among all its lines, ascending."""
    text = F.coalesce(docs[text_col], F.lit(""))
    full = F.filter(F.transform(_lines(text), lambda x, i: F.struct(i.alias("line"), x.alias("x"))), lambda s: F.trim(s["x"]) != "")
    lines = docs.select(*_identity(docs[id_col], text), F.posexplode(full).alias("at", "s"))
    lines = lines.select(*KEY, "at", F.col("s.line").alias("line"), F.xxhash64("s.x").alias("a"), F.xxhash64(F.lit(1), "s.x").alias("b"), (F.size(F.split(F.trim("s.x"), r"\s+")) >= min_words).alias("long"))

    names = first_names(lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    places = stored(lines.join(names.select("a", "b", "name"), ["a", "b"]).select(*KEY, "at", "line", "long", "name").dropDuplicates([*KEY, "at"]), "lines")
    total = places.count()

    windows, length = places.select(*KEY, "at", "name"), 1
    while length < min_lines:
        step = min(length, min_lines - length)
        windows = double(windows, KEY, "at", step, total)
        length += step
        if length < min_lines:
            windows = stored(windows, "windows")
    hit = _later(windows, min_lines)
    if min_lines > 1:
        hit = hit.unionByName(_later(places.filter("long"), 1)).distinct()
    return hit.join(places.select(*KEY, "at", "line"), [*KEY, "at"]).groupBy(*KEY).agg(
        F.array_sort(F.collect_list("line")).alias("removed"),
        F.array_sort(F.collect_list("at")).alias("ats"),
    ).select(*KEY, "removed", F.size(F.filter("ats", lambda x, i: (i == 0) | (x != F.get(F.col("ats"), i - 1) + 1))).cast("bigint").alias("n_runs"))


def _later(places: DataFrame, length: int) -> DataFrame:
    """(key, at) of all lines in windows whose name an earlier place has."""
    where = F.struct(*KEY, "at")
    first = places.groupBy("name").agg(F.min(where).alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1).select("name", "first")
    later = split_join(places, first, ["name"]).filter(where > F.col("first"))
    return later.select(*KEY, F.explode(F.sequence("at", F.col("at") + length - 1)).alias("at")) if length > 1 else later.select(*KEY, "at")


def _with_removed(docs: DataFrame, id_col: str, text_col: str, **limits: int) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    found = repeated_lines(docs, id_col, text_col, **limits)
    return docs.withColumns(dict(zip(KEY, _identity(docs[id_col], text), strict=True))).join(found, KEY, "left")


def _kept(text: Column) -> Column:
    # The one element of the outer array gives the lines a name, so the text is split once; array_except() looks numbers up by hash.
    both = F.array(F.struct(_lines(text).alias("all"), F.col("removed").alias("gone")))
    left = F.get(F.transform(both, lambda v: F.transform(F.array_except(F.sequence(F.lit(0), F.size(v["all"]) - 1), v["gone"]), lambda i: F.get(v["all"], i))), F.lit(0))
    return F.when(F.col("removed").isNull(), text).when(F.size("removed") == F.size(_lines(text)), F.lit("")).otherwise(F.array_join(left, "\n"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_sha256) for each row: all lines, deleted ones, deleted runs, and the text that is left."""
    rows = _with_removed(docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")), "doc_id", "text", **limits)
    none = F.lit(0).cast("bigint")
    return rows.select(
        "doc_id",
        F.when(F.col("text") == "", none).otherwise(F.size(_lines(F.col("text"))).cast("bigint")).alias("n_lines"),
        F.when(F.col("removed").isNull(), none).otherwise(F.size("removed").cast("bigint")).alias("n_removed"),
        F.coalesce("n_runs", none).alias("n_runs"),
        F.sha2(_kept(F.col("text")).cast("binary"), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, **limits: int) -> DataFrame:
    """docs with the repeated lines deleted from its text; rows that nothing but blank lines are left of go. chars_col gets the new length of changed texts."""
    rows = _with_removed(docs, id_col, text_col, **limits)
    changed = F.col("removed").isNotNull()
    kept = F.when(changed, _kept(F.col(text_col))).otherwise(F.col(text_col))
    rows = rows.withColumn(text_col, kept).filter(~changed | (F.trim(F.translate(text_col, "\n\r\t", "")) != ""))
    if chars_col:
        rows = rows.withColumn(chars_col, F.when(changed, F.char_length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return rows.select(*docs.columns)
