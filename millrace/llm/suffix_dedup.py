"""Removal of byte strings that occur twice or more, by prefix doubling over sampled positions.

Every start of a `length`-byte string would be one row in plain prefix doubling, sorted
anew at each offset. Here the positions are sampled first: the anchor of a start p is the
place of the smallest hash of `K` bytes among the places p .. p + `WINDOW` - 1, so equal
strings have their anchors at the same distance. All starts of one anchor share
`length - WINDOW + 1` bytes from the anchor on (the core). Names are fingerprints, and
rows that share a name are found by Spark's shuffles, at growing lengths:

1. by core: anchors whose core occurs once are out, with all their starts;
2. by (core, the whole stretch that the anchor's strings cover): an anchor whose stretch
   occurs again has all its starts repeated. Left are anchors with another neighbourhood;
   one anchor stands for each kind of stretch from here on, however many copies it has;
3. by blocks of `BLOCK` starts at the same distances from the anchor: what all strings of
   a block share, then all that they cover;
4. where blocks share the one and not the other, by single strings: (core, distance) and
   the fingerprint of all `length` bytes, past the threshold.

No group is collected, and no pairs are made: each step counts names, with partial
aggregation, and joins the counts back by equi-joins that adaptive execution can split.
A name stands for bytes with 126 bits: 64 for the core and what is inner, which only rule out,
and 62 for the stretch, the outer bytes and the string, which say that bytes are equal; those
62 are sums modulo a prime, as sums modulo 2**64 collide on structured bytes (fingerprints.py).

Defined results: a null or empty text has no bytes; a text shorter than `length` loses
none. Matches never cross documents; overlaps count, within a document too. Rows that
repeat an id and text are separate documents, so both lose what they share. Rows with
null ids are documents too. An empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.fingerprints import MULTIPLIER, Names, Stretches, mixed
from millrace.llm.shared import release, split_join, stored, texts

LENGTH = 400
#: Places that an anchor is chosen from, bytes that are hashed for that, starts of a block.
WINDOW, K, BLOCK = 200, 24, 25


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def anchors(data: np.ndarray, length: int, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(place, nearest and furthest distance of its starts, core, stretch) of each anchor, by place."""
    starts = len(data) - length + 1
    if starts < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    s = Stretches(data)
    at = np.arange(starts + window - 1)
    value = (s.of(at, at + k) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties: the first place
    rows = np.concatenate([value, np.full(-len(value) % window, 2**64 - 1, np.uint64)]).reshape(-1, window)
    from_left = np.minimum.accumulate(rows, 1).ravel()
    to_right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    place = (np.minimum(to_right[:starts], from_left[window - 1 : window - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [starts])) - 1
    place = place[first]
    near, far = place - last, place - first
    stretch = mixed(Names(data).of(first, last + length) + near.astype(np.uint64) * MULTIPLIER)
    return place, near, far, s.of(place, place + length - window + 1), stretch


def blocks(data: np.ndarray, place: np.ndarray, near: np.ndarray, far: np.ndarray, core: np.ndarray, length: int, block: int) -> tuple[np.ndarray, ...]:
    """For each block of starts of the anchors: (which anchor, block, group, inner, outer, whole?, strings, valid?)."""
    s, names = Stretches(data), Names(data)
    n = far // block - near // block + 1
    of = np.repeat(np.arange(len(place)), n)
    j = near[of] // block + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    p = place[of][:, None] - (j * block)[:, None] - np.arange(block)[None, :]  # by distance
    valid = (p >= 0) & (p + length <= len(data))
    whole = valid.all(1)
    safe = np.where(valid, p, 0)
    strings = names.of(safe, safe + length)
    last, first = p[:, 0], p[:, -1]
    inner = s.of(np.minimum(last, first + length), first + length)
    outer = names.of(np.where(whole, first, 0), np.where(whole, last + length, 0))
    return of, j, mixed(core[of] * MULTIPLIER + j.astype(np.uint64)), inner, outer, whole, strings, valid


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int = WINDOW, k: int = K, block: int = BLOCK) -> DataFrame:
    """(doc_id, _of, spans) of documents with repeated strings: [start, end) of bytes to remove, not merged. _of: hash of the text."""
    window = min(window, max(1, length // 2))
    k, block = min(k, length - window + 1), min(block, window)
    source = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("_of"), "text")
    key = ["doc_id", "_of"]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, of, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                place, near, far, core, stretch = anchors(_bytes(text), length, window, k)
                if len(place):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(place), pa.int64()), pa.array(np.full(len(place), of)), pa.array(place), pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32)), _signed(core), _signed(stretch)], ["doc_id", "_of", "place", "near", "far", "core", "stretch"])

    rows = stored(source.mapInArrow(sample, "doc_id long, _of long, place long, near int, far int, core long, stretch long"), "anchors")
    cores = rows.groupBy("core").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("core")
    left = stored(split_join(rows, cores, ["core"], "left_semi"), "anchors")
    release(rows)

    one = F.struct(*key, "place", "near", "far")
    kinds = stored(left.groupBy("core", "stretch").agg(F.count("*").alias("n"), F.min(one).alias("one")), "kinds")
    several = kinds.filter(F.col("n") > 1).select("core", "stretch")
    spans = split_join(left, several, ["core", "stretch"]).select(*key, (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + length).alias("end"))
    spans = stored(spans, "spans")
    release(left)
    open_cores = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter((F.col("least") == 1) & (F.col("kinds") > 1)).select("core")
    fine = split_join(kinds, open_cores, ["core"], "left_semi").groupBy("one.doc_id", "one._of").agg(F.collect_list(F.struct("one.place", "one.near", "one.far", "core", (F.col("n") > 1).alias("done"))).alias("a"))
    fine = fine.select("doc_id", "_of", *(F.col(f"a.{c}").alias(c) for c in ("place", "near", "far", "core", "done")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, of_text, text, place, near, far, core, done in zip(*(c.to_pylist() for c in b.columns), strict=True):
                place = np.array(place)
                of, j, group, inner, outer, whole, strings, valid = blocks(_bytes(text), place, np.array(near), np.array(far), np.array(core).view(np.uint64), length, block)
                flat = pa.array(strings.ravel().view(np.int64), mask=~valid.ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(of), pa.int64()), pa.array(np.full(len(of), of_text)), pa.array(place[of] - j * block), pa.array(np.array(done)[of]), _signed(group), _signed(inner), pa.array(outer.view(np.int64), mask=~whole), pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * block), flat)],
                    ["doc_id", "_of", "last", "done", "group", "inner", "outer", "strings"],
                )

    paired = source.join(fine, [source.doc_id.eqNullSafe(fine.doc_id), source["_of"] == fine["_of"]]).select(source.doc_id, source["_of"], "text", "place", "near", "far", "core", "done")
    parts = stored(paired.mapInArrow(cut, "doc_id long, _of long, last long, done boolean, group long, inner long, outer long, strings array<long>"), "blocks")
    release(kinds)
    own = F.coalesce("outer", F.xxhash64("doc_id", "_of", "last")).alias("kind")
    parts = parts.select("*", own, F.col("outer").isNull().alias("partial"))
    same = ["group", "kind", "partial"]
    # One block stands for all of its kind; strings are looked up for those alone, in groups of several kinds.
    sorts = stored(parts.groupBy(*same).agg(F.count("*").alias("n"), F.any_value("inner").alias("inner"), F.min(F.struct(*key, "last")).alias("one")), "sorts")
    mine = parts.filter(~F.col("done")).select(*key, "last", *same)
    equal = sorts.filter((F.col("n") > 1) & ~F.col("partial")).select(*same)
    spans = spans.union(mine.join(equal, same, "left_semi").select(*key, (F.col("last") - block + 1).alias("start"), (F.col("last") + length).alias("end")))
    several = sorts.groupBy("group", "inner").agg(F.count("*").alias("m")).filter(F.col("m") > 1).select("group", "inner")
    chosen = split_join(sorts, several, ["group", "inner"], "left_semi").select(*same, F.col("one.doc_id").alias("_id"), F.col("one._of").alias("_text"), F.col("one.last").alias("_last"))
    each = parts.select(*key, "last", *same, "strings").join(chosen, same).filter(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_text")) & (F.col("last") == F.col("_last")))
    each = each.select(*same, F.posexplode("strings").alias("d", "string")).filter(F.col("string").isNotNull())
    each = stored(each, "strings")
    again = each.groupBy("group", "d", "string").agg(F.count("*").alias("m")).filter(F.col("m") > 1).select("group", "d", "string")
    hit = each.join(again, ["group", "d", "string"]).select(*same, "d").distinct()
    single = mine.join(hit, same)
    spans = spans.union(single.select(*key, (F.col("last") - F.col("d")).alias("start"), (F.col("last") - F.col("d") + length).alias("end")))
    spans = stored(spans, "spans")
    for x in (parts, sorts, each):
        release(x)
    return spans.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; adjoining ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; kept: the bytes that are left, which may not be UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for b in batches:
            out = []
            for i, text, starts, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                runs = merged(list(zip(starts or [], ends or [], strict=True)))
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                left = b"".join([*kept, data[at:]])
                out.append((i, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.string(), pa.binary()), strict=True)], names)

    found = repeated(docs, id_col, text_col, length).withColumnsRenamed({"doc_id": "_id", "_of": "_text"})
    source = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("_of"), "text")
    rows = source.join(found, [source.doc_id.eqNullSafe(found["_id"]), source["_of"] == found["_text"]], "left")
    return rows.select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
