"""Benchmark decontamination by spaced-seed hashing.

Texts are sequences of words (lower-cased runs of letters and digits). Each of `MASKS`
is laid on every place; the words under its ones are hashed, those under its zeros
ignored, so a seed still hits where a word was replaced. Seeds of the documents are
looked up among the seeds of the test items. Each hit fixes an item and an offset;
there the two sequences are compared word by word, and of the runs whose score (one
for an equal word, `PENALTY` off for another) isn't below zero, so that at least four
fifths are equal, the one with most equal words is kept. A document is contaminated by an item if the run has `LEAST` equal words,
or four fifths of a shorter item. A run of nine or more equal words never escapes the
masks; of items of 5, 6 or 10 words some runs of exactly 4, 5 or 8 do.

Test items reach the workers in parts of about `PART_BYTES` of text at most (or of one item), whose
index is some 12 bytes for a byte of text; each Python worker holds one part. A larger benchmark
takes more passes over the documents, and none of it is left out. Documents are neither shuffled
nor collected. Where a text and an item repeat the same words, hits are made out `HITS` at a time
and offsets that can't give a better run aren't compared; none is left out.

Defined results: a null, empty or wordless text has no seeds, and such an item matches
nothing. Items and texts shorter than a mask are compared by the shorter masks only;
items of fewer words than the shortest mask by whole. Equal items are reported each.
Rows that repeat are reported each time. Empty tables give an empty result. Further
columns are ignored, and kept by keep_clean().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.fingerprints import MULTIPLIER, Stretches, mixed
from millrace.llm.shared import ship, texts

#: Five words each: without a gap, and around one or two replaced words.
MASKS = ("11111", "111101", "110111", "1101101", "1011011")
LEAST, PENALTY, SHARE = 13, 4, 0.8
PART_BYTES, HITS = 4 << 20, 1 << 20

_of_words: list[np.ndarray] = []


def words(text: str | None) -> np.ndarray:
    """A fingerprint of each word."""
    if not _of_words:
        _of_words.append(np.array([chr(c).isalnum() for c in range(0x110000)]))
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = _of_words[0][codes]
    edges = np.diff(inside)
    return Stretches(codes).of(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))


def seeds(w: np.ndarray, mask: str) -> np.ndarray:
    """A fingerprint of the words under the mask at each place."""
    n = len(w) - len(mask) + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for k, x in enumerate(mask):
        if x == "1":
            out *= MULTIPLIER
            out += w[k : k + n]
    return mixed(out)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(equal words, first, end) of the best run of two sequences laid side by side: most equal words at a score of zero or more, the first among equals, from an equal word to an equal word."""
    equal = a == b
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
    count = np.concatenate(([0], np.cumsum(equal)))
    # For each end the earliest start whose total isn't above the end's: the running minimum is the first to be that low.
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(count - count[start]))
    at = np.flatnonzero(equal[start[end] : end]) + int(start[end])
    return (len(at), int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0, 0)


class Items:
    def __init__(self, rows: list[tuple[int, str | None]]):
        """rows: (item id, text). All items' words are laid end to end; keys are the seeds, sorted, and places where each begins."""
        self.ids = [r[0] for r in rows]
        each = [words(r[1]) for r in rows]
        self.start = np.cumsum([0, *map(len, each)])
        self.words = np.concatenate([np.zeros(0, np.uint64), *each])
        self.short = sorted({len(w) for w in each if 0 < len(w) < 5})
        found = [(seeds(w, m), at) for w, at in zip(each, self.start.tolist(), strict=False) for m in (MASKS if len(w) >= 5 else ("1" * max(1, len(w)),))]
        keys = np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in found)])
        places = np.concatenate([np.zeros(0, np.uint32), *(np.arange(at, at + len(s), dtype=np.uint32) for s, at in found)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]

    def _offsets(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in the text where the item would begin), each once, in order."""
        item, shift, room = np.zeros(0, np.int64), np.zeros(0, np.int64), len(w) + len(self.words) + 1
        for mask in (*MASKS, *("1" * n for n in self.short)):
            s = seeds(w, mask)
            low = np.searchsorted(self.keys, s)
            at = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == s) if len(self.keys) else low[:0]
            if not len(at):
                continue
            low, high = low[at], np.searchsorted(self.keys, s[at], "right")
            ends = np.cumsum(high - low)
            for first in range(0, int(ends[-1]), HITS):
                k = np.arange(first, min(first + HITS, int(ends[-1])))
                of = np.searchsorted(ends, k, "right")
                place = self.places[high[of] - (ends[of] - k)].astype(np.int64)
                n = np.searchsorted(self.start, place, "right") - 1
                code = n * 2 * room + at[of] - (place - self.start[n]) + room  # small enough: items times words
                code = np.unique(np.concatenate([item * 2 * room + shift + room, code]))
                item, shift = code // (2 * room), code % (2 * room) - room
        return item, shift

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, equal words, first and end word in the text) of each contaminating item: its best run, the first among equals."""
        w = words(text)
        item, shift = self._offsets(w)
        size = (self.start[1:] - self.start[:-1])[item]
        room = np.minimum(len(w), shift + size) - np.maximum(0, shift)
        best: dict[int, tuple[int, int, int, int]] = {}
        for k in np.lexsort((shift, -room, item)).tolist():  # the offsets of an item by how many words may be equal
            n, at, most = int(item[k]), int(shift[k]), int(room[k])
            least = min(LEAST, math.ceil(SHARE * int(size[k])))
            if most < least or n in best and (most < best[n][0] or most == best[n][0] and at > best[n][1]):
                continue
            x = self.words[self.start[n] : self.start[n + 1]]
            a = max(0, at)
            equal, first, end = overlap(w[a : a + most], x[a - at : a - at + most])
            if equal >= least and (n not in best or (equal, -at) > (best[n][0], -best[n][1])):
                best[n] = equal, at, a + first, a + end
        return [(self.ids[n], e, first, end) for n, (e, _, first, end) in sorted(best.items())]


def parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> Iterator[Items]:
    """The benchmark as parts of bounded size, each read when it is needed."""
    rows = benchmark.select(benchmark[id_col].cast("bigint").alias("id"), benchmark[text_col].alias("text"))
    n = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / part_bytes))
    for k in range(n):
        yield Items([(r.id, r.text) for r in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, n_equal, first_word, end_word): a row for each document and item that contaminates it."""
    source, out = texts(docs, id_col, text_col), None
    for items in parts(benchmark, part_bytes=part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in shared.value.hits(t)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_equal", "first_word", "end_word"])

        found = source.mapInArrow(run, "doc_id long, item_id long, n_equal long, first_word long, end_word long")
        out = found if out is None else out.union(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of docs that no item contaminates; the columns stay."""
    ship(docs.sparkSession)
    for items in parts(benchmark, part_bytes=part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        @F.pandas_udf("boolean")
        def clean(t, shared=shared):  # noqa: ANN001, ANN202
            return t.map(lambda x: not shared.value.hits(x))

        docs = docs.filter(clean(F.coalesce(docs[text_col], F.lit(""))))
    return docs
