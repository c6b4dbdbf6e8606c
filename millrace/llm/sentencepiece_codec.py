"""SentencePiece encoding and decoding.

Exact merge-type (BPE) encoding by backtracking. An Aho-Corasick automaton over
the vocabulary lists every piece that starts at each position. The encoder takes
the longest one whose neighbour on the left is compatible: two pieces are
compatible if merging their joint text again gives the same two pieces. Where no
piece fits, the position is marked in a bitfield and the last piece is taken
back. A sequence in which all neighbours are compatible is the one that the merge
rule makes, so the result equals the library's.

White space is never inside or at the end of a piece (checked when a model is
loaded), so text is cut where a mark follows another character; each stretch is
encoded once and kept in a bounded table. It is also cut at a line end, and beside
ASCII signs, where the vocabulary has no piece that spans such a place. A character
that no piece has becomes its UTF-8 bytes and merges with nothing.

Defined results: a null or empty text has no ids and decodes to ''. Texts of any
length are encoded whole. Repeated rows give repeated rows. Further columns of the
input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import ship, texts

MARK = "▁"
#: Entries of the tables of stretches and of pairs, after which a table starts anew.
KEPT = 250_000


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.control = {i for i in range(n) if lib.is_control(i)}
        self.unknown = lib.unk_id()
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        odd = self.control | self.byte_of.keys() | {self.unknown}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in odd}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        if len(self.id_of_byte) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids) or any(lib.is_unused(i) for i in self.ids.values()):
            raise ValueError("this needs a BPE model with byte fallback whose pieces have white space in front only")
        for probe, want in (("a", f"{MARK}a"), ("ﬁ  A", f"{MARK}ﬁ{MARK}{MARK}A")):
            if lib.decode(lib.encode(probe)) != probe or self._pieces_of(lib.encode(probe)) != want:
                raise ValueError("this needs a model with a leading mark and no normalisation")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        cut = "\n" if not any("\n" in p for p in self.ids) else ""
        #: Text is also cut between letters and signs, if no piece has such neighbours.
        near = {(x, y) for p in self.ids for x, y in zip(p, p[1:])}
        letters = "".join(x for x in map(chr, range(128, 0x250)) if x.isalpha()) + string.ascii_letters
        signs = re.escape("".join(x for x in string.punctuation if not any((x, y) in near or (y, x) in near for y in letters)))
        whole = f"[{letters}]+(?=[{signs}{MARK}{cut}]|$)|[{signs}]+(?=[{letters}{MARK}{cut}]|$)|" if signs else ""
        self.stretches = re.compile(f"{MARK}*(?:{whole}[^{MARK}{cut}]+)|{MARK}+" + (f"|{cut}" if cut else ""))
        self.none: list[int] = []
        self.size = [len(p) for p in self.pieces]
        self.plain = [i not in self.byte_of for i in range(n)]
        self.surface = ["" if i in self.control else " ⁇ " if i == self.unknown else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.fits: dict[int, bool] = {}  # by left * 2**32 + right
        self.known: dict[str, tuple[str, str]] = {}

    def _pieces_of(self, ids: list[int]) -> str:
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode() for i in ids).decode()

    def merge(self, text: str) -> list[int]:
        """The merge rule itself: always the pair with the best score, the leftmost among equals."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (both := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for p in parts if p for x in self._ids(p)]

    def _ids(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.id_of_byte[b] for b in piece.encode()]

    def _compatible(self, left: int, right: int) -> bool:
        """Left -1: right begins the stretch or follows a character without a piece; it must then be what its own text merges to."""
        if len(self.fits) >= KEPT:
            self.fits.clear()
        ok = self.fits[left << 32 | right] = self.merge((self.pieces[left] if left >= 0 else "") + self.pieces[right]) == [x for x in (left, right) if x >= 0]
        return ok

    def backtrack(self, text: str) -> list[int]:
        """The ids of a stretch, whose marks are all in front."""
        n = len(text)
        starting: list[list[int]] = [self.none] * n  # ids by length, the longest last
        for end, (i, size) in self.automaton.iter(text):
            if (there := starting[end + 1 - size]) is self.none:
                starting[end + 1 - size] = [i]
            else:
                there.append(i)
        fits, size_of, compatible = self.fits, self.size, self._compatible
        taken: list[tuple[int, int, int]] = []  # where it starts, its id (-1: a character without a piece), how many candidates are left
        failed, at, last = 0, 0, -1
        left = len(starting[0]) if n else 0
        while at < n:
            there = starting[at]
            if not there:
                taken.append((at, -1, 0))
                at, last = at + 1, -1
                left = len(starting[at]) if at < n else 0
                continue
            while left:
                left -= 1
                i = there[left]
                if failed and failed >> at + size_of[i] & 1:
                    continue
                if (ok := fits.get(last << 32 | i)) is None:
                    ok = compatible(last, i)
                if ok:
                    taken.append((at, i, left))
                    at, last = at + size_of[i], i
                    left = len(starting[at]) if at < n else 0
                    break
            else:
                failed |= 1 << at
                at, _, left = taken.pop()
                last = taken[-1][1] if taken else -1
        return [x for at, i, _ in taken for x in ((i,) if i >= 0 else self._ids(text[at]))]

    def _entry(self, text: str) -> tuple[str, str]:
        """The ids of a stretch, joined by commas, and what those decode to."""
        if (e := self.known.get(text)) is None:
            ids = self.backtrack(text)
            e = ",".join(map(str, ids)), self._surface(ids)
            if len(self.known) >= KEPT:
                self.known.clear()
            if len(text) <= 64:
                self.known[text] = e
        return e

    def forget(self) -> None:
        """At the end of a partition: a worker that lives on should not hold large tables."""
        if len(self.known) > 20_000:
            self.known, self.fits = {}, {}

    def _cut(self, text: str) -> list[str]:
        return self.stretches.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(x) for part in self._cut(text) for x in self._entry(part)[0].split(",")]

    def _surface(self, ids: list[int]) -> str:
        """Text of ids, the leading space included; bytes that aren't UTF-8 become one U+FFFD each."""
        if all(map(self.plain.__getitem__, ids)):
            return "".join(map(self.surface.__getitem__, ids))
        out: list[str] = []
        held = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i >= 0:
                out.append(self.surface[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._surface(ids)
        first = next((i for i in ids if i not in self.control), self.unknown)
        return text[1:] if first != self.unknown and self.pieces[first].startswith(MARK) else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text). No character's bytes are split by a stretch, so the text is what the stretches' ids decode to, laid end to end, without the leading space."""
        known, entry = self.known, self._entry
        found = [known.get(x) or entry(x) for x in self._cut(text)]
        ids = ",".join([x for x, _ in found])
        return ids.count(",") + 1 if ids else 0, ids, "".join([x for _, x in found])[1:]


def _utf8(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                if n == 4:
                    out.append("�")
                    at += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each Python process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
        c.forget()

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip): encode()'s ids and text as digests, which take less room than the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                n, ids, decoded = c.digest(t)
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == t))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
        c.forget()

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def with_ids(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with one more column, the ids of its text; a clashing column of that name is replaced."""
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c != ids_col]

    def all_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for t in batches:
            yield t.map(lambda x: c.encode(x or ""))
        c.forget()

    ids = F.pandas_udf(all_ids, "array<int>")
    return docs.select(*names, ids(F.coalesce(docs[text_col], F.lit(""))).alias(ids_col))
