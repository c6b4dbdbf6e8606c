"""Token ids in binary files, compressed by an adaptive context-mixing range coder.

Texts are encoded with the tokenizers library, an end id is appended to each document,
and the documents are laid one after another in ascending id order. The ids are cut into
blocks of `BLOCK`. A block is coded on its own: its models start anew, it has the CRC-32
of its ids, and it says which documents it holds parts of.

A block is coded in `n >> 9` lanes, stretches of at least 512 ids that follow each other, side by
side: at each step every lane codes its next id by the models that all lanes of the block share,
and then the models learn from all these ids.

An id is coded as its rank in the block's alphabet, the sorted list of its ids, which the block
begins with (differences in Rice code). Three predictions of the next id are mixed. Order 0
gives each id of the alphabet a share by how often it came so far. Order 1 and order 2 each
name the id that best followed the one or two ids before, in a slot that trusts it more the
more often it held. Their weights beside order 0 adapt: they are learnt, in each block, for each
trust in the two and for whether they agree, from which came true. The mixture is arithmetic
coded, with the predicted ids' weights added to the counts. Counts are summed anew after 1 / 16 more
steps, weights every fourth step. All arithmetic is in integers, so any machine decodes alike.
Several blocks go through the coder at once; none depends on the others.

File format (little-endian), one binary value for each block: magic `MRTB`, version (u8),
0 (u8), ids (u32), CRC-32 of the ids as u32s (u32), parts of documents (u32), payload words
(u32); for each part u32 first id, u32 ids, u8 flags (1: begins here, 2: ends here) and i64
doc_id; then the payload as u16 words: ranks (two words), the parameter of the Rice code, the
code's quotients and remainders, each from a new word on, the words of each lane, and what the range
coder put out for each (what follows is read as 0). A file is a Parquet container of (part, block,
first, n, doc, data): the files are in order, and so are the blocks of each.

Defined results: a null or empty text is its end id alone. Rows that repeat an id are
written each, in order of their texts. Null ids come first and are read as null. An empty
table gives an empty result. A block whose checksum fails raises ValueError.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import scratch, stored, texts

#: Ids of a block, blocks that are coded at once, words whose ids are kept.
BLOCK, LANES, KEPT = 1 << 18, 6, 700_000
MAGIC, VERSION, NULL_ID = b"MRTB", 3, -(2**63)
HEAD, PART = struct.Struct("<4sBBIIII"), struct.Struct("<IIBq")
#: Ids of a lane and bits of the slots of order 2 and of trust, as powers of two; what a count grows by.
_LANE, _ORDER2, _TRUST, _GROWTH = 9, 17, 3, 2
_SURE, _LOW, _32 = (1 << _TRUST) - 1, np.uint64(1 << 32), np.uint64(32)
#: The pattern whose words WordIds finds by itself; words that the library gets in one text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_JOINED = 1000


class _Range:
    """A range coder in each lane: 64-bit ranges, of which 32 bits are put out at a time; carries go back into what was put out."""

    def __init__(self, lanes: int, data: list[np.ndarray] | None, room: int):
        """data: decoding, the words of each lane. room: 32-bit words of a lane, of which each symbol takes one at most."""
        self.range = np.full(lanes, 2**64 - 1, np.uint64)
        if data is None:
            self.low = np.zeros(lanes, np.uint64)
        else:
            room = max(room, max(map(len, data)) // 2 + 1)
            halves = np.zeros((lanes, 2 * room), np.uint16)
            for row, x in zip(halves, data, strict=True):
                row[: len(x)] = x
        # Words of all lanes, one lane after another; where each lane is.
        self.room, self.words = room, np.zeros(lanes * room, np.uint32)
        self.begin = np.arange(0, lanes * room, room)
        self.at = self.begin.copy()
        if data is not None:
            self.words += halves.ravel()[::2]
            self.words <<= np.uint32(16)
            self.words |= halves.ravel()[1::2]
            self.code = self.words.take(self.at).astype(np.uint64) << _32 | self.words.take(self.at + 1)
            self.at += 2

    def expected(self, m: int, total: np.ndarray) -> np.ndarray:
        """Decoding, where in 0 .. total - 1 the next symbol of lanes 0 .. m - 1 is; ranges become those of 1."""
        whole, t = self.range[:m], total.view(np.uint64)
        whole //= t
        return np.minimum(self.code[:m] // whole, t - np.uint64(1)).view(np.int64)

    def taken(self, before: np.ndarray, size: np.ndarray) -> None:
        """Decoding, after expected(): the symbols were these."""
        whole, code = self.range[: len(size)], self.code[: len(size)]
        code -= whole * before.view(np.uint64)
        whole *= size.view(np.uint64)
        i = np.flatnonzero(whole < _LOW)
        at = self.at.take(i)
        whole[i] = whole.take(i) << _32
        code[i] = code.take(i) << _32 | self.words.take(at)
        self.at[i] = at + 1

    def put(self, before: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        whole, low = self.range[: len(size)], self.low[: len(size)]
        whole //= total.view(np.uint64)
        more = whole * before.view(np.uint64)
        low += more
        self._carry(np.flatnonzero(low < more))
        whole *= size.view(np.uint64)
        i = np.flatnonzero(whole < _LOW)
        at, out = self.at.take(i), low.take(i)
        whole[i] = whole.take(i) << _32
        self.words[at] = out >> _32
        low[i] = out << _32
        self.at[i] = at + 1

    def _carry(self, i: np.ndarray) -> None:
        at = self.at.take(i) - 1
        while len(at):
            more = self.words.take(at) + np.uint32(1)
            self.words[at] = more
            at = at[more == 0] - 1

    def finished(self) -> tuple[np.ndarray, np.ndarray]:
        """A row of u16 words for each lane, and how many count: what follows is read as 0."""
        short = self.low + np.uint64(2**48 - 1) & ~np.uint64(2**48 - 1)  # a number of the range in as few words as can be
        long = self.low + np.uint64(2**32 - 1) & ~np.uint64(2**32 - 1)
        last = np.where(short - self.low < self.range, short, long)
        self._carry(np.flatnonzero(last < self.low))
        self.words[self.at] = last >> _32
        words = self.words.reshape(-1, self.room)[:, : (self.at - self.begin).max() + 1]
        halves = np.stack([words >> 16, words & 0xFFFF], 2).astype(np.uint16).reshape(len(words), -1)
        return halves, ((halves != 0) * np.arange(1, halves.shape[1] + 1)).max(1)


def _alphabet_words(alphabet: np.ndarray) -> np.ndarray:
    """The sorted ids of a block as words."""
    gaps = np.diff(alphabet, prepend=-1) - 1
    k = min(range(32), key=lambda k: int((gaps >> k).sum()) + len(gaps) * k)
    unary = np.zeros(int((gaps >> k).sum()) + len(gaps), np.uint8)
    unary[np.cumsum((gaps >> k) + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(k) & 1).astype(np.uint8).ravel()
    return np.concatenate([np.array([len(gaps) & 0xFFFF, len(gaps) >> 16, k], np.uint16), *(_bit_words(x) for x in (unary, rest))])


def _bit_words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.append(bits, np.zeros(-len(bits) % 16, np.uint8)), bitorder="little").view("<u2").astype(np.uint16)


def _alphabet(words: np.ndarray) -> tuple[np.ndarray, int]:
    """The ids, and how many words they take."""
    n, k = int(words[0]) | int(words[1]) << 16, int(words[2])
    room = n // 8 + 16  # words of quotients looked at; they are about two bits each
    ones = np.zeros(0, np.int64)
    while len(ones) < n:
        room *= 2
        bits = np.unpackbits(words[3 : 3 + room].astype("<u2").view(np.uint8), bitorder="little")
        ones = np.flatnonzero(bits)[:n]
        if room > len(words):
            break
    at = -(-(int(ones[-1]) + 1) // 16) * 16
    bits = np.unpackbits(words[3 : 3 + at // 16 + -(-n * k // 16)].astype("<u2").view(np.uint8), bitorder="little")
    rest = bits[at : at + n * k].reshape(n, k).astype(np.int64) << np.arange(k)
    return np.cumsum(((np.diff(ones, prepend=-1) - 1) << k) + rest.sum(1) + 1) - 1, 3 + at // 16 + -(-n * k // 16)


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique() with return_inverse, without a sort where ids are small."""
    top = int(ids.max())
    if top >= 1 << 18:
        return np.unique(ids, return_inverse=True)
    here = np.zeros(top + 1, bool)
    here[ids] = True
    return np.flatnonzero(here), (np.cumsum(here) - 1).take(ids)


def _lanes(n: int) -> int:
    return max(1, n >> _LANE)


def _code(sizes: list[int], letters: list[int], ranks: list[np.ndarray] | None, data: list[tuple[np.ndarray, np.ndarray]] | None) -> list:
    """Encodes ranks of blocks, or decodes data: (words, how many of each lane). The blocks share steps and nothing else.

    Ranks, predictions and counts of all blocks lie one after another: `base` is where a block's begin.
    """
    blocks = len(sizes)
    n_lanes = np.array([_lanes(n) for n in sizes])
    block = np.repeat(np.arange(blocks), n_lanes)
    number = _ragged(np.zeros(blocks, np.int64), n_lanes)
    # A block's first lanes may be one id longer than the others.
    least, longer = np.array(sizes) // n_lanes, np.array(sizes) % n_lanes
    length, begin = least[block] + (number < longer[block]), least[block] * number + np.minimum(number, longer[block])
    order = np.argsort(-length, kind="stable")  # a block's own lanes stay in order
    block, length, begin = block[order], length[order], begin[order]
    rows = [np.flatnonzero(block == k) for k in range(blocks)]
    # (block, steps, lanes, ids of the block): lanes of a block that are of one length lie side by side.
    runs = []
    for k, (n, r) in enumerate(zip(least.tolist(), rows, strict=True)):
        for size, some in ((n + 1, r[: longer[k]]), (n, r[longer[k] :])):
            if len(some):
                runs.append((k, size, slice(some[0], some[-1] + 1), slice(begin[some[0]], begin[some[-1]] + size)))
    steps, lanes = int(length[0]), len(block)
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # lanes that have an id at each step
    base = np.cumsum(letters) - letters
    all_letters = sum(letters)
    first = base[block]

    table = np.full((steps, lanes), all_letters, np.int32)
    if ranks is not None:
        for k, n, across, ids in runs:
            table[:n, across] = ranks[k][ids].reshape(-1, n).T + base[k]
        coder = _Range(lanes, None, steps + 8)
    else:
        words_of: list = [None] * lanes
        for r, (words, each) in zip(rows, data, strict=True):
            ends = np.cumsum(each)
            for lane, i, j in zip(r.tolist(), (ends - each).tolist(), ends.tolist(), strict=True):
                words_of[lane] = words[i:j]
        coder = _Range(lanes, words_of, steps + 8)
    # What a block's lanes share: counts of ranks and their sums up to each; the predicted rank of a context, shifted, plus the trust in it.
    count = np.ones(all_letters + 1, np.int64)
    next1, next2 = np.repeat(base << _TRUST, letters), np.repeat((base << _TRUST).astype(np.int32), 1 << _ORDER2)
    # How often order 0, 1 and 2 came true, by trust in both and whether both agree.
    contexts = 2 << 2 * _TRUST
    weights = np.ones((blocks * contexts, 3), np.int64)
    counted, due = 0, 0
    last, slot = first.copy(), block << _ORDER2
    first_context, first_slot = block * contexts, block << _ORDER2

    for t, m in enumerate(alive.tolist()):
        if t >= due:  # ever rarer: counts that have grown little needn't be summed anew
            if t:
                count += _GROWTH * np.bincount(table[counted:t].ravel(), minlength=all_letters + 1)
            ends = np.cumsum(count[:-1])
            below = ends[base] - count[base]
            total = np.diff(np.append(below, ends[-1]))
            lane_below, lane_total, block_total = below[block], total[block], np.repeat(total, contexts)[:, None]
            counted, due = t, t + 1 + (t >> 4)
            if ranks is None:
                # How many ranks end at or below each 2**fine-th place: what is sought lies a few ranks further at most.
                fine = max(0, int(ends[-1] // all_letters).bit_length() - 3)
                guide = np.cumsum(np.bincount((ends + (1 << fine) - 1) >> fine))
        if t & 3 == 0 or t < 64:
            more1, more2 = np.minimum(weights[:, 1:] * block_total // weights[:, :1], block_total << 7).T.copy()
        last, slot = last[:m], slot[:m]
        held1, held2 = next1.take(last), next2.take(slot).astype(np.int64)
        said1, said2 = held1 >> _TRUST, held2 >> _TRUST
        trust1, trust2 = held1 & _SURE, held2 & _SURE
        context = first_context[:m] + (trust2 << _TRUST + 1) + (trust1 << 1) + (said1 == said2)
        extra1, extra2 = more1.take(context), more2.take(context)
        whole = lane_total[:m] + extra1 + extra2
        # Order 0 gives each rank its count; what is added to the predicted ranks lies at the ends of theirs.
        if ranks is not None:
            true = table[t, :m].astype(np.int64)
        else:
            at = coder.expected(m, whole) + lane_below[:m]
            end = ends.take(said1) + extra2 * (said2 < said1) - 1
            at = np.minimum(at, np.maximum(end, at - extra1))
            at = np.minimum(at, np.maximum(ends.take(said2) - 1, at - extra2))
            true = guide.take(at >> fine)
            i = np.flatnonzero(ends.take(true) <= at)
            while len(i):
                true[i] = more = true.take(i) + 1
                i = i[ends.take(more) <= at.take(i)]
            table[t, :m] = true
        hit1, hit2 = said1 == true, said2 == true
        size = count.take(true)
        before = ends.take(true) - size - lane_below[:m] + extra1 * (said1 < true) + extra2 * (said2 < true)
        size += extra1 * hit1 + extra2 * hit2
        if ranks is not None:
            coder.put(before, size, whole)
        else:
            coder.taken(before, size)
        weights += np.bincount(context * 3 + np.maximum(hit1, hit2 * 2), minlength=weights.size).reshape(weights.shape)
        # A prediction that fails is trusted less, one without trust is replaced. Of lanes in one context the last counts.
        fresh = true << _TRUST
        next1[last] = np.where(hit1, held1 + (trust1 < _SURE), np.where(trust1 > 0, held1 - 1, fresh))
        next2[slot] = np.where(hit2, held2 + (trust2 < _SURE), np.where(trust2 > 0, held2 - 1, fresh))
        slot = first_slot[:m] + (((true - first[:m]) * 2654435761 + (last - first[:m]) * 2654404609 >> 13) & (1 << _ORDER2) - 1)
        last = true
    if ranks is not None:
        words, n = coder.finished()
        return [(words[r][np.arange(words.shape[1]) < n[r][:, None]], n[r]) for r in rows]
    out = [np.zeros(n, np.int64) for n in sizes]
    for k, n, across, ids in runs:
        out[k][ids] = (table[:n, across].T - base[k]).ravel()
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Payloads of blocks of at most 2**18 ids below 2**32 - 1."""
    if max(map(len, blocks), default=0) > 1 << 18:
        raise ValueError("a block has at most 2**18 ids")
    found = {k: _ranked(x) for k, x in enumerate(blocks) if len(x)}
    out = [np.zeros(0, np.uint16)] * len(blocks)
    if found:
        coded = _code([len(r) for _, r in found.values()], [len(a) for a, _ in found.values()], [r for _, r in found.values()], None)
        for (k, (alphabet, _)), (words, sizes) in zip(found.items(), coded, strict=True):
            out[k] = np.concatenate([_alphabet_words(alphabet), sizes.astype(np.uint16), words])
    return out


def decode_blocks(payloads: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    out = [np.zeros(0, np.int64)] * len(sizes)
    full = [k for k, n in enumerate(sizes) if n]
    if full:
        data, alphabets = [], []
        for k in full:
            alphabet, at = _alphabet(payloads[k])
            begin = at + _lanes(sizes[k])
            alphabets.append(alphabet)
            data.append((payloads[k][begin:], payloads[k][at:begin].astype(np.int64)))
        for k, alphabet, ranks in zip(full, alphabets, _code([sizes[k] for k in full], list(map(len, alphabets)), None, data), strict=True):
            out[k] = alphabet[ranks]
    return out


class _Numbers:
    """Numbers 0, 1, ... for keys in the order they came, in a table with open addressing."""

    def __init__(self, bits: int):
        self.shift, self.mask, self.n = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.slots, self.keys = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits - 1, np.uint64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1: not there."""
        at = (keys >> self.shift).astype(np.int64)
        out = self.slots.take(at)
        left = np.flatnonzero((out >= 0) & (self.keys.take(out) != keys))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            out[left] = self.slots[at[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != keys[left])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Keys that are not there yet, each once; at most half the slots are used."""
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.keys[number] = keys
        self.n += len(keys)
        at = (keys >> self.shift).astype(np.int64)
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = number[free]
            left = self.slots[at] != number
            at, number = at[left] + 1 & self.mask, number[left]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class _Store:
    """Stretches of numbers, one after another in an array that grows."""

    def __init__(self, kind: type):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def add(self, x: np.ndarray) -> int:
        """Where x begins."""
        at = self.used
        self.used += len(x)
        if self.used > len(self.data):
            self.data = np.concatenate([self.data[:at], np.zeros(2 * self.used - at, self.data.dtype)])
        self.data[at : self.used] = x
        return at


class _Known:
    """Words whose ids are known: their letters, and their ids."""

    def __init__(self, kind: type):
        self.numbers, self.letters, self.ids = _Numbers(21), _Store(np.uint16), _Store(kind)
        self.of = _Store(np.int64), _Store(np.int64), _Store(np.int64), _Store(np.int64)  # first letter, letters, first id, ids

    def add(self, keys: np.ndarray, letters: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.numbers.add(keys)
        a, b = self.letters.add(letters), self.ids.add(ids)
        for store, x in zip(self.of, (np.cumsum(sizes) - sizes + a, sizes, np.cumsum(counts) - counts + b, counts), strict=True):
            store.add(x)


class WordIds:
    """Ids of texts, word by word: equal to the library's for texts in the letters that `_PLAIN` allows; others, and those with `<|`, it encodes whole.

    Letters have classes; words are runs of a class (digits alone), but for the endings after an apostrophe. The library encodes
    each word once. It is known by its fingerprint from then on, and its letters are compared with those that the library got.
    """

    #: Texts with other letters, or with such whose small letter is several or beyond them, are left to the library.
    _PLAIN = re.compile("[^" + re.escape("".join(c for c in map(chr, (*b"\t\n\r", *range(0x20, 0x7F), *range(0xA1, 0x250))) if len(c.lower()) == 1 and ord(c.lower()) < 0x250)) + "]")
    _CHARS = 1 << 18
    #: Letters of the pieces that are looked up at once: the more, the more new words the library gets at once.
    _AT_ONCE = 1 << 19

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        lower = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
        split = steps[0].get("pattern", {}).get("Regex") if steps[0].get("type") == "Split" and steps[0].get("invert") and len(steps) == 2 else None
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        self.plain = bool(lower and split == _SPLIT and suffix and not model.get("dropout"))
        if self.plain:
            # Words that are found here are small letters without spaces: the library needn't normalise or search them again.
            words = spec | {"normalizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
            words["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, steps[1]]}
            self.word_library = Tokenizer.from_str(json.dumps(words))
        self.width = np.uint16 if self.library.get_vocab_size() < 65535 else np.uint32
        #: Whether an id ends a word.
        self.final = np.zeros(max(model["vocab"].values()) + 1, bool)
        if self.plain:
            self.final[[k for x, k in model["vocab"].items() if x.endswith(suffix)]] = True
        #: Of each UTF-16 unit, its class (4: none that `_PLAIN` allows) and its small letter.
        self.classes, self.small = np.full(1 << 16, 4, np.uint8), np.zeros(1 << 16, np.uint16)
        for c in map(chr, range(0x250)):
            if not self._PLAIN.match(c):
                self.classes[ord(c)] = 0 if c.isspace() else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3
                self.small[ord(c)] = ord(c.lower())
        self.forget()

    def forget(self) -> None:
        """A worker that goes on to other work should not hold large tables."""
        self.known = _Known(self.width)
        self.powers: tuple[np.ndarray, np.ndarray] | None = None

    def _by_library(self, texts_: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.library.encode_batch(texts_, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str]:
        """Pieces that end with a space, of at most `_CHARS` letters where there are spaces."""
        out = []
        while len(text) > self._CHARS:
            at = text.rfind(" ", 0, self._CHARS) + 1
            if not at:
                break
            out.append(text[:at])
            text = text[at:]
        return [*out, text]

    def encode(self, texts_: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of `width`."""
        out: list[bytes] = [b""] * len(texts_)
        odd: set[int] = set()
        pieces: list[tuple[int, str]] = []
        for k, t in enumerate(texts_):
            cut = self._pieces(t) if self.plain and "<|" not in t else []
            if cut and max(map(len, cut)) <= self._CHARS:
                pieces += [(k, x) for x in cut]
            else:
                odd.add(k)
        at = 0
        while at < len(pieces):
            end, n = at + 1, len(pieces[at][1])
            while end < len(pieces) and n + len(pieces[end][1]) < self._AT_ONCE:
                n += len(pieces[end][1]) + 1
                end += 1
            some = pieces[at:end]
            found = self._plain([x for _, x in some])
            if found is None:
                odd |= {k for k, x in some if self._PLAIN.search(x)}
                some = [(k, x) for k, x in some if k not in odd]
                found = self._plain([x for _, x in some]) or []
            for (k, _), x in zip(some, found, strict=True):
                out[k] += x
            at = end
        left = sorted(odd)
        for k, x in zip(left, self._by_library([texts_[k] for k in left]), strict=True):
            out[k] = x
        return out

    def _plain(self, texts_: list[str]) -> list[bytes] | None:
        """None: a text has letters that `_PLAIN` doesn't allow."""
        text = np.frombuffer(("\n".join(texts_) + "\n   ").encode("utf-16-le", "surrogatepass"), np.uint16)
        kind = self.classes.take(text)
        if kind.max() > 3:
            return None
        text = self.small.take(text)
        inside = kind > 0
        start = inside.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        mark = np.flatnonzero((text == 39) & start)
        a, b = text[mark + 1], text[mark + 2]
        one = mark[(a == 115) | (a == 116) | (a == 109) | (a == 100)]  # 's 't 'm 'd
        two = mark[(((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108))]  # 're 've 'll
        start[one + 1] = start[two + 1] = False
        start[one + 2], start[two + 3] = inside[one + 2], inside[two + 3]
        first = np.flatnonzero(start)
        last = inside.copy()
        last[:-1] &= start[1:] | ~inside[1:]
        size = np.flatnonzero(last) + 1 - first

        if self.powers is None:
            room = max(self._CHARS, self._AT_ONCE) + 8
            odd = np.full(room, 0x2545F4914F6CDD1D, np.uint64)
            back = np.full(room, pow(0x2545F4914F6CDD1D, -1, 2**64), np.uint64)
            odd[0] = back[0] = 1
            self.powers = np.cumprod(odd), np.cumprod(back)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text + np.uint64(1)) * self.powers[0][: len(text)], out=sums[1:])
        key = _mixed((sums.take(first + size) - sums.take(first)) * self.powers[1].take(first) + size.astype(np.uint64))

        if self.known.numbers.n > KEPT:
            self.known = _Known(self.width)
        word = self.known.numbers.find(key)
        new = np.flatnonzero(word < 0)
        if len(new):
            fresh, at = np.unique(key[new], return_index=True)
            self._learn(text, fresh, first[new[at]], size[new[at]])
            word[new] = self.known.numbers.find(key[new])
        letter, letters, first_id, ids = (x.data.take(word) for x in self.known.of)
        if (letters != size).any() or (self.known.letters.data.take(_ragged(letter, letters)) != text[inside]).any():
            return self._by_library(texts_)  # words of one fingerprint
        found = self.known.ids.data.take(_ragged(first_id, ids))
        ends = np.concatenate([[0], np.cumsum(ids)])
        sizes = np.array([len(x) + 1 for x in texts_])
        at = ends[np.searchsorted(first, np.concatenate([[0], np.cumsum(sizes)]))]
        return [found[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _learn(self, text: np.ndarray, keys: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """The library encodes the words, many at once, each with a space after it."""
        ends = np.cumsum(size + 1)
        begins, letters = ends - size - 1, text[_ragged(first, size)]
        spaced = np.full(int(ends[-1]), 32, np.uint16)
        spaced[_ragged(begins, size)] = letters
        cuts = [*begins[::_JOINED].tolist(), len(spaced)]
        joined = [spaced[i:j].tobytes().decode("utf-16-le") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        ids = np.concatenate([np.array(e.ids, self.width) for e in self.word_library.encode_batch_fast(joined, add_special_tokens=False)])
        counts = np.diff(np.flatnonzero(self.final.take(ids)), prepend=-1)
        if len(counts) != len(keys) or counts.sum() != len(ids):
            raise ValueError("the tokenizer's words are not those of its pattern")
        self.known.add(keys, letters, size, ids, counts)


_by_path: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _by_path:
        _by_path[path] = WordIds(path)
    return _by_path[path]


def packed(ids: np.ndarray, spans: list[tuple], payload: np.ndarray) -> bytes:
    head = HEAD.pack(MAGIC, VERSION, 0, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(spans), len(payload))
    return head + b"".join(PART.pack(*s) for s in spans) + payload.astype("<u2").tobytes()


SCHEMA = "part int, block long, first long, n long, doc long, data binary"


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, lanes: int = LANES) -> None:
    """Writes the files to path (any store that Spark writes to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        part, number, first, doc = TaskContext.get().partitionId(), 0, 0, 0
        end = np.array([end_id], ids.width).tobytes()
        ready: list[tuple[int, bytes, list]] = []  # first document, ids, parts
        held, parts, width = bytearray(), [], np.dtype(ids.width).itemsize

        def flush() -> pa.RecordBatch:
            nonlocal number, first, ready
            numbers = [np.frombuffer(x, ids.width).astype(np.int64) for _, x, _ in ready]
            rows = []
            for (d, _, spans), x, payload in zip(ready, numbers, encode_blocks(numbers), strict=True):
                rows.append((part, number, first, len(x), d, packed(x, spans, payload)))
                number, first = number + 1, first + len(x)
            ready = []
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), *(pa.int64(),) * 4, pa.binary()), strict=True)], ["part", "block", "first", "n", "doc", "data"])

        first_doc = 0
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), ids.encode(b.column(1).to_pylist()), strict=True):
                data += end
                at, size = 0, len(data) // width
                while at < size:
                    if not parts:
                        first_doc = doc
                    room = block - len(held) // width
                    n = min(room, size - at)
                    parts.append((len(held) // width, n, (at == 0) + 2 * (at + n == size), NULL_ID if i is None else i))
                    held += data[at * width : (at + n) * width]
                    at += n
                    if n == room:
                        ready.append((first_doc, bytes(held), parts))
                        held, parts = bytearray(), []
                        if len(ready) == lanes:
                            yield flush()
                doc += 1
        if parts:
            ready.append((first_doc, bytes(held), parts))
        if ready:
            yield flush()

    rows = texts(docs, id_col, text_col)
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, SCHEMA).write.parquet(path)


def blocks_of(batches: Iterator[pa.RecordBatch], lanes: int = LANES) -> Iterator[tuple[int, int, int, np.ndarray, list[tuple[int, int, int, int]]]]:
    """(part, first id, first document, ids, parts) of each stored block."""
    held: list[tuple] = []

    def decoded() -> Iterator[tuple]:
        for (part, first, doc, head, spans, _), ids in zip(held, decode_blocks([x[5] for x in held], [x[3][3] for x in held]), strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != head[4]:
                raise ValueError(f"block of part {part} at id {first}: wrong checksum")
            yield part, first, doc, ids, spans

    for b in batches:
        for part, first, doc, data in zip(*(b.column(n).to_pylist() for n in ("part", "first", "doc", "data")), strict=True):
            head = HEAD.unpack_from(data)
            if head[:2] != (MAGIC, VERSION):
                raise ValueError("not a block of this format")
            spans = [PART.unpack_from(data, HEAD.size + k * PART.size) for k in range(head[5])]
            held.append((part, first, doc, head, spans, np.frombuffer(data, "<u2", head[6], HEAD.size + head[5] * PART.size)))
            if len(held) == lanes:
                yield from decoded()
                held = []
    if held:
        yield from decoded()


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, lowest powers in the high bits."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_joined(a: int, b: int, b_bytes: int) -> int:
    """CRC-32 of two byte strings laid end to end, from theirs: a is moved on by x to the power 8 b_bytes."""
    power, square, n = 0x80000000, 0x00800000, b_bytes
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(a, power) ^ b


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _by_path.values():  # what this worker learnt as it wrote
            if w.known.numbers.n:
                w.forget()
        rows: list[tuple] = []
        names = ["part", "doc", "doc_id", "first", "n", "crc", "whole"]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *(pa.int64(),) * 5, pa.bool_()), strict=True)], names)

        for part, first, doc, ids, spans in blocks_of(batches):
            data = ids.astype("<u4").tobytes()
            for k, (at, n, flags, i) in enumerate(spans):
                rows.append((part, doc + k, None if i == NULL_ID else i, first + at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), flags == 3))
            if len(rows) > 50_000:
                yield out()
                rows = []
        if rows:
            yield out()

    @F.pandas_udf("long")
    def joined(pieces):  # noqa: ANN001, ANN202
        def one(x):  # noqa: ANN001, ANN202
            crc, first = 0, True
            for p in sorted(x, key=lambda p: p["first"]):
                crc, first = (p["crc"] if first else crc_joined(crc, p["crc"], 4 * p["n"])), False
            return crc

        return pieces.map(one)

    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, total = [], 0
    for part, n in sizes:
        base.append((part, total))
        total += n
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))  # a row for each file
    pieces = files.select("part", "first", "doc", "data").mapInArrow(run, "part int, doc long, doc_id long, first long, n long, crc long, whole boolean")
    pieces = stored(pieces, "token-pieces", tidy=False).join(bases, "part")  # read twice: blocks are decoded once
    whole = pieces.filter("whole").select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = pieces.filter(~F.col("whole")).groupBy("part", "doc", "doc_id", "base").agg(F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct("first", "n", "crc")).alias("pieces"))
    return whole.union(cut.select("doc_id", F.col("base") + F.col("first"), "n_tokens", joined("pieces")))


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """read_documents() of the files that write() makes in the shared folder."""
    spark = docs.sparkSession
    path = scratch(spark, "token-blocks")
    write(docs, tokenizer, end_id, path)
    return read_documents(spark, path)
