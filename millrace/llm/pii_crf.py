"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans of e-mail and IP addresses, card and phone numbers. The
field labels tokens (runs without white space) and finds what the patterns miss: the
same number written otherwise, two numbers run together, half of an address. Its
variables are the tokens that have a digit or an @; all others can only be outside, so
the chain is cut there. Base tokens are clamped to their kind. Potentials:

* features of the token (counts of digits, signs, the checksum, where it is in a run);
* transitions between tokens that adjoin;
* skip edges: a token and the next one of the document with the same key share a potential
  that rewards equal labels. Keys of equal tokens: the text, the digits. Keys of similar ones:
  the last `TAIL` digits, either half of the digits and their number (so numbers that differ in
  one digit meet), an address's letters and digits without its signs.

Edges link a token with the next of its key, so a document has few more edges than
tokens however often one repeats. Sum-product messages pass over the loopy graph for at
most `ROUNDS` rounds. A token whose most likely label is a kind, with `SURE` or more,
adds a span; tokens that adjoin and have one label are one span.

Weights are learnt by pseudo-likelihood from about `SAMPLE` documents of at most `TOKENS` such tokens,
chosen by a hash of the id (the documented bound). The truth are the patterns' labels, which a token's own features
nearly give away; so each token that has an edge is learnt from `BLURRED` times more with most of
its features hidden, and there only its neighbours can tell. Tokens that a skip edge links to a
pattern's token, but that no pattern knows, are left out: the patterns' silence is not the truth
about them. Prediction reads
every whole text. Patterns run in linear time: each starts at most once in a run.

Defined results: a null or empty text has no spans; base spans always stay, and an added
one never overlaps them. Repeated rows give repeated rows, an empty table an empty
result, further columns are ignored. Without a document to learn from nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE, ROUNDS, SURE, TAIL = 5000, 20, 0.9, 7
#: Further copies of a token that has an edge, and the share of its features that each hides.
BLURRED, HIDDEN = 2, 0.7
#: Tokens of a document that is learnt from at most; one with more isn't chosen. So SAMPLE * TOKENS bounds what reaches the driver.
TOKENS = 1000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9@]\S*")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match ends at the first @ with a character for the local part before it and a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = end = m.end()
            yield start, end
        free = max(free, end)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as an index of KINDS, end), sorted."""
    if not _SOME.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


#: The number of features, of labels (0: outside), and of values of a feature that counts.
N_FEATURES, N_LABELS, STEPS = 61, 5, 8


def _features(token: str, digits: str, first: bool, last: bool) -> list[int]:
    """Indices of the features that a token has."""
    n = len(digits)
    letters = sum(1 for _ in islice(filter(str.isalpha, token), STEPS - 1))
    on = [0, 1 + min(n, 20), 22 + min(token.count("."), STEPS - 1), 30 + min(token.count("-"), STEPS - 1), 38 + letters]
    return on + [46 + k for k, x in enumerate(("@" in token, token[0] == "+", token[0] == "(", ")" in token, ":" in token, "=" in token, "/" in token, 12 <= n <= 19 and luhn(digits), n == len(token), "%" in token, first, last, "_" in token, n > 20, '"' in token)) if x]


class Lattice:
    """The variables of a document and their edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans: list[tuple[int, int]] = []
        at = 0
        while m := _TOKEN.search(text, at):
            start = m.start()
            while start > at and not text[start - 1].isspace():
                start -= 1
            self.spans.append((start, m.end()))
            at = m.end()
        n = len(self.spans)
        self.joined = [k > 0 and text[self.spans[k - 1][1] : a].isspace() and a - self.spans[k - 1][1] <= 2 for k, (a, _) in enumerate(self.spans)]
        self.label, k = [-1] * n, 0
        for a, kind, b in base:
            while k and self.spans[k - 1][1] > a:
                k -= 1
            while k < n and self.spans[k][0] < b:
                if self.spans[k][1] > a and self.label[k] < 0:
                    self.label[k] = kind + 1
                k += 1
        self.on, self.skip, seen = [], [], {}
        for k, (a, b) in enumerate(self.spans):
            token = text[a:b]
            digits = "".join(_DIGIT.findall(token))
            self.on.append(_features(token, digits, not self.joined[k], k + 1 == n or not self.joined[k + 1]))
            bare = token.strip(".,;:!?#%$&*|\"'()[]{}<>")
            half = len(digits) // 2
            keys = [("text", bare.lower())] * ("@" in bare or len(digits) >= 3) + [("digits", digits)] * (len(digits) >= 4) + [("tail", digits[-TAIL:])] * (len(digits) >= TAIL)
            keys += [("left", digits[:half], len(digits)), ("right", digits[half:], len(digits))] * (len(digits) >= 2 * TAIL - 4)
            keys += [("letters", "".join(filter(str.isalnum, bare.lower())))] * ("@" in bare)
            near = {seen[x] for x in keys if x in seen}
            self.skip += [(j, k) for j in sorted(near)]
            seen.update(dict.fromkeys(keys, k))


class Field:
    def __init__(self, node: np.ndarray, step: np.ndarray, skip: float):
        """Weights: of features and labels, of a label and the next one's, of equal labels along a skip edge."""
        self.node, self.step, self.skip = node, step, skip

    @classmethod
    def learn(cls, docs: list[tuple[list[list[int]], list[int], list[bool], list[tuple[int, int]]]], rounds: int = 300) -> Field:
        """docs: (features, labels, joined, skip edges) of each. Ascends the pseudo-likelihood, each label given its neighbours'."""
        x, y, left, right, near = [], [], [], [], []
        for on, label, joined, skip in docs:
            at = len(y)
            y += [max(v, 0) for v in label]
            x += on
            left += [label[k - 1] if joined[k] and label[k - 1] > 0 else 0 for k in range(len(label))]
            right += [label[k + 1] if k + 1 < len(label) and joined[k + 1] and label[k + 1] > 0 else 0 for k in range(len(label))]
            near += [(at + i, max(label[j], 0)) for j, k in skip for i, j in ((j, k), (k, j))]
        node, step, skip = np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), 0.0
        if not y:
            return cls(node, step, skip)
        n = len(y)
        dense = np.zeros((n, N_FEATURES))
        for k, on in enumerate(x):
            dense[k, on] = 1
        agree = np.zeros((n, N_LABELS))
        for i, v in near:
            agree[i, v] += 1
        y, left, right = np.array(y), np.array(left), np.array(right)
        # What a skip edge links to a kind, and no pattern knows, teaches nothing; tokens with edges come again with features hidden.
        sure = (y > 0) | (agree[:, 1:].sum(1) == 0)
        again = np.repeat(np.flatnonzero(sure & (agree.sum(1) > 0)), BLURRED)
        pick = np.concatenate([np.flatnonzero(sure), again])
        seen = np.ones((len(pick), N_FEATURES))
        seen[len(pick) - len(again) :] = np.random.default_rng(0).random((len(again), N_FEATURES)) >= HIDDEN
        seen[:, 0] = 1
        dense, agree, y, left, right, n = dense[pick] * seen, agree[pick], y[pick], left[pick], right[pick], len(pick)
        truth = np.eye(N_LABELS)[y]
        by_left, by_right = np.eye(N_LABELS)[left], np.eye(N_LABELS)[right]
        speed = [np.zeros_like(node), np.zeros_like(step), 0.0]
        for _ in range(rounds):
            z = dense @ node + by_left @ step + by_right @ step.T + skip * agree
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            off = (truth - p) / n
            slope = dense.T @ off - 1e-4 * node, by_left.T @ off + off.T @ by_right - 1e-4 * step, (off * agree).sum() - 1e-4 * skip
            speed = [0.9 * v + g for v, g in zip(speed, slope, strict=True)]
            node, step, skip = node + speed[0], step + speed[1], skip + speed[2]
        return cls(node, step, float(skip))

    def marginals(self, on: list[list[int]], label: list[int], joined: list[bool], skip: list[tuple[int, int]]) -> np.ndarray:
        """Beliefs of each token's labels, by loopy sum-product; label -1: not clamped."""
        n = len(on)
        local = np.stack([self.node[x].sum(0) for x in on])
        ends = np.array([not j for j in joined])
        local[ends] += self.step[0]  # what adjoins a cut is outside
        local[np.append(ends[1:], True)] += self.step[:, 0]
        local -= local.max(1, keepdims=True)
        clamped = np.array(label) >= 0
        local[clamped] = -60.0
        local[clamped, np.array(label)[clamped]] = 0.0
        chain = [(k - 1, k) for k in range(1, n) if joined[k]]
        edges = np.array([*chain, *skip], dtype=np.int64).reshape(-1, 2)
        if not len(edges):
            return _normal(local)
        same = np.eye(N_LABELS) * self.skip
        table = np.exp(np.concatenate([np.broadcast_to(self.step, (len(chain), N_LABELS, N_LABELS)), np.broadcast_to(same, (len(skip), N_LABELS, N_LABELS))]))
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        m = len(edges)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        message = np.zeros((2 * m, N_LABELS))  # logarithms
        for _ in range(ROUNDS):
            total = local.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            out = np.log(np.einsum("ea,eab->eb", np.exp(out - out.max(1, keepdims=True)), table) + 1e-300)
            out -= out.max(1, keepdims=True)
            change = np.abs(np.exp(out) - np.exp(message)).max()
            message = 0.5 * message + 0.5 * out
            if change < 1e-3:
                break
        total = local.copy()
        np.add.at(total, target, message)
        return _normal(total)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans beside the base ones."""
        if not self.node.any() or not _SOME.search(text):
            return []
        x = Lattice(text, base)
        if all(v >= 0 for v in x.label):
            return []
        belief = self.marginals(x.on, x.label, x.joined, x.skip)
        best = belief.argmax(1)
        out: list[tuple[int, int, int]] = []
        taken, k = sorted((a, b) for a, _, b in base), 0
        before = -1
        for i, (a, b) in enumerate(x.spans):
            if x.label[i] >= 0 or not best[i] or belief[i, best[i]] < SURE:
                continue
            token = text[a:b]
            lead = len(token) - len(token.lstrip(".,;:!?#%$&*|\"'[]{}<>"))
            a, b = a + lead, a + len(token.rstrip(".,;:!?#%$&*|\"'[]{}<>"))
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if a >= b or (k < len(taken) and taken[k][0] < b):
                continue
            if out and before == i - 1 and x.joined[i] and out[-1][1] == best[i] - 1 and not (k and taken[k - 1][1] > out[-1][2]):
                out[-1] = out[-1][0], out[-1][1], b
            else:
                out.append((a, int(best[i]) - 1, b))
            before = i
        return out


def _normal(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    rows = texts(docs, id_col, text_col).filter(F.col("text").rlike("[0-9@]"))
    total = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = Lattice(t, base_spans(t))
                if len(x.on) > TOKENS:
                    continue
                out.append((i, x.on, x.label, x.joined, [list(e) for e in x.skip]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "x", "label", "joined", "skip"])

    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, sample / max(1, total))))
    found = chosen.mapInArrow(run, "doc_id long, x array<array<int>>, label array<int>, joined array<boolean>, skip array<array<int>>").collect()
    return Field.learn([(r.x, r.label, r.joined, [tuple(e) for e in r.skip]) for r in sorted(found, key=lambda r: (r.doc_id is None, r.doc_id, r.x))])


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = base_spans(t)
                more = field.added(t, base)
                kinds = [k for _, k, _ in base]
                out.append((i, *map(kinds.count, range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    return texts(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names))
