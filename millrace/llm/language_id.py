"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3
characters of lower-cased words, a space on either side), most frequent first. A
document is compared with each profile by out-of-place distance: for each of its own
most frequent n-grams, how far its rank is from the rank in the profile, or the
largest distance if the profile lacks it. The nearest profile names the language.

Profiles are learnt from at most about `per_language` labelled rows of each language,
chosen by a hash of the id (the documented bound); prediction reads every whole text.
Only a profile table (languages x `size` rows) reaches the driver.

Defined results: a null or empty text, or one without a letter, is `und` with score
0. So is every text if there is nothing to learn from. Ties go to the language that
sorts first; n-grams of equal count rank by code point. Null labels aren't learnt
from. Repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import ship, texts

#: Rows of each language that profiles are learnt from, and n-grams of a profile.
PER_LANGUAGE, SIZE = 4000, 300
#: Letters of a text that are counted at a time.
PART = 1 << 20

_folded: list[np.ndarray] = []


def _letters(text: str) -> np.ndarray:
    """Code points of the letters, any other character as a space."""
    if not _folded:
        _folded.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(_folded[0][codes], codes, 32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of a text, ascending, and their counts: of its lower-cased words, each run of other characters as one space, a space at both ends. A code is its characters as digits in base 2**21.

    `PART` characters are looked at a time; the last two of what came before go along, so cuts change no count.
    """
    text = text.lower() + " "
    codes, counts, last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([32])
    for at in range(0, len(text), PART):
        c = np.concatenate((last, _letters(text[at : at + PART])))
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
        n = len(last)
        two = c[:-1] << 21 | c[1:]
        three = two[:-1] << 21 | c[2:]
        here, n_here = np.unique(np.concatenate([c[n:][c[n:] != 32], two[n - 1 :], three[max(0, n - 2) :]]), return_counts=True)
        last = c[-2:]
        if not len(codes):
            codes, counts = here, n_here
            continue
        codes, back = np.unique(np.concatenate([codes, here]), return_inverse=True)
        both = np.zeros(len(codes), np.int64)
        np.add.at(both, back, np.concatenate([counts, n_here]))
        counts = both
    return codes, counts


def top(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    codes, counts = grams(text)
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        """rows: (language, n-gram, rank)."""
        self.size, self.languages = size, sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.rank = np.full((len(self.languages), len(self.codes) + 1), -1, np.int64)  # the last column: n-grams of no profile
        for lang, code, rank in rows:
            self.rank[self.languages.index(lang), np.searchsorted(self.codes, code)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        own = top(text, self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != own] = len(self.codes)
        there = self.rank[:, at]
        away = np.where(there < 0, self.size, np.minimum(np.abs(there - np.arange(len(own))), self.size)).sum(1)
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best] / (self.size * len(own)))


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles([], size)
    # About per_language rows of each, by hash: the share of each language is written into the plan.
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                codes, counts = grams(text)
                if lang in seen:
                    codes, back = np.unique(np.concatenate([seen[lang][0], codes]), return_inverse=True)
                    counts = np.bincount(back, np.concatenate([seen[lang][1], counts])).astype(np.int64)
                seen[lang] = codes, counts
        for lang, (codes, counts) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    summed = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    return Profiles([(r.lang, r.gram, r["rank"] - 1) for r in ranked.select("lang", "gram", "rank").collect()], size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = texts(docs, id_col, text_col)
    return rows.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """Rows of docs whose text has a language with at least that score; the columns stay."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def known(t):  # noqa: ANN001, ANN202
        return t.map(lambda x: (p := profiles.predict(x))[0] != "und" and p[1] >= least)

    return docs.filter(known(F.coalesce(docs[text_col], F.lit(""))))
