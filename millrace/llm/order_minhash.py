"""Near-duplicate detection by Order MinHash.

A document is its sequence of word shingles (five lower-cased words), each labelled
with how often it occurred before. Each of `ROWS` hash functions picks the two labelled
shingles with the smallest hashes and keeps them in text order; three such rows make a
band, and texts that share a band are candidates. Candidates are verified by banded
alignment of their shingle sequences: with m shingles aligned in order, the similarity
is m / (n1 + n2 - m), and a pair at or above the threshold is a link. The band is as
wide as a linked pair's alignment can stray.

Equal texts are one text first, known by a 128-bit hash. In each bucket of candidates the
text that shares most buckets with others leads and is compared with the rest. What is in
one class after that needs no further comparison. In buckets that still hold several
classes, texts of different classes are paired if that makes `SIGNED` / 2 pairs a text at most, and of
these the pairs whose signatures allow a link are compared, if they are `FEW` / 2 a text at most. A signature has
the parity of the number of labelled shingles that fall on each of `BITS` places, so two signatures differ
in at most as many places as there are shingles that only one of the texts has.
Other buckets are refined, so that no large bucket is ever paired off whole: of all texts that such buckets connect, the one that
shares most buckets, L, is aligned with each other text once. What is in L's class by then is
settled among itself. If x is not in it, and y is similar to x, then |x - L| + |L - x| + |y| -
|L| - c (|x| + |y|), with c = (1 - similarity) / (1 + similarity), is at most twice the number of
shingles that x and y share and L lacks. With the least |y| that there is (similarity * |x| at
least) x so knows how many it must share, and one of these is among all but that many, less
one, of what it has beyond L, the rarest of these texts first. If that says nothing for texts shorter than L,
the same holds of shingles that L has and both lack, without the lengths. These shingles make the
buckets of the next level, where texts of L's class come with all that sets them apart from L.
A candidate pair is left out only if it is in one class already, or if the numbers of
shingles, the signatures or the above rule a link out. (The above is about sets. A text whose set is similar to
L's, but not its order, comes with all that sets it apart; where that is nothing, it meets no
more texts.)
Classes are the connected components of the links, by label spreading with the state written
each time.

Only keys and numbers are shuffled, and the shingle hashes and signatures of compared texts. Defined
results: a null or empty text, or one of blanks, has no shingles; equal ones form one
class. Fewer than five words are one shingle. Rows that repeat an id are decided by their
texts, and rows that repeat both share a decision. The class id is the smallest doc_id of the
class, and that document stays (of several texts with that id, the one whose hash is smallest);
null ids sort last, and are a class's id if it has no other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.fingerprints import MULTIPLIER, Stretches, mixed
from millrace.llm.shared import ship, small, split_join, stored, texts

WORDS, SIMILARITY = 5, 0.8
ROWS, ROWS_OF_BAND = 96, 3
#: Twice the pairs of a bucket for each of its texts that are aligned at most, and whose signatures are compared at most, buckets with more being refined; bits of a signature; shingles hashed at a time.
FEW, SIGNED, BITS, PART = 32, 1 << 12, 1 << 10, 1 << 15
#: Links for each part that a state of the components is written in at most.
ROWS_OF_FILE = 1 << 17


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each shingle, in order. Words are separated by ASCII white space."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    word = Stretches(data).of(start, end)
    n = max(1, len(word) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(word))):
        out = mixed(out * MULTIPLIER + word[k : k + n])
    return out


def labelled(x: np.ndarray) -> np.ndarray:
    """Each value mixed with the number of its earlier occurrences."""
    order = np.argsort(x, kind="stable")
    same = x[order]
    first = np.ones(len(x), bool)
    first[1:] = same[1:] != same[:-1]
    at = np.arange(len(x))
    nth = np.empty(len(x), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return mixed(x + nth * MULTIPLIER)


def bands(x: np.ndarray, rows: int = ROWS, of_band: int = ROWS_OF_BAND) -> np.ndarray:
    """A 64-bit key for each band of a text with these shingles."""
    x = labelled(x)
    factors = (mixed(np.arange(1, rows + 1, dtype=np.uint64) * MULTIPLIER) | np.uint64(1))[:, None]
    kept: np.ndarray | None = None  # positions of the two smallest of each row so far
    for at in range(0, len(x), PART):
        here = np.arange(at, min(at + PART, len(x)))
        where = np.broadcast_to(here, (rows, len(here))) if kept is None else np.concatenate([kept, np.broadcast_to(here, (rows, len(here)))], 1)
        h = x[where] * factors if kept is not None else x[here] * factors
        each = np.arange(rows)
        one = h.argmin(1)
        if h.shape[1] == 1:
            kept = np.stack([where[each, one]] * 2, 1)
            continue
        h[each, one] = np.uint64(0xFFFFFFFFFFFFFFFF)
        two = h.argmin(1)
        kept = np.stack([where[each, one], where[each, two]], 1)
    kept = np.sort(kept, 1)  # text order
    row = mixed(mixed(x[kept[:, 0]]) * MULTIPLIER + x[kept[:, 1]])
    key = np.arange(1, rows // of_band + 1, dtype=np.uint64)
    for part in row.reshape(rows // of_band, of_band).T:
        key = mixed(key * MULTIPLIER + part)
    return key


def signature(x: np.ndarray) -> np.ndarray:
    """For each of `BITS` places whether an odd number of labelled shingles fall on it, as 64-bit numbers."""
    on = np.bincount((labelled(x) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(on.astype(np.uint8)).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences; exact from `least` on, below it perhaps too low.

    Of m aligned shingles, m / (n1 + n2 - m) >= least leaves at most (n1 + n2) (1 - least) / (1 + least)
    unaligned, so no aligned pair is further off the diagonal. The table's columns are bits of an integer.
    """
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    off = int(total * (1 - least) / (1 + least)) + 1
    if abs(len(a) - len(b)) > off:
        return 0.0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    front = int(differ[0]) if len(differ) else n
    back = 0
    if front < n:
        differ = np.flatnonzero(a[::-1][: n - front] != b[::-1][: n - front])
        back = int(differ[0]) if len(differ) else n - front
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    m = front + back
    if len(a) and len(b):
        places: dict[int, int] = {}
        for i, x in enumerate(a.tolist()):
            places[x] = places.get(x, 0) | 1 << i
        full = (1 << len(a)) - 1
        free, width = full, (1 << 2 * off + 1) - 1
        for j, x in enumerate(b.tolist()):
            if (hit := places.get(x)) and (hit := hit & (width << j - off if j >= off else width >> off - j)):
                run = free & hit
                free = (free + run | free - run) & full
        m += len(a) - free.bit_count()
    return m / (total - m)


def _name(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, of, same, size, keys) for each row: hashes of the text of 64 and of 128 bits (the latter equal for all blank texts), its number of shingles, and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, size, keys = [], [], []
            for t in b.column(2).to_pylist():
                x = shingles(t)
                same.append(_name(t if len(x) else ""))
                size.append(len(x))
                keys.append(bands(x).view(np.int64) if len(x) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "of", "same", "size", "keys"])

    return texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("of"), "text").mapInArrow(run, "doc_id long, of long, same binary, size long, keys array<long>")


def hashed(docs: DataFrame) -> DataFrame:
    """(id, x, bits) of (text): the text's hash as in sketches(), its shingles as bytes, and their signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts_ = b.column(0).to_pylist()
            found = [shingles(t) for t in texts_]
            yield pa.RecordBatch.from_arrays([pa.array([_name(t) for t in texts_], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([signature(x) for x in found], pa.list_(pa.int64()))], ["id", "x", "bits"])

    return docs.select("text").mapInArrow(run, "id binary, x binary, bits array<long>")


def verified(pairs: DataFrame, x: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of texts, those that are similar enough. x: as hashed() gives, one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([aligned(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    left = x.select(F.col("id").alias("a"), F.col("x").alias("xa")).join(small(pairs), "a")
    return left.join(x.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b").select("a", "b", "xa", "xb").mapInArrow(run, "a binary, b binary")


def beyond(x: np.ndarray, leader: np.ndarray, settled: bool, smallest: int, least: float) -> tuple[bool, bool, np.ndarray, int, np.ndarray, int]:
    """Whether a text is similar to its leader, whether it is shorter, and of what it must share some with similar texts (see above): labelled shingles that the leader lacks and how many of them, the rarest, have one at least that is shared, and likewise those of the leader that it lacks itself. settled: it is in the leader's class."""
    a, b = np.sort(labelled(x)), np.sort(labelled(leader))
    added, lost = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
    c, off, short = (1 - least) / (1 + least), len(added) + len(lost), len(a) < len(b)
    ok = aligned(x, leader, least) >= least
    if ok or settled:
        return ok, short, added, len(added), lost, len(lost) * short
    longer = max(1, math.ceil((off - c * (len(a) + len(b))) / 2 - 1e-9))
    shorter = math.ceil((off - len(b) - c * len(a) + (1 - c) * max(smallest, least * len(a))) / 2 - 1e-9)
    return ok, short, added, max(0, len(added) - (min(longer, shorter) if shorter > 0 else longer) + 1), lost, max(0, len(lost) - longer + 1) * (shorter < 1)


def refined(rows: DataFrame, x: DataFrame, least: float) -> DataFrame:
    """(comp, id, leader, ok, short, added, n_added, lost, n_lost) of rows (comp, id, leader, settled, smallest): see beyond(); what counts for nothing is left empty."""
    names = ["comp", "id", "leader", "ok", "short", "added", "n_added", "lost", "n_lost"]
    kinds = [pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for settled, smallest, x, y in zip(*(c.to_pylist() for c in b.columns[3:]), strict=True):
                ok, short, added, n, lost, m = beyond(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), settled, smallest, least)
                found.append((ok, short, added.view(np.int64) if n else [], n, lost.view(np.int64) if m else [], m))
            cols = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], names)

    left = rows.join(x, "id").join(x.select(F.col("id").alias("leader"), F.col("x").alias("y")), "leader")
    return left.select("comp", "id", "leader", "settled", "smallest", "x", "y").mapInArrow(run, "comp binary, id binary, leader binary, ok boolean, short boolean, added array<long>, n_added long, lost array<long>, n_lost long")


def rarest(fine: DataFrame) -> DataFrame:
    """(comp, id, short, lost, e): of what refined() found the n_added and n_lost rarest shingles of each text that another text of its comp has too. lost: which of the two."""
    sides = F.explode(F.array(F.struct(F.lit(False).alias("lost"), F.col("added").alias("e"), F.col("n_added").alias("most")), F.struct(F.lit(True).alias("lost"), F.col("lost").alias("e"), F.col("n_lost").alias("most"))))
    each = fine.select("comp", "id", "short", sides.alias("s")).select("comp", "id", "short", "s.lost", "s.most", F.explode("s.e").alias("e"))
    key = ["comp", "lost", "e"]
    each = split_join(each, each.groupBy(*key).agg(F.count("*").alias("n")), key)
    nth = F.row_number().over(Window.partitionBy("comp", "id", "lost").orderBy("n", "e"))
    return each.withColumn("nth", nth).filter((F.col("nth") <= F.col("most")) & (F.col("n") > 1)).select("comp", "id", "short", "lost", "e")


def components(links: DataFrame) -> DataFrame:
    """(id, label) for each id in links (a, b): the smallest id that it is connected with."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    parts = max(1, -(-both.count() // ROWS_OF_FILE))
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label")).withColumnRenamed("a", "id").coalesce(parts), "labels", tidy=False)
    while True:
        near = both.join(small(labels.select(F.col("id").alias("b"), "label")), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = near.join(small(labels), labels.id == near.a).select("id", "label", F.least("label", "near").alias("next"))
        hop = small(labels.select(F.col("id").alias("next"), F.col("label").alias("further")))
        step = stored(step.join(hop, "next", "left").select("id", "label", F.least("next", F.coalesce("further", "next")).alias("next")).coalesce(parts), "labels", tidy=False)
        labels = step.select("id", F.col("next").alias("label"))
        if step.filter(F.col("next") != F.col("label")).isEmpty():
            return labels


def joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, label) of the classes of label (as components() gives) after further links: only classes that these connect are looked at."""
    if label is None:
        return components(links)
    of = lambda side: small(label.select(F.col("id").alias(side), F.col("label").alias(f"_{side}")))
    across = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    across = stored(across.filter(F.col("a") != F.col("b")).distinct(), "links", tidy=False)
    if across.isEmpty():
        return label
    new = small(components(across).select(F.col("id").alias("_old"), F.col("label").alias("_new")))
    kept = label.join(new, label.label == new["_old"], "left").select("id", F.coalesce("_new", "label").alias("label"))
    more = new.join(small(label), new["_old"] == label.id, "left_anti").select(F.col("_old").alias("id"), F.col("_new").alias("label"))
    return stored(kept.union(more), "labels", tidy=False)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, n_links, kept) for each row. n_links: how many links its text has that were looked at; classes need no more."""
    return _classes(docs, id_col, text_col, similarity).drop("of")


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """near_duplicates() with the hash of each text."""
    ship(docs.sparkSession)
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    one = rows.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"), F.min(F.struct("doc_id", "of")).alias("one"))
    reps = stored(one, "texts")
    spread = reps.select(F.col("same").alias("id"), "size", F.posexplode("keys").alias("band", "key"))
    members = _open(spread.select("id", "size", F.xxhash64("band", "key").alias("bucket"), F.lit(True).alias("live")), None)

    wanted = reps.select(F.col("same").alias("id"), "one.doc_id", "one.of").join(members.select("id").distinct(), "id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("of").alias("_of")).distinct()
    source = texts(docs, id_col, text_col).withColumn("of", F.xxhash64("text"))
    x = stored(hashed(source.join(wanted, source.doc_id.eqNullSafe(wanted["_id"]) & (source.of == wanted["_of"]), "left_semi")).dropDuplicates(["id"]), "shingles")

    links: list[DataFrame] = []
    label = None
    while not members.isEmpty():
        front = stored(members.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id", "size", "label")).alias("s")).select("bucket", *(F.col(f"s.{c}").alias(f"_{c}") for c in ("id", "size", "label"))), "leaders", tidy=False)
        links.append(stored(verified(_pairs(members, front, similarity), x, similarity), "found", tidy=False))
        label = joined(label, links[-1])
        # Leaders have met all of their bucket. The others may have classes apart still.
        rest = members.join(small(front.select("bucket", F.col("_id").alias("id"))), ["bucket", "id"], "left_anti").select("bucket", "id", "size", "weight", F.lit(True).alias("live"))
        rest = _open(rest, label)
        if rest.isEmpty():
            break
        few = stored(rest.filter(F.col("cross") <= SIGNED * F.col("n")).join(x.select("id", "bits"), "id"), "few", tidy=False)
        near = stored(_alike(few, similarity), "near", tidy=False)
        dense = stored(near.groupBy("bucket").agg(F.count("*").alias("pairs"), F.max("n").alias("n")).filter(2 * F.col("pairs") > FEW * F.col("n")).select("bucket"), "dense", tidy=False)
        pairs = stored(near.join(small(dense), "bucket", "left_anti").select("a", "b").distinct(), "pairs", tidy=False)
        links.append(stored(verified(pairs, x, similarity), "found", tidy=False))
        many = rest.filter(F.col("cross") > SIGNED * F.col("n")).union(rest.join(small(dense), "bucket", "left_semi").select(rest.columns))
        many = stored(many.select("bucket", "id", "size", "weight", "label"), "many")
        if many.isEmpty():
            label = joined(label, links[-1])
            break
        hub = many.groupBy("bucket").agg(F.min("id").alias("a"))
        comp = components(split_join(many.select("bucket", "id"), hub, ["bucket"]).select("a", F.col("id").alias("b")).distinct())
        sized = stored(many.select("id", "size", "weight", "label").distinct().join(comp.withColumnRenamed("label", "comp"), "id"), "sized", tidy=False)
        central = sized.groupBy("comp").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id", "label")).alias("s"), F.min("size").alias("smallest"))
        central = stored(central.select("comp", F.col("s.id").alias("leader"), F.col("s.label").alias("_label"), "smallest"), "leaders", tidy=False)
        aside = sized.join(small(central), "comp").filter(F.col("id") != F.col("leader")).select("comp", "id", "leader", (F.col("label") == F.col("_label")).alias("settled"), "smallest")
        fine = stored(refined(aside, x, similarity), "refined", tidy=False)
        links.append(fine.filter("ok").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")))
        label = joined(label, links[-2].union(links[-1]))
        spread = rarest(fine).join(sized.select("id", "size", "weight"), "id")
        # What texts lack counts where one of them is shorter than the leader.
        members = _open(spread.select("id", "size", "weight", F.xxhash64("comp", "lost", "e").alias("bucket"), (F.col("short") | ~F.col("lost")).alias("live")), label)

    if label is None:
        label = members.select("id", F.col("id").alias("label"))
        links.append(members.select(F.col("id").alias("a"), F.col("id").alias("b")))
    degree = reduce(DataFrame.union, links).distinct().select(F.explode(F.array("a", "b")).alias("same")).groupBy("same").agg(F.count("*").alias("n_links"))
    known = reps.select("same", "rep", "copies").join(label.withColumnRenamed("id", "same"), "same", "left").join(degree, "same", "left")
    known = stored(known.select("same", "rep", F.coalesce("label", "same").alias("label"), "copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "classes")
    chosen = known.groupBy("label").agg(F.sum("copies").alias("class_size"), F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "same")).alias("s"))
    known = split_join(known, chosen, ["label"]).select("same", F.col("s.rep").alias("class_id"), "class_size", "n_links", (F.col("s.same") == F.col("same")).alias("first"))
    return split_join(rows.select("doc_id", "of", "same"), known, ["same"]).select("doc_id", "of", "class_id", "class_size", "n_links", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def _open(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """(bucket, id, size, label, n, cross, top, weight) of members (bucket, id, size, live) in buckets with several classes and a live member. n: texts of the bucket, cross: twice its pairs of different classes, top: its largest class, weight: unless it is there already, the sum of n over the buckets of a text."""
    n, live = F.count("*").alias("n"), F.max("live").alias("live")
    if label is None:  # each text is a class, and none is a bucket's largest
        members = members.withColumn("label", F.col("id"))
        sizes = members.groupBy("bucket").agg(n, live).withColumns({"cross": F.col("n") * (F.col("n") - 1), "top": F.lit(None).cast("binary")})
    else:
        members = stored(members.join(small(label), "id", "left").withColumn("label", F.coalesce("label", "id")), "members", tidy=False)
        sizes = members.groupBy("bucket", "label").agg(n, live)
        sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("cross"), F.max(F.struct("n", "label")).alias("top"), live).withColumn("top", F.col("top.label"))
    sizes = sizes.filter((F.col("cross") > 0) & F.col("live")).select("bucket", "n", "cross", "top")
    members = stored(split_join(members.drop("live"), sizes, ["bucket"]), "members")
    return members if "weight" in members.columns else stored(split_join(members, members.groupBy("id").agg(F.sum("n").alias("weight")), ["id"]), "members")


def _sized_alike(similarity: float) -> Column:
    """Whether members and others (_id, _size, _label) are in different classes and of sizes that allow a link. Of m aligned shingles no pair has more than the shorter text, so the similarity is at most the ratio of the sizes."""
    return (F.col("label") != F.col("_label")) & (F.least("size", "_size") / F.greatest("size", "_size") >= similarity)


def _pairs(members: DataFrame, others: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of members and others (_id, _size, _label) of a bucket that may be links."""
    pairs = members.join(small(others), "bucket").filter(_sized_alike(similarity))
    return stored(pairs.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct(), "pairs", tidy=False)


def _alike(few: DataFrame, similarity: float) -> DataFrame:
    """(bucket, n, a, b), a < b, of the pairs of a bucket that may be links by their sizes and signatures: of a link's shingles at most (n1 + n2) (1 - similarity) / (1 + similarity) are in one text alone."""
    columns = ("id", "size", "label", "bits")
    other = few.select("bucket", *(F.col(c).alias(f"_{c}") for c in columns))
    # Of two classes one isn't the bucket's largest.
    once = (F.col("_label") == F.col("top")) | (F.col("id") < F.col("_id"))
    differ = reduce(Column.__add__, (F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("_bits")[k])) for k in range(BITS // 64)))
    allowed = (F.col("size") + F.col("_size")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    pairs = few.filter(F.col("label") != F.col("top")).join(small(other), "bucket").filter(_sized_alike(similarity) & once & (differ <= allowed))
    return pairs.select("bucket", "n", F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Rows of docs without those whose class keeps another document; the columns stay."""
    gone = _classes(docs, id_col, text_col, similarity).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("of").alias("_of")).distinct()
    of = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, docs[id_col].cast("bigint").eqNullSafe(gone["_gone"]) & (of == gone["_of"]), "left_anti")
