import collections
import hashlib
import random
import time

import numpy as np
import pytest

from millrace.llm import exact_dedup, line_dedup, order_minhash, suffix_dedup

SCHEMA = "doc_id long, text string, size string, _doc int"  # with names that operators use inside


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, 1) for i, t in enumerate(texts)], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_exact_dedup(spark):
    texts = ["Abc", "aBC", "É", "é", "", None, "abd", "x" * 5000, "X" * 5000, "x" * 4999 + "y", "I", "ı", "a b"]
    df = frame(spark, texts).union(spark.createDataFrame([(None, "lone", None, 1), (None, "ABC", None, 1), (6, "abd", None, 1)], SCHEMA))
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = collections.defaultdict(list)
    for r in df.collect():
        groups[fold(r.text)].append(r.doc_id)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep if keep is not None else i, len(ids), i == keep, sha(t)) for i in ids]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(df).collect()), key=key) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    few = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.keepers(df).collect()}
    assert few == {w[:4] for w in want} and exact_dedup.keepers(df).count() == len(want)
    for every in (False, True):  # whole texts are hashed above the joins that say which groups survive
        hashed = exact_dedup.hashes(df.select("doc_id", "text").fillna("", "text"), every=every)
        plan = hashed._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "sha2" in plan.split("Join")[0] and not any("sha2" in x for x in plan.split("Join")[1:])
        assert hashed.filter("text_sha256 is null").count() == (0 if every else hashed.filter("not again").count()) and hashed.filter("not again").count() > 0


LONG = "one two three four five six seven eight nine ten one two three four five six seven eight nine ten end"


def lines_left(docs, min_lines, min_words):
    seq = {i: [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")] for i, t in docs}
    gone = collections.defaultdict(set)
    seen = set()
    for i in sorted(seq):
        for p in range(len(seq[i])):
            for k_th, (n, ok) in enumerate(((min_lines, True), (1, len(seq[i][p][1].split()) >= min_words))):
                window = tuple(x for _, x in seq[i][p : p + n])
                if len(window) == n and ok and (k_th == 0 or min_lines > 1):
                    if (n, window) in seen:
                        gone[i] |= {k for k, _ in seq[i][p : p + n]}
                    seen.add((n, window))
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) for i, t in docs}, gone


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4])
def test_line_dedup(spark, min_lines):
    rng = random.Random(min_lines)
    pool = ["a", "b", "c d", "", "  ", LONG, "e"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(25)] + [None, "", "a\na\na\na\na\na", "\n\n\n"]
    df = frame(spark, texts)
    left, gone = lines_left(list(enumerate(texts)), min_lines, 20)
    got = {r.doc_id: r for r in line_dedup.report(df, min_lines=min_lines, min_words=20).collect()}
    for i, t in enumerate(texts):
        assert (got[i].kept_sha256, got[i].n_removed, got[i].n_lines) == (sha(left[i]), len(gone[i]), len(t.split("\n")) if t else 0), (i, t)


def test_single_lines_between_others(spark):
    """Boilerplate between lines that differ goes from four words on, and the copy with the smallest id stays."""
    df = frame(spark, [f"first {i} of\nplease share this page now\nmore {i}\nthe end\nlast {i}" for i in range(5)])
    assert {r.doc_id: (r.n_removed, r.n_runs) for r in line_dedup.report(df).collect()} == {i: (int(i > 0), int(i > 0)) for i in range(5)}
    assert "please share" not in line_dedup.drop_lines(df).filter("doc_id = 3").first().text


def test_many_lines_are_cut_in_linear_time(spark):
    many = "\n".join(f"line {i % 15000} with five words" for i in range(60_000))
    t = time.monotonic()
    r = line_dedup.report(frame(spark, [many])).first()
    assert (r.n_lines, r.n_removed, r.n_runs) == (60_000, 45_000, 1) and time.monotonic() - t < 40


def test_line_dedup_edges(spark):
    twice = spark.createDataFrame([(1, f"{LONG}\nx", None, 1), (1, f"{LONG}\nx", None, 1), (2, f"{LONG}\nx", None, 1), (2, "other", None, 1), (None, LONG, None, 1)], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_removed, r.n_runs) for r in line_dedup.report(twice).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 0, 0), (2, 2, 1)]
    kept = line_dedup.drop_lines(twice)
    assert kept.columns == twice.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "None"]
    assert line_dedup.report(twice.limit(0)).count() == 0
    plan = line_dedup.report(twice)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), len(b) - len(left), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0, sha(left)))
    return out


@pytest.mark.parametrize("length", [30, 41])
def test_suffix_dedup(spark, length):
    rng = random.Random(length)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(200))) for _ in range(10)]
    texts = [None, "", "x" * 150, "ab" * 90]
    for _ in range(45):
        t = "".join(rng.choice(base)[rng.randrange(40) :] if rng.random() < 0.6 else rng.choice("xyz") * rng.randrange(50) for _ in range(rng.randrange(1, 5)))
        k = rng.randrange(len(t) + 1)
        texts.append(t[:k] + "Q" * (rng.random() < 0.5) + t[k:])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, texts), length=length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_suffix_dedup_edges(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(100))
    df = spark.createDataFrame([(1, text, None, 1), (1, text, None, 1), (None, "z" + text, None, 1), (2, "short", None, 1)], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_removed, r.kept) for r in suffix_dedup.remove_repeats(df, length=40).collect())
    assert got == [(0, 100, b"z"), (1, 100, b""), (1, 100, b""), (2, 0, b"short")]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_dedup_structured_bytes(spark):
    """Two stretches of 184 bytes whose sums of byte times power agree modulo 2**64 for any base that is 3 modulo 8 aren't equal."""
    c = np.array([1])
    for a in (1, 2, 4, 4, 4, 8, 8, 8, 16, 16, 16, 32, 64):  # multiples of 2, 8, 16, 32 ...: 2**64 in all
        c = np.convolve(c, np.concatenate(([-1], np.zeros(a - 1, int), [1])))
    two = [bytes((48 + np.maximum(s * c, 0)).astype(np.uint8)).decode() for s in (1, -1)]
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for _ in range(6):
        before, after = noise(300), noise(300)
        texts += [before + x + after for x in two]
        before, after = noise(300), noise(300)
        texts += [noise(300) + before + x + after + noise(300) for x in two]
    texts.append(texts[0])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    want = brute_repeats(texts, 400)
    assert [got[i] for i in range(len(texts))] == want
    assert 0 < sum(w[1] for w in want) < sum(w[0] for w in want)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment():
    rng = random.Random(3)
    for _ in range(600):
        a = [rng.randrange(rng.choice([3, 30, 1000])) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(50)] * rng.randrange(2)
        m = lcs(a, b)
        exact, got = m / (len(a) + len(b) - m), order_minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == pytest.approx(exact) if exact >= 0.8 else got < 0.8


def test_shingles_are_words_in_order():
    s = order_minhash.shingles
    assert (s("A b\tc d\n e  f") == s("a b c d e f")).all() and len(s("a b c d e f")) == 2
    assert len(s("a b")) == 1 and len(s(" \n")) == 0 and (s("a b c d e") != s("b a c d e")).all()
    big = s("w " * 70000 + "x y z")
    assert len(order_minhash.bands(big)) == order_minhash.ROWS // order_minhash.ROWS_OF_BAND and (order_minhash.bands(big) == order_minhash.bands(s("w " * 70000 + "x y z"))).all()


def test_near_duplicates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(150)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for n, b in enumerate(base[:8]):
        for _ in range(5):
            c = list(b)
            for _ in range(n // 3 + 1):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    texts += [texts[0], texts[0].upper(), "", None, " ", "one two", "one two"]
    got = {r.doc_id: r for r in order_minhash.near_duplicates(frame(spark, texts)).collect()}
    x = [order_minhash.shingles(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if order_minhash.aligned(x[i], x[j]) >= 0.8 and len(x[i]) and len(x[j]) or not len(x[i]) and not len(x[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [got[i].class_id for i in range(len(texts))] == root
    assert all(got[i].kept == (root[i] == i) and got[i].class_size == root.count(root[i]) for i in got)


def test_chains_in_a_hot_bucket_are_followed(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "bands", lambda x: np.zeros(1, np.uint64))  # one bucket
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for n in (3, 4, 9, 1):  # neighbours are linked, others aren't
        chain = [[word() for _ in range(150)]]
        for k in range(1, n):
            chain.append([w if i % 75 != 7 * k else word() for i, w in enumerate(chain[-1])])
        texts.append(list(map(" ".join, chain)))
    x = [order_minhash.shingles(t) for t in texts[0]]
    assert [order_minhash.aligned(x[a], x[b]) >= 0.8 for a, b in ((0, 1), (1, 2), (0, 2))] == [True, True, False]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame(spark, sum(texts, []))).collect()}
    assert [got[i] for i in range(17)] == [0] * 3 + [3] * 4 + [7] * 9 + [16]


def classes(x):
    root = list(range(len(x)))
    for i in range(len(x)):
        for j in range(i):
            if root[i] != root[j] and order_minhash.aligned(x[i], x[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_a_dense_family_in_a_hot_bucket_loses_no_link(spark, monkeypatch):
    """Half are edits of one text, half edits of those; most pairs aren't linked, and all share a bucket with texts that are not alike."""
    bands = order_minhash.bands
    monkeypatch.setattr(order_minhash, "bands", lambda x: np.append(bands(x), np.uint64(0)))
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for size in (60, 45):
        base = [word() for _ in range(size)]
        family = []
        for k in range(120):
            t = list(base if k < 60 else rng.choice(family[:60]))
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = [word()] * rng.randrange(2) if k % 3 else [word()]
            family.append(t)
        texts += family
    texts += [texts[0][30:] + texts[0][:30], texts[0][30:] + texts[0][:30] + [word()], *([word() for _ in range(50)] for _ in range(30))]
    rng.shuffle(texts)
    texts = list(map(" ".join, texts))
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    root = classes([order_minhash.shingles(t) for t in first])
    want = {t: list(first.values()).index(first[t]) for t in first}
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame(spark, texts)).collect()}
    of = {}
    for t, i in first.items():
        of.setdefault(root[want[t]], set()).add(got[i])
    assert all(len(v) == 1 for v in of.values()) and len(set().union(*of.values())) == len(of)


def test_signatures_differ_by_no_more_than_the_texts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 300, 5000):
        for _ in range(20):
            a = rng.integers(0, 400, n).astype(np.uint64)
            b = np.delete(np.append(a, rng.integers(0, 900, 7)), rng.integers(0, n + 7, 3)).astype(np.uint64)
            differ = (order_minhash.signature(a) ^ order_minhash.signature(b)).view(np.uint64)
            alone = set(order_minhash.labelled(a).tolist()) ^ set(order_minhash.labelled(b).tolist())
            assert sum(int(v).bit_count() for v in differ) <= len(alone)


@pytest.mark.parametrize("few, signed, levels", [(32, 1 << 12, False), (0, 1 << 12, True), (32, 8, True)])
def test_families_in_one_bucket_need_no_level_each(spark, monkeypatch, few, signed, levels):
    """Several families share a bucket; in each, few pairs are links. Buckets with too many pairs are still refined, and give the same classes."""
    monkeypatch.setattr(order_minhash, "bands", lambda x: np.zeros(1, np.uint64))
    monkeypatch.setattr(order_minhash, "FEW", few)
    monkeypatch.setattr(order_minhash, "SIGNED", signed)
    called, refined = [], order_minhash.refined
    monkeypatch.setattr(order_minhash, "refined", lambda *a: called.append(1) or refined(*a))
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(2):
        base = [word() for _ in range(100)]
        for k in range(24):
            t = list(base)
            for at in rng.sample(range(100), 6):
                t[at] = word()
            texts.append(t)
            if k % 10 == 0:
                texts.append([*t[:-1], word()])
    rng.shuffle(texts)
    texts = list(map(" ".join, texts))
    want = classes([order_minhash.shingles(t) for t in texts])
    assert 40 < len(set(want)) < len(texts)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want and bool(called) == levels


def test_recall_on_the_documents(spark):
    """Pairs of different texts that are similar, by brute force, against the classes found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.text: r.doc_id for r in docs.collect() if r.text}
    x = {i: order_minhash.shingles(t) for t, i in rows.items()}
    sets = {i: order_minhash.labelled(v) for i, v in x.items()}
    where = collections.defaultdict(list)
    for i, v in sets.items():
        for s in v.tolist():
            where[s].append(i)
    shared = collections.Counter((a, b) for v in where.values() if len(v) < 200 for a in v for b in v if a < b)
    links = [(a, b) for (a, b), n in shared.items() if n / (len(x[a]) + len(x[b]) - n) > 0.6 and order_minhash.aligned(x[a], x[b]) >= 0.8]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert len(links) >= 5 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)


def test_very_long_texts_are_compared_whole(spark):
    words = [f"w{k % 50021}" for k in range(120_000)]
    near, far = list(words), words[:60_000] + [f"v{k}" for k in range(60_000)]
    near[119_000] = "z"
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame(spark, [" ".join(words), " ".join(near), " ".join(far)])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_ids_that_repeat_or_are_missing_are_decided_by_text(spark):
    base = " ".join(f"w{k}" for k in range(100))
    near = [base + " x", "y " + base, base.replace("w50", "z")]
    df = spark.createDataFrame([(None, base, None, 1), (None, near[0], None, 1), (5, "other " * 30, None, 1), (5, near[1], None, 1), (5, near[2], None, 1)], SCHEMA)
    got = [(r.doc_id, r.class_id, r.class_size, r.kept) for r in order_minhash.near_duplicates(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, 5, 4, False), (None, 5, 4, False), (5, 5, 1, True), (5, 5, 4, True), (5, 5, 4, False)]))
    assert order_minhash.keep_one(df).count() == 2
    assert order_minhash.keep_one(df.filter("doc_id is null")).count() == 1


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(1, "a b c", None, 1), (1, "a b c", None, 1), (None, "a b c", None, 1), (None, "q r s", None, 1)], SCHEMA)
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in order_minhash.near_duplicates(df).collect())
    assert got == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]
    assert order_minhash.near_duplicates(df.limit(0)).count() == 0
    assert order_minhash.keep_one(df).columns == df.columns
