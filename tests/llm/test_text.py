import collections
import gzip
import itertools
import random
import re
import time

import numpy as np
import pytest

from millrace.llm import decontamination, language_id, pii_crf, revisits

SCHEMA = "doc_id long, text string, lang string, label int"


def test_languages(spark):
    rng = random.Random(1)
    parts = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "ich"], "cc": ["é", "eau", "oi", "lle"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), k, 0) for i in range(150) for k in [rng.choice(list(parts))]]
    docs = spark.createDataFrame([*rows, (900, None, "aa", 0), (901, "", "aa", 0), (902, "12 !?", "bb", 0), (903, "kato", None, 0), (903, "kato", None, 0), (None, "schung ver", "bb", 0), (905, "漢字", None, 0)], SCHEMA)
    profiles = language_id.learn(docs)
    got = language_id.identify(docs, profiles).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 157 and profiles.languages == ["aa", "bb", "cc"]
    held = [i for i, *_ in rows if by_id[i].held_out]
    assert len(held) > 10 and all(by_id[i].lang_pred == rows[i][2] for i in held)
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert by_id[902].score == 0 and all(0 <= r.score <= 1 for r in got) and by_id[905].score == 0
    kept = {r.doc_id for r in language_id.keep_known(docs, profiles, 0.1).collect()}
    assert kept == {r.doc_id for r in got if r.lang_pred != "und" and r.score >= 0.1} and 905 not in kept
    nothing = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), profiles).count() == 0


def brute_grams(text):
    t = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    count = collections.Counter(t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1))
    del count[" "]
    return {sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)): n for g, n in count.items()}


@pytest.mark.parametrize("part", [1, 2, 3, 7, 50, 1 << 20])
def test_grams_of_long_texts_add_up(monkeypatch, part):
    monkeypatch.setattr(language_id, "PART", part)
    rng = random.Random(part)
    texts = ["abc " * 100, "", " ", "a", "..", "ΑΣ ΑΣΒ", "x" * 200] + ["".join(rng.choice("ab  É.1") for _ in range(rng.randrange(120))) for _ in range(40)]
    for t in texts:
        codes, counts = language_id.grams(t)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == brute_grams(t), t
    assert brute_grams(texts[0])[ord("a") << 42 | ord("b") << 21 | ord("c")] == 100


def test_the_nearest_profile_equals_brute_force():
    rng = random.Random(3)
    size = 30
    ranks = {k: rng.sample(range(40), size) for k in ("p", "q", "r")}
    profiles = language_id.Profiles([(k, 97 + x, n) for k, v in ranks.items() for n, x in enumerate(v)], size)
    for _ in range(60):
        text = " ".join(chr(97 + rng.randrange(45)) for _ in range(rng.randrange(1, 80)))
        own = [g for g, _ in sorted(brute_grams(text).items(), key=lambda x: (-x[1], x[0]))][:size]
        away = {k: sum(min(size, abs(v.index(g - 97) - n)) if g - 97 in v else size for n, g in enumerate(own)) for k, v in ranks.items()}
        best = min(sorted(away), key=away.get)
        if any(map(str.isalpha, text)):
            assert profiles.predict(text) == (best, pytest.approx(1 - away[best] / (size * len(own))))


PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k != 1 or all(int(x) <= 255 for x in m[0].split("."))) and (k != 2 or (12 <= len(digits) <= 19 and pii_crf.luhn(digits))) and (k != 3 or 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(6000):
        t = "".join(rng.choice("a@@..1122 -+()_é\n") for _ in range(rng.randrange(45)))
        assert pii_crf.base_spans(t) == plain_spans(t), t
    assert pii_crf.base_spans("1" * 200_000 + "." + "2" * 200_000 + " " + "a" * 200_000 + " " + "+1" + "(" * 200_000) == []
    assert pii_crf.luhn("4111111111111111") and not pii_crf.luhn("4111111111111112")


def test_personal_data(spark):
    rng = random.Random(3)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii_crf.luhn(d + c))

    cards = [card() for _ in range(160)]
    texts = [f"word {cards[i]} and more text. ip 10.{i % 250}.3.4 done. in {1990 + i % 40} there were {i} of them, mail u{i}@h{i % 9}.example.com ok" for i in range(160)]
    texts += [f"twice {cards[0]} {cards[1]} here", None, "", "no data", "page 12 of 2019, 3.14"]
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in pii_crf.find(docs, pii_crf.learn(docs)).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        assert [got[i][f"n_{k}"] for k in pii_crf.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]
        spans = got[i].spans.split(",") if got[i].spans else []
        assert {f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(spans)
        assert len(spans) == len(base) + got[i].n_added
    assert got[160].n_card == 0 and got[160].spans.startswith("card:6:")  # two numbers run together
    assert all(got[i].spans == "" for i in (161, 162, 163, 164)) and sum(r.n_added for r in got.values()) == 1
    assert pii_crf.find(docs.limit(0), pii_crf.learn(docs.limit(0))).count() == 0


def test_messages_make_copies_agree():
    node = np.zeros((pii_crf.N_FEATURES, pii_crf.N_LABELS))
    node[0] = [1.0, 0, 0, 0, 0]
    field = pii_crf.Field(node, np.zeros((5, 5)), 3.0)
    alone = field.marginals([[0], [0]], [2, -1], [False, False], [])
    linked = field.marginals([[0], [0]], [2, -1], [False, False], [(0, 1)])
    assert alone[1].argmax() == 0 and linked[1].argmax() == 2
    joint = np.exp(node[0] + np.array([0, 0, 3.0, 0, 0]))
    assert linked[1] == pytest.approx(joint / joint.sum(), abs=1e-3)  # exact on a tree


def test_loopy_messages_come_near_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(12):
        n = 5
        node = np.zeros((pii_crf.N_FEATURES, pii_crf.N_LABELS))
        node[1 : n + 1] = rng.normal(0, 1, (n, pii_crf.N_LABELS))
        step = rng.normal(0, 0.4, (pii_crf.N_LABELS, pii_crf.N_LABELS))
        step[0], step[:, 0] = 0, 0  # so ends of the chain add nothing
        field = pii_crf.Field(node, step, 0.7)
        skip = [(0, 2), (1, 4), (0, 4)]  # loops with the chain
        got = field.marginals([[k + 1] for k in range(n)], [-1] * n, [False, True, True, True, True], skip)
        want = np.zeros((n, pii_crf.N_LABELS))
        for labels in itertools.product(range(pii_crf.N_LABELS), repeat=n):
            p = np.exp(sum(node[k + 1, v] for k, v in enumerate(labels)) + sum(step[a, b] for a, b in zip(labels, labels[1:], strict=False)) + 0.7 * sum(labels[a] == labels[b] for a, b in skip))
            for k, v in enumerate(labels):
                want[k, v] += p
        assert np.abs(got - want / want.sum(1, keepdims=True)).max() < 0.1


def test_skip_edges_change_the_spans(spark):
    """A number written as no pattern knows it, whose copy elsewhere in the document is one: found with the edges, not without them."""
    rng = random.Random(9)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii_crf.luhn(d + c))

    number = lambda: "".join(rng.choice("0123456789") for _ in range(16))
    texts = []
    for i in range(300):
        a, junk = card(), number()
        texts.append(f"card {a} was used on day {i}, again {a}. order {junk} and order {junk} came" if i % 2 else f"order {junk} and {junk} on {i % 30}.{i % 12}.2020, page {i}")
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)], SCHEMA)
    field = pii_crf.learn(docs)
    a = card()
    typo = a[:3] + str((int(a[3]) + 1) % 10) + a[4:]
    text = f"card {a} was used and {a} again, then the number {typo} was noted, {a} once more"
    base = pii_crf.base_spans(text)
    assert field.skip > 0.5 and len(base) == 3
    found = field.added(text, base)
    assert [(text[x:y], k) for x, k, y in found] == [(typo, 2)]
    field.skip = 0.0
    assert field.added(text, base) == []


def test_decontamination(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (40, 25, 16, 3, 8)]
    fill = lambda n: [word() for _ in range(n)]
    changed = list(items[0])
    for k in range(5, 40, 6):
        changed[k] = "zzz"
    texts = [fill(50) + items[0] + fill(9), fill(5) + changed, items[1][3:20] + fill(30), items[1][:8] + fill(60), fill(4) + items[3] + fill(5), fill(100), items[4] + items[2], []]
    docs = spark.createDataFrame([(i, " ".join(t), None, 1) for i, t in enumerate(texts)] + [(50, None, None, 1), (None, " ".join(items[2]).upper() + ".", None, 1)], SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(items)] + [(9, None, "x"), (10, "", "x")], "item_id long, text string, doc_id string")
    want = [(0, 0), (1, 0), (2, 1), (4, 3), (6, 2), (6, 4), (None, 2)]
    key = lambda r: tuple(map(str, r))
    for size in (decontamination.PART_BYTES, 100):
        got = decontamination.contaminated(docs, bench, part_bytes=size).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=key) == sorted(want, key=key)
    one = next(r for r in got if (r.doc_id, r.item_id) == (0, 0))
    assert (one.n_equal, one.first_word, one.end_word) == (40, 50, 90)
    clean = decontamination.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["3", "5", "50", "7"]
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


def brute_hits(items, text, mask_hits=True):
    """Every offset of every item at which some mask fits; the best run by trying all."""
    w, out = re.findall(r"[^\W_]+", text.lower()), []
    for i, item in items:
        x, best = re.findall(r"[^\W_]+", item.lower()), None
        for at in range(-len(x) + 1, len(w)):
            a, b = max(0, at), min(len(w), at + len(x))
            equal = [w[k] == x[k - at] for k in range(a, b)]
            masks = decontamination.MASKS if len(x) >= 5 else ["1" * max(1, len(x))]
            if not any(all(equal[k + j] for j, c in enumerate(m) if c == "1") for m in masks for k in range(len(equal) - len(m) + 1)):
                continue
            runs = [(sum(equal[p:q]), -p, q) for p in range(len(equal)) if equal[p] for q in range(p + 1, len(equal) + 1) if equal[q - 1] and 5 * sum(equal[p:q]) >= 4 * (q - p)]
            if runs and (best is None or max(runs)[0] > best[0]):
                best = max(runs)[0], a
        if best and best[0] >= min(decontamination.LEAST, -(-4 * len(x) // 5)):
            out.append((i, best[0]))
    return out


def test_hits_equal_brute_force_over_all_offsets(monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(decontamination, "HITS", 7)
    for _ in range(150):
        pool = [f"w{k}" for k in range(rng.choice([2, 6, 300]))]
        items = [(k, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 5, 7, 16, 30])))) for k in range(4)]
        parts = [rng.choice(items)[1].split() if rng.random() < 0.6 else [rng.choice(pool) for _ in range(rng.randrange(12))] for _ in range(3)]
        text = " ".join("z" if rng.random() < 0.08 else w for p in parts for w in p)
        got = decontamination.Items(items).hits(text)
        assert [(i, e) for i, e, *_ in got] == brute_hits(items, text), (items, text)
        for _, e, first, end in got:
            assert 0 <= first < end <= len(text.split()) and 5 * e >= 4 * (end - first)


def test_long_repetitive_texts():
    items = decontamination.Items([(1, "na " * 60), (2, "na no " * 30), (3, "other words " * 8)])
    t = time.monotonic()
    assert [x[:2] for x in items.hits("na " * 20_000)] == [(1, 60)]
    assert [x[:2] for x in items.hits("na no " * 10_000)] == [(2, 60)]
    assert time.monotonic() - t < 4


def test_best_run():
    a, b = np.array([9, 1, 2, 3, 0, 4, 5, 6, 7, 8]), np.array([8, 1, 2, 3, 4, 4, 5, 6, 7, 9])
    assert decontamination.overlap(a, b) == (7, 1, 9) or decontamination.overlap(a, b)[0] >= 4


@pytest.mark.parametrize(("n", "replaced"), [(15, [5, 10]), (20, [5, 10, 15]), (59, range(4, 59, 5)), (16, [4, 9, 14])])
def test_items_with_words_replaced_close_together(n, replaced):
    item = [f"w{k}" for k in range(n)]
    text = ["z" if k in replaced else w for k, w in enumerate(item)]
    found = decontamination.Items([(7, " ".join(item))]).hits(" ".join(["x", "y", *text, "x"]))
    left = [k for k in range(n) if k not in replaced]
    assert found == [(7, len(left), 2 + left[0], 3 + left[-1])]


def test_best_run_equals_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(400):
        equal = rng.random(rng.integers(1, 40)) < rng.choice([0.3, 0.8, 0.9])
        sums = [(int(equal[i:j].sum()), j - i) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)]
        most = max((e for e, n in sums if 5 * e >= 4 * n), default=0)
        got, first, end = decontamination.overlap(np.zeros(len(equal)), np.where(equal, 0, 1))
        assert got == most == int(equal[first:end].sum()) and 5 * got >= 4 * (end - first)


@pytest.mark.parametrize(
    ("url", "canonical"),
    [
        ("http://www.Example.com:80/a/?utm_source=x#top", "example.com/a"), ("https://example.com", "example.com/"), ("https://m.e.org/a?b=2&a=1&ref=q", "m.e.org/a?a=1&b=2"), (None, None),
        ("http://e.org:8080/", "e.org:8080/"), ("http://[bad", "http://[bad"), ("", "/"),
    ],
)
def test_canonical_urls(url, canonical):
    assert revisits.canonical_url(url) == canonical


def test_warc_round_trip(spark):
    rows = [(1, "response", "http://a/x", 5, {"etag": '"1"'}, "d1", b"hello\r\n\r\nworld"), (2, "revisit", "http://a/x", 9, {"etag": '"1"'}, None, None), (3, "response", None, 0, {}, "d3", b"")]
    records = spark.createDataFrame(rows, "record_id long, type string, url string, at long, headers map<string,string>, digest string, content binary")
    back = sorted(tuple(r) for r in revisits.read_warc(revisits.write_warc(records)).collect())
    assert back == [tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows]
    raw = b"".join(revisits.warc_bytes(1, "response", "u", 0, {"A": "b"}, b"x" * 10) for _ in range(2))
    assert [r["content"] for r in revisits.parse_warc(gzip.compress(gzip.decompress(raw) + b"\r\n"))] == [b"x" * 10] * 2  # one member
    assert [r["type"] for r in revisits.parse_warc(raw)] == ["response"] * 2
    cut = gzip.compress(gzip.decompress(raw[: len(raw) // 2])[:-9])
    assert [r["type"] for r in revisits.parse_warc(cut)] == ["broken"]


def test_warc_files(spark, tmp_path):
    """Files that roll over, very long contents, null ids, URLs, times and pages, and a read of the files by binaryFile."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["response", "revisit"]), f"http://a/{i}", i, {"a": "é"}, None, None) for i in range(300)]
    rows = [(*r[:6], bytes(rng.randrange(256) for _ in range(rng.randrange(300)))) if r[1] == "response" else r for r in rows]
    rows += [(300, "response", "http://long/", 1, {}, "d", b"0123456789" * 500_000), (301, "response", None, None, {}, "d", None), (302, "response", "u", 2, None, "d", b"")]
    records = spark.createDataFrame(rows, "record_id long, type string, url string, at long, headers map<string,string>, digest string, content binary").repartition(3)
    files = revisits.write_files(records, str(tmp_path / "warc"), file_bytes=2000)
    assert files.count() > 10 and files.agg({"records": "sum"}).first()[0] == 303
    for back in (revisits.read_files(files, str(tmp_path / "warc")), revisits.read_warc(spark.read.format("binaryFile").load(str(tmp_path / "warc")))):
        got = {r.record_id: r for r in back.collect()}
        assert len(got) == 303 and all((got[i].type, got[i].url, got[i].at, got[i].headers) == (k, u, at, h or {}) for i, k, u, at, h, *_ in rows)
        assert all(got[r[0]].content == (r[6] or (b"" if r[1] == "response" else None)) for r in rows)
    assert revisits.written_and_read(records.limit(0)).count() == 0
    pages = spark.createDataFrame([(None, "http://a/", "x"), (1, None, "y"), (2, "http://a/", None), (2, "http://a/", None)], "page_id long, url string, html string")
    out = revisits.resolve(revisits.written_and_read(revisits.captures(pages))).collect()
    assert len(out) == 11 and sum(r.status == "resolved" for r in out) == 4 and sum(r.status == "full" for r in out if r.url is None) == sum(r.type == "response" for r in out if r.url is None)


def test_revisits_resolve_to_the_latest_earlier_response(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        full = rng.random() < 0.4
        url = rng.choice(["http://hot/x", "https://www.hot/x/", "http://b/y?ref=1", "http://c/z", None])
        headers = {k: v for k, v in (("etag", rng.choice(['"1"', 'W/"1"', '"2"', None])), ("last-modified", rng.choice(["m", None])), ("date", str(i)), ("server", f"s{i}")) if v}
        rows.append((i, "response" if full else "revisit", url, rng.choice([None, *range(300)]), headers, f"d{i % 3}", f"c{i}".encode() if full else None))
    rows.append((400, "request", "http://hot/x", 5, {}, None, None))
    records = spark.createDataFrame(rows, "record_id long, type string, url string, at long, headers map<string,string>, digest string, content binary")
    got = {r.record_id: r for r in revisits.resolve(records, bucket=16).collect()}
    assert len(got) == len(rows)
    for i, kind, url, at, headers, digest, content in rows:
        r = got[i]
        if kind != "revisit":
            assert r.status == ("full" if kind == "response" else kind) and r.headers == headers and r.content == content
            continue
        key = revisits.canonical_url(url)
        earlier = [x for x in rows if x[1] == "response" and key and at is not None and revisits.canonical_url(x[2]) == key and x[3] is not None and x[3] <= at]
        if not earlier:
            assert r.status == "unresolved" and r.content is None
            continue
        best = max(earlier, key=lambda x: (x[3], x[0]))
        bare = lambda e: e and e.removeprefix("W/")
        if "etag" in headers:
            ok = bare(headers["etag"]) == bare(best[4].get("etag"))
        else:
            ok = headers["last-modified"] == best[4].get("last-modified") if "last-modified" in headers else digest == best[5]
        assert r.status == ("resolved" if ok else "mismatch"), i
        if ok:
            assert r.source_id == best[0] and r.content == best[6] and r.headers == best[4] | {k: v for k, v in headers.items() if k in revisits.PERMITTED}
    assert revisits.resolve(records.limit(0)).count() == 0
