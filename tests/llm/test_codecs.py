import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest

from millrace.llm import sentencepiece_codec, token_blocks

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = ["a", " ", "  ", "▁", "\n", "é", "the", "😀", "\x00", "ing", " " * 20, "漢", "1", "2023", "<s>", "<0x0A>", "\t", "xxxxx", "́", "ﬁ", ",", ".", "-", "'s", "_"]


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(PIECES)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def samples(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(25))) for _ in range(n)] + ["", " ", " " * 5000 + "a", "abcde" * 2000, "▁▁", "a▁b"]


def test_ids_and_texts_equal_the_librarys(codec, library):
    for t in samples(1500, 1):
        ids = library.encode(t)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == library.decode(ids)
        n, joined, decoded = codec.digest(t)
        assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_any_ids_decode_like_the_librarys(codec, library):
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 28705, 1, 2]) for _ in range(rng.randrange(7))]
        assert codec.decode(ids) == library.decode(ids)


def test_backtracking_equals_merging(codec):
    rng = random.Random(3)
    for _ in range(500):
        t = "▁" + "".join(rng.choice("thesaingoru") for _ in range(rng.randrange(14)))
        assert codec.backtrack(t) == codec.merge(t)
        marks = "▁" * rng.randrange(1, 120)
        assert codec.backtrack(marks + t) == codec.merge(marks + t) and codec.backtrack(marks) == codec.merge(marks)


def test_frames(spark, library):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "é\n" * 9, "z")], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_codec.encode_digest(docs, PIECES).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _ in docs.collect():
        ids = library.encode(t or "")
        want.append((i or 0, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want)
    full = sentencepiece_codec.encode(docs, PIECES).collect()
    assert all(r.decoded == library.decode(r.ids) for r in full)
    assert sentencepiece_codec.encode_digest(docs.limit(0), PIECES).count() == 0
    more = sentencepiece_codec.with_ids(docs, PIECES, ids_col="n_tokens")
    assert more.columns == ["doc_id", "text", "n_tokens"] and next(r.n_tokens for r in more.collect() if r.doc_id == 1) == library.encode("a b")


def test_models_it_cannot_encode_are_refused(tmp_path):
    with pytest.raises(Exception):
        sentencepiece_codec.Codec(str(tmp_path / "none.model"))


def test_word_ids_equal_the_librarys():
    w = token_blocks.WordIds(WORDS)
    texts = samples(800, 4) + ["don't İ Σς <|endoftext|> x", "a²³ ª_!'", "\x1cx\xa0y", "It'S we'LL"]
    for t, x, e in zip(texts, w.encode(texts), w.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(x, w.width).tolist() == e.ids, t


@pytest.mark.parametrize("top", [65534, 2**32 - 2])
def test_blocks_round_trip(top):
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, top, n) for n in (1, 700, 3, 0, 64)] + [np.zeros(900, np.int64), np.tile([top, 0, 7], 200), rng.integers(0, 40, 500) ** 2]
    payloads = token_blocks.encode_blocks(blocks)
    back = token_blocks.decode_blocks(payloads, [len(b) for b in blocks])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back, strict=True))
    assert len(payloads[5]) < 20 and len(payloads[6]) < 150  # what repeats is predicted
    alone = token_blocks.encode_blocks(blocks[1:2])[0]
    assert (alone == payloads[1]).all()  # a block doesn't depend on its neighbours


def test_blocks_of_many_lanes_round_trip():
    rng = np.random.default_rng(7)
    blocks = [rng.integers(0, top, n) ** 2 for n, top in ((1023, 9), (1024, 200), (5000, 3), (70_001, 220), (2600, 2**15))] + [np.zeros(20_000, np.int64), np.tile([5, 0, 7], 4000)]
    payloads = token_blocks.encode_blocks(blocks)
    back = token_blocks.decode_blocks(payloads, [len(b) for b in blocks])
    assert all(a.tolist() == b.tolist() for a, b in zip(blocks, back, strict=True))
    for k in (3, 6):
        assert (token_blocks.encode_blocks([blocks[k]])[0] == payloads[k]).all()
        assert (token_blocks.decode_blocks([payloads[k]], [len(blocks[k])])[0] == blocks[k]).all()


def test_blocks_take_little_time():
    import time

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
    w = token_blocks.WordIds(WORDS)
    ids = np.frombuffer(b"".join(w.encode([t or "" for t in docs["text"]])), w.width).astype(np.int64)
    blocks = [ids[k : k + token_blocks.BLOCK] for k in range(0, len(ids), token_blocks.BLOCK)]
    start = time.process_time()
    back = token_blocks.decode_blocks(token_blocks.encode_blocks(blocks), [len(b) for b in blocks])
    assert (time.process_time() - start) / len(ids) < 8e-6
    assert (np.concatenate(back) == ids).all()


def test_blocks_need_no_sort_or_search_for_each_id(monkeypatch):
    asked = []
    for name, k in (("unique", 0), ("searchsorted", 1), ("sort", 0), ("argsort", 0)):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), k=k, **b: asked.append(np.size(a[k])) or f(*a, **b))
    ids = np.random.default_rng(4).zipf(1.3, 300_000) % 49_000
    blocks = [ids[:200_000], ids[200_000:]]
    back = token_blocks.decode_blocks(token_blocks.encode_blocks(blocks), [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    assert sum(asked) < len(ids) / 50


def test_new_words_are_not_normalised_again():
    w = token_blocks.WordIds(WORDS)
    texts, library = ["It'S the CAT, Äpfel: don't 1984!"], w.library
    w.library, w._by_library = None, lambda odd: [1 / 0 for _ in odd]
    assert np.frombuffer(w.encode(texts)[0], w.width).tolist() == library.encode(texts[0], add_special_tokens=False).ids


def test_texts_in_other_letters_beside_plain_ones():
    w = token_blocks.WordIds(WORDS)
    w._CHARS, w._AT_ONCE = 32, 64
    plain, other = ["the cat sat on a mat " * 9, "", "it's"], ["İ", "plain at first " * 9 + "Σς 猫 😀", "a\x00b", "x" * 40]
    for texts in (other, plain + other, other[:1] + plain, [*other * 3, *plain * 3]):
        for t, x, e in zip(texts, w.encode(texts), w.library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(x, w.width).tolist() == e.ids, t


def test_ranks_are_those_of_a_sort():
    rng = np.random.default_rng(9)
    for ids in (np.array([7]), np.zeros(5, np.int64), rng.integers(0, 49_000, 5000), rng.integers(0, 2**32 - 2, 5000), np.array([0, (1 << 18) - 1, 1 << 18])):
        got, want = token_blocks._ranked(ids), np.unique(ids, return_inverse=True)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_words_equal_the_librarys_pattern():
    w = token_blocks.WordIds(WORDS)
    rng = random.Random(8)
    letters, few = [*map(chr, [*range(32, 127), *range(0xA1, 0x250)]), "\t", "\n", "\r"], list("''''strevlmd  !.12aé\n")
    for chars in (1 << 19, 1 << 7):
        w._CHARS = chars
        w.forget()
        texts = ["".join(rng.choice(rng.choice((letters, few))) for _ in range(rng.randrange(400))) for _ in range(300)] + ["".join(rng.choice(few) for _ in range(30)) for _ in range(300)]
        texts += ["", "'", "a'", "'ll", "'l", "é" * 900 + " a", "it's " * 90]
        for t, x, e in zip(texts, w.encode(texts), w.library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(x, w.width).tolist() == e.ids, t


def test_alphabets_round_trip():
    rng = np.random.default_rng(6)
    for n, top in ((1, 2**32 - 2), (2, 2**32 - 2), (300, 400), (5000, 49_000), (900, 2**32 - 2)):
        x = np.unique(rng.integers(0, top + 1, n))
        words = token_blocks._alphabet_words(x)
        got, size = token_blocks._alphabet(np.concatenate([words, np.full(9, 0xFFFF, np.uint16)]))
        assert (got == x).all() and size == len(words)


def test_blocks_are_smaller_than_order_0_and_zlib():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
    w = token_blocks.WordIds(WORDS)
    ids = np.concatenate([np.append(np.frombuffer(x, w.width), 2) for x in w.encode([t or "" for _, t in sorted(zip(docs["doc_id"], docs["text"], strict=True))])]).astype(np.int64)
    blocks = [ids[k : k + token_blocks.BLOCK] for k in range(0, len(ids) - token_blocks.BLOCK + 1, token_blocks.BLOCK)]
    assert len(blocks) > 2
    payloads = token_blocks.encode_blocks(blocks)  # that they are read back is tested above, and in files
    for b, x in zip(blocks, payloads, strict=True):
        share = np.unique(b, return_counts=True)[1] / len(b)
        assert 16 * len(x) < -len(b) * (share * np.log2(share)).sum() and 2 * len(x) < len(zlib.compress(b.astype("<u2").tobytes(), 9))


def test_crc_of_joined_strings():
    for a, b in ((b"abc", b"defg"), (b"", b"x"), (b"x" * 999, b"y" * 7777), (b"z", b"")):
        assert token_blocks.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_files_of_blocks(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(7, "the cat " * 900), (3, None), (5, ""), (9, "sat, on"), (9, "sat"), (None, "x y"), (8, "ab " * 3000)], "doc_id long, text string")
    path = str(tmp_path / "blocks")
    token_blocks.write(docs, WORDS, 2, path, block=128, lanes=8)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_blocks.read_documents(spark, path).collect())
    t, at, want = Tokenizer.from_file(WORDS), 0, []
    for i, text in sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    row = spark.read.parquet(path).first()
    bad = bytearray(row.data)
    bad[-5] ^= 255
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in (row.part, row.first, row.doc, bytes(bad))], ["part", "first", "doc", "data"])
    with pytest.raises(ValueError, match="checksum"):
        list(token_blocks.blocks_of(iter([batch])))
    token_blocks.write(docs.limit(0), WORDS, 2, str(tmp_path / "empty"))
    assert token_blocks.read_documents(spark, str(tmp_path / "empty")).count() == 0
