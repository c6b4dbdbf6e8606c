import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import mine, oracle

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert mine(QUERIES[name](spark, DATA)) == oracle(name, ORACLE_SQL[name], DATA)


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op2_pii_crf", "op3_language_id", "op6_token_blocks", "op8_suffix_dedup", "op9_exact_dedup", "op10_order_minhash"])
def test_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES[name](spark, DATA)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for (_, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True], strict=True):
        after = stage(spark, docs, DATA)
        if not last:
            assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert docs.count() > 100 and "token_ids" in docs.columns
    assert docs.filter("n_tokens <> size(token_ids)").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == {r.doc_id for r in docs.collect()}


def test_the_pipeline_removes_what_is_planted(spark):
    """Near copies whose lines all differ, a benchmark passage and a repeated line, beside documents that stay as they are."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    long = max((r.text for r in docs.filter("lang = 'en'").collect() if r.text), key=len).replace("\n", " ").split()
    made = [" ".join(long[k * 150 : k * 150 + 150][::-1]) for k in range(6)]
    near = [" ".join(w if k not in (3, 77) else "changed" for k, w in enumerate(t.split())) for t in made[:2]]
    line = "please subscribe to our weekly letter"
    texts = [*made, *near, f"{made[2][::-1]} {passage}", f"{line}\n{' '.join(made[3].split()[::-1])}", f"{line}\n{' '.join(made[4].split()[::-1])}"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], schema)
    kept = rows
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, spark.createDataFrame(kept.collect(), schema), DATA)
    got = {r.doc_id: r.text for r in kept.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 9, 10}
    assert all(got[k] == texts[k] for k in (0, 1, 2, 3, 4, 5, 9)) and got[10] == texts[10].partition("\n")[2]


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "asdf qwer jkl zxcv hjkl uiop asdfgh " * 20,
]


def test_foreign_latin_text_goes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    foreign = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(foreign), DATA)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    """Nulls, repeated rows, ties, extra columns and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, rep string, same string"
    rows = [(1, "alpha beta gamma delta", "en", "s", 22, 1, 1, "a", "b"), (1, "alpha beta gamma delta", "en", "s", 22, 1, 1, "a", "b"), (2, None, None, None, None, None, None, None, None), (None, "one two three", "en", "s", 13, 2, 2, "c", "d"), (3, "", "fr", "s", 0, 3, 3, "", "")]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, DATA)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert {r.text for r in out.collect()} >= {"alpha beta gamma delta"}
    assert stage(spark, docs.limit(0), DATA).count() == 0
