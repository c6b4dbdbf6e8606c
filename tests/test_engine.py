import io
import math
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.columns import BindProblem
from millrace.operators import relational as op
from millrace.session import Session, main
from millrace.sources.catalog import catalog_text, parse_catalog, schema_of
from millrace.sources.tables import SORTED, Store
from millrace.sources.text import malformed, read_text


@pytest.fixture
def t(spark):
    return spark.createDataFrame([(7, 2, 1.5, "a"), (-7, 2, 2.5, "b"), (7, 3, 1.5, "a"), (0, 1, -4.0, "c")], "x int, y bigint, z double, s string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sums(t):
    assert rows(op.sum_(t, "x / y")) == [(3 - 3 + 2 + 0,)]  # truncates toward zero
    assert rows(op.sum_(t, "x", only_distinct=True)) == [(0,)]
    assert rows(op.sum_(op.select_pipe(t, "(x > 100)"), "z")) == [(0.0,)]
    assert rows(op.group_by(t, ["s"], "z", only_distinct=True)) == [(-4.0, "c"), (1.5, "a"), (2.5, "b")]
    assert op.group_by(op.select_pipe(t, "(x > 100)"), ["s"], "z").collect() == []
    assert op.sum_(t, "x").schema[0].dataType.simpleString() == "bigint"
    with pytest.raises(BindProblem):
        op.sum_(t, "s + 1")
    with pytest.raises(BindProblem):
        op.group_by(t, [], "x")


def test_predicates_need_equal_classes(t):
    for bad in ("(x = 1.0)", "(z < 2)", "(s > 1)", "(q = 1)"):
        with pytest.raises(BindProblem):
            op.select_pipe(t, bad)
    assert op.select_pipe(t, "(x > y)").count() == 2
    assert op.select_pipe(t, "('b' = s OR 3 < y)").count() == 1


def test_join_keeps_bags(spark):
    a = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "k int, w int")
    joined = op.join(a, b, "(k = w)")
    assert joined.columns == ["k", "v", "k", "w"] and joined.count() == 0
    b = b.withColumnRenamed("k", "j")
    assert op.join(a, b, "(k = j)").count() == 4
    assert op.join(a, b.limit(0), "(k = j)").count() == 0
    assert op.join(a, a.toDF("k2", "v2"), "(k < k2)").count() == 2
    assert op.join(a, b).count() == 9


def test_projection_distinct_and_sort(t):
    assert op.project(t, ["z", "x"]).columns == ["z", "x"]
    assert op.distinct(op.project(t, ["x", "s"])).count() == 3
    assert op.order_on_all(t) == ["x", "y", "z", "s"]
    assert [tuple(r) for r in op.sort(op.project(t, ["x", "y"]), "(x) AND (y)").collect()] == [(-7, 2), (0, 1), (7, 2), (7, 3)]


@pytest.mark.parametrize("value", [0.0, 1.0, -1.5, 123456.0, 1234567.0, 0.0001, 0.00001234, 999999.5, 100.0, 2.74251602e8, 3.14159265, -0.5, 1e-300, float("inf"), 12345.678, 99999.94])
def test_numbers_as_text(spark, value):
    assert spark.range(1).select(op.number_text(F.lit(value)).alias("v")).first().v == "%g" % value


def test_lines(t):
    assert op.lines(t.limit(1)).first().value == "x: [7], y: [2], z: [1.5], s: [a]"


def test_catalog_round_trip():
    text = "BEGIN\nt\nt.tbl\na Int\nb Double\nc String\nEND\n\nBEGIN u u.tbl k Int END"
    found = parse_catalog(text)
    assert found["t"].schema.names == ["a", "b", "c"] and found["u"].file == "u.tbl"
    assert parse_catalog(catalog_text(found)) == found
    for bad in ("x", "BEGIN t", "BEGIN t f a END", "BEGIN t f a Blob END"):
        with pytest.raises(ValueError):
            parse_catalog(bad)


def test_text_files(spark, tmp_path):
    (tmp_path / "t.tbl").write_text('1|2.5|say "hi"|\n||\\|\n12abc|x|é|\n')
    schema = schema_of([("a", "Int"), ("b", "Double"), ("c", "String")])
    assert rows(read_text(spark, str(tmp_path / "t.tbl"), schema)) == [(0, 0.0, "\\"), (0, 0.0, "é"), (1, 2.5, 'say "hi"')]
    assert tuple(malformed(spark, str(tmp_path / "t.tbl"), schema).first()) == (1, 1)


def test_sorted_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    t = store.create("t", schema_of([("a", "Int"), ("s", "String")]), SORTED, ["s"])
    parts = lambda: [n for n in store.files.names(t.path) if n.startswith("part-")]
    assert t.scan().count() == 0
    for part in ([(1, "d"), (2, "b")], [(3, "a"), (4, "c"), (5, "b")]):
        t.append(spark.createDataFrame(part, "a int, s string"))
    began = t.scan()
    assert [r.s for r in t.sorted_scan().collect()] == ["a", "b", "b", "c", "d"] and len(parts()) == 2  # reads change nothing
    t.compact()
    assert len(parts()) == 2  # too few to merge
    t.compact(full=True)
    assert rows(t.scan("(s = 'b')")) == [(2, "b"), (5, "b")] and len(t._state()["parts"]) == 1
    assert began.count() == 5  # a reader that began before keeps its files
    t.vacuum()
    assert len(parts()) == 3
    t.vacuum(0)
    assert len(parts()) == 1 and t.scan().count() == 5
    assert store.create("u", schema_of([("s", "String"), ("a", "Int")]), SORTED).keys == ["a", "s"]
    assert store.names() == ["t", "u"]
    store.drop("t")
    assert "t" not in store
    with pytest.raises(FileNotFoundError):
        store.open("t")
    with pytest.raises(ValueError):
        store.create("u", schema_of([("a", "Int")]))
    with pytest.raises(ValueError):
        store.create("v", schema_of([("a", "Int")]), SORTED, ["b"])
    made = store.sink("w", spark.createDataFrame([(2, "x"), (1, "y")], "a int, s string"))
    assert made.keys == ["a", "s"] and [r.a for r in made.sorted_scan().collect()] == [1, 2]


def test_appends_at_the_same_time_lose_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    t = store.create("t", schema_of([("a", "Int")]), SORTED, ["a"])
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: store.open("t").append(spark.range(k, k + 1).selectExpr("cast(id as int) AS a")), range(12)))
    assert sorted(r.a for r in t.scan().collect()) == list(range(12)) and t._state()["number"] == 13
    t.compact()
    assert sorted(r.a for r in t.scan().collect()) == list(range(12)) and sorted(p["tier"] for p in t._state()["parts"]) == [1]
    (tmp_path / "store" / "t" / "state-00000099.json").write_text("{")  # a writer died here
    t.append(spark.range(12, 13).selectExpr("cast(id as int) AS a"))
    assert t.scan().count() == 13 and t._state()["number"] == 100
    state = t._state()
    t.append(spark.range(1).selectExpr("cast(id as int) AS a"))
    assert not t._become(state)  # the number is taken
    store.files.write(f"{store.path}/x.json", "old")
    store.files.write(f"{store.path}/x.json", "new")
    assert store.files.read(f"{store.path}/x.json") == "new" and not store.files.create(f"{store.path}/x.json", "other")


def test_a_name_equal_to_itself_is_a_full_scan(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (2, "b")], "x int, s string")
    assert op.select_pipe(df, "(x = x) AND (s = s)").count() == 3
    assert op.select_pipe(df, "(x = x OR x > 5)").count() == 3 and op.select_pipe(df, "(x < x)").count() == 0
    s = Session(spark)
    s.register("t", df)
    assert s.query("SELECT a.x FROM t AS a WHERE (a.x = a.x)").count() == 3
    assert s.query("SELECT a.x FROM t AS a, t AS b WHERE (a.x = b.x)").count() == 2


def test_division(t):
    assert rows(op.sum_(t, "z / 2")) == [(0.75,)] and rows(op.sum_(t, "x / 2.0")) == [(3.5,)]
    assert rows(op.sum_(t, "(0 - x) / 2")) == [(-3 + 3 - 3,)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        op.sum_(t, "z / 0.0").collect()


def test_session(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|2.5|x|\n2|3.5|y|\n")
    out = io.StringIO()
    s = Session(spark, f"file://{tmp_path}/store", str(tmp_path), out=out)
    s.execute("CREATE TABLE t (a INTEGER, b DOUBLE, c STRING) AS SORTED ON c")
    s.execute("INSERT 't.tbl' INTO t")
    s.execute(f"INSERT '{tmp_path}/t.tbl' INTO t")
    df = s.execute("SELECT r.a, r.c FROM t AS r WHERE (r.b > 3.0)")
    assert rows(df) == [(2, "y"), (2, "y")] and df.columns == ["a", "c"]
    assert "r.a: [2], r.c: [y]" in out.getvalue() and "Query returned 2 records" in out.getvalue()
    s.execute("SET OUTPUT NONE")
    assert s.execute("SELECT SUM (r.a) FROM t AS r WHERE (r.b > 3.0)") is None and "Physical Plan" in out.getvalue()
    s.execute(f"SET OUTPUT '{tmp_path}/result'")
    Session(spark, f"file://{tmp_path}/store").execute("SELECT SUM (r.a) FROM t AS r WHERE (r.b > 3.0)")
    assert [r.value for r in spark.read.text(f"{tmp_path}/result").collect()] == ["sum_result: [4]"]
    s.execute("DROP TABLE t")
    main(spark, s, io.StringIO("SELECT r.a FROM t AS r WHERE (r.a > 0)\n\nnonsense\n"))
    assert "unknown table t" in out.getvalue() and "SyntaxProblem" in out.getvalue()


def test_planner_decisions(spark, t):
    s = Session(spark)
    s.register("t", t)
    s.register("u", spark.createDataFrame([(1, 5), (2, 6)], "y bigint, w int"))
    assert rows(s.query("SELECT x, w FROM t AS a, u AS b WHERE (a.y = b.y)")) == [(-7, 6), (0, 5), (7, 6)]
    assert s.query("SELECT a.x, b.w FROM t AS a, u AS b WHERE (a.x > 0)").count() == 4  # no predicate on u: all pairs
    assert s.query("SELECT a.x FROM t AS a, u AS b WHERE (a.y = b.y) AND (b.w > a.x)").count() == 2
    assert s.query("SELECT a.x FROM t AS a WHERE (a.x < a.y)").count() == 2
    assert s.query("SELECT a.x FROM t AS a WHERE (1 = 2)").count() == 0
    assert s.query("SELECT SUM (a.z) FROM t AS a WHERE (a.x > -9) GROUP BY a.s, a.y").columns == ["agg_result", "s", "y"]
    for bad in (
        "SELECT a.x FROM t AS a WHERE (a.nope = 1)", "SELECT y FROM t AS a, u AS b WHERE (a.x = b.w)", "SELECT SUM (a.x), a.s FROM t AS a WHERE (a.x > 0)", "SELECT a.s FROM t AS a WHERE (a.x > 0) GROUP BY a.s",
        "SELECT SUM (a.x), a.z FROM t AS a WHERE (a.x > 0) GROUP BY a.s", "SELECT a.x FROM t AS a, u AS a WHERE (a.x > 0)", "SELECT a.x FROM t AS a WHERE (b.x > 0)",
    ):
        with pytest.raises(BindProblem):
            s.query(bad)


def test_days_reach_the_files(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(id) AS d, id FROM range(100)").write.parquet(str(tmp_path / "d"))
    df = op.select_file(spark, str(tmp_path / "d"), "(d > '2020-03-01')")
    assert df.count() == 39 and "PushedFilters: [IsNotNull(d), GreaterThan(d" in df._jdf.queryExecution().toString()
    assert op.select_file(spark, str(tmp_path / "d"), "(d > '2020-03-1')").count() == 31


def test_join_pushes_filters_and_prunes(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "id % 7 AS v", "id AS w").write.parquet(str(tmp_path / "big.parquet"))
    s = Session(spark)
    s.register_parquet(str(tmp_path), "big")
    plan = s.query("SELECT SUM (a.v) FROM big AS a, big AS b WHERE (a.k = b.w) AND (b.v < 3)")._jdf.queryExecution().toString()
    assert "LessThan(v,3)" in plan and "CartesianProduct" not in plan and "ReadSchema: struct<k:bigint,v:bigint>" in plan


values = st.integers(-3, 3)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(values, values), min_size=1, max_size=12), cnf=st.lists(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("<>="), values), min_size=1, max_size=3), min_size=1, max_size=3))
def test_random_predicates(spark, data, cnf):
    compare = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "=": lambda x, y: x == y}
    text = " AND ".join("(" + " OR ".join(f"{n} {o} {v}" for n, o, v in g) + ")" for g in cnf)
    wanted = sorted(r for r in data if all(any(compare[o](r["ab".index(n)], v) for n, o, v in g) for g in cnf))
    df = spark.createDataFrame(data, "a int, b int")
    kept = op.select_pipe(df, text)
    assert rows(kept) == wanted
    total = op.sum_(kept, "a * 2").first()[0]
    assert total == 2 * sum(r[0] for r in wanted) and not math.isnan(total)
    assert sum(r[0] for r in op.group_by(kept, ["b"], "a * 2").collect()) == total
