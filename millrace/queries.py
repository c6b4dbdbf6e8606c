"""The engine's registered queries, and their SQL for another engine on the same tables."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.columns import quoted
from millrace.operators import relational as op
from millrace.plans.statistics import Statistics, profile, tpch
from millrace.session import Session, main
from millrace.sources.tables import SORTED, Files, Store
from millrace.sources.text import read_text, write_text

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"]
Query = Callable[[SparkSession, str], DataFrame]


def partsupp(lineitem: DataFrame) -> DataFrame:
    """The parts that suppliers deliver, made of lineitem where the table itself is absent."""
    return lineitem.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.sum("l_linenumber").cast("int").alias("ps_availqty"), F.min("l_extendedprice").alias("ps_supplycost")
    )


PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(l_linenumber) AS INT) AS ps_availqty, min(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY ALL)"


def session(spark: SparkSession, sf_dir: str, statistics: Statistics | None = None) -> Session:
    s = Session(spark, statistics=statistics)
    s.register_parquet(sf_dir, *TABLES)
    if Files(spark).exists(f"{sf_dir}/partsupp.parquet"):
        s.register_parquet(sf_dir, "partsupp")
    else:
        s.register("partsupp", partsupp(s.table("lineitem")))
    return s


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.select(*(F.round(quoted(c), places[c]).alias(c) if c in places else quoted(c) for c in df.columns))


def sql(text: str, **places: int) -> Query:
    return lambda spark, sf_dir: rounded(session(spark, sf_dir).query(text), **places)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Statements of the dialect, known cases among them, with the SQL that another engine gets for each.
STATEMENTS: dict[str, tuple[str, dict[str, int], str]] = {
    "filter_lt": (
        "SELECT l.l_orderkey, l.l_partkey, l.l_suppkey FROM lineitem AS l WHERE (l.l_discount < 0.03) AND (l.l_quantity > 45.0)", {},
        "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_discount < 0.03 AND l_quantity > 45.0",
    ),
    "filter_string_eq": (
        "SELECT s.s_suppkey, s.s_name FROM supplier AS s WHERE (s.s_name = 'Supplier#000000010')", {},
        "SELECT s_suppkey, s_name FROM supplier WHERE s_name = 'Supplier#000000010'",
    ),
    "filter_string_range": (
        "SELECT c.c_custkey, c.c_name FROM customer AS c WHERE (c.c_name > 'Customer#000001400')", {},
        "SELECT c_custkey, c_name FROM customer WHERE c_name > 'Customer#000001400'",
    ),
    "filter_cnf_or": (
        "SELECT l.l_orderkey, l.l_linenumber FROM lineitem AS l WHERE (l.l_returnflag = 'R') AND (l.l_discount < 0.04 OR l.l_linestatus = 'O')", {},
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND (l_discount < 0.04 OR l_linestatus = 'O')",
    ),
    "filter_cnf_or_band": (
        "SELECT l.l_orderkey, l.l_partkey, l.l_suppkey FROM lineitem AS l WHERE (l.l_returnflag = 'R') AND (l.l_discount < 0.04 OR l.l_linestatus = 'O') AND (l.l_orderkey > 5000) AND (l.l_orderkey < 6000)", {},
        "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND (l_discount < 0.04 OR l_linestatus = 'O') AND l_orderkey > 5000 AND l_orderkey < 6000",
    ),
    "filter_att_att": (
        "SELECT l.l_orderkey, l.l_linenumber FROM lineitem AS l WHERE (l.l_tax > l.l_discount)", {},
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount",
    ),
    "filter_partsupp": (
        "SELECT ps.ps_partkey, ps.ps_suppkey, ps.ps_availqty FROM partsupp AS ps WHERE (ps.ps_partkey < 100) AND (ps.ps_suppkey < 50)", {},
        f"SELECT ps_partkey, ps_suppkey, ps_availqty FROM {PARTSUPP} WHERE ps_partkey < 100 AND ps_suppkey < 50",
    ),
    "filter_tautology": ("SELECT d.doc_id, d.n_chars FROM documents AS d WHERE (d.lang = d.lang) AND (d.text = d.text)", {}, "SELECT doc_id, n_chars FROM documents"),
    "filter_literal_left": ("SELECT p.p_partkey, p.p_size FROM part AS p WHERE (45 < p.p_size)", {}, "SELECT p_partkey, p_size FROM part WHERE 45 < p_size"),
    "filter_date": (
        "SELECT o_orderkey FROM orders AS o WHERE (o.o_orderdate > '1998-06-01') AND (o.o_orderdate < '1998-07-15')", {},
        "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-07-15'",
    ),
    "filter_constant": ("SELECT r.r_name FROM region AS r WHERE (1 = 2 OR 3 > 2)", {}, "SELECT r_name FROM region"),
    "project_reorder": (
        "SELECT p.p_retailprice, p.p_partkey, p.p_name FROM part AS p WHERE (p.p_retailprice > 931.01) AND (p.p_retailprice < 950.3)", {},
        "SELECT p_retailprice, p_partkey, p_name FROM part WHERE p_retailprice > 931.01 AND p_retailprice < 950.3",
    ),
    "sum_int": ("SELECT SUM (l.l_linenumber) FROM lineitem AS l WHERE (l.l_quantity > 0.0)", {}, "SELECT CAST(sum(l_linenumber) AS BIGINT) AS sum_result FROM lineitem"),
    "sum_double_expr": (
        "SELECT SUM (s.s_acctbal + (s.s_acctbal * 1.05)) FROM supplier AS s WHERE (s.s_suppkey > -1)", {"sum_result": 2},
        "SELECT round(sum(s_acctbal + s_acctbal * 1.05), 2) AS sum_result FROM supplier",
    ),
    "sum_revenue": (
        "SELECT SUM (l.l_extendedprice * l.l_discount) FROM lineitem AS l WHERE (l.l_discount < 0.07) AND (l.l_quantity < 24.0)", {"sum_result": 2},
        "SELECT round(sum(l_extendedprice * l_discount), 2) AS sum_result FROM lineitem WHERE l_discount < 0.07 AND l_quantity < 24.0",
    ),
    "sum_right_assoc": (
        "SELECT SUM (l.l_extendedprice - l.l_discount - l.l_tax) FROM lineitem AS l WHERE (l.l_quantity > 0.0)", {"sum_result": 2},
        "SELECT round(sum(l_extendedprice - (l_discount - l_tax)), 2) AS sum_result FROM lineitem",
    ),
    "sum_neg": ("SELECT SUM (- l.l_linenumber + 3) FROM lineitem AS l WHERE (l.l_quantity > 0.0)", {}, "SELECT CAST(sum(-(l_linenumber + 3)) AS BIGINT) AS sum_result FROM lineitem"),
    "sum_int_div": ("SELECT SUM (p.p_size / 7) FROM part AS p WHERE (p.p_size > 0)", {}, "SELECT CAST(sum(p_size // 7) AS BIGINT) AS sum_result FROM part"),
    "sum_int_div_negative": ("SELECT SUM ((3 - p.p_size) / 7) FROM part AS p WHERE (p.p_size > 0)", {}, "SELECT CAST(sum(trunc((3 - p_size) / 7.0)) AS BIGINT) AS sum_result FROM part"),
    "sum_double_div": (
        "SELECT SUM (l.l_extendedprice / l.l_quantity) FROM lineitem AS l WHERE (l.l_quantity > 0.0)", {"sum_result": 2},
        "SELECT round(sum(l_extendedprice / l_quantity), 2) AS sum_result FROM lineitem",
    ),
    "sum_mixed_div": (
        "SELECT SUM (p.p_retailprice / p.p_size) FROM part AS p WHERE (p.p_size > 0)", {"sum_result": 2},
        "SELECT round(sum(p_retailprice / p_size), 2) AS sum_result FROM part",
    ),
    "sum_empty": ("SELECT SUM (l.l_extendedprice) FROM lineitem AS l WHERE (l.l_quantity < 0.0)", {}, "SELECT coalesce(sum(l_extendedprice), 0.0) AS sum_result FROM lineitem WHERE l_quantity < 0.0"),
    "sum_distinct_int": ("SELECT SUM DISTINCT (p.p_size) FROM part AS p WHERE (p.p_size > 0)", {}, "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS sum_result FROM part"),
    "sum_distinct_double": (
        "SELECT SUM DISTINCT (l.l_discount) FROM lineitem AS l WHERE (l.l_quantity > 0.0)", {"sum_result": 4},
        "SELECT round(sum(DISTINCT l_discount), 4) AS sum_result FROM lineitem",
    ),
    "group_sum": (
        "SELECT SUM (l.l_extendedprice), s.s_nationkey FROM supplier AS s, lineitem AS l WHERE (s.s_suppkey = l.l_suppkey) GROUP BY s.s_nationkey", {"agg_result": 2},
        "SELECT round(sum(l_extendedprice), 2) AS agg_result, s_nationkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_nationkey",
    ),
    "group_sum_multi": (
        "SELECT SUM (l.l_quantity) FROM lineitem AS l WHERE (l.l_quantity > 0.0) GROUP BY l.l_returnflag, l.l_linestatus", {"agg_result": 2},
        "SELECT round(sum(l_quantity), 2) AS agg_result, l_returnflag, l_linestatus FROM lineitem GROUP BY ALL",
    ),
    "group_sum_distinct": (
        "SELECT SUM DISTINCT (l.l_linenumber), l.l_returnflag FROM lineitem AS l WHERE (l.l_quantity > 0.0) GROUP BY l.l_returnflag", {},
        "SELECT CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS agg_result, l_returnflag FROM lineitem GROUP BY l_returnflag",
    ),
    "group_shipping": (
        "SELECT SUM (l.l_extendedprice * (1 - l.l_discount)), l.l_orderkey, o.o_orderdate, o.o_orderpriority FROM customer AS c, orders AS o, lineitem AS l "
        "WHERE (c.c_mktsegment = 'BUILDING') AND (c.c_custkey = o.o_custkey) AND (l.l_orderkey = o.o_orderkey) AND (l.l_orderkey < 100 OR o.o_orderkey < 100) "
        "GROUP BY l.l_orderkey, o.o_orderdate, o.o_orderpriority", {"agg_result": 2},
        "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS agg_result, l_orderkey, o_orderdate, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey "
        "JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND (l_orderkey < 100 OR o_orderkey < 100) GROUP BY ALL",
    ),
    "distinct_one": ("SELECT DISTINCT l.l_suppkey FROM lineitem AS l WHERE (l.l_extendedprice < 2000.0)", {}, "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_extendedprice < 2000.0"),
    "distinct_multi": ("SELECT DISTINCT c.c_nationkey, c.c_mktsegment FROM customer AS c WHERE (c.c_custkey > -1)", {}, "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer"),
    "distinct_join": (
        "SELECT DISTINCT s.s_name FROM supplier AS s, part AS p, partsupp AS ps WHERE (s.s_suppkey = ps.ps_suppkey) AND (p.p_partkey = ps.ps_partkey) AND (p.p_brand = 'Brand#4') AND (ps.ps_supplycost < 20000.0)", {},
        f"SELECT DISTINCT s_name FROM supplier JOIN {PARTSUPP} ON s_suppkey = ps_suppkey JOIN part ON p_partkey = ps_partkey WHERE p_brand = 'Brand#4' AND ps_supplycost < 20000.0",
    ),
    "join2_sum": (
        "SELECT SUM (c.c_acctbal) FROM customer AS c, orders AS o WHERE (c.c_custkey = o.o_custkey) AND (o.o_totalprice < 10000.0)", {"sum_result": 2},
        "SELECT round(sum(c_acctbal), 2) AS sum_result FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice < 10000.0",
    ),
    "join3_sum": (
        "SELECT SUM (ps.ps_supplycost) FROM part AS p, supplier AS s, partsupp AS ps WHERE (p.p_partkey = ps.ps_partkey) AND (s.s_suppkey = ps.ps_suppkey) AND (s.s_acctbal > 2500.0)", {"sum_result": 2},
        f"SELECT round(sum(ps_supplycost), 2) AS sum_result FROM {PARTSUPP} JOIN part ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey WHERE s_acctbal > 2500.0",
    ),
    "join3_point": (
        "SELECT SUM (l.l_discount) FROM customer AS c, orders AS o, lineitem AS l WHERE (c.c_custkey = o.o_custkey) AND (o.o_orderkey = l.l_orderkey) AND (c.c_name = 'Customer#000000919') AND (l.l_quantity > 30.0) AND (l.l_discount < 0.03)", {"sum_result": 4},
        "SELECT round(coalesce(sum(l_discount), 0.0), 4) AS sum_result FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_name = 'Customer#000000919' AND l_quantity > 30.0 AND l_discount < 0.03",
    ),
    "join5": (
        "SELECT ps.ps_suppkey FROM part AS p, partsupp AS ps, supplier AS s, nation AS n, region AS r WHERE (p.p_partkey = ps.ps_partkey) AND (p.p_size = 2) AND (s.s_suppkey = ps.ps_suppkey) AND (s.s_nationkey = n.n_nationkey) AND (n.n_regionkey = r.r_regionkey) AND (r.r_name = 'AMERICA')", {},
        f"SELECT ps_suppkey FROM {PARTSUPP} JOIN part ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size = 2 AND r_name = 'AMERICA'",
    ),
    "join5_distinct": (
        "SELECT DISTINCT c.c_name FROM lineitem AS l, orders AS o, customer AS c, nation AS n, region AS r WHERE (l.l_orderkey = o.o_orderkey) AND (o.o_custkey = c.c_custkey) AND (c.c_nationkey = n.n_nationkey) AND (n.n_regionkey = r.r_regionkey)", {},
        "SELECT DISTINCT c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "join5_filtered": (
        "SELECT l.l_discount FROM customer AS c, orders AS o, lineitem AS l, nation AS n, region AS r WHERE (c.c_custkey = o.o_custkey) AND (o.o_orderkey = l.l_orderkey) AND (c.c_nationkey = n.n_nationkey) AND (n.n_regionkey = r.r_regionkey) AND (r.r_regionkey = 1) AND (o.o_orderkey < 10000)", {},
        "SELECT l_discount FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 AND o_orderkey < 10000",
    ),
    "self_join": (
        "SELECT c1.c_name, c2.c_name FROM customer AS c1, customer AS c2 WHERE (c1.c_nationkey = c2.c_nationkey) AND (c1.c_name = 'Customer#000000070')", {},
        """SELECT c1.c_name AS "c1.c_name", c2.c_name AS "c2.c_name" FROM customer c1 JOIN customer c2 ON c1.c_nationkey = c2.c_nationkey WHERE c1.c_name = 'Customer#000000070'""",
    ),
    "join_multi_key": (
        "SELECT l.l_orderkey, l.l_linenumber, ps.ps_availqty FROM lineitem AS l, partsupp AS ps WHERE (l.l_partkey = ps.ps_partkey) AND (ps.ps_suppkey = l.l_suppkey)", {},
        f"SELECT l_orderkey, l_linenumber, ps_availqty FROM lineitem JOIN {PARTSUPP} ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey",
    ),
    "join_theta": ("SELECT s.s_suppkey, n.n_name FROM supplier AS s, nation AS n WHERE (s.s_nationkey < n.n_nationkey)", {}, "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey < n_nationkey"),
    "join_or": (
        "SELECT s.s_suppkey, n.n_name FROM supplier AS s, nation AS n WHERE (s.s_nationkey = n.n_nationkey OR s.s_suppkey < n.n_nationkey)", {},
        "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey OR s_suppkey < n_nationkey",
    ),
    "join_or3": (
        "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier AS s, nation AS n, region AS r WHERE (s.s_nationkey = n.n_nationkey) AND (n.n_regionkey = r.r_regionkey) AND (s.s_acctbal > 9000.0 OR n.n_nationkey < 3 OR r.r_name = 'ASIA')", {},
        "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 9000.0 OR n_nationkey < 3 OR r_name = 'ASIA'",
    ),
    "join_equi_residual": (
        "SELECT s.s_suppkey, c.c_custkey FROM supplier AS s, customer AS c WHERE (s.s_nationkey = c.c_nationkey) AND (s.s_acctbal > c.c_acctbal)", {},
        "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal",
    ),
    "cross_join": ("SELECT r.r_name, n.n_name FROM region AS r, nation AS n WHERE (n.n_nationkey < 4)", {}, "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 4"),
}


def _store(spark: SparkSession) -> Store:
    """A store in the folder that all executors share."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return Store(spark, f"{base}/store-{uuid.uuid4().hex}")


def sorted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the orders loaded, then the other half; a lookup on the first key in both."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    stored = _store(spark).create("orders", orders.schema, SORTED, ["o_custkey", "o_orderkey"])
    stored.append(orders.filter("o_orderkey % 2 = 0"))
    stored.append(orders.filter("o_orderkey % 2 <> 0"))
    return stored.scan("(o_custkey = 42)")


def heap_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    stored = _store(spark).create("nation", nation.schema)
    stored.append(nation)
    stored.append(nation.limit(0))
    stored.append(nation)
    return stored.scan()


def load_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, store = table(spark, sf_dir, "supplier"), _store(spark)
    write_text(supplier, f"{store.path}/supplier.tbl")
    return read_text(spark, f"{store.path}/supplier.tbl", supplier.schema)


def _violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many neighbours of sorted rows are out of order, in a partition or from one to the next."""
    rows = rows.select(*keys, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    key, w = F.struct(*keys), Window.partitionBy("p").orderBy("i")
    inside = rows.select("p", (F.lag(key).over(w) > key).alias("bad")).agg(F.count_if("bad").alias("n"))
    ends = rows.groupBy("p").agg(F.min(key).alias("low"), F.max(key).alias("high"))  # a row for each partition
    across = ends.select((F.lag("high").over(Window.orderBy("p")) > F.col("low")).alias("bad")).agg(F.count_if("bad").alias("n"))
    return inside.union(across).agg(F.sum("n").cast("bigint").alias("violations"))


def sort_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(op.sort(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "(o_custkey) AND (o_orderkey)"), ["o_custkey", "o_orderkey"])


def sorted_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of three appends, some merged, read in the order of its keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    stored = _store(spark).create("orders", orders.schema, SORTED, ["o_custkey", "o_orderkey"])
    for k in range(2):
        stored.append(orders.filter(f"o_orderkey % 3 = {k}"))
    stored.compact(full=True)
    stored.append(orders.filter("o_orderkey % 3 = 2"))
    read = stored.sorted_scan()
    return _violations(read, ["o_custkey", "o_orderkey"]).crossJoin(read.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total")))


def sort_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort's result as a stored table."""
    return _store(spark).sink("part", table(spark, sf_dir, "part").select("p_size", "p_partkey"), ["p_size", "p_partkey"]).scan("(p_size = 7)")


def order_on_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a sorted table that names none: Ints, Doubles, then Strings."""
    keys = _store(spark).create("part", table(spark, sf_dir, "part").schema, SORTED).keys
    return spark.createDataFrame(list(enumerate(keys)), "nth int, name string")


def _session_with_text(spark: SparkSession, sf_dir: str, name: str) -> tuple[Session, io.StringIO]:
    """A session over a new store, in whose folder the table lies as text."""
    store, out = _store(spark), io.StringIO()
    write_text(table(spark, sf_dir, name), f"{store.path}/text/{name}.tbl")
    return Session(spark, store.path, f"{store.path}/text", out=out), out


def statement_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE, INSERT twice and SELECT."""
    s, _ = _session_with_text(spark, sf_dir, "supplier")
    s.execute("CREATE TABLE supplier (s_suppkey INTEGER, s_name STRING, s_nationkey INTEGER, s_acctbal DOUBLE) AS HEAP")
    for _ in range(2):
        s.execute("INSERT 'supplier.tbl' INTO supplier")
    return s.query("SELECT s.s_suppkey, s.s_name FROM supplier AS s WHERE (s.s_acctbal > 1000.0)")


def statement_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _session_with_text(spark, sf_dir, "nation")
    s.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name STRING, n_regionkey INTEGER) AS SORTED ON n_regionkey, n_name")
    s.execute("INSERT 'nation.tbl' INTO nation")
    return s.query("SELECT SUM (n.n_nationkey), n.n_regionkey FROM nation AS n WHERE (n.n_regionkey > 0) GROUP BY n.n_regionkey")


def statement_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of two tables after DROP, and after one of the same name is made anew."""
    s, _ = _session_with_text(spark, sf_dir, "region")
    for name in ("a", "b"):
        s.execute(f"CREATE TABLE {name} (r_regionkey INTEGER, r_name STRING) AS HEAP")
        s.execute(f"INSERT 'region.tbl' INTO {name}")
    s.execute("DROP TABLE a")
    left = s.store.names()
    s.execute("CREATE TABLE a (r_regionkey INTEGER, r_name STRING) AS HEAP")
    counts = s.table("a").agg(F.count("*").alias("n")).withColumn("name", F.lit("a")).union(s.table("b").agg(F.count("*").alias("n")).withColumn("name", F.lit("b")))
    return counts.withColumn("left", F.lit(",".join(left)))


def statement_output_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written to a text file by a SELECT, doubles with six digits, in the file that SET OUTPUT names for sessions to come."""
    store = _store(spark)
    Session(spark, store.path).execute(f"SET OUTPUT '{store.path}/result'")
    later = Session(spark, store.path)
    later.register_parquet(sf_dir, "supplier")
    later.execute("SELECT s.s_suppkey, s.s_acctbal FROM supplier AS s WHERE (s.s_suppkey < 30)")
    return spark.read.text(f"{store.path}/result")


def statement_stdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that a loop of statements prints, the count of records last; a line that is wrong is reported and the next one read."""
    s, out = _session_with_text(spark, sf_dir, "region")
    s.register_parquet(sf_dir, "region")
    lines = ["SELECT r.r_name FROM region AS r WHERE (r.r_regionkey > 1)", "", "no statement", "SELECT SUM (r.r_regionkey) FROM region AS r WHERE (r.r_regionkey > 1)"]
    main(spark, s, io.StringIO("\n".join(lines)))
    return spark.createDataFrame([(x.partition(":")[0] if "Problem" in x else x,) for x in out.getvalue().splitlines()], "value string")


def statement_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET OUTPUT NONE prints the plan and runs nothing; STDOUT goes back to rows."""
    s, out = _session_with_text(spark, sf_dir, "region")
    s.register_parquet(sf_dir, "region")
    s.execute("SET OUTPUT NONE")
    nothing = s.execute("SELECT r.r_name FROM region AS r WHERE (r.r_regionkey > 1)") is None
    planned = "Physical Plan" in out.getvalue() and "Query returned" not in out.getvalue()
    s.execute("SET OUTPUT STDOUT")
    n = s.execute("SELECT r.r_name FROM region AS r WHERE (r.r_regionkey > 1)").count()
    return spark.createDataFrame([(nothing, planned, f"Query returned {n} records" in out.getvalue(), n)], "no_rows boolean, planned boolean, trailer boolean, n long")


def stats_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predicates applied one after the other to statistics that are written and read in between, of this data's own counts."""
    import tempfile

    s = Statistics()
    for name, keys in (("customer", ["c_custkey", "c_nationkey"]), ("orders", ["o_custkey", "o_orderkey"]), ("nation", ["n_nationkey"])):
        counts = profile(table(spark, sf_dir, name).select(*keys), exact=True).first().asDict()
        s.add_relation(name, counts.pop("num_tuples"))
        for k, n in counts.items():
            s.add_attribute(name, k, n)
    first = s.apply("(o_custkey = c_custkey)", ["orders", "customer"])
    with tempfile.TemporaryDirectory() as d:
        s.write(f"{d}/statistics")
        again = Statistics.read(f"{d}/statistics")
    second = again.apply("(c_nationkey = n_nationkey) AND (o_orderkey = 7 OR o_orderkey < 100)", ["orders", "customer", "nation"])
    return spark.createDataFrame([(round(first), round(second))], "joined long, chained long")


#: Predicates whose estimates are known, by relation names (and, where they differ, the tables behind them).
ESTIMATES: dict[str, tuple[list[tuple[str, str]], str, int]] = {
    "stats_estimate_or": ([("lineitem", "lineitem")], "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_shipmode = 'MAIL')", 857316),
    "stats_estimate_join": ([("orders", "o"), ("customer", "c"), ("nation", "n")], "(c.c_nationkey = n.n_nationkey) AND (o.o_custkey = c.c_custkey)", 1500000),
    "stats_estimate_same": ([("part", "p"), ("partsupp", "ps")], "(p.p_partkey = ps.ps_partkey) AND (p.p_size = 3 OR p.p_size = 6 OR p.p_size = 19)", 48000),
}


def _estimate(relations: list[tuple[str, str]], where: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = tpch()
        for table_, alias in relations:
            if alias != table_:
                s.copy_relation(table_, alias)
        return spark.createDataFrame([(round(s.estimate(where, [a for _, a in relations])),)], "estimate long")

    return run


QUERIES: dict[str, Query] = {name: sql(text, **places) for name, (text, places, _) in STATEMENTS.items()}
QUERIES |= {
    "scan_all": lambda spark, d: op.select_file(spark, f"{d}/region.parquet"),
    "select_file": lambda spark, d: op.project(op.select_file(spark, f"{d}/part.parquet", "(p_size > 48) AND (p_brand = 'Brand#1' OR p_brand = 'Brand#2')"), ["p_brand", "p_partkey"]),
    "operator_pipeline": lambda spark, d: rounded(
        op.group_by(op.join(op.select_file(spark, f"{d}/supplier.parquet", "(s_acctbal > 1000.0)"), partsupp(table(spark, d, "lineitem")), "(s_suppkey = ps_suppkey)"), ["s_nationkey"], "ps_supplycost * (1 + 0.5)"),
        agg_result=0,
    ),
    "join_advised": lambda spark, d: rounded(session(spark, d, tpch()).query(STATEMENTS["join3_point"][0]), sum_result=4),
    "stats_profile": lambda spark, d: profile(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), exact=True),
    "writeout_text": lambda spark, d: op.lines(table(spark, d, "region")),
    "sorted_lookup": sorted_lookup,
    "heap_append": heap_append,
    "load_text": load_text,
    "sort_violations": sort_violations,
    "sorted_scan_order": sorted_scan_order,
    "sort_sink": sort_sink,
    "order_on_all": order_on_all,
    "statement_heap": statement_heap,
    "statement_sorted": statement_sorted,
    "statement_drop": statement_drop,
    "statement_output_file": statement_output_file,
    "statement_stdout": statement_stdout,
    "statement_none": statement_none,
    "stats_chain": stats_chain,
}
QUERIES |= {name: _estimate(relations, where) for name, (relations, where, _) in ESTIMATES.items()}

ORACLE_SQL: dict[str, str] = {name: text for name, (_, _, text) in STATEMENTS.items()}
ORACLE_SQL |= {
    "scan_all": "SELECT * FROM region",
    "select_file": "SELECT p_brand, p_partkey FROM part WHERE p_size > 48 AND p_brand IN ('Brand#1', 'Brand#2')",
    "operator_pipeline": f"SELECT round(sum(ps_supplycost * 1.5), 0) AS agg_result, s_nationkey FROM supplier JOIN {PARTSUPP} ON s_suppkey = ps_suppkey WHERE s_acctbal > 1000.0 GROUP BY s_nationkey",
    "join_advised": STATEMENTS["join3_point"][2],
    "stats_profile": "SELECT count(*) AS num_tuples, count(DISTINCT c_custkey) AS c_custkey, count(DISTINCT c_nationkey) AS c_nationkey, count(DISTINCT c_mktsegment) AS c_mktsegment FROM customer",
    "writeout_text": "SELECT 'r_regionkey: [' || r_regionkey || '], r_name: [' || r_name || ']' AS value FROM region",
    "sorted_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 42",
    "heap_append": "SELECT * FROM nation UNION ALL SELECT * FROM nation",
    "load_text": "SELECT * FROM supplier",
    "sort_violations": "SELECT CAST(0 AS BIGINT) AS violations",
    "sorted_scan_order": "SELECT CAST(0 AS BIGINT) AS violations, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders",
    "sort_sink": "SELECT p_size, p_partkey FROM part WHERE p_size = 7",
    "order_on_all": "SELECT * FROM (VALUES (0, 'p_partkey'), (1, 'p_size'), (2, 'p_retailprice'), (3, 'p_name'), (4, 'p_brand'), (5, 'p_type')) AS v(nth, name)",
    "statement_heap": "SELECT s_suppkey, s_name FROM supplier, (VALUES (1), (2)) AS twice WHERE s_acctbal > 1000.0",
    "statement_sorted": "SELECT CAST(sum(n_nationkey) AS BIGINT) AS agg_result, n_regionkey FROM nation WHERE n_regionkey > 0 GROUP BY n_regionkey",
    "statement_drop": "SELECT CAST(0 AS BIGINT) AS n, 'a' AS name, 'b' AS left UNION ALL SELECT count(*), 'b', 'b' FROM region",
    "statement_output_file": "SELECT printf('s.s_suppkey: [%d], s.s_acctbal: [%g]', s_suppkey, s_acctbal) AS value FROM supplier WHERE s_suppkey < 30",
    "statement_stdout": """
        SELECT 'r.r_name: [' || r_name || ']' AS value FROM region WHERE r_regionkey > 1
        UNION ALL SELECT 'Query returned ' || count(*) || ' records' FROM region WHERE r_regionkey > 1
        UNION ALL SELECT 'SyntaxProblem' UNION ALL SELECT 'sum_result: [' || sum(r_regionkey) || ']' FROM region WHERE r_regionkey > 1
        UNION ALL SELECT 'Query returned 1 records'
    """,
    "statement_none": "SELECT true AS no_rows, true AS planned, true AS trailer, count(*) AS n FROM region WHERE r_regionkey > 1",
    "stats_chain": """
        WITH o AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS cust, count(DISTINCT o_orderkey) AS key FROM orders),
        c AS (SELECT count(*) AS n, count(DISTINCT c_custkey) AS cust, count(DISTINCT c_nationkey) AS nat FROM customer),
        n AS (SELECT count(*) AS n, count(DISTINCT n_nationkey) AS nat FROM nation),
        j AS (SELECT o.n * c.n / greatest(o.cust, c.cust) AS joined, o.key AS key, c.nat AS nat FROM o, c)
        SELECT CAST(round(joined) AS BIGINT) AS joined,
            CAST(round(trunc(joined) * n.n / greatest(trunc(least(j.nat, joined)), n.nat) * (1 - (1 - 1.0 / key) * (1 - 1.0 / 3))) AS BIGINT) AS chained FROM j, n
    """,
}
ORACLE_SQL |= {name: f"SELECT CAST({value} AS BIGINT) AS estimate" for name, (_, _, value) in ESTIMATES.items()}
