"""The operators: each takes DataFrames and texts in the dialect, and returns a DataFrame.

Nothing runs here; Catalyst pushes predicates and columns down to the files, and picks
the joins' algorithms. Bags throughout: only distinct() drops equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import DOUBLE, INT, STRING, BindProblem, Scope, arithmetic, class_of, predicate, quoted
from millrace.plans.syntax import Arithmetic, Cnf, parse_arithmetic, parse_cnf, parse_sort


def _cnf(where: str | Cnf) -> Cnf:
    return parse_cnf(where) if isinstance(where, str) else where


def _expression(of: str | Arithmetic) -> Arithmetic:
    return parse_arithmetic(of) if isinstance(of, str) else of


def select_file(spark: SparkSession, path: str, where: str | Cnf | None = None) -> DataFrame:
    """The rows of a Parquet file or folder that satisfy the predicate."""
    df = spark.read.parquet(path)
    return select_pipe(df, where) if where else df


def select_pipe(df: DataFrame, where: str | Cnf) -> DataFrame:
    """The rows that satisfy the predicate."""
    return df.filter(predicate(_cnf(where), Scope(df)))


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, in that order."""
    scope = Scope(df)
    return df.select(*(quoted(scope.full_name(n)) for n in names))


def join(left: DataFrame, right: DataFrame, on: str | Cnf | None = None) -> DataFrame:
    """Inner join; all columns of left, then all of right. Names are looked up on the left first. Without a predicate all pairs."""
    right = right.select(*(quoted(c).alias(c) for c in right.columns))  # so that a table can be joined with itself
    if not on:
        return left.crossJoin(right)
    return left.join(right, predicate(_cnf(on), Scope(left, right)), "inner")


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def _total(df: DataFrame, of: str | Arithmetic, only_distinct: bool) -> Column:
    column, kind = arithmetic(_expression(of), Scope(df))
    total = F.sum_distinct(column) if only_distinct else F.sum(column)
    return F.coalesce(total, F.lit(0).cast("bigint" if kind == INT else "double"))


def sum_(df: DataFrame, of: str | Arithmetic, only_distinct: bool = False, name: str = "sum_result") -> DataFrame:
    """One row with the sum of the expression, 0 over no rows; with only_distinct each value of the expression counts once."""
    return df.agg(_total(df, of, only_distinct).alias(name))


def group_by(df: DataFrame, keys: Sequence[str], of: str | Arithmetic, only_distinct: bool = False, name: str = "agg_result") -> DataFrame:
    """A row for each group: the sum, then the keys."""
    if not keys:
        raise BindProblem("grouping needs a key")
    scope = Scope(df)
    full = [scope.full_name(k) for k in keys]
    return df.groupBy(*map(quoted, full)).agg(_total(df, of, only_distinct).alias(name)).select(quoted(name), *map(quoted, full))


def order_on_all(df: DataFrame) -> list[str]:
    """All columns: Ints first, then Doubles, then Strings, each in their own order."""
    rank = {INT: 0, DOUBLE: 1, STRING: 2}
    return [f.name for f in sorted(df.schema.fields, key=lambda f: rank[class_of(f.dataType)])]


def sort(df: DataFrame, keys: str | Sequence[str] | None = None) -> DataFrame:
    """Ascending by the keys, a list or a text such as '(a) AND (b)'; by all columns without."""
    names = order_on_all(df) if keys is None else [k.text for k in parse_sort(keys)] if isinstance(keys, str) else list(keys)
    scope = Scope(df)
    return df.orderBy(*(quoted(scope.full_name(n)).asc() for n in names))


def number_text(column: Column) -> Column:
    """A double with six significant digits, as C prints it by default: no trailing zeros, an exponent below -4 or above 5. Decimal ties are rounded up."""
    short = F.format_string("%.5e", column)
    exponent = F.substring_index(short, "e", -1).cast("int")
    bare = lambda x: F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1")
    tidy = lambda x: F.regexp_replace(bare(x), r"\.$", "")
    plain = F.coalesce(*(F.when(exponent == e, tidy(F.format_string(f"%.{5 - e}f", column)) if e < 5 else F.format_string("%.0f", column)) for e in range(-4, 6)))
    far = F.concat(tidy(F.substring_index(short, "e", 1)), F.lit("e"), F.substring_index(short, "e", -1))
    return (
        F.when(F.isnan(column), "nan").when(column == float("inf"), "inf").when(column == float("-inf"), "-inf")
        .when(column == 0, "0").otherwise(F.coalesce(plain, far))
    )


def lines(df: DataFrame) -> DataFrame:
    """One column `value`: each row as `name: [value], name: [value]`."""
    cells = []
    for f in df.schema.fields:
        column = quoted(f.name)
        text = number_text(column.cast("double")) if class_of(f.dataType) == DOUBLE else column.cast("string")
        cells.append(F.concat(F.lit(f"{f.name}: ["), F.coalesce(text, F.lit("")), F.lit("]")))
    return df.select(F.concat_ws(", ", *cells).alias("value"))


def write_out(df: DataFrame, path: str) -> None:
    """Writes the lines as text, one file for each partition."""
    lines(df).write.mode("overwrite").text(path)
