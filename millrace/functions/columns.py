"""From syntax trees to Spark columns: name resolution, strict types, predicates, arithmetic."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.syntax import Arithmetic, Binary, Cnf, Comparison, Literal, Name, Negation

INT, DOUBLE, STRING = "Int", "Double", "String"
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


class BindProblem(ValueError):
    """A name that isn't there or isn't unique, or types that don't fit."""


def class_of(kind: T.DataType) -> str:
    """Any integral type is an Int, any other number a Double; text and times are Strings."""
    if isinstance(kind, T.IntegralType):
        return INT
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return DOUBLE
    if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return STRING
    raise BindProblem(f"no class for the type {kind.simpleString()}")


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


class Scope:
    """The names of one or more DataFrames: a full name first, else the only one that ends in .name; earlier DataFrames go before later ones."""

    def __init__(self, *frames: DataFrame):
        self.frames = frames

    def find(self, name: str) -> tuple[DataFrame, T.StructField]:
        for frame in self.frames:
            fields = [f for f in frame.schema.fields if f.name == name] or [f for f in frame.schema.fields if f.name.endswith(f".{name}")]
            if len(fields) > 1:
                raise BindProblem(f"the name {name} is not unique: {', '.join(f.name for f in fields)}")
            if fields:
                return frame, fields[0]
        raise BindProblem(f"unknown name {name}; there are {', '.join(c for f in self.frames for c in f.columns)}")

    def full_name(self, name: str) -> str:
        return self.find(name)[1].name

    def column(self, name: str) -> tuple[Column, T.DataType]:
        frame, field = self.find(name)
        return (frame[f"`{field.name}`"] if len(self.frames) > 1 else quoted(field.name)), field.dataType


def _side(x: Name | Literal, scope: Scope) -> tuple[Column, T.DataType]:
    if isinstance(x, Name):
        return scope.column(x.text)
    return F.lit(x.value), {int: T.LongType(), float: T.DoubleType(), str: T.StringType()}[type(x.value)]


def comparison(c: Comparison, scope: Scope) -> Column:
    """A name that is set equal to itself holds for every row, with a null or not."""
    if c.op == "=" and isinstance(c.left, Name) and isinstance(c.right, Name):
        (a, x), (b, y) = scope.find(c.left.text), scope.find(c.right.text)
        if a is b and x.name == y.name:
            return F.lit(True)
    sides = [(x, *_side(x, scope)) for x in (c.left, c.right)]
    (_, left, left_type), (_, right, right_type) = sides
    if (a := class_of(left_type)) != (b := class_of(right_type)):
        raise BindProblem(f"{a} is compared with {b} in {c}")
    if a == STRING and left_type != right_type:
        left, right = _alike(sides)
    return {"<": left < right, ">": left > right, "=": left == right}[c.op]


def _alike(sides: list[tuple[Name | Literal, Column, T.DataType]]) -> list[Column]:
    """A time beside a day in quotes: the day becomes a time, so that the comparison reaches the files. Beside other text, the time becomes the text of its day."""
    time = next((kind for _, _, kind in sides if not isinstance(kind, T.StringType)))
    texts = [x for x, _, kind in sides if isinstance(kind, T.StringType)]
    if all(isinstance(x, Literal) and _DAY.fullmatch(x.value) for x in texts):
        return [col.try_cast(time) if isinstance(kind, T.StringType) else col for _, col, kind in sides]
    return [col if isinstance(kind, T.StringType) else F.date_format(col, "yyyy-MM-dd") for _, col, kind in sides]


def predicate(cnf: Cnf, scope: Scope) -> Column:
    return reduce(and_, (reduce(or_, (comparison(c, scope) for c in group)) for group in cnf))


def arithmetic(x: Arithmetic, scope: Scope) -> tuple[Column, str]:
    """(column, class): bigint for Int, double for Double. Int / Int truncates toward zero; ANSI mode raises where a divisor is 0."""
    if isinstance(x, Negation):
        column, kind = arithmetic(x.of, scope)
        return -column, kind
    if isinstance(x, Binary):
        (left, a), (right, b) = arithmetic(x.left, scope), arithmetic(x.right, scope)
        kind = INT if a == b == INT else DOUBLE
        if kind == DOUBLE:
            left, right = left.cast("double"), right.cast("double")
        if x.op == "/":
            return (F.call_function("div", left, right) if kind == INT else left / right), kind
        return {"+": left + right, "-": left - right, "*": left * right}[x.op], kind
    column, own = _side(x, scope)
    if (kind := class_of(own)) == STRING:
        raise BindProblem(f"text in arithmetic: {x}")
    return column.cast("bigint" if kind == INT else "double"), kind
