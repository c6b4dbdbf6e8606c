"""Text files of one row a line, each field followed by '|', without quotes or escapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _raw(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return spark.read.schema(texts).csv(path, sep="|", quote="", escape="", header=False, enforceSchema=True)


def read_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the schema's types. An empty or malformed number is 0, an empty text ''; what follows the last field is dropped."""
    rows = _raw(spark, path, schema)
    zero = {f.name: "" if isinstance(f.dataType, T.StringType) else 0 for f in schema.fields}
    return rows.select(*(F.coalesce(F.col(f"`{f.name}`").try_cast(f.dataType), F.lit(zero[f.name]).cast(f.dataType)).alias(f.name) for f in schema.fields))


def malformed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row: for each number, how many fields are neither empty nor a number."""
    rows = _raw(spark, path, schema)
    numbers = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    return rows.agg(*(F.count_if(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull()).alias(f.name) for f in numbers))


def write_text(df: DataFrame, path: str) -> None:
    """The same format, for loading elsewhere."""
    df.select(F.concat(*(F.concat(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|")) for c in df.columns)).alias("value")).write.mode("overwrite").text(path)
