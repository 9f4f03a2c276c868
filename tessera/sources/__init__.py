"""Where values come from and go to: Parquet, JSON lines, CSV, whole files, literals; and the same as sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.jsonio import format_json, parse_json
from tessera.types import Struct, parse, to_spark
from tessera.value import Value


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_literal(spark: SparkSession, rows: list, shape: str) -> DataFrame:
    """Rows of nested Python values of a struct shape."""
    return spark.createDataFrame(rows, to_spark(shape))


def from_arrow(spark: SparkSession, data: object) -> DataFrame:
    """Rows of an Arrow table or a pandas frame that the driver holds."""
    return spark.createDataFrame(data)


def from_json_lines(spark: SparkSession, path: str, shape: str, checked: bool = True) -> DataFrame:
    """One JSON value a line. ``checked`` applies the shape's own rules; else Spark's reader with the shape's schema."""
    parsed = parse(shape)
    if not checked:
        if not isinstance(parsed, Struct):
            raise ValueError("Spark's reader needs a struct shape")
        return spark.read.schema(to_spark(parsed)).json(path)
    out = spark.read.text(path).select(parse_json(shape, Value(F.col("value"), T.StringType())).alias("value"))
    return out.select("value.*") if isinstance(parsed, Struct) else out


def from_csv(spark: SparkSession, path: str, shape: str, header: bool = True) -> DataFrame:
    return spark.read.schema(to_spark(shape)).csv(path, header=header, mode="FAILFAST")


def memmap(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes, one row a file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def to_json_lines(df: DataFrame, path: str, struct_as_list: bool = False) -> None:
    row = Value(F.struct(*df.columns), df.schema)
    df.select(format_json(row, struct_as_list).alias("value")).write.text(path)


def show(v: Column) -> Column:
    """The textual form of a value."""
    return F.to_json(v, {"ignoreNullFields": "false"})
