"""JSON directed by a datashape.

Parsing checks what Spark's reader passes over: fields that must be there,
sizes of fixed dimensions, numbers and booleans written as text. Unknown keys
are ignored, structs may come as objects or as lists, and missing optional
fields are missing. A text that is no JSON is an error.

Each level of the shape is read once, into the texts of its items or fields
(Spark keeps the text of nested values of a string field), and converted with
plain expressions that name those texts as bound variables: the plan has one
reader for a list and two for a struct (as it may come in either form),
whatever the depth, so that it grows with the shape and no faster.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.casting import _scalar, na_text
from tessera.functions.lifting import fail, once
from tessera.types import Dim, Option, Scalar, Struct, Tuple, from_spark, parse, relaxed, to_spark
from tessera.value import Value

_TEXTS = T.ArrayType(T.StringType())


def _level(text: Column, shape, optional: bool) -> Column:
    """The value of a shape; ``text`` is named several times, so it must be a variable."""
    dtype = relaxed(to_spark(shape))
    if isinstance(shape, Option):
        return F.when(~(text.isNull() | na_text(text)), _level(text, shape.item, True))
    match shape:
        case Scalar():
            out = _scalar(Value(text, T.StringType()), dtype, "fractional", optional).col
            return F.when(text.isNotNull(), out).otherwise(fail("a value is missing", dtype))
        case Dim(size, item):

            def listed(parts: Column) -> Column:
                items = F.transform(parts, lambda x: _level(x, item, False))
                if isinstance(size, int):
                    items = F.when(F.size(parts) == size, items).otherwise(fail(f"a list has not {size} items", dtype))
                return F.when(parts.isNotNull(), items).otherwise(fail("a list is missing", dtype))

            return once(F.from_json(text, _TEXTS), listed).cast(dtype)
        case Struct(fields) | Tuple(fields):
            named = [(n, s) for n, s in fields] if isinstance(shape, Struct) else [(f"_{k}", s) for k, s in enumerate(fields)]
            keyed = F.from_json(text, T.StructType([T.StructField(n, T.StringType()) for n, _ in named]))
            in_order = once(keyed, lambda r: F.array(*[r[n] for n, _ in named]))
            is_list = F.startswith(F.ltrim(text), F.lit("["))

            def field(text: Column, shape) -> Column:
                return once(text, lambda x: _level(x, shape, False))

            def filled(parts: Column) -> Column:
                out = F.struct(*[field(F.get(parts, F.lit(k)), s).alias(n) for k, (n, s) in enumerate(named)])
                return F.when(F.size(parts) == len(named), out.cast(dtype)).otherwise(fail("an object is missing, or a list has another length", dtype))

            return once(F.when(text.isNull(), F.lit(None).cast(_TEXTS)).when(is_list, F.from_json(text, _TEXTS)).otherwise(in_order), filled)
    raise TypeError(f"JSON has no {shape}")


def valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def parse_json(shape: str, text: Value) -> Value:
    """Value of a datashape from JSON text; what does not fit the shape is an error."""
    parsed = parse(shape)
    dtype = relaxed(to_spark(parsed))
    checked = once(text.col, lambda t: F.when(t.isNull() | valid(t), t).otherwise(fail("not valid JSON", T.StringType())))
    return Value(once(checked, lambda t: F.when(t.isNotNull(), _level(t, parsed, False))), dtype)


def validate_json(text: Value) -> Value:
    return Value(valid(text.col), T.BooleanType())


def format_json(v: Value, struct_as_list: bool = False) -> Value:
    """JSON text; missing values are null; structs are objects or, on demand, lists."""
    if not struct_as_list:
        if isinstance(v.dtype, (T.StructType, T.ArrayType, T.MapType)):
            return Value(F.to_json(v.col, {"ignoreNullFields": "false"}), T.StringType())
        return Value(_as_list(v.col, v.dtype), T.StringType())
    return Value(_as_list(v.col, v.dtype), T.StringType())


def _as_list(x: Column, dtype: T.DataType) -> Column:
    null = F.lit("null")
    if isinstance(dtype, T.StructType):
        parts = [_as_list(x[f.name], f.dataType) for f in dtype]
        return F.when(x.isNull(), null).otherwise(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))
    if isinstance(dtype, T.ArrayType):
        return F.when(x.isNull(), null).otherwise(F.concat(F.lit("["), F.array_join(F.transform(x, lambda y: _as_list(y, dtype.elementType)), ","), F.lit("]")))
    # the text between the brackets of a one-item list
    one = F.to_json(F.array(x), {"ignoreNullFields": "false"})
    return F.when(x.isNull(), null).otherwise(F.substring(one, F.lit(2), F.char_length(one) - 2))


def discover(df: DataFrame, column: str) -> str:
    """Datashape of the JSON texts of a column.

    Spark's JSON reader infers it, one pass over all rows: each partition's
    types are merged on the executors, then those of the partitions. Rows stay
    in the JVM.
    """
    spark = df.sparkSession
    strings = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    texts = getattr(df.select(F.col(column).cast("string"))._jdf, "as")(strings)
    inferred = spark._jsparkSession.read().json(texts).schema().json()
    return from_spark(T.StructType.fromJson(json.loads(inferred)))
