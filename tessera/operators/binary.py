"""Values as bytes, and transforms that need numpy: serialise, reinterpret, byte swap and Fourier transforms.

Spark has no expression for these; they are Arrow batches to numpy and back, a
whole batch at a time. Spark doesn't plan a Python function whose argument has a
lambda that names the variable of a lambda around it: give such an argument (a
value reshaped after a conversion, say) a column of its own in a written table,
or convert after reshaping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.complexes import COMPLEX
from tessera.functions.lifting import elwise
from tessera.types import to_spark
from tessera.value import Value

# Little-endian numpy types of the Spark types.
NUMPY = {"boolean": "<u1", "tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}


def _starts(cells: pa.Array) -> np.ndarray:
    """Where each cell's items start among those of the whole batch, and where the last one ends."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(cells) if pa.types.is_list(cells.type) else pa.compute.binary_length(cells), 0)
    return np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)])


def _items(cells: pa.Array, numpy_type: str) -> np.ndarray:
    """All items of a batch of lists in one array."""
    flat = cells.flatten()
    if flat.null_count:
        raise ValueError("a missing value has no bytes")
    return flat.to_numpy(zero_copy_only=False).astype(numpy_type)


def _bytes(cells: pa.Array) -> np.ndarray:
    """All bytes of a batch in one array."""
    filled = pa.compute.fill_null(cells, b"").cast(pa.large_binary())
    start, end = np.frombuffer(filled.buffers()[1], np.int64)[[filled.offset, filled.offset + len(filled)]]
    return np.frombuffer(filled.buffers()[2], np.uint8)[start:end] if end > start else np.zeros(0, np.uint8)


def _mask(cells: pa.Array) -> pa.Array | None:
    return pa.compute.is_null(cells) if cells.null_count else None


def _lists(items: np.ndarray, starts: np.ndarray, cells: pa.Array, kind: pa.DataType) -> pa.Array:
    """Lists of the items; missing where the cells are."""
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(items).cast(kind), mask=_mask(cells))


def _arrow(t: T.DataType) -> pa.DataType:
    return pa.from_numpy_dtype(np.dtype(NUMPY[t.simpleString()])) if not isinstance(t, T.BooleanType) else pa.bool_()


def serialize(v: Value) -> Value:
    """Elements in C order as little-endian bytes; missing values have no bytes, so they are an error."""
    from tessera.operators.arrays import flat

    line = flat(v) if v.depth else Value(F.array(v.col), T.ArrayType(v.dtype, True))
    kind = line.dtype.elementType.simpleString()
    if kind in ("string", "binary"):
        joined = F.aggregate(F.transform(line.col, lambda x: x.cast("binary")), F.lit(b""), lambda a, x: F.concat(a, x))
        return Value(joined, T.BinaryType())
    numpy_type = NUMPY[kind]

    def run(cells: pa.Array) -> pa.Array:
        items = _items(cells, numpy_type)
        starts = (_starts(cells) * items.itemsize).astype(np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cells), [None, pa.py_buffer(starts), pa.py_buffer(items.tobytes())])
        whole = pa.compute.if_else(pa.compute.is_null(cells), None, whole) if cells.null_count else whole
        return whole.cast(pa.binary())

    return Value(F.arrow_udf(run, T.BinaryType())(line.col), T.BinaryType())


def deserialize(v: Value, dtype: str) -> Value:
    """1-d value of a type from little-endian bytes."""
    t = to_spark(dtype)
    numpy_type = NUMPY[t.simpleString()]

    def run(cells: pa.Array) -> pa.Array:
        starts, size = _starts(cells), np.dtype(numpy_type).itemsize
        if (starts % size).any():
            raise ValueError(f"bytes are no whole number of {dtype}")
        return _lists(_bytes(cells).view(numpy_type), starts // size, cells, _arrow(t))

    return Value(F.arrow_udf(run, T.ArrayType(t))(v.col), T.ArrayType(t, True))


def view(v: Value, dtype: str) -> Value:
    """The same bytes as another type; sizes must fit."""
    return deserialize(v if isinstance(v.dtype, T.BinaryType) else serialize(v), dtype)


def storage(v: Value) -> Value:
    """What a value is stored as: the bytes of strings; any other value as it is."""
    if isinstance(v.scalar, T.StringType):
        return elwise(lambda s: Value(s.col.cast("binary"), T.BinaryType()))(v)
    return v


def replace_dtype(v: Value, dtype: str) -> Value:
    """The elements' bytes as another type of the same width; dimensions (at most one) stay."""
    t = to_spark(dtype)
    if v.depth > 1 or NUMPY.get(t.simpleString(), "0")[-1] != NUMPY.get(v.scalar.simpleString(), "1")[-1]:
        raise TypeError(f"{v.dtype.simpleString()} can't be stored as {dtype}")
    seen = view(v, dtype)
    return seen if v.depth else Value(F.get(seen.col, F.lit(0)), t)


def byteswap(v: Value) -> Value:
    """Integers and reals with their bytes in reverse order."""
    line = v if v.depth else Value(F.array(v.col), T.ArrayType(v.dtype, True))
    t = line.dtype.elementType
    numpy_type = NUMPY[t.simpleString()]

    def run(cells: pa.Array) -> pa.Array:
        return _lists(_items(cells, numpy_type).byteswap(), _starts(cells), cells, _arrow(t))

    col = F.arrow_udf(run, T.ArrayType(t))(line.col)
    return Value(col, line.dtype) if v.depth else Value(F.get(col, F.lit(0)), v.dtype)


def _by_length(z: np.ndarray, starts: np.ndarray, f) -> list[np.ndarray]:
    """f of each cell; cells of one length are one matrix."""
    lengths = np.diff(starts)
    out: list[np.ndarray] = [np.zeros(0, complex)] * len(lengths)
    for n in np.unique(lengths):
        where = np.nonzero(lengths == n)[0]
        if n:
            for k, row in zip(where, f(z[starts[where][:, None] + np.arange(n)]), strict=True):
                out[k] = row
    return out


def _complex_lists(rows: list[np.ndarray], cells: pa.Array) -> pa.Array:
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    z = np.concatenate([*rows, np.zeros(0, complex)])
    both = pa.StructArray.from_arrays([pa.array(z.real), pa.array(z.imag)], names=["re", "im"])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), both, mask=_mask(cells))


def _transform(f) -> callable:
    """A transform of 1-d complex or real cells; results are arrays of STRUCT<re, im>."""

    def applied(v: Value) -> Value:
        is_real = not isinstance(v.dtype.elementType, T.StructType)
        parts = [v.col.cast("array<double>")] if is_real else [v.col["re"].cast("array<double>"), v.col["im"].cast("array<double>")]

        def run(*cells: pa.Array) -> pa.Array:
            z = _items(cells[0], "<f8").astype(complex)
            if len(cells) > 1:
                z += 1j * _items(cells[1], "<f8")
            return _complex_lists(_by_length(z, _starts(cells[0]), f), cells[0])

        # an Arrow function takes its columns one by one
        udf = F.arrow_udf((lambda re: run(re)) if is_real else (lambda re, im: run(re, im)), T.ArrayType(COMPLEX))
        return Value(udf(*parts), T.ArrayType(COMPLEX, True))

    return applied


def _one_sided(z: np.ndarray) -> np.ndarray:
    return np.fft.rfft(z.real)


fft, ifft, rfft = _transform(np.fft.fft), _transform(np.fft.ifft), _transform(_one_sided)


def fft2(v: Value) -> Value:
    """2-d transform of a real matrix."""

    def run(cells: pa.Array) -> pa.Array:
        rows, starts, done = cells.flatten(), _starts(cells), []
        values, places = _items(rows, "<f8"), _starts(rows)
        for k in range(len(cells)):
            n = starts[k + 1] - starts[k]
            matrix = values[places[starts[k]] : places[starts[k + 1]]].reshape(n, -1) if n else np.zeros((0, 0))
            done += list(np.fft.fft2(matrix)) if matrix.size else [np.zeros(0, complex)] * n
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), _complex_lists(done, rows), mask=_mask(cells))

    return Value(F.arrow_udf(run, T.ArrayType(T.ArrayType(COMPLEX)))(v.col.cast("array<array<double>>")), T.ArrayType(T.ArrayType(COMPLEX, True), True))
