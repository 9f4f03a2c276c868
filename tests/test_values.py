"""Literal fixtures for values: arithmetic, comparison, lifting, structure and reductions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import complexes
from tessera.functions.lifting import outer, state_elwise
from tessera.operators import arrays, binary, reduce
from tessera.operators.neighborhood import convolve, neighborhood
from tessera.value import Value, literal, value

R = registry.get


@pytest.mark.parametrize(
    ("name", "args", "expected"),
    [
        ("add", ([[5, 8], [13, 21]], [100, 200]), [[105, 208], [113, 221]]),
        ("add", ([7, 0, -7], [6]), [13, 6, -1]),
        ("subtract", (5, [1, 2]), [4, 3]),
        ("divide", (7, -2), -3),
        ("divide", (1.0, 0.0), math.inf),
        ("divide", (-1.0, 0.0), -math.inf),
        ("mod", (-7, 3), -1),
        ("pow", (2.0, 10), 1024.0),
        ("sqrt", (9.0,), 3.0),
        ("cbrt", (27.0,), 3.0),
        ("bitwise_not", (5,), -6),
        ("left_shift", (1, 4), 16),
        ("logical_and", (None, False), None),
        ("logical_or", (True, None), None),
        ("logical_xor", (3, 0), True),
        ("logical_not", (0,), True),
        ("less", ([17, None, -3, 6, None], 6), [False, None, True, False, None]),
        ("total_order", ("pear", "plum"), 1),
        ("total_order", ("plum", "pear"), 0),
        ("minus", ([9, 0, -14],), [-9, 0, 14]),
        ("is_na", ([[None, 6.5], [math.nan, -8.0], [0.0, None]],), [[True, False], [True, False], [False, True]]),
        ("all", ([[True, True, True], [True]],), True),
        ("all", ([[True, True], [True, False, True]],), False),
        ("max", ([[-6.5, 3.25], [], [8.75, 8.5, -90.0]],), 8.75),
        ("min", ([[-6.5, 3.25], [], [8.75, 8.5, -90.0]],), -90.0),
        ("max", ([math.nan, -2.5, math.nan],), -2.5),
        ("sum", ([14, 6, -31, 8],), -3),
        ("sum", ([0.5, 16.25, -4.75],), 12.0),
        ("mean", ([[12.0, -4.0], [7.0, 1.0]],), 4.0),
        ("all_equal", ([[6], [2, 8]], [[6], [2, 8]]), True),
        ("all_equal", ([6, 2, 8], [6, 2, 9]), False),
        ("take", ([40, 30, 20, 10], [True, False, False, True]), [40, 10]),
        ("take", ([40, 30, 20, 10], [2, 2, -4, 1]), [20, 20, 40, 30]),
        ("sort", ([0.75, -3.5, 12.0, 0.5],), [-3.5, 0.5, 0.75, 12.0]),
        ("unique", ([-5, 4, 4, 4, 11, 11],), [-5, 4, 11]),
        ("binary_search", ([-8, -2, 0, 19, 44], 19), 3),
        ("binary_search", ([-8, -2, 0, 19, 44], 20), -1),
        ("binary_search", ([-8, -2, 0, 19, 44], -8), 0),
        ("concatenate", ([6], [0, 6]), [6, 0, 6]),
        ("reshape", ([9, 8, 7, 6, 5, 4, 3, 2], (4, 2)), [[9, 8], [7, 6], [5, 4], [3, 2]]),
        ("transpose", ([[9, 8], [7, 6], [5, 4]],), [[9, 7, 5], [8, 6, 4]]),
        ("permute", ([[[9, 8, 7]], [[6, 5, 4]]], (1, 2, 0)), [[[9, 6], [8, 5], [7, 4]]]),
        ("new_axis", ([70, 80, 90], 1), [[70], [80], [90]]),
        ("equals_exact", ([1, None], [1, None]), True),
    ],
)
def test_functions(one, name, args, expected):
    assert one(R(name)(*args)) == expected


def test_promotion():
    small = literal(3, "int8")
    assert (small + small).dtype.simpleString() == "int"
    assert (literal(3.5, "float32") * small).dtype.simpleString() == "float"
    assert (literal(1, "int64") + 1).dtype.simpleString() == "bigint"
    with pytest.raises(TypeError):
        R("mod")(1.5, 2)


def test_reduction_axes(one):
    """Against numpy, over every choice of axes."""
    rng = np.random.default_rng(12)
    total = reduce.reduction(0.0, lambda a, x: a + x)
    for shape in ((4,), (2, 5), (3, 2, 4)):
        x = rng.integers(-40, 40, shape) / 4
        for n in range(1, len(shape) + 1):
            for axes in itertools.combinations(range(len(shape)), n):
                for keepdims in (False, True):
                    assert one(total(x.tolist(), axes=axes, keepdims=keepdims)) == x.sum(axis=axes, keepdims=keepdims).tolist()
                    assert np.allclose(one(R("mean")(x.tolist(), axes=axes, keepdims=keepdims)), x.mean(axis=axes, keepdims=keepdims))
    assert one(total([[0.5], [], [8.0, -2.5, 1.0]], axes=(1,))) == [0.5, 0.0, 6.5]
    assert one(reduce.reduction(64.0, lambda a, x: a - x)([0.25, 3.0, -8.5])) == 69.25
    with pytest.raises(ValueError):
        reduce.reduction(None, None)


@pytest.mark.parametrize("name", ["sum", "product", "max", "min", "mean", "std", "var"])
def test_nan_forms(one, name):
    """Against numpy: NaN does not exist in the nan forms, and spoils the others but max and min."""
    x = np.array([[1.5, math.nan, -2.0, 8.25], [0.5, 4.0, math.nan, math.nan], [3.0, 3.5, -1.0, 2.0]])
    how = {"ddof": 1} if name in ("std", "var") else {}
    other = {"product": "nanprod"}.get(name, f"nan{name}")
    for axes in (None, (0,), (1,)):
        want = getattr(np, other)(x, axis=None if axes is None else axes[0], **how)
        assert np.allclose(one(R(f"nan{name}")(x.tolist(), axes=axes)), want)
        if name in ("std", "var"):
            got = np.array(one(R(name)(x.tolist(), axes=axes)), float)
            assert np.allclose(got, getattr(np, name)(x, axis=None if axes is None else axes[0], **how), equal_nan=True)
    none = [math.nan, math.nan]
    assert one(R(f"nan{name}")(none)) == {"sum": 0.0, "product": 1.0}.get(name)


def test_nan_forms_over_rows(spark):
    x = [4.0, math.nan, 1.0, 2.5]
    df = spark.createDataFrame([(1, [v]) for v in x], "k int, a array<double>")
    got = {h: reduce.reduce_rows(df, "a", h, ["k"]).first()["value"] for h in ("nansum", "nanproduct", "nanmax", "nanmin", "nanmean", "nanstd", "nanvar")}
    y = np.array([4.0, 1.0, 2.5])
    assert got == pytest.approx({"nansum": 7.5, "nanproduct": 10.0, "nanmax": 4.0, "nanmin": 1.0, "nanmean": 2.5, "nanstd": y.std(ddof=1), "nanvar": y.var(ddof=1)})
    assert reduce.reduce_rows(df.filter("false"), "a", "nansum").first()["value"] == 0.0
    assert reduce.reduce_rows(spark.createDataFrame([([2.0, 3.0],), ([4.0],)], "a array<double>"), "a", "product").first()["value"] == 24.0


def test_binary_reduction(one):
    best = R("elwise")(lambda x, y: Value(F.greatest(x.col, y.col), x.dtype))
    a, b = [6, -9, 30], [5, 0, 31]
    assert one(reduce.reduction(0, lambda acc, x: acc + x)(a, b, combine=best)) == sum(map(max, a, b))


def test_empty_reductions(one):
    none = Value(F.array().cast("array<int>"), literal([1]).dtype)
    assert one(R("sum")(none)) == 0
    assert one(R("all")(none > 0)) is True
    assert one(R("max")(none)) == -(2**31)


def test_compound(one):
    v = literal([1, 2, 3])
    assert one(reduce.left_compound(lambda a, x: a - x, 10)(v)) == 4
    assert one(reduce.right_compound(lambda x, a: x - a, 10)(v)) == 3 - (2 - (1 - 10))


def test_where_and_rows(spark, one):
    assert one(arrays.where(lambda x: x > 5)([2, 6, 5, 70])) == [1, 3]
    df = spark.createDataFrame([(8, [2, 6, 70])], "id int, a array<int>")
    assert [tuple(r) for r in arrays.where_rows(df, "a", lambda x: x > 5, ["id"]).orderBy("index").collect()] == [(8, 1, 6), (8, 2, 70)]


def test_slices(one):
    plain = [60, 50, 40, 30, 20, 10]
    v = literal(plain)
    for at in (slice(2, 5), slice(-3, None), slice(-50, 2), slice(4, 60), slice(None, None, -1), slice(1, None, 2), slice(5, 0, -2)):
        assert one(v[at]) == plain[at]
    assert one(v[-2]) == 20
    assert one(literal([[60, 50], [40, 30], [20, 10]])[:, 0]) == [60, 40, 20]


@pytest.mark.parametrize("bad", [lambda: literal([1, 2])[5], lambda: literal([1, 2])[7:], lambda: literal([1, 2])[9::-1], lambda: R("add")([1, 2], [1, 2, 3])])
def test_errors(one, bad):
    with pytest.raises(Exception, match="out of range|broadcast"):
        one(bad())


def test_outer_and_state(one):
    assert one(outer(R("multiply"))([3, -1], [10, 0, 7])) == [[30, 0, 21], [-10, 0, -7]]
    assert one(state_elwise(lambda x, i: x * 10 + Value(i, literal(1).dtype))([5, 6])) == [50, 61]


def test_neighborhood(one):
    window = neighborhood(R("sum"))
    line = [7, -2, 5, 0, 9, 4]
    assert one(window(literal(line), 2, -1)) == [None, *(line[i - 1] + line[i] for i in range(1, 6))]
    grid = [[i * i - 3 * j for i in range(5)] for j in range(3)]
    want = [[sum(grid[y][x] for y in (j, j + 1) for x in (i, i + 1, i + 2)) if j < 2 and i < 3 else None for i in range(5)] for j in range(3)]
    assert one(window(literal(grid), (2, 3))) == want
    assert one(neighborhood(R("sum"), 0)(literal([1, 2, 3]), 2, 0)) == [3, 5, 0]
    assert one(convolve(literal([1.0, 2.0, 3.0, 4.0]), [1, 0, -1])) == [2.0, 2.0]
    assert one(convolve(literal([1.0, 2.0]), [1, 1], "full")) == [1.0, 3.0, 2.0]


def test_complex(one):
    z = literal(3 + 4j)
    assert tuple(one(z * literal(1j))) == (-4.0, 3.0)
    assert tuple(one(R("divide")(literal(1 + 2j), literal(1j)))) == (2.0, -1.0)
    assert one(R("real")(R("conj")(z))) == 3.0
    assert one(R("imag")(R("conj")(z))) == -4.0
    root = one(R("sqrt")(literal(-4 + 0j)))
    assert (root["re"], root["im"]) == (0.0, 2.0)


def test_bytes(spark, one):
    assert one(R("serialize")([6, -1])) == b"\x06\0\0\0\xff\xff\xff\xff"
    assert one(R("serialize")(["ab", "é"])) == b"ab\xc3\xa9"
    assert one(R("byteswap")([1, 258])) == [1 << 24, 0x02010000]
    assert one(R("byteswap")(literal(1, "int64"))) == 1 << 56
    assert one(binary.view(literal([2.0]), "int64")) == [1 << 62]
    assert one(binary.deserialize(literal(b"\x02\x01\x00\x80"), "int16")) == [258, -32768]
    assert one(R("storage")(["é", None])) == [b"\xc3\xa9", None]
    assert one(R("storage")(5)) == 5
    assert one(R("replace_dtype")([2.0, -0.0], "int64")) == [1 << 62, -(1 << 63)]
    assert one(R("replace_dtype")(literal(1 << 62, "int64"), "float64")) == 2.0
    for v, dtype in ((1, "int64"), ("x", "int32"), ([[1]], "float32")):
        with pytest.raises(TypeError, match="stored"):
            R("replace_dtype")(v, dtype)
    with pytest.raises(Exception, match="missing value has no bytes"):
        one(R("serialize")([1, None]))
    with pytest.raises(Exception, match="whole number"):
        one(binary.deserialize(literal(b"abc"), "int16"))
    # batches of cells of differing lengths, missing and empty ones among them
    cells = [[1, 2, 3], None, [], [4], [5, -6]] * 40
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "id int, a array<bigint>").repartition(3)
    a = value(df, "a")
    got = df.select("id", R("serialize")(a).alias("raw"), binary.view(R("byteswap")(R("byteswap")(a)), "int32").alias("halves")).orderBy("id").collect()
    assert [r["raw"] for r in got] == [None if c is None else b"".join(x.to_bytes(8, "little", signed=True) for x in c) for c in cells]
    assert [r["halves"] for r in got] == [None if c is None else [h for x in c for h in (x % 2**32 - (x < 0) * 2**32, -(x < 0))] for c in cells]


def test_transforms(spark, one):
    """Against numpy, over cells of differing lengths."""
    rng = np.random.default_rng(4)
    cells = [None if n is None else rng.normal(size=n).tolist() for n in (8, 3, None, 0, 8, 1, 5, 3)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "id int, a array<double>")
    v = value(df, "a")
    z = R("fft")(v)
    got = df.select("id", z.alias("z"), R("rfft")(v).alias("h"), R("ifft")(z).alias("back")).orderBy("id").collect()
    number = lambda line: np.array([complex(x["re"], x["im"]) for x in line])
    for c, r in zip(cells, got, strict=True):
        if c is None:
            assert r["z"] is None and r["h"] is None and r["back"] is None
        elif c:
            assert np.allclose(number(r["z"]), np.fft.fft(c)) and np.allclose(number(r["h"]), np.fft.rfft(c)) and np.allclose(number(r["back"]), c)
        else:
            assert r["z"] == r["h"] == r["back"] == []
    m = rng.normal(size=(3, 4))
    assert np.allclose([number(line) for line in one(binary.fft2(literal(m.tolist())))], np.fft.fft2(m))


def test_values_that_are_passed_on(spark, one):
    """Views, evaluation, dereference, copies: the value itself; a functor gets the column."""
    for name in ("view", "eval", "dereference", "to_host", "copy"):
        assert one(R(name)([3, 1, 2])) == [3, 1, 2]
    assert one(arrays.identity(literal("x"))) == "x"
    assert spark.range(1).select(registry.with_value(literal([3, 1]), F.size)).first()[0] == 2
    assert tuple(one(complexes.as_complex(literal(2)))) == (2.0, 0.0)


def test_structs(spark):
    df = spark.createDataFrame([((7, 0.5), [(1, 2)])], "s struct<x:int,y:double>, l array<struct<a:int,b:int>>")
    assert df.select(value(df, "s").p("x").alias("x")).first()[0] == 7
    assert df.select(arrays.field_access(value(df, "l"), "b").alias("x")).first()[0] == [2]
    with pytest.raises(AttributeError):
        value(df, "s").p("z")


def test_rows(spark):
    df = spark.createDataFrame([(1, [[1, 2], [3]]), (1, [[4]]), (2, [[]])], "k int, a array<array<int>>")
    total = {r["k"]: r["value"] for r in reduce.reduce_rows(df, "a", "sum", ["k"]).collect()}
    assert total == {1: 10}
    by = {(r["k"], r["i0"]): r["value"] for r in reduce.reduce_rows(df, "a", "max", ["k"], axes=(1,)).collect()}
    assert by == {(1, 0): 4, (1, 1): 3}
