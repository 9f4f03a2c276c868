"""Strings, JSON, casts, generators, datashapes, the registry and the sources."""

import math

import pytest
from pyspark.sql import types as T

from tessera import registry, sources
from tessera.functions import casting, generators, jsonio, strings
from tessera.operators import categorical
from tessera.streaming import windowed
from tessera.types import from_spark, match, parse, to_spark
from tessera.value import literal, value

R = registry.get


TEXTS = ["", "oak", "oakoak", "an oak by an oak", "oaoak ", "kaoaka", "Ünder öaks oak", "日本oak語oak", "o" * 50 + "oak"]
NEEDLES = ["oak", "o", "ö", "語o", " ", "a by"]


@pytest.mark.parametrize("needle", NEEDLES)
def test_strings_match_plain_bytes(one, needle):
    """Positions and counts in UTF-8 bytes, by Python's own search of the encoded text."""
    raw, n = [t.encode() for t in TEXTS], needle.encode()
    assert one(strings.string_find(TEXTS, needle)) == [t.find(n) for t in raw]
    assert one(strings.string_rfind(TEXTS, needle)) == [t.rfind(n) for t in raw]
    assert one(strings.string_count(TEXTS, needle)) == [t.count(n) for t in raw]
    assert one(strings.string_replace(TEXTS, needle, "<é>")) == [t.replace(needle, "<é>") for t in TEXTS]
    assert one(strings.string_split(TEXTS, needle)) == [t.split(needle) for t in TEXTS]
    assert one(strings.string_startswith(TEXTS, needle)) == [t.startswith(needle) for t in TEXTS]
    assert one(strings.string_endswith(TEXTS, needle)) == [t.endswith(needle) for t in TEXTS]
    assert one(strings.string_contains(TEXTS, needle)) == [needle in t for t in TEXTS]
    assert one(strings.string_concatenation(TEXTS, needle)) == [t + needle for t in TEXTS]


@pytest.mark.parametrize(
    ("f", "args", "expected"),
    [
        (strings.string_find, ("tree", ""), -1),
        (strings.string_rfind, ("tree", ""), -1),
        (strings.string_count, ("tree", ""), 0),
        (strings.string_replace, ("tree", "", "+"), "tree"),
        (strings.string_split, ("tree", ""), ["tree"]),
        (strings.string_split, ("1\\Q2\\E3", "\\E"), ["1\\Q2", "3"]),
        (strings.string_contains, ("tree", ""), False),
        (strings.string_startswith, (["tree", None], "tr"), [True, None]),
        (strings.string_concatenation, ("t", ["o", None]), ["to", None]),
    ],
)
def test_strings_at_the_edges(one, f, args, expected):
    assert one(f(*args)) == expected


@pytest.mark.parametrize(("encoding", "name"), [("utf8", "utf-8"), ("utf16", "utf-16-le"), ("utf16be", "utf-16-be"), ("utf32", "utf-32-be"), ("ucs2", "utf-16-le"), ("latin1", "latin-1"), ("ascii", "ascii")])
def test_encodings(one, encoding, name):
    texts = {"ascii": ["", "plain ~"], "latin1": ["", "año ÿ"], "ucs2": ["", "añ 日本"]}.get(encoding, ["", "añ 日本 🌲"])
    for mode in ("checked", "nocheck"):
        assert one(strings.encode(literal(texts), encoding, mode)) == [t.encode(name) for t in texts]
    for t in texts:
        for mode in ("checked", "nocheck"):
            assert one(strings.decode(literal(t.encode(name)), encoding, mode)) == t


@pytest.mark.parametrize(("encoding", "text", "lenient"), [("ascii", "año", b"a?o"), ("latin1", "a日o", b"a?o"), ("ucs2", "a🌲", "a?".encode("utf-16-le"))])
def test_characters_that_an_encoding_lacks(one, encoding, text, lenient):
    assert one(strings.encode(literal(text), encoding, "nocheck")) == lenient
    with pytest.raises(Exception, match="USER_RAISED|MALFORMED|encod|ENCOD"):
        one(strings.encode(literal(text), encoding))


@pytest.mark.parametrize(("encoding", "raw", "lenient"), [("ascii", b"a\xf1o", "a?o"), ("utf8", b"a\xffo", "a?o"), ("utf16", b"a\0\x3d\xd8", "a?"), ("ucs2", "🌲".encode("utf-16-le") + b"o\0", "?o")])
def test_bytes_that_are_no_text(one, encoding, raw, lenient):
    assert one(strings.decode(literal(raw), encoding, "nocheck")) == lenient
    with pytest.raises(Exception, match="USER_RAISED|MALFORMED|decod|DECOD"):
        one(strings.decode(literal(raw), encoding))
    with pytest.raises(ValueError, match="error mode"):
        strings.encode(literal("x"), "utf8", "sloppy")


def test_json(one):
    text = literal('[{"y":"a","x":1},[2,null],{"x":"3","other":[1]}]')
    assert [tuple(r) for r in one(R("parse_json")("3 * {x: int32, y: ?string}", text))] == [(1, "a"), (2, None), (3, None)]
    assert one(R("parse_json")("var * ?bool", literal('[true,false,null,1,0,"NA"]'))) == [True, False, None, True, False, None]
    assert one(R("parse_json")("{a: {b: var * float64}}", literal('{"a":{"b":[1,2.5]}}')))["a"]["b"] == [1.0, 2.5]
    assert one(R("format_json")([None, 32, 21])) == "[null,32,21]"
    assert one(R("validate_json")('{"a":1')) is False
    for shape, bad in (("2 * int32", "[1]"), ("{x: int32}", "{}"), ("int32", '"x"'), ("{x: int32}", "{")):
        with pytest.raises(Exception, match="USER_RAISED|CAST"):
            one(R("parse_json")(shape, literal(bad)))


def readers(col) -> int:
    """How many JSON readers an expression has."""
    return str(col._jc.toString()).lower().count("from_json")


def test_json_plan_grows_with_the_shape(one):
    """A constant number of readers for each level, at any depth."""
    shape, text, counts = "int32", "7", []
    for _ in range(5):
        shape, text = "{a: %s, b: ?int32}" % shape, '{"a":%s,"b":2}' % text
        counts.append(readers(R("parse_json")(shape, literal(text)).col))
    steps = {b - a for a, b in zip(counts, counts[1:], strict=False)}
    assert len(steps) == 1 and steps.pop() <= 4
    v = one(R("parse_json")(shape, literal(text)))
    for _ in range(5):
        assert v["b"] == 2
        v = v["a"]
    assert v == 7


def test_json_structs_as_lists(one):
    shape = "{p: {x: int32, y: ?string}, q: 2 * (int32, float64)}"
    want = ((4, None), [(1, 0.5), (2, -1.0)])
    for text in ('{"q":[[1,0.5],[2,-1]],"p":{"x":4}}', '[[4,null],[[1,0.5],[2,-1]]]', ' {"p":[4,"NA"],"q":[{"_0":1,"_1":0.5},[2,-1.0]]}'):
        got = one(R("parse_json")(shape, literal(text)))
        assert (tuple(got["p"]), [tuple(x) for x in got["q"]]) == want
    for bad in ('{"p":[4],"q":[[1,0.5],[2,-1]]}', '{"p":{"x":4},"q":[[1,0.5]]}', '{"q":[[1,0.5],[2,-1]]}', '{"p":{"x":4},"q":7}'):
        with pytest.raises(Exception, match="USER_RAISED|CAST"):
            one(R("parse_json")(shape, literal(bad)))
    assert one(R("parse_json")("?{x: int32}", literal("null"))) is None


def test_discover(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":2,"b":["x"]}',)], "j string")
    assert jsonio.discover(df, "j") == "{a: ?int64, b: ?var * ?string}"


def test_casts(one):
    assert one(casting.assign(["88", "None", " -5 ", "NULL", "NA", ""], "?int32")) == [88, None, -5, None, None, None]
    assert one(casting.assign([math.nan, 41.0, -7.0], "?int32")) == [None, 41, -7]
    assert one(casting.cast([300.7, -1.5], "int8")) == [44, -1]
    assert one(casting.cast(literal(300), "int8")) == 44
    for v, shape, mode in ((1.5, "int32", "fractional"), (1e10, "int32", "overflow"), (16777217, "float32", "inexact"), ("x", "int32", "overflow"), (2, "bool", "fractional")):
        with pytest.raises(Exception, match="USER_RAISED|CAST|OVERFLOW"):
            one(casting.assign(v, shape, mode))
    assert one(casting.assign(1.5, "int32", "overflow")) == 1
    with pytest.raises(ValueError):
        casting.assign(1, "int32", "sloppy")


def test_generators(one):
    assert one(R("range")(10, start=5, step=3)) == [5, 8]
    assert one(R("range")(start=10, stop=5, step=-1)) == [10, 9, 8, 7, 6]
    assert len(one(R("range")(1.0, start=0.0, step=0.1))) == 10
    assert one(R("range")(0)) == []
    assert one(R("linspace")(0.0, 1.0, 5)) == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert one(R("zeros")((2, 1), "int32")) == [[0], [0]]
    assert one(generators.empty_like(literal([[1, 2], [3]]))) == [[None, None], [None]]
    assert one(R("limits.max")("int16")) == 32767
    assert generators.limits("float64")[0] == -1.7976931348623157e308
    with pytest.raises(Exception, match="step is 0"):
        one(R("range")(3, start=0, step=0))


def test_uniform(spark):
    df = spark.range(2000)
    rows = df.select(generators.uniform(1, 6, "int32", seed=1).alias("d"), generators.uniform(seed=2).alias("u")).collect()
    assert {r["d"] for r in rows} == {1, 2, 3, 4, 5, 6}
    assert 0.45 < sum(r["u"] for r in rows) / 2000 < 0.55
    draws = df.limit(2).select(generators.uniform_array(3, seed=5).alias("x")).collect()
    assert len({x for r in draws for x in r["x"]}) == 6


@pytest.mark.parametrize("shape", ["int32", "var * ?int64", "{x: int32, y: ?string}", "(int32, float64)", "var * var * complex64", "bytes"])
def test_datashape_round_trip(shape):
    assert parse(from_spark(to_spark(shape))) is not None
    assert to_spark(from_spark(to_spark(shape))) == to_spark(shape)


def test_datashape_errors_and_patterns():
    with pytest.raises(ValueError, match="line 2"):
        parse("{x: int32,\n y: nonsense}")
    assert match("N * T", "3 * int32") == {"N": 3, "T": parse("int32")}
    assert match("Fixed * Scalar", "3 * int32") == {}
    assert match("T * T", "3 * int32") is None
    assert match("Fixed * Any", "var * int32") is None
    assert match("{x: T, y: T}", "{x: int32, y: float64}") is None


def test_overloads():
    kind = registry.Overloads("kind").overload(["int32"], lambda a: "int").overload(["Scalar"], lambda a: "scalar").overload(["Any"], lambda a: "any")
    assert (kind(1), kind("x"), kind([1])) == ("int", "scalar", "any")
    unclear = registry.Overloads("f").overload(["int32", "Any"], lambda a, b: 1).overload(["Any", "int32"], lambda a, b: 2)
    assert unclear(1, "x") == 1
    with pytest.raises(TypeError, match="ambiguous"):
        unclear(1, 1)
    with pytest.raises(TypeError, match="no overload"):
        registry.Overloads("f").overload(["string"], lambda a: a)(1)


def test_registry():
    with pytest.raises(KeyError):
        registry.get("nothing")
    with pytest.raises(ValueError):
        registry.insert("add", lambda a: a)
    registry.insert("twice_for_test", lambda a: literal(a) * 2)
    assert "twice_for_test" in registry.observe()


def test_combinators(one):
    assert one(registry.compose(lambda x: literal(x) * 2.6, lambda x: x + 1, "int32")(1)) == 3
    assert one(registry.constant(5)("ignored")) == 5
    with pytest.raises(TypeError, match="keywords"):
        registry.apply(lambda x, k: x + k, "int32", "k")(1)
    assert one(registry.apply(lambda x, k: x + k, "int32", "k")([1, 2], k=10)) == [11, 12]
    adder = registry.apply_class(type("Adder", (), {"__init__": lambda s, n: setattr(s, "n", n), "__call__": lambda s, x: x + s.n}), "int32")
    assert one(adder(n=3)([1, 2])) == [4, 5]
    shelf = type("Shelf", (), {"width": 4, "fits": lambda s, x: x <= s.width})()
    assert one(registry.apply_method(shelf, "fits", "bool")([4, 5])) == [True, False]
    assert one(registry.adapt("int32", lambda v: v * 2.5)(literal([1, 3]))) == [2, 7]


def test_functions_in_sql_text(spark):
    registry.register_udf(spark, "thrice_for_test", lambda x: x * 3, "int64")
    assert [r[0] for r in spark.sql("SELECT thrice_for_test(id) FROM range(3)").collect()] == [0, 3, 6]
    assert [r[0] for r in generators.range_rows(spark, 2, 9, 3).collect()] == [2, 5, 8]


def test_sources(spark, tmp_path):
    df = sources.from_literal(spark, [(1, [1.5]), (2, None)], "{a: int32, b: ?var * float64}")
    sources.to_json_lines(df, str(tmp_path / "j"))
    back = sources.from_json_lines(spark, str(tmp_path / "j"), "{a: int32, b: ?var * float64}")
    assert sorted(map(tuple, back.collect())) == [(1, [1.5]), (2, None)]
    sources.to_parquet(df, str(tmp_path / "p"))
    assert sources.from_parquet(spark, str(tmp_path / "p")).count() == 2
    import pyarrow as pa

    assert sources.from_arrow(spark, pa.table({"a": [1, 2]})).count() == 2
    (tmp_path / "raw.bin").write_bytes(b"\x01\x02")
    assert bytes(sources.memmap(spark, str(tmp_path / "raw.bin")).first()["content"]) == b"\x01\x02"
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert sources.from_csv(spark, str(tmp_path / "c.csv"), "{a: int32, b: string}").first()["a"] == 1


def test_categorical(spark):
    df = spark.createDataFrame([("elm",), ("ash",), (None,), ("yew",), ("elm",)], "v string")
    assert {r["v"]: r["v_code"] for r in categorical.factor(df, "v").collect()} == {"yew": 2, "ash": 0, "elm": 1, None: None}
    numbers = spark.createDataFrame([(30,), (10,)], "v int")
    assert {r["value"]: r["code"] for r in categorical.dictionary(numbers, "v").collect()} == {10: 0, 30: 1}
    many = spark.createDataFrame([(f"https://example.org/{k * 7919 % 1000:04d}",) for k in range(1000)] * 2, "v string")
    for ranges in (1, 7, 300):
        assert [(r["value"][-4:], r["code"]) for r in categorical.dictionary(many, "v", ranges).orderBy("code").collect()] == [(f"{k:04d}", k) for k in range(1000)]
    assert categorical.dictionary(many.filter("false"), "v").count() == 0
    assert (categorical.code_type(256), categorical.code_type(257)) == ("uint8", "uint16")


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.sql("select timestamp'2024-01-01 00:00:01' ts, 'a' k, 2 v union all select timestamp'2024-01-01 00:00:02', 'a', 3").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("ts timestamp, k string, v int").parquet(str(tmp_path / "in"))
    doubled = rows.withColumn("v", (value(rows, "v") * 2).col)
    out = windowed(doubled, "ts", "1 minute", "1 minute", ["k"], {"total": lambda: F.sum("v")})
    q = out.writeStream.format("memory").queryName("stream_test").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["k"], r["total"]) for r in spark.table("stream_test").collect()] == [("a", 10)]


def test_types():
    assert isinstance(to_spark("uint64"), T.DecimalType)
    assert to_spark("complex[float32]").names == ["re", "im"]
