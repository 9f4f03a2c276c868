"""All registered queries of the array engine, and the DuckDB SQL that checks each.

A query reads whole tables, names the columns that it needs, and is built from
registered functions only. Arrays are rendered as text in results, so that
either engine's rows compare value by value; real numbers are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import registry, sources
from tessera.functions import arithmetic, casting, complexes, generators, jsonio, strings
from tessera.functions.lifting import elwise, forward_na, outer, state_elwise
from tessera.operators import arrays, binary, categorical, reduce
from tessera.operators.neighborhood import convolve, neighborhood, rolling_rows
from tessera.session import table
from tessera.value import Value, literal, value

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
R = registry.get


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def text(v: Value) -> Column:
    """Array of scalars as text."""
    return F.array_join(F.transform(v.col, lambda x: x.cast("string")), ",", "NA")


def rounded(v: Value, digits: int = 6) -> Column:
    return F.round(v.col.cast("double"), digits)


def _order_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each order, by line."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")).alias("s"))
    return rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["q"]).alias("q"))


_VECTORS = "v AS (SELECT l_orderkey, list(CAST(l_quantity AS INT) ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY l_orderkey)"


@query("""
SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_quantity < 24 GROUP BY l_returnflag
""")
def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    v = lambda c: value(rows, c)
    kept = rows.filter((v("l_quantity") < 24).col)
    amount = v("l_extendedprice") * R("subtract")(1, v("l_discount"))
    return kept.groupBy("l_returnflag").agg(F.round(F.sum(amount.col), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_orderkey AS up, -l_orderkey AS un, l_orderkey + l_partkey AS ad, l_orderkey - l_partkey AS su,
  l_orderkey * l_linenumber AS mu, l_orderkey // l_linenumber AS dv, l_orderkey % l_linenumber AS md,
  round(l_extendedprice / (l_quantity + 0.1), 6) AS rd, round(pow(l_discount, 2), 6) AS pw, round(sqrt(l_tax), 6) AS sq, round(cbrt(l_tax), 6) AS cb
FROM lineitem
""")
def arithmetic_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    v = lambda c: value(rows, c)
    k, p, n = v("l_orderkey"), v("l_partkey"), v("l_linenumber")
    return rows.select(
        "l_orderkey", "l_linenumber", (+k).alias("up"), (-k).alias("un"), (k + p).alias("ad"), (k - p).alias("su"), (k * n).alias("mu"),
        (k / n).alias("dv"), (k % n).alias("md"), rounded(v("l_extendedprice") / (v("l_quantity") + 0.1)).alias("rd"), rounded(v("l_discount") ** 2).alias("pw"),
        rounded(R("sqrt")(v("l_tax"))).alias("sq"), rounded(R("cbrt")(v("l_tax"))).alias("cb"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INT) * 100 AS wide, round(l_linenumber * 0.5, 6) AS mixed,
  CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END + 1 AS truth, CASE WHEN l_discount = 0 THEN 'inf' ELSE 'finite' END AS by_zero
FROM lineitem
""")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns(
        {"small": F.col("l_linenumber").cast("tinyint"), "half": F.lit(0.5).cast("float"), "even": F.col("l_linenumber") % 2 == 0}
    )
    v = lambda c: value(rows, c)
    ratio = R("divide")(1.0, v("l_discount"))
    return rows.select(
        "l_orderkey", "l_linenumber", (v("small") * literal(100, "int8")).alias("wide"), rounded(v("small") * v("half")).alias("mixed"),
        (v("even") + 1).alias("truth"), F.when(ratio.col == float("inf"), "inf").otherwise("finite").alias("by_zero"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_orderkey & l_partkey AS a, l_orderkey | l_partkey AS o, xor(l_orderkey, l_partkey) AS x, ~l_orderkey AS n,
  l_orderkey << 3 AS l, l_orderkey >> 2 AS r FROM lineitem
""")
def bitwise_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    k, p = value(rows, "l_orderkey"), value(rows, "l_partkey")
    return rows.select(
        "l_orderkey", "l_linenumber", (k & p).alias("a"), (k | p).alias("o"), (k ^ p).alias("x"), (~k).alias("n"), (k << 3).alias("l"), (k >> 2).alias("r")
    )


_NA = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {_NA} AS q, l_discount AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN q IS NULL THEN NULL ELSE q > 25 AND d <> 0 END AS a, CASE WHEN q IS NULL THEN NULL ELSE q > 25 OR d <> 0 END AS o,
  CASE WHEN q IS NULL THEN NULL ELSE (q > 25) <> (d <> 0) END AS x, NOT (q > 25) AS n, q IS NULL AS m FROM t
""")
def logic_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    q, d = value(rows, "q"), value(rows, "l_discount")
    big = q > 25
    return rows.select(
        "l_orderkey", "l_linenumber", R("logical_and")(big, d).alias("a"), R("logical_or")(big, d).alias("o"), R("logical_xor")(big, d).alias("x"),
        R("logical_not")(big).alias("n"), R("is_na")(q).alias("m"),
    )


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {_NA} AS q, l_tax * 100 + 20 AS u, l_returnflag, l_linestatus FROM lineitem)
SELECT l_orderkey, l_linenumber, q < u AS lt, q <= u AS le, q > u AS gt, q >= u AS ge, q = u AS eq, q <> u AS ne, l_returnflag < l_linestatus AS st,
  CAST(l_returnflag < l_linestatus AS INT) AS tot FROM t
""")
def comparison_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"q": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")), "u": F.col("l_tax") * 100 + 20})
    q, u, f, s = (value(rows, c) for c in ("q", "u", "l_returnflag", "l_linestatus"))
    return rows.select(
        "l_orderkey", "l_linenumber", (q < u).alias("lt"), (q <= u).alias("le"), (q > u).alias("gt"), (q >= u).alias("ge"), (q == u).alias("eq"), (q != u).alias("ne"),
        (f < s).alias("st"), R("total_order")(f, s).alias("tot"),
    )


@query("""
SELECT l_orderkey, l_linenumber, round(cos(l_discount), 6) AS c, round(sin(l_discount), 6) AS s, round(tan(l_discount), 6) AS t, round(exp(l_discount), 6) AS e,
  round(l_tax * pi(), 6) AS p FROM lineitem
""")
def math_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    d = value(rows, "l_discount")
    return rows.select(
        "l_orderkey", "l_linenumber", *[rounded(R(n)(d)).alias(n[0]) for n in ("cos", "sin", "tan", "exp")],
        rounded(value(rows, "l_tax") * arithmetic.constant("pi")).alias("p"),
    )


@query("""
WITH t AS (SELECT *, l_tax AS p, l_discount AS q, l_discount + 0.5 AS r, l_tax - 0.25 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round(p, 6) AS re, round(0 - q, 6) AS im, round(p * p - q * q, 6) AS re2, round(2 * p * q, 6) AS im2, round(p + 1, 6) AS re3,
  p = r AND q = s OR p = q AS same, round(p - r, 6) AS dre, round(q - s, 6) AS dim, round((p * r + q * s) / (r * r + s * s), 5) AS qre,
  round((q * r - p * s) / (r * r + s * s), 5) AS qim, round(sqrt((sqrt(r * r + s * s) + r) / 2), 5) AS rre,
  round(CASE WHEN s < 0 THEN -1 ELSE 1 END * sqrt(greatest((sqrt(r * r + s * s) - r) / 2, 0)), 5) AS rim FROM t
""")
def complex_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    z, w = complexes.make(F.col("l_tax"), F.col("l_discount")), complexes.make(F.col("l_discount") + 0.5, F.col("l_tax") - 0.25)
    turned = complexes.make(F.col("l_discount"), F.col("l_tax"))
    conj, square, less, ratio, root = R("conj")(z), z * z, z - w, z / w, R("sqrt")(w)
    parts = {"re": R("real")(conj), "im": R("imag")(conj), "re2": R("real")(square), "im2": R("imag")(square), "re3": R("real")(z + 1), "dre": less.p("re"), "dim": less.p("im")}
    rest = {"qre": ratio.p("re"), "qim": ratio.p("im"), "rre": root.p("re"), "rim": root.p("im")}
    return rows.select(
        "l_orderkey", "l_linenumber", *[rounded(x).alias(n) for n, x in parts.items()], *[(F.round(x.col, 5) + 0.0).alias(n) for n, x in rest.items()],
        R("logical_or")(z == w, z == turned).alias("same"),
    )


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s, round(CAST(list_min(embedding) AS DOUBLE), 6) AS lo,
  round(CAST(list_max(embedding) AS DOUBLE), 6) AS hi, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS m,
  list_min(embedding) > -1 AS every, list_max(embedding) > 0.3 AS some FROM embeddings
""")
def reduce_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    v = casting.cast(value(rows, "embedding"), "float64")
    return rows.select(
        "vec_id", rounded(R("sum")(v), 4).alias("s"), rounded(R("min")(v)).alias("lo"), rounded(R("max")(v)).alias("hi"), rounded(R("mean")(v)).alias("m"),
        R("all")(v > -1.0).alias("every"), R("any")(v > literal(0.3, "float32")).alias("some"),
    )


@query("""
WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i0, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, i0, round(sum(x), 4) AS value FROM e GROUP BY label, i0
""")
def reduce_over_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reduce.reduce_rows(table(spark, sf_dir, "embeddings"), "embedding", "sum", ["label"], axes=())
    return out.select("label", F.col("i0").cast("long").alias("i0"), F.round("value", 4).alias("value"))


@query("""
WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, round(stddev_samp(x), 5) AS sd, round(var_samp(x), 5) AS vr, round(avg(x), 6) AS m, count(x) AS n, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM e GROUP BY label
""")
def statistics_over_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrays.iterate(table(spark, sf_dir, "embeddings"), "embedding", ["label"]).withColumn("value", F.col("value").cast("double"))
    each = {n: reduce._AGGREGATES[h](F.col("value"), T.DoubleType()) for n, h in (("sd", "std"), ("vr", "var"), ("m", "mean"), ("n", "count"), ("lo", "min"), ("hi", "max"))}
    return rows.groupBy("label").agg(*[(c if n == "n" else F.round(c, 5 if n in ("sd", "vr") else 6)).alias(n) for n, c in each.items()])


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)
SELECT vec_id, round(list_sum([a[8 * i + 3] for i in range(0, 8)]), 5) AS col2, round(list_sum(a[17:24]), 5) AS row2, 1 AS kept FROM e
""")
def reduce_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    m = arrays.reshape(casting.cast(value(rows, "embedding"), "float64"), (8, 8))
    columns, lines = R("sum")(m, axes=(0,)), R("sum")(m, axes=(1,))
    kept = R("sum")(m, axes=(0,), keepdims=True)
    return rows.select("vec_id", rounded(columns[2], 5).alias("col2"), rounded(lines[2], 5).alias("row2"), F.size(kept.col).alias("kept"))


@query(f"""
WITH {_VECTORS} SELECT l_orderkey, CAST(list_sum(q) AS BIGINT) AS s, list_max(q) AS hi, list_min(q) AS lo, CAST(list_reduce(list_prepend(0, q), lambda a, x: x - a) AS BIGINT) AS r,
  CAST(list_reduce(list_prepend(0, q), lambda a, x: (a * 3 + x) % 1000003) AS BIGINT) AS l, len(q) AS n FROM v
""")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_vectors(spark, sf_dir)
    q = value(rows, "q")
    start = literal(0, "int64")
    left = reduce.left_compound(lambda acc, x: (acc * 3 + x) % 1000003, start)(q)
    right = reduce.right_compound(lambda x, acc: R("cast")(x, "int64") - acc, start)(q)
    return rows.select(
        "l_orderkey", R("sum")(q).col.cast("long").alias("s"), R("max")(q).alias("hi"), R("min")(q).alias("lo"), right.alias("r"), left.alias("l"), F.size("q").cast("long").alias("n")
    )


@query(f"""
WITH {_VECTORS} SELECT l_orderkey, q[1] AS head, q[-1] AS tail, coalesce(array_to_string(q[2:3], ','), '') AS mid, array_to_string(list_reverse(q), ',') AS back,
  array_to_string([x for x, i in q if i % 2 = 1], ',') AS every2 FROM v WHERE len(q) >= 3
""")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_vectors(spark, sf_dir).filter(F.size("q") >= 3)
    q = value(rows, "q")
    return rows.select(
        "l_orderkey", q[0].alias("head"), q[-1].alias("tail"), text(q[1:3]).alias("mid"), text(q[::-1]).alias("back"), text(q[::2]).alias("every2")
    )


@query(f"""
WITH {_VECTORS} SELECT l_orderkey, array_to_string(list_filter(q, lambda x: x > 25), ',') AS masked, array_to_string([i - 1 for x, i in q if x > 25], ',') AS places,
  concat_ws(',', q[-1], q[1], q[1]) AS picked FROM v
""")
def take_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_vectors(spark, sf_dir)
    q = value(rows, "q")
    places = R("where")(lambda x: x > 25)(q)
    return rows.select("l_orderkey", text(R("take")(q, q > 25)).alias("masked"), text(places).alias("places"), text(R("take")(q, [-1, 0, 0])).alias("picked"))


@query(f"""
WITH {_VECTORS}, e AS (SELECT l_orderkey, generate_subscripts(q, 1) - 1 AS i, unnest(q) AS x FROM v)
SELECT l_orderkey, CAST(i AS BIGINT) AS i, x FROM e WHERE x > 40
""")
def where_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrays.where_rows(_order_vectors(spark, sf_dir), "q", lambda x: x > 40, ["l_orderkey"])
    return rows.select("l_orderkey", F.col("index").cast("long").alias("i"), F.col("value").alias("x"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(x * 1000) AS INT)) AS a FROM embeddings)
SELECT vec_id, array_to_string(list_concat(a, a), ',') AS joined, array_to_string([a[16 * (k % 4) + k // 4 + 1] for k in range(0, 64)], ',') AS turned,
  array_to_string(a[17:32], ',') AS line, array_to_string(a, ',') AS same, a[19] AS cell FROM e
""")
def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    a = casting.cast(value(rows, "embedding") * 1000, "int32")
    m = R("reshape")(a, (4, 16))
    turned = R("transpose")(m)
    back = R("permute")(R("rotate")(m, 1), (1, 0))
    return rows.select(
        "vec_id", text(R("concatenate")(a, a)).alias("joined"), text(arrays.flat(turned)).alias("turned"), text(m[1]).alias("line"),
        text(arrays.flat(R("new_axis")(back, 1))).alias("same"), m[1, 2].alias("cell"),
    )


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(x * 100) AS INT)) AS a FROM embeddings)
SELECT vec_id, array_to_string(list_transform(a, lambda x: list_sum(list_transform(a, lambda y: (x - y) * (x - y) % 101))::INT), ',') AS differences,
  array_to_string(list_transform(a, lambda x: x - a[64]), ',') AS last FROM e
""")
def outer_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    a = casting.cast(value(rows, "embedding") * 100, "int32")
    rows = rows.select("vec_id", outer(R("subtract"))(a, a).alias("d"))
    d = value(rows, "d")
    return rows.select("vec_id", text(R("sum")(d * d % 101, axes=(1,))).alias("differences"), text(d[:, -1]).alias("last"))


@query("""
SELECT event_id, round(CASE WHEN count(*) OVER w = 5 THEN sum(value) OVER w END, 4) AS roll, round(CASE WHEN count(*) OVER c = 3 THEN max(value) OVER c END, 6) AS near
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  c AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
""")
def neighborhood_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    by = (["user_id"], ["ts", "event_id"])
    out = rolling_rows(rows, F.sum, "value", *by, size=5, offset=-4, name="roll")
    out = rolling_rows(out, F.max, "value", *by, size=3, offset=-1, name="near")
    return out.select("event_id", F.round("roll", 4).alias("roll"), F.round("near", 6).alias("near"))


@query(f"""
WITH {_VECTORS} SELECT l_orderkey, array_to_string([CASE WHEN i >= 2 AND i < len(q) THEN CAST(q[i - 1] + q[i] + q[i + 1] AS VARCHAR) ELSE 'NA' END for x, i in q], ',') AS sums FROM v
""")
def neighborhood_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_vectors(spark, sf_dir)
    return rows.select("l_orderkey", text(neighborhood(R("sum"))(value(rows, "q"), 3, -1)).alias("sums"))


@query(f"""
WITH {_VECTORS}, s AS (SELECT l_orderkey, list_sort(q) AS q FROM v)
SELECT l_orderkey, array_to_string(q, ',') AS sorted, array_to_string(list_sort(list_distinct(q)), ',') AS uniq,
  CAST(CASE WHEN list_contains(q, 25) THEN 25 ELSE -1 END AS INT) AS found, q[-1] AS last FROM s
""")
def sort_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_vectors(spark, sf_dir)
    s = R("sort")(value(rows, "q"))
    at = R("binary_search")(s, 25)
    found = F.when(at.col >= 0, F.get(s.col, at.col.cast("int"))).otherwise(-1)
    return rows.select("l_orderkey", text(s).alias("sorted"), text(R("unique")(s)).alias("uniq"), found.alias("found"), s[-1].alias("last"))


@query("""
WITH c AS (SELECT DISTINCT event_type FROM events), d AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS code FROM c)
SELECT event_id, code FROM events LEFT JOIN d USING (event_type)
""")
def categorical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return categorical.factor(rows, "event_type").select("event_id", F.col("event_type_code").cast("int").alias("code"))


@query("""
SELECT p_partkey, p_name || '/' || p_brand AS cat, CASE WHEN instr(p_type, 'E') = 0 THEN -1 ELSE strlen(left(p_type, instr(p_type, 'E') - 1)) END AS find,
  CAST((strlen(p_type) - strlen(replace(p_type, 'E', ''))) AS BIGINT) AS cnt, replace(p_name, 'a', 'AA') AS rep, starts_with(p_type, 'S') AS st, ends_with(p_type, 'L') AS en,
  contains(p_name, 're') AS co, CAST(len(string_split(p_type, ' ')) AS INT) AS parts, string_split(p_type, ' ')[1] AS first,
  CASE WHEN instr(p_type, 'E') = 0 THEN -1 ELSE strlen(p_type) - strlen(left(reverse(p_type), instr(reverse(p_type), 'E') - 1)) - 1 END AS rfind FROM part
""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    n, b, t = (value(rows, c) for c in ("p_name", "p_brand", "p_type"))
    parts = strings.string_split(t, " ")
    return rows.select(
        "p_partkey", strings.string_concatenation(strings.string_concatenation(n, "/"), b).alias("cat"), strings.string_find(t, "E").alias("find"),
        strings.string_count(t, "E").alias("cnt"), strings.string_replace(n, "a", "AA").alias("rep"), strings.string_startswith(t, "S").alias("st"),
        strings.string_endswith(t, "L").alias("en"), strings.string_contains(n, "re").alias("co"), F.size(parts.col).alias("parts"), parts[0].alias("first"),
        strings.string_rfind(t, "E").alias("rfind"),
    )


@query("""
SELECT doc_id, CASE WHEN instr(text, 'é') = 0 THEN -1 ELSE strlen(left(text, instr(text, 'é') - 1)) END AS find,
  CAST((strlen(text) - strlen(replace(text, 'en', ''))) // 2 AS BIGINT) AS cnt, CAST(len(string_split(text, '. ')) AS INT) AS parts, strlen(text) AS n,
  sha256(encode(text)) AS utf8, sha256(regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g')) AS ascii,
  md5(array_to_string(list_transform(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN unicode(c) > 65535 THEN 63 ELSE unicode(c) END),
    lambda u: format('{:02X}{:02X}', u % 256, u // 256)), '')) AS units
FROM documents
""")
def string_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    t = value(rows, "text")
    encoded, wide = strings.encode(t, "utf8"), strings.encode(t, "ucs2", "nocheck")
    return rows.select(
        "doc_id", strings.string_find(t, "é").alias("find"), strings.string_count(t, "en").alias("cnt"), F.size(strings.string_split(t, ". ").col).alias("parts"),
        F.octet_length(encoded.col).cast("long").alias("n"), F.sha2(encoded.col, 256).alias("utf8"), F.sha2(strings.encode(t, "ascii", "nocheck").col, 256).alias("ascii"),
        F.md5(F.hex(wide.col)).alias("units"),
    )


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_valid(props) AS ok, '{"k":' || CAST(json_extract(props, '$.k') AS INT) || ',"z":null}' AS out,
  '[' || CAST(json_extract(props, '$.k') AS INT) || ',null]' AS listed FROM events
""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    props = value(rows, "props")
    # a column that is named several times is computed once: Catalyst keeps costly projections apart
    rows = rows.select("event_id", "props", R("parse_json")("{k: int32, z: ?string}", props).alias("parsed"))
    parsed = value(rows, "parsed")
    return rows.select(
        "event_id", parsed.p("k").alias("k"), R("validate_json")(props).alias("ok"), R("format_json")(parsed).alias("out"), R("format_json")(parsed, True).alias("listed")
    )


@query("""
SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(l_quantity AS INT) AS exact,
  CAST(((l_orderkey % 256) + 128) % 256 - 128 AS TINYINT) AS wrapped, CAST(l_linenumber AS VARCHAR) AS txt,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linenumber END AS parsed, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_discount, 6) END AS clean FROM lineitem
""")
def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns(
        {
            "t": F.when(F.col("l_returnflag") == "R", F.lit(" NA ")).otherwise(F.col("l_linenumber").cast("string")),
            "x": F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")),
        }
    )
    v = lambda c: value(rows, c)
    return rows.select(
        "l_orderkey", "l_linenumber", R("cast")(v("l_extendedprice"), "int64").alias("whole"), R("assign")(v("l_quantity"), "int32").alias("exact"),
        R("cast")(v("l_orderkey"), "int8").alias("wrapped"), R("assign")(v("l_linenumber"), "string").alias("txt"), R("assign")(v("t"), "?int32").alias("parsed"),
        rounded(casting.nan_to_na(v("x"))).alias("clean"),
    )


@query("""
SELECT l_orderkey, l_linenumber, array_to_string(range(0, CAST(l_linenumber AS BIGINT)), ',') AS up, array_to_string(range(10, l_linenumber, -3), ',') AS down,
  array_to_string([CAST(round(l_tax * i * 25) AS INT) for i in range(0, 5)], ',') AS steps FROM lineitem
""")
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    n = value(rows, "l_linenumber")
    steps = R("linspace")(0.0, value(rows, "l_tax"), 5)
    hundredths = Value(F.transform(steps.col, lambda x: F.round(x * 100).cast("int")), T.ArrayType(T.IntegerType()))
    return rows.select("l_orderkey", "l_linenumber", text(R("range")(n)).alias("up"), text(R("range")(n, start=10, step=-3)).alias("down"), text(hundredths).alias("steps"))


@query("SELECT o_orderkey, TRUE AS die, TRUE AS unit, TRUE AS re, TRUE AS apart FROM orders")
def random_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws are in range; those of a row are independent of each other."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    drawn = rows.select(
        "o_orderkey", generators.uniform(1, 6, "int32", seed=1).alias("die"), generators.uniform(seed=2).alias("unit"), generators.uniform(0, 1 + 1j, "complex64", seed=3).p("re").alias("re"),
        generators.uniform_array(3, seed=4).alias("three"),
    )
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < 1)
    return drawn.select("o_orderkey", F.col("die").between(1, 6).alias("die"), inside("unit").alias("unit"), inside("re").alias("re"), (F.size(F.array_distinct("three")) == 3).alias("apart"))


@query("""
SELECT 6 AS faces, TRUE AS even, TRUE AS middle, TRUE AS spread FROM orders HAVING count(*) > 0
""")
def random_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the whole table: every face comes, about as often as others; mean and spread of reals are those of a uniform law."""
    rows = table(spark, sf_dir, "orders").select(generators.uniform(1, 6, "int32", seed=1).alias("die"), generators.uniform(2.0, 4.0, seed=2).alias("x"))
    faces = rows.groupBy("die").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = faces.agg(F.count("*").alias("faces"), F.sum("n").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean, n = F.col("s") / F.col("n"), F.col("n")
    # six deviations of a share of a sixth, of a mean, and of a variance of a third
    off = F.greatest(F.col("hi") - n / 6, n / 6 - F.col("lo")) <= 6 * F.sqrt(n * 5 / 36) + 1
    return total.select(F.col("faces").cast("int").alias("faces"), off.alias("even"), (F.abs(mean - 3) < 6 * F.sqrt(1 / (3 * n))).alias("middle"), (F.abs(F.col("q") / n - mean * mean - 1 / 3) < 6 / F.sqrt(n)).alias("spread"))


@query("""
SELECT o_orderkey, '0,0,0' AS zeros, list_sum(list_transform(range(0, 4), lambda i: o_custkey))::BIGINT AS ones, 2147483647 AS top, -128 AS bottom, o_custkey IS NULL AS none, 4 AS cells FROM orders
""")
def constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = value(rows, "o_custkey")
    zeros, ones, none = R("zeros")((3,), "int32"), R("ones")((2, 2), "int64"), R("empty")((2, 2), "int32")
    like = generators.empty_like(none)
    missing = R("all")(R("is_na")(none)).col & R("all")(R("is_na")(like)).col
    return rows.select(
        "o_orderkey", text(zeros).alias("zeros"), R("sum")(ones * k).col.cast("long").alias("ones"), R("limits.max")("int32").alias("top"),
        R("limits.min")("int8").col.cast("int").alias("bottom"), F.when(missing, k.col.isNull()).alias("none"), F.size(arrays.flat(like).col).alias("cells"),
    )


@query(f"""
WITH {_VECTORS} SELECT l_orderkey, array_to_string([CAST(q[i + 2] - q[i] AS INT) for i in range(1, len(q) - 1)], ',') AS c FROM v WHERE len(q) >= 3
""")
def convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_vectors(spark, sf_dir).filter(F.size("q") >= 3)
    return rows.select("l_orderkey", text(casting.cast(convolve(value(rows, "q"), [1.0, 0.0, -1.0]), "int32")).alias("c"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)
SELECT vec_id, round(list_sum(a), 3) AS dc, round(list_sum([a[i] * cos(2 * pi() * 3 * (i - 1) / 64) for i in range(1, 65)]), 3) AS re3,
  round(-list_sum([a[i] * sin(2 * pi() * 3 * (i - 1) / 64) for i in range(1, 65)]), 3) AS im3, 33 AS half, round(a[6], 4) AS back FROM e
""")
def fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    v = casting.cast(value(rows, "embedding"), "float64")
    z, half = R("fft")(v), R("rfft")(v)
    back = R("ifft")(z)
    return rows.select(
        "vec_id", rounded(z[0].p("re"), 3).alias("dc"), rounded(z[3].p("re"), 3).alias("re3"), rounded(z[3].p("im"), 3).alias("im3"), F.size(half.col).alias("half"), rounded(back[5].p("re"), 4).alias("back")
    )


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS k FROM orders),
b AS (SELECT o_orderkey, k, list_transform(range(0, 8), lambda i: CAST((k >> CAST(8 * i AS INT)) & 255 AS INT)) AS x FROM o)
SELECT o_orderkey, array_to_string(list_transform(x, lambda y: format('{:02X}', y)), '') AS little,
  CAST(list_sum(list_transform(range(0, 8), lambda i: CAST(x[8 - i] AS HUGEINT) << CAST(8 * i AS INT))) - CASE WHEN x[1] > 127 THEN CAST(1 AS HUGEINT) << 64 ELSE 0 END AS BIGINT) AS swapped,
  k AS same, 8 AS n FROM b
""")
def bytes_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("k"))
    k = value(rows, "k")
    raw = R("serialize")(k)
    return rows.select("o_orderkey", F.hex(raw.col).alias("little"), R("byteswap")(k).alias("swapped"), binary.view(raw, "int64")[0].alias("same"), F.octet_length(raw.col).alias("n"))


@query(f"""
WITH {_VECTORS} SELECT l_orderkey, list_sort(q) = q AS ordered, q = q AS exact, list_sort(q) = q AS other FROM v
""")
def equality_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_vectors(spark, sf_dir)
    q = value(rows, "q")
    # another type is never exactly equal, whatever its values
    never = R("equals_exact")(q, R("cast")(q, "int64"))
    return rows.select(
        "l_orderkey", R("all_equal")(R("sort")(q), q).alias("ordered"), R("equals_exact")(q, q).alias("exact"), R("logical_or")(never, R("equals_exact")(R("sort")(q), q)).alias("other")
    )


@query("SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status, o_custkey + 1 AS second FROM orders")
def structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    s = arrays.pack(price=value(rows, "o_totalprice"), inner=arrays.pack(status=value(rows, "o_orderstatus")))
    t = arrays.as_tuple(value(rows, "o_orderkey"), value(rows, "o_custkey") + 1)
    return rows.select("o_orderkey", s.p("price").alias("price"), s.p("inner").p("status").alias("status"), t.p("_1").alias("second"))


@query("SELECT o_orderkey, round(o_totalprice / 2, 4) AS o_totalprice, o_custkey + 5 AS o_custkey FROM orders")
def compound_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    rows = R("compound_div")(R("compound_add")(rows, "o_custkey", 5), "o_totalprice", 2.0)
    return rows.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {_NA} AS q, l_tax FROM lineitem)
SELECT l_orderkey, l_linenumber, round(sqrt(trunc(l_tax * 100)), 6) AS composed, 7 AS fixed, q + l_tax AS strict, CAST(l_linenumber AS BIGINT) + 1 AS converted,
  CASE WHEN l_linenumber > 3 THEN 'many' ELSE 'few' END AS applied FROM t
""")
def combinators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    v = lambda c: value(rows, c)
    rooted = registry.compose(lambda x: x * 100.0, R("sqrt"), "int32")
    named = registry.apply(lambda n, limit: F.when(n > limit, "many").otherwise("few"), "string", "limit")
    strict = forward_na(lambda a, b: Value(F.coalesce(a.col, F.lit(0.0)) + b.col, T.DoubleType()))
    return rows.select(
        "l_orderkey", "l_linenumber", rounded(rooted(v("l_tax"))).alias("composed"), registry.constant(7)(v("q")).alias("fixed"), strict(v("q"), v("l_tax")).alias("strict"),
        registry.convert(["int64", "int64"], R("add"))(v("l_linenumber"), 1).alias("converted"), named(v("l_linenumber"), limit=3).alias("applied"),
    )


@query("SELECT o_orderkey, o_custkey + 1 AS a, round(-o_totalprice, 4) AS b, upper(o_orderstatus) AS c, 'two, one int64' AS d FROM orders")
def overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific signature decides; two that are equally specific are an error while the plan is built."""
    rows = table(spark, sf_dir, "orders")
    kind = registry.Overloads("kind").overload(["int64"], lambda v: v + 1).overload(["string"], lambda v: Value(F.upper(v.col), v.dtype)).overload(["Scalar"], lambda v: -v)
    pair = registry.Overloads("pair").overload(["int64", "Any"], registry.constant("two, one int64")).overload(["Any", "Any"], registry.constant("two"))
    key = R("cast")(value(rows, "o_custkey"), "int64")
    unclear = registry.Overloads("unclear").overload(["int64", "Any"], registry.constant(1)).overload(["Any", "int64"], registry.constant(2))
    try:
        unclear(key, key)
    except TypeError:
        return rows.select("o_orderkey", kind(key).alias("a"), rounded(kind(value(rows, "o_totalprice")), 4).alias("b"), kind(value(rows, "o_orderstatus")).alias("c"), pair(key, "x").alias("d"))
    raise AssertionError("an ambiguous call was resolved")


@query(f"""
WITH {_VECTORS} SELECT l_orderkey, array_to_string([x * 10 + i - 1 for x, i in q], ',') AS indexed, array_to_string([x + 100 for x in q], ',') AS spread FROM v
""")
def state_and_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_vectors(spark, sf_dir)
    q = value(rows, "q")
    indexed = state_elwise(lambda x, i: x * 10 + Value(i, T.IntegerType()))(q)
    return rows.select("l_orderkey", text(indexed).alias("indexed"), text(q + [100]).alias("spread"))


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(max(value), 6) AS hi FROM events GROUP BY event_type
""")
def reduce_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.max("value"), 6).alias("hi"))


@query("SELECT c_custkey, round(c_acctbal * 2, 4) AS doubled FROM customer")
def vectorised_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    twice = registry.apply(lambda x: x * 2, "float64", vectorised=True)
    return rows.select("c_custkey", rounded(twice(value(rows, "c_acctbal")), 4).alias("doubled"))


@query("SELECT n_nationkey, n_name, n_regionkey * 2 AS doubled, '[' || n_nationkey || ',\"' || n_name || '\"]' AS listed FROM nation")
def from_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the driver holds as an Arrow table (25 at every scale)."""
    held = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").toArrow()
    rows = sources.from_arrow(spark, held)
    pair = arrays.pack(k=value(rows, "n_nationkey"), n=value(rows, "n_name"))
    return rows.select("n_nationkey", "n_name", (value(rows, "n_regionkey") * 2).alias("doubled"), R("format_json")(pair, True).alias("listed"))


@query("SELECT 'PAR1' AS head, 'PAR1' AS tail, TRUE AS whole")
def files_as_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a table, mapped as bytes: Parquet has a mark at both ends."""
    files = sources.memmap(spark, f"{sf_dir.rstrip('/')}/region.parquet").filter(F.col("path").endswith(".parquet"))
    raw = value(files, "content")
    ends = files.select(
        F.substring(raw.col, 1, 4).cast("string").alias("head"), F.substring(raw.col, -4, 4).cast("string").alias("tail"),
        (F.octet_length(raw.col) == F.col("length")).alias("whole"),
    )
    return ends.distinct()


@query("""
SELECT n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '","none":null}' AS shown FROM nation
""")
def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    shown = arrays.pack(key=value(rows, "n_nationkey"), name=value(rows, "n_name"), none=R("assign_na")("int32"))
    return rows.select("n_nationkey", sources.show(shown.col).alias("shown"))


@query(f"""
WITH {_VECTORS} SELECT l_orderkey, list_sum(q)::BIGINT + len(q) AS called, len(q) AS n, array_to_string(q, ',') AS same, q[1] * 2 AS held FROM v
""")
def views_and_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by name; views, dereference, evaluation and copies give the value itself; a functor gets its column."""
    rows = _order_vectors(spark, sf_dir)
    q = value(rows, "q")
    same = R("copy")(R("to_host")(R("eval")(R("dereference")(R("view")(q)))))
    return rows.select(
        "l_orderkey", q.f("add", 1).f("sum").col.cast("long").alias("called"), registry.with_value(same, F.size).cast("long").alias("n"), text(same).alias("same"),
        registry.with_value(q.f("index", 0), lambda c: c * 2).alias("held"),
    )


@query("""
SELECT o_orderkey, hex(encode(o_orderstatus)) AS stored, CASE WHEN o_totalprice > 0 THEN o_totalprice END AS same, (o_totalprice > 0) AS sign, o_orderkey AS back FROM orders
""")
def storage_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored bytes of a string, and numbers read as others of their width: a positive double is a positive integer."""
    rows = table(spark, sf_dir, "orders")
    price = R("cast")(value(rows, "o_totalprice"), "float64")
    bits = R("replace_dtype")(price, "int64")
    key = R("cast")(value(rows, "o_orderkey"), "int64")
    return rows.select(
        "o_orderkey", F.hex(R("storage")(value(rows, "o_orderstatus")).col).alias("stored"), R("replace_dtype")(bits, "float64").alias("same"), (bits > 0).alias("sign"),
        R("replace_dtype")(R("replace_dtype")(key, "float64"), "int64").alias("back"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 4 THEN l_quantity END AS q, l_linenumber > 4 AS gone,
  CASE WHEN l_linenumber <= 4 THEN l_quantity + 1 END AS next FROM lineitem
""")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    some, na = value(rows, "l_quantity"), R("assign_na")("float64")
    q = Value(F.when((value(rows, "l_linenumber") > 4).col, na.col).otherwise(some.col), some.dtype)
    return rows.select("l_orderkey", "l_linenumber", q.alias("q"), R("is_na")(q).alias("gone"), (q + 1).alias("next"))


@query("SELECT '{k: ?int64}' AS shape, '{a: ?{b: ?var * ?float64}, s: ?string}' AS nested FROM events HAVING count(*) > 0")
def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes found in the texts of a whole table, plain and nested."""
    rows = table(spark, sf_dir, "events")
    nested = F.when(F.col("event_id") % 2 == 0, F.format_string('{"a":{"b":[%s,0.5]}}', F.col("event_id"))).otherwise(F.format_string('{"s":"%s"}', F.col("event_type")))
    found = jsonio.discover(rows, "props"), jsonio.discover(rows.select(nested.alias("j")), "j")
    return spark.range(1).select(F.lit(found[0]).alias("shape"), F.lit(found[1]).alias("nested"))


@query("""
SELECT event_id, event_id % 7 AS c, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 0.5 END AS d, user_id AS first, event_type AS last, 3 AS n,
  array_to_string(list_transform(range(0, event_id % 3), lambda i: i * 10), ',') AS many FROM events
""")
def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four levels of structs and lists, structs as objects and as lists, optional fields left out or null."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    d = F.when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise((F.col("event_id") * 0.5).cast("string"))
    many = F.array_join(F.transform(F.sequence(F.lit(0), F.col("event_id") % 3), lambda i: F.when(i < F.col("event_id") % 3, F.concat(F.lit('{"i":'), (i * 10).cast("string"), F.lit("}")))), ",")
    as_object = F.format_string('{"a":{"b":{"c":%s,"d":%s}},"l":[[%s,"x"],[0,"y"],[1,"%s"]],"m":[%s],"unknown":{"z":[1]}}', F.col("event_id") % 7, d, "user_id", "event_type", many)
    as_lists = F.format_string('[[[%s,%s]],[[%s,"x"],[0,"y"],[1,"%s"]],[%s]]', F.col("event_id") % 7, d, "user_id", "event_type", many)
    texts = rows.withColumn("j", F.when(F.col("event_id") % 2 == 0, as_object).otherwise(as_lists))
    texts = texts.select("event_id", R("parse_json")("{a: {b: {c: int64, d: ?float64}}, l: 3 * (int64, string), m: var * {i: int32}}", value(texts, "j")).alias("v"))
    v = value(texts, "v")
    inner, pairs = v.p("a").p("b"), v.p("l")
    return texts.select(
        "event_id", inner.p("c").alias("c"), inner.p("d").alias("d"), pairs[0].p("_0").alias("first"), pairs[2].p("_1").alias("last"), F.size(pairs.col).alias("n"),
        text(arrays.field_access(v.p("m"), "i")).alias("many"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity * 3 AS scaled, l_quantity + 7 AS shifted, CAST(trunc(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem")
def functors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class built with its state and called with columns, a method of an object, and a view of a column through a function."""

    class Times:
        def __init__(self, by: float):
            self.by = by

        def __call__(self, x: Column) -> Column:
            return x * self.by

        def plus(self, x: Column) -> Column:
            return x + self.by

    rows = table(spark, sf_dir, "lineitem")
    quantity = value(rows, "l_quantity")
    cents = registry.adapt("int64", lambda v: v * 100.0)
    return rows.select(
        "l_orderkey", "l_linenumber", registry.apply_class(Times, "float64")(by=3.0)(quantity).alias("scaled"),
        registry.apply_method(Times(7.0), "plus", "float64")(quantity).alias("shifted"), cents(value(rows, "l_extendedprice")).alias("cents"),
    )


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.15 THEN NULL ELSE CAST(x AS DOUBLE) END) AS a,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings)
SELECT vec_id, round(list_sum(a), 6) AS s, round(list_avg(a), 6) AS m, round(list_min(a), 6) AS lo, round(list_max(a), 6) AS hi, round(list_stddev_samp(a), 5) AS sd,
  round(list_var_samp(a), 5) AS vr, len(list_filter(a, lambda x: x IS NULL)) > 0 AS broken, round(list_stddev_samp(w), 5) AS all_sd,
  round(list_product(list_transform(a[1:8], lambda x: x + 1)), 6) AS p FROM e
""")
def nan_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN does not exist in the nan forms, and spoils the others."""
    rows = table(spark, sf_dir, "embeddings")
    whole = casting.cast(value(rows, "embedding"), "float64")
    a = elwise(lambda x: Value(F.when(x.col > F.lit(0.15).cast("float").cast("double"), F.lit(float("nan"))).otherwise(x.col), T.DoubleType()))(whole)
    each = {"s": ("nansum", 6), "m": ("nanmean", 6), "lo": ("nanmin", 6), "hi": ("nanmax", 6), "sd": ("nanstd", 5), "vr": ("nanvar", 5)}
    return rows.select(
        "vec_id", *[rounded(R(f)(a), n).alias(c) for c, (f, n) in each.items()], F.isnan(R("std")(a).col).alias("broken"), rounded(R("std")(whole), 5).alias("all_sd"),
        rounded(R("nanproduct")(a[0:8] + 1.0)).alias("p"),
    )


@query("""
WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), k AS (SELECT label, CASE WHEN x > 0.15 THEN NULL ELSE x END AS x FROM e)
SELECT label, round(sum(x), 4) AS s, round(avg(x), 6) AS m, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(stddev_samp(x), 5) AS sd FROM k GROUP BY label
""")
def nan_reductions_over_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrays.iterate(table(spark, sf_dir, "embeddings"), "embedding", ["label"]).withColumn("value", F.col("value").cast("double"))
    x = F.when(F.col("value") > F.lit(0.15).cast("float").cast("double"), F.lit(float("nan"))).otherwise(F.col("value"))
    each = {"s": "nansum", "m": "nanmean", "lo": "nanmin", "hi": "nanmax", "sd": "nanstd"}
    return rows.groupBy("label").agg(*[F.round(reduce._AGGREGATES[h](x, T.DoubleType()), {"s": 4, "sd": 5}.get(n, 6)).alias(n) for n, h in each.items()])


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(x * 100) AS INT)) AS a FROM embeddings),
p AS (SELECT vec_id, a, i, j FROM e, range(0, 6) AS r(i), range(0, 6) AS c(j)),
s AS (SELECT vec_id, i, j, a[8 * i + j + 1] + a[8 * i + j + 2] + a[8 * i + j + 3] + a[8 * i + j + 9] + a[8 * i + j + 10] + a[8 * i + j + 11] + a[8 * i + j + 17]
  + a[8 * i + j + 18] + a[8 * i + j + 19] AS x FROM p)
SELECT vec_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY i, j) AS inside, 28 AS outside,
  (SELECT array_to_string(list_transform(range(0, 27), lambda k: CAST(list_sum([a[16 * (k // 9) + 4 * (k // 3 % 3) + k % 3 + 1 + o] for o in [0, 1, 4, 5, 16, 17, 20, 21]]) AS INT)), ',')
   FROM e AS f WHERE f.vec_id = s.vec_id) AS cubes
FROM s GROUP BY vec_id
""")
def neighborhood_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 3 x 3 over a matrix of 8 x 8, and of 2 x 2 x 2 over a cube."""
    rows = table(spark, sf_dir, "embeddings")
    a = casting.cast(value(rows, "embedding") * 100, "int32")
    window = neighborhood(R("sum"))
    sums = arrays.flat(window(R("reshape")(a, (8, 8)), (3, 3)))
    cubes = arrays.flat(window(R("reshape")(a, (4, 4, 4)), (2, 2, 2)))
    known = lambda v: Value(F.filter(v.col, lambda x: x.isNotNull()), v.dtype)
    return rows.select("vec_id", text(known(sums)).alias("inside"), (F.size(sums.col) - F.size(known(sums).col)).alias("outside"), text(known(cubes)).alias("cubes"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), c AS (SELECT unnest(range(0, 64)) AS k),
t AS (SELECT vec_id, sum(a[k + 1]) AS dc, sum(a[k + 1] * cos(2 * pi() * (2 * (k // 8) + 3 * (k % 8)) / 8)) AS re, -sum(a[k + 1] * sin(2 * pi() * (2 * (k // 8) + 3 * (k % 8)) / 8)) AS im
  FROM e, c GROUP BY vec_id)
SELECT vec_id, round(dc, 3) AS dc, round(re, 3) AS re, round(im, 3) AS im, 64 AS n FROM t
""")
def fourier_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    z = R("fft2")(casting.cast(arrays.reshape(value(rows, "embedding"), (8, 8)), "float64"))
    return rows.select("vec_id", rounded(z[0, 0].p("re"), 3).alias("dc"), rounded(z[2, 3].p("re"), 3).alias("re"), rounded(z[2, 3].p("im"), 3).alias("im"), F.size(arrays.flat(z).col).alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
