"""Line deduplication against a plain version and its SQL: repeated and null ids, hot lines, and a plan that streams."""

import contextlib
import hashlib
import io
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup

SCHEMA = "doc_id long, text string"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least=40, enough=5):
    """Rows with a null id are one document below all others."""
    order = lambda d: -(2**63) if d is None else d
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(h := holders.get(key(x), ())) < enough or order(d) == max(h)]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def table():
    rng = random.Random(4)
    common = [f"Common line number {k} that many of the documents hold, long enough" for k in range(12)]
    rows = []
    for k in range(60):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"line {rng.random()} of a document, found nowhere else at all" for _ in range(rng.randint(1, 90))]
        lines = [x.upper() if rng.random() < 0.2 else f"  {x}\t" if rng.random() < 0.2 else x for x in lines]
        rows.append((k // 2 if k < 30 else k, "\n".join([*lines, *["", "short"] * rng.randint(0, 2)])))
    rows += [(None, "\n".join([common[0], "UNIQUE line of the first row without an id, long enough"])), (None, "\n".join(["another UNIQUE line without an id that is long enough", common[0], common[1]]))]
    rows += [(100, f"{common[k]}\nend") for k in range(3)]  # the largest id, in three rows
    rows += [rows[0], rows[0], (None, None), (7, None), (8, ""), (9, "\n\n"), (10, "x" * 200_000 + "\n" + common[3]), (11, "Ünïcode líne with ÀÉ and A-Z letters that is long enough\n" * 3)]
    return rows


@pytest.mark.parametrize("few", [1000, 3])
def test_bitmaps_match_the_plain_version(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rows = table()
    clash = {c: F.lit(c) for c in ("doc", "k1", "bits", "n", "left", "whole", "n_lines", "kept_text", "h1")}
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(clash)
    assert sorted(map(tuple, line_dedup.op9_line_bitmaps(docs).collect()), key=repr) == brute(rows)
    applied = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert [c for c in applied.columns if c not in docs.columns] == ["n_dropped"] and applied.filter("bits <> 'bits' or left <> 'left'").count() == 0
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in applied.collect()), key=repr) == brute(rows)


def test_unique_lines_of_rows_with_one_id_stay(spark):
    common = "A line that all of the documents of this small table hold."
    rows = [(k, f"{common}\nfirst {k}") for k in range(6)] + [(0, "UNIQUE first line, found nowhere else in the whole table\nsecond")]
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.op9_line_bitmaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(k, 2, 1) for k in range(5)} | {(5, 2, 0), (0, 2, 0)}


def test_sql_says_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = table()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    assert sorted(con.execute(line_dedup.OP9_SQL).fetchall(), key=repr) == brute(rows)


def test_bitmaps_hold_what_stays(spark):
    common = "A line that all of the documents of this small table hold."
    rows = [(k, "\n".join(common if i in (0, 63, 64, 130) else f"{k} {i}" for i in range(200))) for k in range(5)]
    maps = {r["doc"]: {w["word"]: w["bits"] % 2**64 for w in r["kept"]} for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    every = 2**64 - 1
    assert maps == {k: {0: every ^ 1 ^ 1 << 63, 1: every ^ 1, 2: every ^ 1 << 2} for k in range(4)}


def test_plan_streams_sorted_ranges(spark):
    """Lines cross the network once, by range; the sort by document and position feeds the windows and is not removed."""
    lines = line_dedup.hashed_lines(spark.createDataFrame(table(), SCHEMA), 40)
    hot = line_dedup.hot_lines(lines, 4)
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        line_dedup.dropped_lines(lines, hot, 4, 5).explain("simple")
    plan = said.getvalue()
    assert plan.count("rangepartitioning(") == 1 and "hashpartitioning" not in plan
    assert len(re.findall(r"Window \[", plan)) >= 2
    assert re.search(r"Sort \[h1#\d+L ASC NULLS FIRST, h2#\d+L ASC NULLS FIRST, place#\d+L? ASC NULLS FIRST, doc#\d+L DESC NULLS LAST, pos#\d+ ASC NULLS FIRST\], false", plan)
    assert plan.count("Sort [") == 1


def test_empty_table(spark):
    assert line_dedup.op9_line_bitmaps(spark.createDataFrame([], SCHEMA)).count() == 0
