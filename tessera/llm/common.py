"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five control characters from tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; without that name a cluster
    gets an error, as its machines don't see each other's folders. Only where
    driver and executors are one process, as in local tests, a folder of this
    machine is used instead, and removed at exit.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_dir, "local"):
        shared_dir.local = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, shared_dir.local, ignore_errors=True)
    return f"file://{shared_dir.local}"


#: Tables in the shared folder that are not discarded yet, their sessions, and the threads that wrote them.
_TABLES: dict[str, tuple[SparkSession, int]] = {}

#: Narrow rows that one task writes at least, where their number is known.
ROWS_A_TASK = 250_000


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    ``rows``: a bound on its number of (narrow) rows, if that is known: then
    there is a task for each ``ROWS_A_TASK`` of them, and at most one for each
    shuffle partition, whose number is meant for texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_TASK + 1))
    if not _TABLES:
        atexit.register(_discard_at_exit)
    _TABLES[path] = spark, threading.get_ident()
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._shared_path = path
    return back


def _delete(path: str) -> None:
    spark, _ = _TABLES.pop(path, (None, 0))
    if spark is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by :func:`materialise` when no plan needs them any more."""
    for df in tables:
        if hasattr(df, "_shared_path"):
            _delete(df._shared_path)


def written() -> set[str]:
    """Paths of the tables that this thread wrote and that are in the shared folder now."""
    return {path for path, (_, owner) in list(_TABLES.items()) if owner == threading.get_ident()}


def discard_all(but: set[str] = frozenset()) -> None:
    """Delete what :func:`materialise` wrote in this thread, but for some paths; results that read those tables must be written before."""
    for path in written() - set(but):
        _delete(path)


def _discard_at_exit() -> None:
    """Tables that a query's result reads go when the driver ends."""
    for path in list(_TABLES):
        with suppress(Exception):  # the session may have ended, and its folder with it
            _delete(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn a label from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that none of the columns has."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def cells(column: pa.Array, step: int = 256) -> Iterator:
    """Python values of an Arrow column, a few rows at a time: a batch of long texts is never held twice."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the Arrow batches of texts by bytes, in the JVM and in Python; a lower bound of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864b")
    if now.rstrip("b").isdigit() and int(now.rstrip("b")) > most:
        spark.conf.set(key, str(most))
