"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract that speaks of words: a run of characters other than blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Removes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a folder of its own; a cluster is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = sc.getCheckpointDir()
    return found


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts the lineage and survives the loss of executors.

    The shuffle files of the write go when it has ended, where this Spark knows how to. ``release`` removes the table.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes stashed tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if not hasattr(df, "_stashed"):
            continue
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stashed)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc32_of_id(doc_id: Column) -> Column:
    """CRC-32 of the id as decimal text; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))


def sliced(batch: pa.RecordBatch, text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch into runs of rows of about ``most`` characters; a longer text is a run of its own."""
    size, start = 0, 0
    for i, value in enumerate(batch.column(text)):
        n = len(value.as_buffer() or b"") if value.is_valid else 0
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            size, start = 0, i
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


_KEPT: dict = {}


def kept_in_worker(key: str | None = None, make=None):
    """What this Python worker keeps under a key from task to task; anything kept under another key goes. Tasks that keep nothing call it without a key, so that they have a worker's memory for themselves."""
    if key is None or key not in _KEPT:
        _KEPT.clear()
    if key is not None and key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT.get(key)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once a session, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_sievewright_shipped", False):
        return spark
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="spark-", dir=None)) / f"{root.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._sievewright_shipped = True
    return spark
