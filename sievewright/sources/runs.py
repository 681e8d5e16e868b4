"""A table of last writes per key that streams write: sorted runs, a manifest that names those that count, and compaction.

A table is a folder of runs (Parquet, one row a key, dealt to buckets by the key's hash) and of manifests. A manifest is
written beside its predecessor and takes its number by one rename, so a reader sees one version and a writer that was
overtaken fails. It names the last batch merged, so that a batch that is replayed changes nothing. Runs of one level
are merged into one of the next when ``FAN`` of them have come together: a table of n batches has at most FAN - 1 runs
on each of log(n) levels, and a row is rewritten once a level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Runs of a level that become one of the next, buckets of a run, and manifests whose runs are kept for readers.
FAN, BUCKETS, KEPT = 4, 8, 3


@dataclass
class Manifest:
    version: int = 0
    batch: int = -1
    runs: list[dict] = field(default_factory=list)


class Runs:
    """A table of last writes: ``key`` columns, ``order`` columns that tell the later of two writes, and values."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], order: list[str], buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets, self.fan = spark, path, schema, key, order, buckets, fan
        self.fs = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    # --- manifests ---

    def versions(self) -> list[int]:
        folder = self._path(self.path, "manifest")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The given version, or the latest; an empty one before the first write."""
        found = self.versions()
        if not found:
            return Manifest()
        at = self._path(self.path, "manifest", f"{found[-1] if version is None else version:012}.json")
        stream = self.fs.open(at)
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _swap(self, new: Manifest) -> None:
        """Makes a manifest the latest by one rename; another writer that took its number first is an error."""
        beside = self._path(self.path, "manifest", f".{uuid.uuid4().hex}")
        out = self.fs.create(beside)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        at = self._path(self.path, "manifest", f"{new.version:012}.json")
        if self.fs.exists(at) or not self.fs.rename(beside, at):
            self.fs.delete(beside, False)
            raise RuntimeError(f"version {new.version} of {self.path} was written by another")

    # --- reading ---

    def read(self, version: int | None = None) -> DataFrame:
        """The last write of every key as of a version; one version, whatever is written meanwhile."""
        return self._last(self._rows(self.manifest(version).runs))

    def _rows(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/runs/{r['name']}" for r in runs])

    def _last(self, rows: DataFrame) -> DataFrame:
        value = [c for c in self.schema.names if c not in self.key]
        got = rows.groupBy(*self.key).agg(F.max_by(F.struct(*value), F.struct(*self.order)).alias("x"))
        return got.select(*self.key, "x.*").select(*self.schema.names)

    # --- writing ---

    def _write(self, rows: DataFrame, level: int) -> dict:
        name = f"{level}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows.repartition(self.buckets, bucket).sortWithinPartitions(*self.key).write.parquet(f"{self.path}/runs/{name}")
        return {"name": name, "level": level}

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Adds the last write of each key of a batch as a run; False if a batch of this number or a later one is there. Runs that have come together are merged with it, before one manifest tells of both."""
        now = self.manifest()
        if number <= now.batch:
            return False
        runs = [*now.runs, self._write(self._last(batch.select(*self.schema.names)), 0)]
        level = 0
        while len(same := [r for r in runs if r["level"] == level]) >= self.fan:
            runs = [r for r in runs if r["level"] != level] + [self._write(self._last(self._rows(same)), level + 1)]
            level += 1
        self._swap(Manifest(now.version + 1, number, runs))
        self._clear()
        return True

    def _clear(self) -> None:
        """Removes manifests but the last ``KEPT``, and runs that none of those names: what a reader of an older version may still read stays."""
        versions = self.versions()
        named = {r["name"] for v in versions[-KEPT:] for r in self.manifest(v).runs}
        for v in versions[:-KEPT]:
            self.fs.delete(self._path(self.path, "manifest", f"{v:012}.json"), False)
        for f in self.fs.listStatus(self._path(self.path, "runs")):
            if f.getPath().getName() not in named:
                self.fs.delete(f.getPath(), True)


def merged_stream(stream: DataFrame, table: Runs, checkpoint: str, prepare: Callable[[DataFrame, Runs], DataFrame] | None = None):
    """Writes a stream into a table of last writes, each batch once however often it is replayed.

    ``prepare`` makes the batch's writes from the batch and the table as it stands; without it the batch's rows are the
    writes. Returns the query; it takes what is there and ends.
    """

    def one(batch: DataFrame, number: int) -> None:
        if number > table.manifest().batch:
            rows = batch.persist()
            try:
                table.merge(prepare(rows, table) if prepare else rows, number)
            finally:
                rows.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
