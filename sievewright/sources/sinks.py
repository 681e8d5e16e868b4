"""Writers and reload rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from .runs import Runs, merged_stream


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the place that all machines share, ``spark.checkpoint.dir``; a local session that names none gets a temporary one, a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_index(df: DataFrame, path: str, by: str = "shelf") -> None:
    """Overwrites only the partitions that the frame holds; rows are clustered by partition before, so that each is few files, and a large partition is cut into tasks of the advisory size."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


KV = StructType().add("key", "string").add("value", "double").add("expires_at", "timestamp").add("used_at", "timestamp").add("seq", "long")


def kv_table(spark: SparkSession, path: str, schema: StructType = KV) -> Runs:
    """The table of last writes that ``write_kv_snapshot`` fills: the latest ``used_at``, then ``seq``, of a key counts."""
    return Runs(spark, path, schema, ["key"], ["used_at", "seq"])


def write_kv_snapshot(stream: DataFrame, path: str, checkpoint: str):
    """A stream of writes (``key``, values, ``used_at``, ``seq``) as a table of last writes per key. Each batch is a run, runs are merged as they come together, replayed batches change nothing."""
    return merged_stream(stream, kv_table(stream.sparkSession, path, stream.schema), checkpoint)


def read_kv_snapshot(spark: SparkSession, path: str, schema: StructType = KV) -> DataFrame:
    """The last write of every key, as of the latest manifest."""
    return kv_table(spark, path, schema).read()


def links_to_feed(links: DataFrame) -> DataFrame:
    """Feed rows: the title with a tag of what is known, size in bytes, one seeder."""
    tag = F.concat_ws(" ", F.array_compact(F.array(*[F.nullif(c, F.lit("")) for c in ("quality", "source", "audio", "size_text")])))
    return links.select("link_id", F.concat(F.col("title"), F.when(tag != "", F.concat(F.lit(" ["), tag, F.lit("]"))).otherwise("")).alias("title"), "size", F.lit(1).cast("long").alias("seeders"))


def load_with_quota(kv: DataFrame, now: str, grace_s: int, versions: dict[str, str], quotas: dict[str, int], most: int) -> DataFrame:
    """What of a key-value table is loaded again: not expired beyond the grace, of the current version of its namespace, the last to expire within quotas."""
    t = F.lit(now).cast("timestamp").cast("double")
    live = kv.where(F.col("expires_at").cast("double") + grace_s > t)
    for ns, v in versions.items():
        live = live.where((F.col("namespace") != ns) | F.col("key").startswith(f"{ns}:{v}:"))
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv_ in quotas.items() for x in kv_]), F.col("namespace")), F.lit(most))
    own = live.withColumn("rn", F.row_number().over(W.partitionBy("namespace").orderBy(F.col("expires_at").desc(), "key"))).where(F.col("rn") <= quota)
    return own.orderBy(F.col("expires_at").desc(), "key").limit(most).drop("rn")
