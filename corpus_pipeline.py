"""A training corpus from raw documents: toxicity, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to the shared folder
and reads them again as the next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import bpe, lines, minhash, mixing, toxicity
from sievewright.llm.common import release, stash, table
from sievewright.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labels outside the held-out fold, predicts as toxic go."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    # numbered names, so that no column of the documents meets one of the result
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    scored = toxicity.toxicity(docs.withColumnsRenamed(names), model, names["text"], names["doc_id"], spans=False, keep=tuple(names.values()))
    return scored.where("predicted = 0").select(*[F.col(n).alias(c) for c, n in names.items()])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; every document stays, if only with what is left of its text."""
    cleaned = lines.clean(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cleaned


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id."""
    return minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of their decoding."""
    return bpe.bpe(docs, vocabulary_path(), ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("minhash_dedup", dedup_documents), ("source_mixing", mix_sources), ("bpe", encode)]

#: Edit distance, sampling and BPE have no SQL form here; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
