"""The pipeline stage by stage, each on what its predecessor kept."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from sievewright.llm import common, minhash, quality
from tests.llm.test_operators import WORD

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "source_mixing", "bpe"]
    kept = []
    for name, stage in P.STAGES:
        out = common.stash(stage(spark, docs, DATA), f"t-{name}")
        if name != "bpe":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept.append(out.count())
        if name == "line_dedup":
            lines = [x for r in out.collect() for x in r.text.split("\n") if WORD.search(x)]
            assert len(lines) == len(set(lines)) and out.count() == docs.count()
            assert out.where("n_chars <> length(text)").count() == 0
        if name == "minhash_dedup":
            classes = minhash.near_duplicates(docs)
            assert out.count() == classes.select("class_id").distinct().count()
        docs = out if name != "bpe" else docs
    assert kept[0] >= kept[2] and kept[3] == kept[4]
    assert P.run(spark, DATA).count() == kept[-1]


def test_stages_on_an_empty_table(spark):
    docs = common.table(spark, DATA, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_columns_that_clash(spark):
    docs = common.table(spark, DATA, "documents").withColumns({"row": F.lit("r"), "id": F.lit(1), "predicted": F.lit("p"), "score": F.lit("s"), "dropped": F.lit("d"), "copies": F.lit("c"), "kept": F.lit("k"), "a": F.lit("a")})
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() > 0, name
    assert P.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_measures_are_plain_numpy():
    got = quality.measure(["a b c", ""])
    assert got["n_words"].tolist() == [3, 0] and np.isfinite(got["cover_5"]).all()
