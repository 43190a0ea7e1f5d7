"""The pipeline's stages, on odd rows, empty tables and a whole small table."""
from __future__ import annotations

import corpus_pipeline as C
from pyspark.sql import functions as F

from rewardlake.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in C.STAGES:
            out = staged(stage(spark, docs, SF), "t")
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() or docs is no_docs or name == "mixing"
    kept = C.drop_near_copies(spark, odd_docs, SF).collect()
    # the id 8 stands for two unlike texts, one row without an id is empty like row 2
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6, 8, 8, 9, 10]
    assert [r.text for r in kept if r.doc_id is None] == ["no id at all"]
    again = C.drop_near_copies(spark, odd_docs.unionByName(odd_docs).repartition(5), SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, kept))


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = staged(C.drop_toxic(spark, docs, SF), "t")
    kept = staged(C.drop_near_copies(spark, clean, SF), "t")
    assert kept.groupBy("text").count().where("count > 1").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.where("toxic = 0"), "doc_id")
    assert clean.join(good.select("doc_id"), "doc_id").count() >= 0.97 * good.count()
    masked = staged(C.mask_secrets(spark, kept, SF), "t")
    assert masked.count() == kept.count() and masked.where(F.col("text").rlike("[0-9a-f]{32}")).count() == 0
    out = C.run(spark, SF)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert per.where("n <> m or n > 2048").count() == 0 and out.count() > 0
