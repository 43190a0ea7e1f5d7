"""The corpus pipeline: raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rewardlake.llm import mix, pack, secrets, simhash, toxicity
from rewardlake.llm.common import cut_lineage, fresh, read_table, staged

#: texts that score at least this are toxic
TOXIC = 0.3
#: words of a shingle and differing bits of near duplicates
WORDS, BITS = 3, 3
#: word cache of a packing task; the workers of a long session have little memory left
CACHE = 80_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC`` (null texts have the
    base score and stay)."""
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_score(model, F.col("text")) < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id
    (rows without an id come last), of its smallest fingerprint and text.
    Groups are of fingerprints, so unlike texts that share an id, or have
    none, are judged each on its own."""
    prints = cut_lineage(docs.select("doc_id", simhash.fingerprint(F.col("text"), WORDS).alias("fingerprint"))
                         .groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")))
    groups = simhash.fingerprint_components(prints.withColumn("node", F.col("fingerprint")), BITS, "node")
    first = groups.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("fingerprint").alias("fp"))).alias("d"))
    key, wanted, nth = fresh(docs, "key", "wanted", "nth")
    first = first.select(F.struct(F.col("d.id").alias("id"), F.col("d.fp").alias("fp")).alias(wanted))
    # a struct as key: null ids meet like any other; repeated rows go before the shuffle, which serves window and join
    held = docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), simhash.fingerprint(F.col("text"), WORDS).alias("fp")))
    rest = [F.col(c) for c in docs.columns if c != "text"]
    one = held.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy("text", F.xxhash64(*rest)))).where(F.col(nth) == 1)
    return one.join(first, F.col(key) == F.col(wanted)).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mix.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return pack.pack_documents(docs, cache=CACHE)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: the classifier, the battery, the draws and the tokenizer are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
