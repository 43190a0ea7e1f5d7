"""The registered queries of the corpus operators (``opN_<name>``) with their
DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bitslice, caps, licenses, mix, negatives, pack, quality, secrets, shards, simhash, sketch, toxicity, whitening,
)
from .common import read_table
from .labelled import held_out

SHARDS = 8


TOXIC, GOOD = 0.3, 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return _judged(toxicity.score_toxicity(docs, model), TOXIC)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return _judged(quality.score_quality(docs, chain), GOOD)


def _judged(d: DataFrame, least: float) -> DataFrame:
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= least).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents: patterns and randomness battery."""
    d = secrets.scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < secrets.KINDS.index("random"))
    counts = [F.size(_of_kind(i)).cast("bigint").alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)]
    return d.select("doc_id", *counts, F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"),
                    secrets.spans_text(F.col("spans")).alias("spans"), "base_judged", "base_random")


def _of_kind(kind: int):
    return F.filter("spans", lambda s: s["kind"] == kind)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of all texts, their edited texts and likeness."""
    d = sketch.fingerprint_documents(read_table(spark, sf_dir, "documents"))
    s, e, n = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    sketch.as_text(s).alias("fingerprint"), sketch.as_text(e).alias("edited_fingerprint"),
                    sketch.resemblance(s, e).alias("near_edited"), sketch.resemblance(s, n).alias("near_next"),
                    sketch.containment(s, e).alias("contained_in_edited"),
                    sketch.distinct_shingles(s).alias("distinct_shingles"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendezvous shards 0 to 7 of all documents, and under a ninth shard."""
    d = shards.shard_documents(read_table(spark, sf_dir, "documents"), (1.0,) * SHARDS)
    return d.withColumn("law", F.lit("key"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places, labels and score of all documents."""
    d = licenses.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["start"])
    return d.select("doc_id", "n_words", F.size(starts).cast("bigint").alias("n_base"),
                    F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                    licenses.labels_of(F.col("places"), True).alias("base_labels"),
                    licenses.labels_of(F.col("places"), False).alias("labels"), "score")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document, with its source's target."""
    d = mix.mix_plan(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept representatives of all embeddings."""
    return caps.near_vectors(read_table(spark, sf_dir, "embeddings"), 0.93)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    d = simhash.simhash_components(read_table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into windows of 2048 tokens."""
    d = pack.pack_documents(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh has its label moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0,
                                    positives=5, negatives=5, low=80, scale=256, label=moved)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows by integer inner product for every hundredth embedding."""
    return bitslice.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all embeddings."""
    d = whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=4, scale=256)
    return d.withColumn("deviation", F.col("deviation").cast("bigint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality": op4_quality,
    "op5_shards": op5_shards,
    "op6_licenses": op6_licenses,
    "op7_mix": op7_mix,
    "op8_near_vectors": op8_near_vectors,
    "op9_simhash": op9_simhash,
    "op10_pack": op10_pack,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_top_k": op12_top_k,
    "op13_whitening": op13_whitening,
}


def _whole_vectors(scale: int, extra: str) -> str:
    """Rows of ``embeddings`` with a whole vector, scaled and rounded down."""
    return f"""SELECT vec_id{extra}, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"""


_DOT = "CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda t: t[1] * t[2])) AS BIGINT)"

ORACLES: dict[str, str] = {
    "op11_hard_negatives": f"""
    WITH v AS ({_whole_vectors(256, ", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")} AND label IS NOT NULL),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, {_DOT} AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
           n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
         AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
    QUALIFY rank <= 5""",
    "op12_top_k": f"""
    WITH v AS ({_whole_vectors(1024, "")}),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT} AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10""",
}
