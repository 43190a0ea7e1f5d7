"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes
of a document's shingles.  Sketches merge (the k smallest of the union is
the sketch of the union), and two of them estimate resemblance, containment
and distinct shingle counts.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quantile_bounds, range_chunk, shuffle_parts, words_of

WORDS, K = 5, 128


def shingle_hashes(hashes: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of ``words`` neighbours in an array of word hashes
    (fewer words: one shingle of them all; none: empty).  ``hashes`` must be
    a column, not an expression: it is looked up once per shingle."""
    many = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (words - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, words)]))
    return F.when(F.size(hashes) >= words, many).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))) \
            .otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS, k: int = K) -> DataFrame:
    """Add the sketch of column ``text`` (null: empty) as ``out``.

    Defined cases: null, empty and white-space texts have the empty sketch;
    texts of fewer than ``words`` words have one shingle; equal texts have
    equal sketches; repeated shingles count once.
    """
    tmp = f"_words_{out}"
    d = df.withColumn(tmp, F.transform(words_of(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))
    d = d.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.col(tmp), words))), 1, k))
    return d.drop(tmp)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """Sketch of each group's union.  Map tasks pass on at most ``k`` hashes a
    group, so a hot group costs one short list per task."""
    h = df.select(*by, F.explode(sketch).alias("_h")).distinct()
    ranked = h.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's sketch that both
    hold.  Two empty sketches are alike (1)."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b))).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else
    ``(k - 1) / u_k`` with u_k the k-th hash scaled to (0, 1)."""
    u = (F.element_at(s, k).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / u)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds (an empty a: 1)."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def as_text(s: Column) -> Column:
    """Printable form: 16 hex digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, n_chunks: int | None = None) -> DataFrame:
    """``doc_id, text, _chunk, _ghost``: the documents dealt by id range,
    plus in each range a copy (``_ghost``) of the row that follows its last
    one in descending id order -- the first row of the range below, or the
    very first row for the lowest range.  A window per range then finds each
    row's follower without a global sort.

    Order: doc_id descending (null last), then text ascending (null first).
    Two number-per-range aggregates reach the driver.
    """
    spark = docs.sparkSession
    n = n_chunks or 2 * shuffle_parts(spark)
    d = docs.select("doc_id", "text")
    bounds = quantile_bounds(d, "doc_id", n)
    d = d.withColumn("_chunk", range_chunk(F.col("doc_id"), bounds))
    tops = sorted(((r["_chunk"], r["top"]) for r in d.groupBy("_chunk").agg(F.max("doc_id").alias("top")).collect()),
                  reverse=True)
    rows = d.withColumn("_ghost", F.lit(0))
    if not tops:
        return rows
    kind = dict(d.dtypes)["doc_id"]
    edges = [F.struct(F.lit(c).alias("_chunk"), F.lit(tops[(i + 1) % len(tops)][1]).cast(kind).alias("_id"))
             for i, (c, _) in enumerate(tops)]
    table = spark.range(1).select(F.inline(F.array(*edges)))
    ghosts = d.drop("_chunk").join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("_id"))) \
              .select("doc_id", "text", "_chunk", F.lit(1).alias("_ghost"))
    return rows.unionByName(ghosts)


def fingerprint_documents(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """Sketch of every text, of the text that follows it in descending id
    order, and of its edited text: the last ``floor(n_chars / 2)`` code
    points replaced by the first as many (or all) of the follower's.

    Columns: ``doc_id, n_chars, edited, sketch, edited_sketch, next_sketch``.
    Defined cases: null text counts as empty; a single row follows itself;
    rows that share an id follow one another in text order; null ids come
    last; an empty table gives an empty result.
    """
    d = with_next(docs).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.repartition(shuffle_parts(docs.sparkSession), "_chunk")
    d = with_sketch(d, "text", "sketch", words, k)
    w = Window.partitionBy("_chunk").orderBy("_ghost", F.desc_nulls_last("doc_id"), "text")
    d = d.withColumn("_next", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w))
    d = d.where(F.col("_ghost") == 0).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.expr("cast(n_chars div 2 as int)")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
                                        F.substring(F.col("_next"), F.lit(1), half)))
    d = with_sketch(d.drop("_next"), "edited", "edited_sketch", words, k)
    return d.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")
