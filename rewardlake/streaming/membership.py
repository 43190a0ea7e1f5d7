"""Membership of ids in a growing set, with reads that follow the question
and not the set (SURVEY J1, C1).

The ids lie in hash buckets.  Every bucket has a Bloom filter whose words are
rows ``(word, bits)``: an id sets a few bits of one word, filters of one size
are merged by OR-ing words, and a question is an equi-join on (bucket, word).
``seen`` reads the filters of the buckets that its ids fall into, opens only
the buckets where a filter hits, and compares ids there exactly.  ``add``
writes an epoch's ids and the filters it changed; the heads file that names
them comes last, by a rename, so an epoch that failed has changed nothing
and is added again.

``<root>/ids/bucket=B/epoch=E/``, ``<root>/filters/epoch=E/bucket=B/``,
``<root>/heads/<E + 1>.json`` (for every bucket: ids, words, epoch of its
filter; an index may begin with epoch -1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.shared import filesystem, get_json, names, put_whole

#: hash buckets, filter bits for an id, bits that an id sets in its word
BUCKETS, BITS, PROBES = 256, 16, 4
#: heads files that are kept
HEADS = 4


def _words(ids: int) -> int:
    """Words of a filter for so many ids: a power of four, so that a filter
    is built anew rarely."""
    words = 1
    while words * 64 < ids * BITS:
        words *= 4
    return words


def _mask(id_col: Column) -> Column:
    h = F.xxhash64(id_col, F.lit(2))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(PROBES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


class IdIndex:
    """Ids (strings) taken up to some epoch.  The number of buckets is fixed
    when the index is begun."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self.base = filesystem(root)
        newest = self._heads(1 << 62)
        self.buckets = newest["buckets"] if newest else buckets
        #: what the last ``seen`` read: filters, buckets opened
        self.looked = self.opened = 0
        ensure_checkpoint_dir(spark)

    def _heads(self, before: int) -> dict | None:
        """The heads of the last epoch before ``before``."""
        found = [n for n in names(self.fs, f"{self.base}/heads") if int(n.removesuffix(".json")) <= before]
        return get_json(self.fs, f"{self.base}/heads/{max(found)}") if found else None

    def _keyed(self, ids: DataFrame) -> DataFrame:
        """Distinct ids with bucket, hash of the word and mask."""
        i = F.col("id")
        return ids.select(F.col(ids.columns[0]).cast("string").alias("id")).filter(i.isNotNull()).distinct().select(
            "id", F.pmod(F.xxhash64(i), F.lit(self.buckets)).cast("int").alias("bucket"),
            F.xxhash64(i, F.lit(1)).alias("hash"), _mask(i).alias("mask"))

    def _with_word(self, keyed: DataFrame, words: dict[int, int]) -> DataFrame:
        sizes = self.spark.createDataFrame(sorted(words.items()), "bucket int, words bigint")
        # one row a bucket
        return keyed.join(F.broadcast(sizes), "bucket").withColumn("word", F.pmod("hash", F.col("words"))).drop("words")

    def _filters(self, heads: dict[int, list], buckets: list[int]) -> DataFrame:
        paths = [f"{self.root}/filters/epoch={heads[b][2]}/bucket={b}" for b in buckets]
        rows = self.spark.read.schema("word bigint, bits bigint, epoch bigint, bucket int") \
            .option("basePath", f"{self.root}/filters").parquet(*paths)
        return rows.select("bucket", "word", "bits")

    def _ids(self, buckets: list[int], before: int) -> DataFrame:
        rows = self.spark.read.schema("id string, bucket int, epoch bigint").option("basePath", f"{self.root}/ids") \
            .parquet(*[f"{self.root}/ids/bucket={b}" for b in buckets])
        return rows.filter(F.col("epoch") < before).select("bucket", "id")

    @staticmethod
    def _of(heads: dict | None) -> dict[int, list]:
        return {int(b): h for b, h in heads["heads"].items()} if heads else {}

    def seen(self, ids: DataFrame, epoch: int) -> DataFrame:
        """Those of the (first column's) ids that were added in an epoch
        before this one."""
        heads = self._of(self._heads(epoch))
        keyed = self._keyed(ids).checkpoint()
        # at most one row a bucket comes to the driver
        asked = sorted({r["bucket"] for r in keyed.select("bucket").distinct().collect()} & set(heads))
        self.looked, self.opened = len(asked), 0
        if not asked:
            return self.spark.createDataFrame([], "id string")
        probes = self._with_word(keyed, {b: heads[b][1] for b in asked})
        hits = probes.join(self._filters(heads, asked), ["bucket", "word"]) \
            .filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("bucket", "id").checkpoint()
        opened = sorted(r["bucket"] for r in hits.select("bucket").distinct().collect())
        self.opened = len(opened)
        if not opened:
            return self.spark.createDataFrame([], "id string")
        return hits.join(self._ids(opened, epoch), ["bucket", "id"], "left_semi").select("id")

    def add(self, ids: DataFrame, epoch: int) -> None:
        """Add ids that are not in the index yet, as ``epoch``; adding an
        epoch again replaces it."""
        heads = self._of(self._heads(epoch))
        keyed = self._keyed(ids).checkpoint()
        counts = {r["bucket"]: r["n"] for r in keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        new = {b: [heads.get(b, [0])[0] + n] for b, n in counts.items()}
        for b, h in new.items():
            h += [max(_words(h[0]), heads[b][1] if b in heads else 1), epoch]
        if counts:
            keyed.select("id", "bucket", F.lit(epoch).cast("bigint").alias("epoch")).repartition("bucket") \
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                .partitionBy("bucket", "epoch").parquet(f"{self.root}/ids")
            words = {b: h[1] for b, h in new.items()}
            grown = sorted(b for b in new if b in heads and heads[b][1] != new[b][1])
            same = sorted(b for b in new if b in heads and heads[b][1] == new[b][1])
            own = keyed.select("id", "bucket", "hash", "mask")
            if grown:                                  # a filter that has become too small is built from its bucket's ids
                own = own.unionByName(self._keyed(self._ids(grown, epoch).select("id")))
            bits = self._with_word(own, words).select("bucket", "word", F.col("mask").alias("bits"))
            if same:
                bits = bits.unionByName(self._filters(heads, same))
            merged = bits.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
            merged.withColumn("epoch", F.lit(epoch).cast("bigint")).repartition("bucket").sortWithinPartitions("bucket", "word") \
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                .partitionBy("epoch", "bucket").parquet(f"{self.root}/filters")
        put_whole(self.fs, f"{self.base}/heads/{epoch + 1:020d}.json",
                  {"epoch": epoch, "buckets": self.buckets, "heads": {str(b): h for b, h in {**heads, **new}.items()}})
        kept = sorted(names(self.fs, f"{self.base}/heads"))
        for n in kept[:-HEADS]:
            self.fs.delete_file(f"{self.base}/heads/{n}")
