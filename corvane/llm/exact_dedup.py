"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

The index is a Spark table of digests, bucketed and sorted by the digest. A batch of documents is
reduced to one row per digest, an anti-join against the index (a sort-merge join in which only the
batch is shuffled, as the index is bucketed) finds the new digests, and those are appended. How often a
later batch holds a digest that an earlier one brought is appended to a second table, bucketed alike.

Defined cases: a null text counts as empty; the empty text is a text like others; letters A-Z are
lower-cased before hashing, no other character is changed; of equal texts the largest doc_id of the batch that brought
them stays (a null doc_id is smaller than any); rows that repeat doc_id and text are one document twice: both
count in group_size, and `deduplicate` returns one of them. An empty table gives an empty result.
Columns other than doc_id and text are not read; their names do not matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, discard, free_name, scratch, written

#: Digests of more than a thousandth of a batch's rows are joined by broadcast; there are fewer than 1000, as the batch's groups add up to its rows.
HOT_SHARE = 1000
#: Ids that `deduplicate` broadcasts at the most, 16 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def digest():
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, each with the document that stays and the number of its rows.

    The index survives sessions: give `path` and open it again. The number of buckets lies beside the data, so every session
    reads and appends by the same one. Rows carry the id of the batch that brought them. A batch that is committed again
    finds its digests, and its rows among the repeats, and adds nothing; one that broke off is completed.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path, self.fresh = spark, path or scratch(spark, "digest-index"), path is None
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/buckets/_SUCCESS")
        if not self.fresh and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            self.buckets = spark.read.schema("buckets int").json(f"{self.path}/buckets").first()["buckets"]
        else:
            self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.createDataFrame([(self.buckets,)], "buckets int").write.mode("overwrite").json(f"{self.path}/buckets")
        key = uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        self.name, self.repeats = f"digest_index_{key}", f"digest_repeats_{key}"
        for name, columns in ((self.name, "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"), (self.repeats, "digest BINARY, n BIGINT, batch STRING")):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name.split('_')[1]}'")

    def rows(self) -> DataFrame:
        """A row for each digest: digest, keep_id, group_size (in the batch that brought it) and batch."""
        return self.spark.table(self.name)

    def known(self) -> DataFrame:
        """digest, keep_id and group_size over all batches."""
        rows = self.rows().select("digest", "keep_id", "group_size")
        if self.fresh:
            return rows
        more = self.spark.table(self.repeats).groupBy("digest").agg(F.sum("n").alias("_more"))
        return rows.join(more, "digest", "left").select("digest", "keep_id", (F.col("group_size") + F.coalesce("_more", F.lit(0))).alias("group_size"))

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.repartition(self.buckets, "digest").write.insertInto(name)
        self.spark.catalog.refreshTable(name)

    def append(self, groups: DataFrame, batch: str | None = None) -> None:
        """Adds a batch, a row per digest: an anti-join finds the digests that the index does not hold. Without an id a batch is known by its contents."""
        if batch is None:
            n, total = groups.agg(F.count("*"), F.sum(F.xxhash64("digest", "keep_id", "group_size").cast("decimal(38,0)"))).first()
            batch = f"{n}:{total}"
        new = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        self._append(new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")), self.name)
        if not self.fresh:
            before = self.rows().filter(F.col("batch") != batch).select("digest")
            told = self.spark.table(self.repeats).filter(F.col("batch") == batch).select("digest")
            again = groups.hint("merge").join(before, "digest", "left_semi").join(told, "digest", "left_anti")
            self._append(again.select("digest", F.col("group_size").alias("n"), F.lit(batch).alias("batch")), self.repeats)

    def close(self) -> None:
        """Takes the tables out of the catalog; the files stay."""
        for name in (self.name, self.repeats):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and digest of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))


def mark(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, keep_id, group_size, kept, digest.

    Digests the index held before keep the document it names; for a new index that is the largest doc_id.
    """
    spark = docs.sparkSession
    seen = written(digests(docs), "digests")
    own = index or DigestIndex(spark)
    groups = written(seen.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    own.append(groups, batch)
    found = written(groups.select("digest", F.col("group_size").alias("_n")).hint("merge").join(own.known(), "digest"), "found")
    if index is None:
        own.close()
    discard(groups)
    hot = F.broadcast(found.filter(F.col("_n") * HOT_SHARE > F.lit(seen.count())))
    found, hot = found.drop("_n"), hot.drop("_n")
    warm = seen.join(hot, "digest")
    cold = seen.join(hot.select("digest"), "digest", "left_anti").hint("merge").join(found, "digest")
    return warm.unionByName(cold).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, all columns unchanged; of rows that repeat doc_id and text, one."""
    marked = written(mark(docs, index, batch), "marked")
    key = F.col("doc_id").cast("long")
    if marked.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count() == 0:
        name = free_name(docs.columns, "_gone")
        gone = marked.filter("NOT kept").select(F.col("doc_id").alias(name))
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
        return docs.join(gone, key == F.col(name), "left_anti")
    # a doc_id does not name a row: by doc_id and digest, and one row of each
    name, stay_id, stay_digest = (free_name(docs.columns, x) for x in ("_digest", "_stay_id", "_stay_digest"))
    stay = marked.filter("kept").select(F.col("doc_id").alias(stay_id), F.col("digest").alias(stay_digest)).distinct()
    both = docs.withColumn(name, digest()).join(stay, key.eqNullSafe(F.col(stay_id)) & (F.col(name) == F.col(stay_digest)), "left_semi")
    return both.dropDuplicates(["doc_id", name]).drop(name)
