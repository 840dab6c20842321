"""Token counts: delta-maintained rollups by source, language and tokenizer version.

Each batch of changes is a set of signed rows: an inserted document adds 1 document and its tokens, a deleted one
takes them away, a revised count takes the old and adds the new. A batch is summed per key before anything is moved and committed
as a folder named after its id. A batch whose folder is complete is not written again, and one that broke off is
overwritten, so commits are idempotent; totals are the sums over complete batches. `compact` folds batches into one
base and remembers the ids that it holds; it counts once its marker file exists.

Defined cases: a null text counts as empty (0 tokens); null source or lang are keys of their own; a document given
twice counts twice; a batch id is any text of at most MOST_ID bytes in UTF-8 (its folder is named by those bytes in hexadecimal), longer ones are refused; columns named version or n_tokens in `docs` are not read; keys whose documents and tokens are all taken away leave the rollup; empty batches are committed too. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import ChunkEncoder, scratch, small_batches, texts_of

#: Tokenizer versions that Spark counts by itself: a regular expression for a token. `counted_by_vocabulary` counts with a vocabulary.
VERSIONS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]",
}
KEYS = ["source", "lang", "version"]
#: Bytes of a batch id; file systems take names of 255 characters.
MOST_ID = 120
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def counted(docs: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, version, n_tokens: a row per document and tokenizer version."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = [F.struct(F.lit(v).alias("version"), F.regexp_count(text, F.lit(p)).cast("long").alias("n_tokens")) for v, p in (versions or VERSIONS).items()]
    return docs.select("doc_id", "source", "lang", F.inline(F.array(*counts)))


def signed(counts: DataFrame, sign: Column | int) -> DataFrame:
    """Changes from `counts`: +1 inserts, -1 deletes."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    return counts.select(*KEYS, sign.cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that turn the counts of `old` into those of `new`; documents that stand in both alike cancel out in the sums."""
    return signed(old, -1).unionByName(signed(new, 1))


def counted_by_vocabulary(docs: DataFrame, version: str, path: str) -> DataFrame:
    """Like `counted`, by the vocabulary at `path` (a file of the tokenizers library, without special tokens), as `version`."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        encoder = ChunkEncoder.of(path)
        for batch in batches:
            n = pa.array([len(encoder.encode(t)) // 4 for t in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), n], names=["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long").select("doc_id", "source", "lang", F.lit(version).alias("version"), "n_tokens")


def folder_of(batch: str) -> str:
    """The name of a batch's folder: one path element, and no pattern to Spark's readers, whatever the id."""
    name = batch.encode()
    if len(name) > MOST_ID:
        raise ValueError(f"a batch id has at most {MOST_ID} bytes")
    return f"batch={name.hex()}"


def id_of(folder: str) -> str:
    return bytes.fromhex(folder.removeprefix("batch=")).decode()


class Rollup:
    """Totals in a folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "token-counts")
        jvm = spark.sparkContext._jvm
        self._path = lambda *x: jvm.org.apache.hadoop.fs.Path("/".join((self.path, *x)))
        self.fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, kind: str) -> list[str]:
        if not self.fs.exists(self._path(kind)):
            return []
        names = (x.getPath().getName() for x in self.fs.listStatus(self._path(kind)))
        return sorted(x for x in names if not x.startswith(("_", ".")) and self.fs.exists(self._path(kind, x, "_SUCCESS")))

    def _state(self) -> tuple[str | None, set[str], list[str]]:
        """Of one look at the folders: the newest complete base, the batches it holds, and the complete batches after it."""
        deltas = [id_of(x) for x in self._folders("deltas")]  # first: a base that is newer than this list may only hold more of it
        base = (self._folders("base") or [None])[-1]
        held = {r["batch"] for r in self.spark.read.schema("batch string").json(f"{self.path}/base/{base}/batches").collect()} if base else set()
        return base, held, [x for x in deltas if x not in held]

    def _sums(self, base: str | None, after: list[str]) -> DataFrame:
        parts = ([f"{self.path}/base/{base}/totals"] if base else []) + [f"{self.path}/deltas/{folder_of(x)}" for x in after]
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 OR n_tokens != 0")

    def committed(self) -> set[str]:
        """Ids of all complete batches."""
        _, held, after = self._state()
        return held | set(after)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch once; whether it was new."""
        if batch in self.committed():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/deltas/{folder_of(batch)}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens now."""
        base, _, after = self._state()
        return self._sums(base, after)

    def compact(self) -> None:
        """Folds all complete batches into a new base, which counts from the moment that its _SUCCESS is there. What the base before it
        held already, its deltas and older bases, is removed; what is folded now stays until the next time, for those who still read it."""
        base, held, after = self._state()  # sums and ids are of one look, so a batch that is committed meanwhile is in neither
        name = f"{int(base) + 1 if base else 0:08d}"
        self._sums(base, after).write.mode("overwrite").parquet(f"{self.path}/base/{name}/totals")
        self.spark.createDataFrame([(i,) for i in sorted(held | set(after))], "batch string").write.mode("overwrite").json(f"{self.path}/base/{name}/batches")
        self.fs.create(self._path("base", name, "_SUCCESS"), True).close()
        for kind, x in [("deltas", x) for x in self._folders("deltas") if id_of(x) in held] + [("base", x) for x in self._folders("base") if base and x < base]:
            self.fs.delete(self._path(kind, x), True)
