"""Token-ID output: Parquet with list columns, dictionary or delta encoding, row groups and page indexes.

`write_tokens` encodes documents and writes, in ascending doc_id order over the files, the columns doc_id, shard
(number of the file in that order), row (place in the file, from 0), n_tokens and tokens (list of int). Spark's own Parquet writer does it, so writing
is committed, survives lost executors and works on any file system Spark reaches. Row groups and pages have the
sizes given; page (column and offset) indexes and statistics let `read_tokens` skip row groups and pages by doc_id, and read
metadata without tokens. `token_spans` gives the place of each document in the stream of all ids.

Defined cases: a null text counts as empty; each document ends with `end_id`; rows that repeat a doc_id follow each
other in an order fixed by their text and each has its own span; a null doc_id comes first; an empty table gives a
folder without rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import ChunkEncoder, small_batches, texts_of, tokenizer_path, written

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
PAGE_ROWS = 2000
SCHEMA = "doc_id long, shard int, row long, n_tokens long, tokens array<int>"


def encoded(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, shard, row, n_tokens and tokens of `docs`, which has doc_id, text and shard, a partition for each shard."""
    path = path or tokenizer_path(VOCABULARY)
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        encoder, row = ChunkEncoder.of(path), 0
        for batch in batches:
            ids = [encoder.encode(text) + end for text in texts_of(batch)]
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
            rows = pa.array(np.arange(row, row + len(ids)))
            row += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), rows, pa.array(n), tokens], names=["doc_id", "shard", "row", "n_tokens", "tokens"])

    return docs.select("doc_id", "text", "shard").mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, to: str, encoding: str = "dictionary", end_id: int = END_ID, path: str | None = None, files: int | None = None) -> None:
    """Writes the ids of all `docs` to the folder `to`."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    spark = docs.sparkSession
    small_batches(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(files, "doc_id").withColumn("shard", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")
    (
        encoded(ranged, end_id, path)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(to)
    )


def read_tokens(spark: SparkSession, at: str, doc_ids: list[int] | None = None, columns: tuple[str, ...] = ("doc_id", "tokens")) -> DataFrame:
    """Columns of the documents asked for; the filter on doc_id reaches the scan."""
    rows = spark.read.schema(SCHEMA).parquet(at)
    return (rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))).select(*columns)


def token_spans(spark: SparkSession, at: str) -> DataFrame:
    """Read back from the files, in the order of their rows: doc_id, start, n_tokens, ids_crc32."""
    small_batches(spark)

    def digest(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            tokens = batch.column("tokens")
            values, offsets = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<u4"), tokens.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            n = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("row"), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "shard", "row", "n_tokens", "ids_crc32"])

    found = written(read_tokens(spark, at, columns=("doc_id", "shard", "row", "tokens")).mapInArrow(digest, "doc_id long, shard int, row long, n_tokens long, ids_crc32 long"), "spans")
    # a row per file: bounded by the number of files
    files = found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("_before", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("shard", F.coalesce("_before", F.lit(0)).alias("_before"))
    before = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_start", F.coalesce(before, F.lit(0))).join(F.broadcast(files), "shard").select("doc_id", (F.col("_start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
