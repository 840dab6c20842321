"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Fitting takes a bounded sample of labelled rows (`sample` per label, those of the smallest hash of doc_id), turns each text
into weighted counts of hashed byte trigrams and of a few terms for its shape, and keeps the leading singular vectors. The
sample's latent vectors are broadcast (2 * sample * RANK floats at the most); every document's cosines with all of them are
computed block by block, exactly, and the nearest vote, weighted by similarity and by how much rarer or commoner their label is
among all labelled rows than in the sample.

Only text is an input of a score; labels, lang, source and doc_id are not.

Defined cases: a null text counts as empty, and the empty text is scored by its shape; labels other than 0 and 1 are left out,
and of repeated labels of a doc_id the largest counts; with labels of one kind only, the score is that label, with none 0.5; repeated
rows are scored each; an empty table gives no rows. Columns other than doc_id, text and quality are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import small_batches

DIMS = 2048
BINS = 12
SHAPES = 8
RANK = 64
SAMPLE = 1500
NEIGHBOURS = 25
SHARPNESS = 8.0
THRESHOLD = 0.7


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def counts_of(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams, then one of BINS terms for each of SHAPES measures."""
    out = np.zeros(DIMS + SHAPES * BINS, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) > 2:
        x = raw.astype(np.uint32)
        code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        out[:DIMS] = np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 11), minlength=DIMS)
    n = max(1, len(raw))
    kinds = np.bincount(_KIND[raw], minlength=5) / n if len(raw) else np.zeros(5)
    words = text.split()
    lines = text.split("\n")
    measures = (
        kinds[0] * 2,  # capitals
        kinds[1] * 4,  # digits
        kinds[2] * 4,  # signs
        kinds[3] * 2,  # white space
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / max(1, len(lines)),
        min(1.0, len(text) / max(1, len(words)) / 20),
        min(1.0, np.log1p(len(text)) / 12),
    )
    for i, m in enumerate(measures):
        out[DIMS + i * BINS + min(BINS - 1, int(m * BINS))] = 1
    return out


_KIND = np.full(256, 4)
_KIND[ord("A") : ord("Z") + 1] = 0
_KIND[ord("0") : ord("9") + 1] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of terms weighted by log count and rarity, trigrams and shape each of length 1."""
    x = np.log1p(counts) * idf
    for part in (x[:, :DIMS], x[:, DIMS:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from `labels` (doc_id, quality), learning from at most `sample` rows of either label."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows at the most
    # thin by hash before ranking, so that no task ranks more than a few samples' worth
    share = {y: min(1.0, 4 * sample / n) for y, n in prior.items()}
    draw = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    few = known.withColumn("_draw", draw).filter(F.col("_draw") <= F.when(F.col("quality") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    # the rows of the smallest draws of each label: every task keeps `sample` at the most
    first = lambda y: few.filter(F.col("quality") == y).orderBy("_draw", "doc_id").limit(sample).select("doc_id", "quality")
    chosen = first(0).unionByName(first(1))

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = [counts_of(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(vectors, pa.binary())], names=["doc_id", "quality", "vector"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows are broadcast
    rows = sorted({r["doc_id"]: (r["quality"], bytes(r["vector"])) for r in texts.mapInArrow(features, "doc_id long, quality int, vector binary").collect()}.items())
    total = sum(prior.values())
    model = {"prior": prior.get(1, 0) / total if total else 0.5, "basis": None}
    y = np.array([q for _, (q, _) in rows])
    if len(set(y)) < 2:
        return model
    counts = np.stack([np.frombuffer(v, np.float32) for _, (_, v) in rows])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x = weighted(counts, idf)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = vectors[:, np.argsort(values)[::-1][:RANK]].astype(np.float32)
    votes = np.where(y == 1, prior[1] / (y == 1).sum(), prior[0] / (y == 0).sum()).astype(np.float32)
    return model | {"basis": basis, "idf": idf, "latent": unit(x @ basis), "y": y.astype(np.float32), "votes": votes}


def score_texts(texts: list[str], model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    if model["basis"] is None or not texts:
        return np.full(len(texts), model["prior"])
    out = []
    for i in range(0, len(texts), 256):
        latent = unit(weighted(np.stack([counts_of(t) for t in texts[i : i + 256]]), model["idf"]) @ model["basis"])
        cosine = latent @ model["latent"].T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        similarity = np.clip(np.take_along_axis(cosine, near, 1), 1e-6, 1).astype(np.float64)
        weight = similarity**SHARPNESS * model["votes"][near]
        out.append((weight * model["y"][near]).sum(1) / weight.sum(1))
    return np.clip(np.concatenate(out), 0, 1)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts([t or "" for t in batch.column("text").to_pylist()], shared.value), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, all columns unchanged."""
    model = fit(docs, labels)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(score_texts(texts, shared.value) >= threshold))

    return docs.mapInArrow(run, schema)
