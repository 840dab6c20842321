"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, collocations, exact_dedup, fingerprints, langid, lm_score, merkle, near_dedup, packing, quality, token_counts, token_output
from corvane.llm.common import scratch, table, written


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; a twentieth is deleted and inserted again in two more batches; each batch is committed twice."""
    counts = written(token_counts.counted(table(spark, sf_dir, "documents")), "counts")
    some = counts.filter(F.col("doc_id") % 20 == 0)
    rollup = token_counts.Rollup(spark)
    for batch, changes in (("load", token_counts.signed(counts, 1)), ("out", token_counts.signed(some, -1)), ("in", token_counts.signed(some, 1))):
        rollup.commit(batch, changes)
        rollup.commit(batch, changes)
    return rollup.totals()


OP1_SQL = """
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\x20\\x09-\\x0D]')) FROM documents)
GROUP BY source, lang, version
"""


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.mark(table(spark, sf_dir, "documents"), width=2)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(quality.remainder(4) != 2))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(quality.remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), at)
    return token_output.token_spans(spark, at)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(quality.remainder(7) == 2, F.lit(False))
    scored = lm_score.train_and_score(docs, ~held_out)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    return chat.read_back(chat.formatted(rows))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = langid.predict(docs, langid.fit(docs.filter(quality.remainder(4) != 2)))
    return predicted.select("doc_id", F.coalesce(quality.remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_second", "ambiguous")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH text AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
piece AS (SELECT lang, piece, row_number() OVER () AS p FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM text) x),
word AS (SELECT lang, p, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT lang, p, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece) x),
start AS (SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM word WINDOW p AS (PARTITION BY p ORDER BY i)),
gram AS (
  SELECT lang, 1 AS m, w1 AS phrase, count(*) AS a FROM start GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM start WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM start WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM start WHERE w4 IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM gram WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM gram WHERE m > 1 AND a >= 30),
cut AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest FROM cand, range(1, 4) AS t(k) WHERE k < m),
scored AS (
  SELECT cut.lang, cut.m, cut.phrase, cut.a, k, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * cut.a) // (l.a::HUGEINT + r.a) AS BIGINT) AS score
  FROM cut JOIN gram l ON l.lang = cut.lang AND l.m = k AND l.phrase = first JOIN gram r ON r.lang = cut.lang AND r.m = cut.m - k AND r.phrase = rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (SELECT DISTINCT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM cand, range(1, 4) AS t(i), range(2, 4) AS u(s) WHERE s < m AND i + s - 1 <= m),
kept AS (SELECT * FROM weakest WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.lang = weakest.lang AND part.phrase = weakest.phrase AND 100::HUGEINT * part.a >= 80::HUGEINT * weakest.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = merkle.leaves_of(table(spark, sf_dir, "documents"), merkle.tampered_text())
    return merkle.proofs(merkle.build(leaves)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in merkle.FIELDS[:-1])
#: The unsigned CRC-32 of the decimal doc_id, bit by bit.
_CRC32 = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT),"
    " lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
)
OP13_SQL = f"""
WITH RECURSIVE tampered AS (
  SELECT *, {_FIELDS} AS head, dense_rank() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS lang_no,
    CASE WHEN {_CRC32} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now FROM documents),
digests AS (
  SELECT doc_id, lang_no, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS leaf_now FROM tampered),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY lang_no ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang_no) AS n, row_number() OVER (ORDER BY lang_no, doc_id NULLS FIRST, leaf) AS k FROM digests),
node AS (
  SELECT lang_no, 0 AS h, i, leaf AS d, n FROM leaf
  UNION ALL SELECT lang_no, h + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM node WHERE n > 1 GROUP BY lang_no, h, i // 8, n),
subroot AS (SELECT lang_no, d FROM node WHERE n = 1),
above AS (
  SELECT 0 AS h, lang_no AS i, d, count(*) OVER () AS n FROM subroot
  UNION ALL SELECT h + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM above WHERE n > 1 GROUP BY h, i // 8, n),
step AS (
  SELECT lang_no, h, i, coalesce(string_agg(d, '') OVER (PARTITION BY lang_no, h, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER (PARTITION BY lang_no, h, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM node WHERE n > 1),
step_above AS (
  SELECT h, i, coalesce(string_agg(d, '') OVER (PARTITION BY h, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER (PARTITION BY h, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM above WHERE n > 1),
path AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY up, h) - 1 AS nth, l, r FROM (
    SELECT k, 0 AS up, h, l, r FROM leaf JOIN step ON step.lang_no = leaf.lang_no AND step.i = leaf.i >> (3 * h)
    UNION ALL SELECT k, 1, h, l, r FROM leaf JOIN step_above ON step_above.i = leaf.lang_no >> (3 * h)) x),
proof AS (SELECT k, sha256(string_agg(l || r, '' ORDER BY nth)) AS proof_sha256 FROM path GROUP BY k),
fold AS (
  SELECT k, 0 AS nth, leaf_now AS d FROM leaf
  UNION ALL SELECT fold.k, fold.nth + 1, sha256(l || d || r) FROM fold JOIN path ON path.k = fold.k AND path.nth = fold.nth),
folded AS (SELECT k, arg_max(d, nth) AS folded_root FROM fold GROUP BY k)
SELECT doc_id, leaf, subroot.d AS subroot, above.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = above.d AS verified
FROM leaf JOIN subroot USING (lang_no) JOIN folded USING (k) LEFT JOIN proof USING (k) CROSS JOIN (SELECT d FROM above WHERE n = 1) above
"""


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_document_fingerprints, op3_minhash_near_dedup, op4_quality_classifier, op5_token_output, op6_lm_scoring, op7_best_fit_packing, op8_exact_dedup, op9_bpe, op10_chat_format, op11_language_id, op12_collocations, op13_merkle_manifest)}
ORACLE_SQL = {"op1_token_counts": OP1_SQL, "op8_exact_dedup": OP8_SQL, "op12_collocations": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
