"""Language identification: error-correcting output codes over byte n-grams.

Each language has a codeword. For every bit a binary naive Bayes classifier on hashed byte n-grams (2 to 4 bytes, letters only, lower-cased) tells the languages whose
codeword has that bit from the others; languages count alike, however many rows they have. A text's margin for a bit is the mean log odds of its n-grams, scaled so that typical margins are alike for
all bits. Decoding is loss-weighted: a language's loss is the sum over the bits of log(1 + exp(-codeword bit * margin)), each weighted by how often that bit's classifier was
right on the language's validation rows. The language with the least loss is chosen; its share of exp(-loss) is the score. A prediction is marked ambiguous if the score is below AMBIGUOUS, or if plain Hamming decoding of the signs prefers another codeword.

Codes: all dichotomies for up to 6 languages (4 have 7 bits, any two codewords differ in 4), else the best of CODES random codes by least distance, of 15 bits for each bit of a language's number.

It fits on at most SAMPLE rows of each language (those of the smallest hashes of doc_id and text, in each of SALTS groups; three quarters for the counts, a quarter for scales and weights), so
the model's cost does not grow with the corpus. Only sums per language reach the driver: at most 4 vectors of DIMS numbers a language, and at most MOST_LANGS languages, more are refused.

Defined cases: rows with a null lang are not learned from; a null text, or one without a letter, is `und` with score 0, ambiguous; without any learned language every text is;
with one learned language that one is chosen with score 1; equal losses go to the language that sorts first; rows that repeat are predicted each; an empty table has no rows. Columns other than doc_id, text and (for fitting) lang are not read.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import discard, small_batches, written

UNKNOWN = "und"
#: Rows of each language that the model is fitted on, at the most.
SAMPLE = 2000
SALTS = 16
MOST_LANGS = 500
#: Buckets of n-grams, as a power of 2, and the lengths of n-grams in bytes.
BITS = 14
DIMS = 1 << BITS
ORDERS = (2, 3, 4)
#: N-grams without evidence that every text has besides its own, so that short texts have small margins.
PRIOR = 20.0
SMOOTH = 0.02
MARGIN = 3.0
AMBIGUOUS = 0.6
CODES = 300
_SPACED = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]").search


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER(text)) or any(map(str.isalpha, text))


def counts_of(text: str) -> np.ndarray:
    """How often n-grams fall into each bucket, over the whole text."""
    letters = b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())
    a = np.frombuffer(b" " + letters + b" ", np.uint8).astype(np.uint32)
    out, gram = np.zeros(DIMS, np.float32), a
    for n in range(2, max(ORDERS) + 1):
        if len(a) < n:
            break
        gram = gram[:-1] | a[n - 1 :] << np.uint32(8 * (n - 1))
        if n in ORDERS:
            out += np.bincount(((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=DIMS)
    return out


def codes_for(n: int, seed: int = 7) -> np.ndarray:
    """A codeword of +1 and -1 for each of `n` languages; no bit is the same for all, and no two bits are equal or opposite where all dichotomies are taken."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        return np.array([(1, *x) for x in itertools.product((1, -1), repeat=n - 1) if -1 in x], np.int8).T
    rng, bits, best = np.random.default_rng(seed), 15 * (n - 1).bit_length(), None
    for _ in range(CODES if n < 100 else 20):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        agree = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(agree, -bits)
        if best is None or agree.max() < best[0]:
            best = agree.max(), code
    return best[1]


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray | None = None  # DIMS x bits: log odds
    scale: np.ndarray | None = None  # bits
    trust: np.ndarray | None = None  # langs x bits

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights / (counts.sum(1, keepdims=True) + PRIOR) * self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Per text and language."""
        return (np.logaddexp(0, -self.codes[None].astype(np.float64) * margins[:, None, :]) * self.trust[None]).sum(2)

    def decide(self, texts: list[str | None]) -> list[tuple[str, str | None, float, bool]]:
        """Of each text the language, the next likely one, the score, and whether it is ambiguous."""
        out: list[tuple[str, str | None, float, bool]] = [(UNKNOWN, None, 0.0, True)] * len(texts)
        if not self.langs:
            return out
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if len(self.langs) == 1:
            for i in known:
                out[i] = (self.langs[0], None, 1.0, False)
            return out
        for some in (known[i : i + 128] for i in range(0, len(known), 128)):
            margins = self.margins(np.stack([counts_of(texts[i]) for i in some]))
            losses = self.losses(margins)
            order = np.argsort(losses, axis=1, kind="stable")
            share = np.exp(losses.min(1, keepdims=True) - losses)
            score = 1 / share.sum(1)
            agree = np.sign(margins) @ self.codes.T
            plain = agree.max(1) > agree[np.arange(len(some)), order[:, 0]]
            for i, o, s, p in zip(some, order, score, plain):
                out[i] = (self.langs[o[0]], self.langs[o[1]], float(s), bool(s < AMBIGUOUS or p))
        return out


def _sample(docs: DataFrame, sample: int) -> tuple[DataFrame, list[str]]:
    """lang, text, check (a quarter: for validation) of at most `sample` rows a language, and the languages."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("_draw")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    # thin by hash in the scan, before any text moves
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, 4 * sample / n)) for x, n in sizes.items()], "lang string, _share double")
    few = rows.join(F.broadcast(shares), "lang").filter(F.pmod("_draw", F.lit(1 << 40)) / F.lit(float(1 << 40)) <= F.col("_share"))
    # a language's rows are dealt out to SALTS groups by hash, of which each gives its share; each task keeps as many a group at the most before they move
    nth = F.row_number().over(Window.partitionBy("lang", F.pmod("_draw", F.lit(SALTS))).orderBy("_draw"))
    chosen = few.withColumn("_nth", nth).filter(F.col("_nth") <= max(1, sample // SALTS))
    return chosen.select("lang", "text", (F.pmod(F.shiftright("_draw", 40), F.lit(4)) == 0).alias("check")), sorted(sizes, key=str.encode)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the languages in `docs` (doc_id, text, lang)."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen, langs = _sample(docs, sample)
    model = Model(langs, codes_for(len(langs)))
    if len(langs) < 2:
        return model
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = written(chosen, "language-sample").repartition(parts, "lang", F.pmod(F.xxhash64("text"), F.lit(4)))

    def sums(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts = counts_of(text)
                if (n := counts.sum()) > 0:
                    total.setdefault(lang, np.zeros(DIMS))
                    total[lang] += counts / n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["lang", "sums"])

    total = np.zeros((len(langs), DIMS))
    for r in chosen.filter("NOT check").select("lang", "text").mapInArrow(sums, "lang string, sums binary").collect():  # 4 rows a language
        total[langs.index(r["lang"])] += np.frombuffer(bytes(r["sums"]), np.float32)
    share = (1 - SMOOTH) * total / np.maximum(total.sum(1, keepdims=True), 1e-9) + SMOOTH / DIMS
    sides = [np.stack([share[column == s].mean(0) for column in model.codes.T]) for s in (1, -1)]
    model.weights = np.log(sides[0] / sides[1]).T.astype(np.float32)
    model.scale, model.trust = np.ones(model.codes.shape[1]), np.ones(model.codes.shape)
    shared, codes = spark.sparkContext.broadcast(model), dict(zip(langs, model.codes))

    def checked(batches):
        import pyarrow as pa

        m, rows = shared.value, []
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if has_letter(text):
                    margin = m.margins(counts_of(text)[None])[0]
                    rows.append((lang, (margin * codes[lang] > 0).astype(np.float64), np.abs(margin)))
        seen = sorted({r[0] for r in rows})
        gathered = [np.concatenate([[sum(r[0] == x for r in rows)], sum(r[1] for r in rows if r[0] == x), sum(r[2] for r in rows if r[0] == x)]).tobytes() for x in seen]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(gathered, pa.binary())], names=["lang", "found"])

    bits = model.codes.shape[1]
    found = np.zeros((len(langs), 1 + 2 * bits))
    for r in chosen.filter("check").select("lang", "text").mapInArrow(checked, "lang string, found binary").collect():
        found[langs.index(r["lang"])] += np.frombuffer(bytes(r["found"]))
    discard(chosen)
    n = found[:, :1]
    right = (found[:, 1 : 1 + bits] + 1) / (n + 2)
    mean = (found[:, 1 + bits :].sum(0) + 1e-9) / max(n.sum(), 1)
    model.scale = np.where(n.sum() > 0, MARGIN / mean, 1.0)
    model.trust = right / right.sum(1, keepdims=True) * bits
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, lang_second, score, ambiguous."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = shared.value.decide(batch.column("text").to_pylist())
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, (pa.string(), pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "lang_pred", "lang_second", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, lang_second string, score double, ambiguous boolean")
