"""Phrase collocations: hashed bucket counts of the next length (PCY, DHP), Apriori pruning, exact counts.

Pass m (1 to 4) over the texts counts phrases of m words exactly, and phrases of m + 1 words into 2**BITS buckets:

* a phrase is counted only if both its parts of m - 1 words reached the least count (Apriori) and its bucket did (PCY);
* a phrase of m + 1 words goes into its bucket only if both its parts of m words may be frequent by these tests (DHP).

What the passes broadcast are bitmaps of 2**BITS bits (16 MB each, three at the most), whatever the corpus: of the buckets, and of the frequent phrases, by hash. A bitmap only ever lets too many
through, so counts are exact: they are sums by the phrase itself. Bucket counts move as slices of 2**16 buckets, of which each task sends those it met, at most 3
bytes a phrase. Words that are not frequent cut a piece, so later passes carry few phrases.

A phrase's score is that of its weakest cut into two, floor(2000000 * a / (l + r)), with a, l and r how often the phrase and its two parts occur; all parts are frequent, as
they occur at least as often as the phrase. Phrases that lie in a longer candidate which has SHARE of their count are dropped.

Defined cases: null texts are empty; a null lang is `und`, together with any of that name; A-Z are lower-cased and nothing else; words are what stands between blanks and tabs, so other white space is a part of them;
rows that repeat count as often as they stand; ties are ordered by count and phrase; an empty table, or one without frequent phrases, has no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import UPPER, discard, ranked, small_batches, written

LONGEST = 4
MIN_COUNT = 30
SHARE = 80
KEEP = 2000
#: Buckets of phrases, as a power of 2, and those of a slice.
BITS = 27
SLICE = 16
#: Words of a language that a task keeps ids of; then it starts anew.
MOST_WORDS = 400_000
#: Bytes of text that a task counts together.
GATHER = 8 << 20
CUT = b"\xff"
# fixed values: what ends a piece
ENDS = b".,;:!?\n\x0b\x0c\r"
_MAP = bytes.maketrans(UPPER.encode() + ENDS, UPPER.lower().encode() + CUT * len(ENDS))
_P, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
RAW_NAMES = ["lang", "phrase", "n", "slice", "at", "counts"]
RAW = "lang string, phrase string, n long, slice int, at binary, counts binary"


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """The words of texts, with CUT between pieces; no UTF-8 text has that byte."""
    return CUT.join(texts).translate(_MAP).replace(CUT, b" " + CUT + b" ").split()


def seed_of(lang: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(lang.encode())


def bucket(x, bits: int):
    """The bucket of a phrase's hash, for integers and arrays of unsigned 64-bit ones."""
    if isinstance(x, int):
        return ((x ^ (x >> 31)) * _MIX & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(_MIX)) >> np.uint64(64 - bits)


class Bitmap:
    """Bits by bucket."""

    def __init__(self, data: bytes, bits: int):
        self.data, self.bits = np.frombuffer(data, np.uint8), bits

    def has(self, x):
        b = bucket(x, self.bits)
        if isinstance(b, int):
            return bool(self.data[b >> 3] >> (b & 7) & 1)
        return (self.data[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Vocabulary(dict):
    """Ids of a language's words, from 1; 0 for what cuts a piece: its end, and words that are not frequent."""

    def __init__(self, lang: str, frequent: Bitmap | None):
        import xxhash

        super().__init__({CUT: 0})
        self.words, self.hashes = [b""], [0]
        self.hash, self.seed = xxhash.xxh64_intdigest, seed_of(lang)
        self.bits, self.shift = (frequent.data.tobytes(), 64 - frequent.bits) if frequent is not None else (None, 0)

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word, self.seed)
        if self.bits is not None:
            b = ((h ^ (h >> 31)) * _MIX & 0xFFFFFFFFFFFFFFFF) >> self.shift  # as in bucket()
            if not self.bits[b >> 3] >> (b & 7) & 1:
                self[word] = 0
                return 0
        self[word] = i = len(self.words)
        self.words.append(word)
        self.hashes.append(h)
        return i


def tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def phrases_at(ids: np.ndarray, at: np.ndarray, m: int, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct phrases of `m` words that start at the places `at`, and their counts."""
    key, parts = ids[at].astype(np.int64), []
    for j in range(1, m):  # pairs of a phrase's number and the next word, numbered anew each time, so that they fit in 64 bits
        seen, key = np.unique(key, return_inverse=True)
        parts.append(seen)
        key = key.astype(np.int64) << 32 | ids[at + j]
    seen, n = tally(key)
    columns = []
    for earlier in reversed(parts):
        columns.append((seen & 0xFFFFFFFF).tolist())
        seen = earlier[seen >> 32]
    columns.append(seen.tolist())
    return [b" ".join([words[i] for i in row]) for row in zip(*reversed(columns))], n


def slices(buckets: np.ndarray, least: int):
    """Counts of buckets as rows (slice, places, counts), the counts cut off where they suffice."""
    seen, n = tally(buckets.astype(np.uint32))
    kind = np.uint8 if least <= 255 else np.uint32
    n = np.minimum(n, least).astype(kind)
    of = seen >> SLICE
    bounds = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else []
    low = (seen & ((1 << SLICE) - 1)).astype(np.uint16)
    for a, b in zip(bounds, [*bounds[1:], len(of)]):
        yield int(of[a]), low[a:b].tobytes(), n[a:b].tobytes()


def gathered(batches):
    """Texts by language, GATHER bytes of them or so at a time."""
    import pyarrow as pa

    texts: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            texts.setdefault(lang, []).append(text)
            size += len(text)
            if size >= GATHER:
                yield texts
                texts, size = {}, 0
    if texts:
        yield texts


def counted(docs: DataFrame, m: int, least: int, longest: int, bits: int, maps: dict[str, bytes]) -> DataFrame:
    """Pass `m` over `docs` (lang, text): sums of phrases (lang, phrase, n; in the first pass also a null phrase, all words) and of buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches):
        import pyarrow as pa

        known = {k: Bitmap(v, bits) for k, v in shared.value.items()}
        vocabularies: dict[str, Vocabulary] = {}
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

        def rows(lang, **columns):
            n = len(next(iter(columns.values())))
            arrays = [pa.array([lang]).take(pa.array(np.zeros(n, np.int32))) if f == "lang" else pa.array(columns[f], t) if f in columns else pa.nulls(n, t) for f, t in zip(RAW_NAMES, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=RAW_NAMES)

        def told(lang, phrases, n):
            for i in range(0, len(phrases), 100_000):
                yield rows(lang, phrase=pa.array(phrases[i : i + 100_000], pa.binary()).cast(pa.string()), n=n[i : i + 100_000])

        for texts in gathered(batches):
            for lang, own in texts.items():
                v = vocabularies.get(lang)
                if v is None or len(v) > MOST_WORDS:
                    v = vocabularies[lang] = Vocabulary(lang, known.get("words"))
                tokens = tokens_of(own)
                own.clear()
                ids = np.fromiter(map(v.__getitem__, tokens), np.int64, len(tokens))
                del tokens
                x = np.array(v.hashes, np.uint64)[ids]
                one, ok = x, ids > 0
                if m == 1:
                    n = np.bincount(ids, minlength=len(v.words))
                    at = np.flatnonzero(n[1:]) + 1
                    yield rows(lang, n=np.array([n[1:].sum()], np.int64))
                    yield from told(lang, [v.words[i] for i in at.tolist()], n[at])
                for k in range(2, m + 2):
                    if len(ok) < 2 or k > longest:
                        break
                    x = x[:-1] * np.uint64(_P) + one[k - 1 :]
                    ok = ok[:-1] & ok[1:]
                    at = np.flatnonzero(ok)
                    if k == m + 1:
                        if parts := list(slices(bucket(x[at], bits), least)):
                            of, places, counts = zip(*parts)
                            yield rows(lang, slice=of, at=places, counts=counts)
                    elif (test := known.get(f"frequent-{k}" if k < m else "buckets")) is not None:
                        ok[at[~test.has(x[at])]] = False
                    if k == m:
                        yield from told(lang, *phrases_at(ids, np.flatnonzero(ok), m, v.words))

    return docs.mapInArrow(run, RAW)


def bitmap(parts: DataFrame, least: int, bits: int) -> bytes:
    """The bits of all buckets whose `parts` (slice, at, counts) add up to `least`: 2**bits / 8 bytes, gathered slice by slice."""
    kind = np.uint8 if least <= 255 else np.uint32

    def run(batches):
        import pyarrow as pa

        now, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])
        for batch in batches:
            for s, at, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "at", "counts"))):
                if s != now:
                    if now is not None and (total >= least).any():
                        yield done()
                    now, total = s, np.zeros(1 << SLICE, np.int64)
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, kind)
        if now is not None and (total >= least).any():
            yield done()

    parts_n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.select("slice", "at", "counts").repartition(parts_n, "slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, bits binary")
    out, step = bytearray(max(1, (1 << bits) >> 3)), (1 << SLICE) >> 3
    for r in rows.collect():  # a row per slice
        data = bytes(r["bits"])[: len(out)]
        out[r["slice"] * step : r["slice"] * step + len(data)] = data
    return bytes(out)


def phrase_slices(phrases: DataFrame, least: int, bits: int) -> DataFrame:
    """The buckets of `phrases` (lang, phrase), each with a count that suffices."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            found, seeds = [], {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist()):
                seed = seeds[lang] if lang in seeds else seeds.setdefault(lang, seed_of(lang))
                x = 0
                for i, word in enumerate(phrase.split(b" ")):
                    h = xxhash.xxh64_intdigest(word, seed)
                    x = h if i == 0 else (x * _P + h) & 0xFFFFFFFFFFFFFFFF
                found.append(bucket(x, bits))
            rows = list(slices(np.repeat(np.array(found, np.uint32), least), least))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "at", "counts"])

    return phrases.select("lang", "phrase").mapInArrow(run, "slice int, at binary, counts binary")


def frequent(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, a of all phrases of up to `longest` words that occur `least` times; and lang, n: all words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    maps: dict[str, bytes] = {}
    found, totals = [], None
    for m in range(1, longest + 1):
        raw = written(counted(texts, m, least, longest, bits, maps), f"phrases-{m}")
        sums = written(raw.filter("n IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(f"phrase IS NULL OR a >= {least}"), f"frequent-{m}")
        if m == 1:
            totals = sums.filter("phrase IS NULL").select("lang", F.col("a").alias("n"))
        own = sums.filter("phrase IS NOT NULL").select("lang", "phrase", F.lit(m).alias("words"), "a")
        found.append(own)
        if m < longest:
            maps = {"words": maps["words"]} if m > 1 else {}
            maps["words" if m == 1 else f"frequent-{m}"] = bitmap(phrase_slices(own, least, bits), least, bits)
            maps["buckets"] = bitmap(raw.filter("slice IS NOT NULL"), least, bits)
        discard(raw)
    out = found[0]
    for own in found[1:]:
        out = out.unionByName(own)
    return out, totals


def candidates(grams: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more that stay."""
    whole = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  sums and products of counts stay exact
    long = grams.filter("words > 1").withColumn("w", F.split("phrase", " "))
    piece = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = long.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    of = lambda name, count: grams.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    scored = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # every part of two words and more of a longer phrase, with the largest count that such a phrase has
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: piece(i, n))))
    inside = long.filter("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (whole("most") * 100 < whole("a") * share))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def top(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, share: int = SHARE, keep: int = KEEP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `keep` best phrases of each language."""
    grams, totals = frequent(docs, least, longest, bits)
    numbered, _ = ranked(candidates(written(grams, "grams"), share), "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()])
    return numbered.filter(F.col("rank") < keep).join(F.broadcast(totals), "lang").select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
