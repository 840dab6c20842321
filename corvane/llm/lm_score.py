"""LM scoring: a Brown class-based bigram model.

Words are counted over all training documents. The TOP most frequent are clustered by the exchange algorithm on their bigram
counts, all others standing as one item meanwhile. Every other word then joins the class that makes its own bigrams likeliest: the same
exchange step, on its counts of classes before and after it, in one distributed pass. Classes of all words met, class transitions are
counted over all training documents. A text's probability is the product of class transitions and word emissions. Transitions are
smoothed by absolute discounting towards class frequencies; emissions are relative frequencies, and the class that has most words
seen once gives a discount of its own to the unknown word, which is in it. Both are proper distributions.

Texts are split once. From then on a document is a string of 64-bit codes: the rank of a word among the most frequent, KNOWN at the
most, which are broadcast; for any other word its 63-bit hash, below zero; and 0, the end. All later passes work on codes.
Counts that grow with the corpus stay distributed: the classes and counts of words are a table. Words that are not broadcast
are joined with it, place by place, as their neighbours' transitions need their classes, and each document's sums are added up.
The driver holds class statistics and at most (TOP + 2)**2 bigram counts.

Words are the runs of bytes other than white space, A-Z lower-cased; the end of a text is a word of its own, kept as the empty one.

Defined cases: a null text counts as empty and has one token, the end; without training documents every word has probability 1 in its
class; rows that repeat a doc_id are scored each (a null doc_id counts as the text '' where documents are drawn by it); an empty table
gives no rows; two rare words whose hashes agree (once in 2**63 pairs) count as one. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import discard, small_batches, written

TOP = 1000
CLASSES = 48
SWEEPS = 6
KNOWN = 200_000
FLUSH = 200_000
#: Codes that a task gathers before it counts them together.
GATHER = 2_000_000
BINS_PER_DOUBLING = 16
#: Words of more than a thousandth of all places to be joined are joined by broadcast; there are fewer than 1000.
HOT_SHARE = 1000
END = b""
#: In place of a class: the words without one so far, and the word itself.
OTHER, SELF = CLASSES + 1, CLASSES + 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and c: how often each word, and the end, stands in `docs`."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(words_of(text))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield flush()
                    counts.clear()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(vocab: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int]:
    """The words of at least some count, `most` at the most, commonest first; that count."""
    level = F.floor(F.log2(F.col("c").cast("double")) * BINS_PER_DOUBLING).cast("int")
    sizes = sorted(((r["level"], r["n"], r["least"]) for r in vocab.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()), reverse=True)  # a row per level: some 1000 at the most
    least, held = 1 << 62, 0
    for _, n, c in sizes:
        if held + n > most:
            break
        held, least = held + n, c
    rows = vocab.filter(F.col("c") >= F.lit(least)).collect() if held else []
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0])), least


def code_of(word: Column) -> Column:
    """The code of a word that is not broadcast: its hash, below zero."""
    return F.xxhash64(word).bitwiseOR(F.lit(-(1 << 63)))


def coded(docs: DataFrame, words: list[bytes], learn: Column | None = None) -> DataFrame:
    """row (a number of its own), doc_id, learn and codes (64-bit integers in bytes) of each of `docs`; `words` have the codes from 1 on."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(words, 1)})

    def run(batches):
        import pyarrow as pa
        import xxhash

        class Codes(dict):
            def __missing__(self, word):
                return (xxhash.xxh64_intdigest(word, 42) | 1 << 63) - (1 << 64)

        get = Codes(shared.value).__getitem__
        for batch in batches:
            out = [np.array([*map(get, words_of(t)), 0], np.int64).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("learn"), pa.array(out, pa.large_binary()).cast(pa.binary())], names=["row", "doc_id", "learn", "codes"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))).alias("learn"), "text")
    return written(rows.mapInArrow(run, "row long, doc_id long, learn boolean, codes binary"), "codes")


def _flat(batch) -> np.ndarray:
    """The codes of a batch in a row. Each text ends with 0, so what stands before a text is an end, too."""
    return np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int64)


def _gathered(batches):
    """Codes of some batches in a row, GATHER of them or so."""
    held, n = [], 0
    for batch in batches:
        x = _flat(batch)
        held.append(x)
        n += len(x)
        if n >= GATHER:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def bigrams(codes: DataFrame, top: int) -> np.ndarray:
    """Counts of adjacent items, in a matrix of (top + 2) squared; item 0 is the end, on both sides of each text, and the last one all words after the `top` first."""
    size = top + 2

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(size * size, np.int64)
        for x in _gathered(batches):
            items = np.where((x >= 0) & (x <= top), x, top + 1)
            counts += np.bincount(np.concatenate([[0], items[:-1]]) * size + items, minlength=size * size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pair", "n"])

    rows = codes.select("codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size, np.int64)
    out[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item, by exchange clustering: items move, one by one, to the class that makes the bigrams likeliest. Item 0 keeps class 0 alone, and the last item the last class."""
    n = len(pairs)
    pairs = pairs.astype(np.float64)
    order = np.argsort(-pairs.sum(1), kind="stable")
    order = order[(order != 0) & (order != n - 1)]
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(len(order)) % classes
    of[n - 1] = classes + 1
    f, size = xlogx, classes + 2
    member = np.zeros((n, size))
    member[np.arange(n), of] = 1
    out_of, into = pairs @ member, pairs.T @ member  # item to class, class to item
    table = member.T @ out_of
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, lw, rw, own = of[w], out_of[w].copy(), into[w].copy(), pairs[w, w]
            # counts with w taken out of its class
            lw[a] -= own
            rw[a] -= own
            table[a] -= lw
            table[:, a] -= rw
            table[a, a] -= own
            gain = (f(table + lw) - f(table)).sum(1) + (f(table.T + rw) - f(table.T)).sum(1)
            d = np.diag(table)
            gain += f(d + lw + rw + own) - f(d) - (f(d + lw) - f(d)) - (f(d + rw) - f(d))
            left, right = table.sum(1), table.sum(0)
            lt, rt = lw.sum() + own, rw.sum() + own
            gain -= f(left + lt) - f(left) + f(right + rt) - f(right)
            b = 1 + int(np.argmax(gain[1:-1]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += lw
            table[:, b] += rw
            table[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                out_of[:, a] -= pairs[:, w]
                out_of[:, b] += pairs[:, w]
                into[:, a] -= pairs[w]
                into[:, b] += pairs[w]
        if not moved:
            break
    return of


def contexts(codes: DataFrame, of_top: np.ndarray, broadcast_words: bool) -> DataFrame:
    """code, key and n: how often each word without a class in `of_top` (by code) stands between two classes; key is 64 * before + after, each a class, OTHER or SELF.
    Either of the words that are broadcast (codes above 0), summed up for each GATHER codes, or of all others, a row each time."""
    shared = codes.sparkSession.sparkContext.broadcast(of_top)

    def run(batches):
        import pyarrow as pa

        of = shared.value
        for x in _gathered(batches):
            c = np.where((x >= 0) & (x < len(of)), of[np.clip(x, 0, len(of) - 1)], OTHER)
            at = np.flatnonzero(c == OTHER)  # never the last, which is an end
            code, before = x[at], np.where(at > 0, c[at - 1], 0)
            after = c[at + 1]
            before[(at > 0) & (x[at - 1] == code)] = SELF
            after[x[at + 1] == code] = SELF
            key = 64 * before + after
            own = (code > 0) == broadcast_words
            code, key = code[own], key[own].astype(np.int32)
            n = np.ones(len(code), np.int64)
            if broadcast_words:
                pair, n = np.unique(code * 4096 + key, return_counts=True)
                code, key = pair // 4096, (pair % 4096).astype(np.int32)
            for i in range(0, len(n), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[i : i + 50_000]), pa.array(key[i : i + 50_000]), pa.array(n[i : i + 50_000])], names=["code", "key", "n"])

    return codes.select("codes").mapInArrow(run, "code long, key int, n long")


def joined_class(before: np.ndarray, after: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class each word goes to from OTHER, by the gain of exchange(): a row per word of the counts of classes before and after it, and of itself after itself."""
    f, n = xlogx, len(own)
    gain = np.zeros((n, len(table)))
    for counts, t, back in ((before, table, after), (after, table.T, before)):
        held = counts.copy()
        held[:, OTHER] = 0
        row, c = np.nonzero(held)  # few for a rare word
        np.add.at(gain, row, f(t[c] + held[row, c][:, None]) - f(t[c]))
        rest = t[OTHER] - back  # the word is out of OTHER
        gain += f(rest + counts[:, OTHER, None]) - f(rest)
    d = np.diag(table)
    gain += f(d + before + after + own[:, None]) - f(d) - (f(d + before) - f(d)) - (f(d + after) - f(d))
    total = (before.sum(1) + own)[:, None]
    left, right = table.sum(1), table.sum(0)
    gain -= f(left + total) - f(left) + f(right + total) - f(right)
    return 1 + np.argmax(gain[:, 1:OTHER], 1)


def classes_of(codes: DataFrame, of_top: np.ndarray, table: np.ndarray) -> DataFrame:
    """code, c and class of every word of `codes` that has no class in `of_top`; `table` has the bigrams of classes, OTHER the last."""

    def run(batches):
        import pyarrow as pa

        seen: dict[int, int] = {}  # the class of a word met once, by its key
        for batch in batches:
            lists = batch.column("around")
            sizes, entries = lists.value_lengths().to_numpy(), lists.flatten()
            key, n = (entries.field(i).to_numpy() for i in range(2))
            first = np.cumsum(sizes) - sizes
            once = (sizes == 1) & (n[first] == 1)
            new = [k for k in np.unique(key[first[once]]).tolist() if k not in seen]
            # the words met more often, then one of each new kind of the others
            many = np.flatnonzero(~once)
            at = np.flatnonzero(np.repeat(~once, sizes))
            row = np.concatenate([np.repeat(np.arange(len(many)), sizes[many]), len(many) + np.arange(len(new))]).astype(np.int64)
            keys, counts = np.concatenate([key[at], np.array(new, np.int32)]), np.concatenate([n[at], np.ones(len(new), np.int64)])
            before, after = np.zeros((len(many) + len(new), SELF + 1)), np.zeros((len(many) + len(new), SELF + 1))
            np.add.at(before, (row, keys // 64), counts)
            np.add.at(after, (row, keys % 64), counts)
            got = joined_class(before[:, :SELF], after[:, :SELF], before[:, SELF], table)
            seen |= dict(zip(new, got[len(many) :].tolist()))
            of, c = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int64)
            of[many], c[many] = got[: len(many)], before[: len(many)].sum(1)
            of[once] = [seen[k] for k in key[first[once]].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(c), pa.array(of)], names=["code", "c", "class"])

    # a word has at most 64**2 keys. The frequent words' rows are summed before they move, and dealt by key, too, before a word's keys meet;
    # no other word is frequent, so theirs move once
    summed = lambda x: x.groupBy("code", "key").agg(F.sum("n").alias("n"))
    sums = summed(contexts(codes, of_top, True)).unionByName(summed(contexts(codes, of_top, False).repartition("code")))
    return sums.groupBy("code").agg(F.collect_list(F.struct("key", "n")).alias("around")).mapInArrow(run, "code long, c long, class int")


def places(codes: DataFrame, classes: np.ndarray, rare: DataFrame, unknown: int) -> DataFrame:
    """The places of words that are not broadcast: row, learn, before, class, after and c (null for unknown words). `classes` are those
    of the words that are, by code; before and after are classes, before is -1 where such a word stands there."""
    shared = codes.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        import pyarrow as pa

        of = shared.value
        for batch in batches:
            x = _flat(batch)
            sizes = np.array([len(b) // 8 for b in batch.column("codes").to_pylist()])
            at = np.flatnonzero(x < 0)
            c = np.where(x >= 0, of[np.maximum(x, 0)], -1)
            doc = np.repeat(np.arange(len(sizes)), sizes)[at]
            row, learn = batch.column("row").to_numpy()[doc], batch.column("learn").to_numpy(zero_copy_only=False)[doc]
            before, after = np.where(at > 0, c[at - 1], 0).astype(np.int32), c[at + 1].astype(np.int32)
            for i in range(0, len(at), 50_000):
                j = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(row[j]), pa.array(learn[j]), pa.array(at[j]), pa.array(x[at[j]]), pa.array(before[j]), pa.array(after[j])], names=["row", "learn", "pos", "code", "before", "after"])

    found = written(codes.select("row", "learn", "codes").mapInArrow(run, "row long, learn boolean, pos long, code long, before int, after int"), "places")
    total = found.count()
    hot = found.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") * HOT_SHARE > F.lit(total)).select("code")
    warm = F.broadcast(hot.join(rare, "code", "left"))
    cold = found.join(F.broadcast(hot), "code", "left_anti").join(rare, "code", "left")
    both = found.join(warm, "code").unionByName(cold).withColumn("class", F.coalesce("class", F.lit(unknown)))
    follow = F.lead("class").over(Window.partitionBy("row").orderBy("pos"))
    out = written(both.select("row", "learn", "before", "class", F.when(F.col("after") < 0, follow).otherwise(F.col("after")).alias("after"), "c"), "placed")
    discard(found)
    return out


def class_pairs(codes: DataFrame, placed: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of adjacent classes over all words of `codes`."""
    shared = codes.sparkSession.sparkContext.broadcast(classes)
    size = CLASSES + 1

    def run(batches):
        import pyarrow as pa

        of, counts = shared.value, np.zeros(size * size, np.int64)
        for x in _gathered(batches):
            b = np.where(x >= 0, of[np.maximum(x, 0)], -1)
            a = np.concatenate([[0], b[:-1]])
            both = (a >= 0) & (b >= 0)
            counts += np.bincount(a[both] * size + b[both], minlength=size * size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pair", "n"])

    out = np.zeros((size, size), np.int64)
    for r in codes.filter("learn").select("codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # a row per pair of classes
        out[divmod(r["pair"], size)] += r["n"]
    for r in placed.filter("learn").groupBy("before", "class", "after").count().collect():  # a row per three classes
        if r["before"] >= 0:
            out[r["before"], r["class"]] += r["count"]
        out[r["class"], r["after"]] += r["count"]
    return out


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 of the probability of a class (column) after a class (row), from the counts of adjacent classes."""
    table = table.astype(np.float64)
    base = (table.sum(0) + 1) / (table.sum() + len(table))
    discount = np.minimum(table, 0.5)
    total = table.sum(1, keepdims=True)
    smooth = np.where(total > 0, (table - discount + discount.sum(1, keepdims=True) * base) / np.maximum(total, 1), base)
    return np.log10(smooth)


def _clustered(codes: DataFrame, vocab: DataFrame, known: list[tuple[bytes, int]]) -> dict:
    """The model but for its transitions, from the `codes` of training documents."""
    n, v = vocab.agg(F.sum("c"), F.count("*")).first()
    ends = codes.count()
    top = min(TOP, len(known))
    pairs = bigrams(codes, top)
    of = exchange(pairs)
    member = np.eye(CLASSES + 2)[of]
    of_top = of[: top + 1]  # by code; the end has class 0
    further = written(classes_of(codes, of_top, member.T @ pairs.astype(np.float64) @ member), "classes")
    one = lambda c: F.count(F.when(F.col("c") == c, 1))
    total, kinds, once, twice = (np.zeros(CLASSES + 1) for _ in range(4))
    for r in further.groupBy("class").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), one(1).alias("once"), one(2).alias("twice")).collect():  # a row per class
        total[r["class"]], kinds[r["class"]], once[r["class"]], twice[r["class"]] = r["total"], r["kinds"], r["once"], r["twice"]
    counts = np.array([ends, *(c for _, c in known)], np.int64)
    np.add.at(total, of_top, counts[: top + 1])
    np.add.at(kinds, of_top, 1)
    np.add.at(once, of_top, counts[: top + 1] == 1)
    twice = twice.sum() + (counts[: top + 1] == 2).sum()
    if not ends:
        kinds[0] = 0
    discount = min(0.9, max(0.1, once.sum() / max(1, once.sum() + 2 * twice)))
    unknown = 1 + int(np.argmax((once if once[1:].any() else kinds)[1:]))
    classes = np.zeros(len(known) + 1, np.int64)
    classes[: top + 1] = of_top
    for r in further.filter("code > 0").collect():  # KNOWN at the most
        classes[r["code"]] = r["class"]
    words = [w for w, _ in known]
    code = vocab.sparkSession.createDataFrame([(END, 0), *((w, i) for i, w in enumerate(words, 1))], "word binary, _known long")
    every = further.select("code", "class").unionByName(vocab.sparkSession.createDataFrame(list(enumerate(of_top.tolist())), "code long, class int"))
    table = vocab.join(code, "word", "left").withColumn("code", F.coalesce("_known", code_of(F.col("word")))).join(every, "code").select("word", "c", "class")
    return {"vocab": table, "words": words, "counts": counts, "classes": classes, "rare": further.filter("code < 0"), "unknown": unknown, "total": total, "kinds": kinds, "discount": discount, "N": int(n or 0), "V": int(v)}


def _known(vocab: DataFrame) -> list[tuple[bytes, int]]:
    """The words that are broadcast, commonest first, without the end."""
    return [(w, c) for w, c in frequent(vocab, KNOWN)[0] if w != END]


def train(docs: DataFrame) -> dict:
    """The model of the documents `docs`; `vocab` is its table of words."""
    small_batches(docs.sparkSession)
    vocab = written(vocabulary(docs), "vocabulary")
    known = _known(vocab)
    codes = coded(docs, [w for w, _ in known])
    model = _clustered(codes, vocab, known)
    placed = places(codes, model["classes"], model["rare"], model["unknown"])
    model["trans"] = transitions(class_pairs(codes, placed, model["classes"]))
    discard(codes, placed)
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    codes = coded(docs, model["words"])
    return _scored(codes, places(codes, model["classes"], model["rare"], model["unknown"]), model).drop("learn")


def train_and_score(docs: DataFrame, learn: Column) -> DataFrame:
    """Like `score` on all `docs`, with the model of those where `learn` holds, and that column; texts are split once for both."""
    small_batches(docs.sparkSession)
    vocab = written(vocabulary(docs.filter(learn)), "vocabulary")
    known = _known(vocab)
    codes = coded(docs, [w for w, _ in known], learn)
    model = _clustered(codes.filter("learn"), vocab, known)
    placed = places(codes, model["classes"], model["rare"], model["unknown"])
    return _scored(codes, placed, model | {"trans": transitions(class_pairs(codes, placed, model["classes"]))})


def _scored(codes: DataFrame, placed: DataFrame, model: dict) -> DataFrame:
    spark = codes.sparkSession
    total, kinds, discount, unknown, n, v, counts, classes = (model[k] for k in ("total", "kinds", "discount", "unknown", "N", "V", "counts", "classes"))
    off = np.where(np.arange(CLASSES + 1) == unknown, discount, 0.0)  # what each word of a class gives to the unknown one
    new = math.log10(discount * kinds[unknown] / total[unknown]) if total[unknown] else 0.0
    emit = np.where(classes == 0, 0.0, np.log10(np.maximum(counts - off[classes], 1e-300) / np.maximum(total[classes], 1)))
    floor = n + 1 * (v + 1)
    # the end has its base probability also where nothing was learned
    shared = spark.sparkContext.broadcast({"class": classes, "emit": emit, "base": np.log10((counts + 1) / floor), "trans": model["trans"], "end": int(counts[0] > 0)})

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            x = _flat(batch)
            if not len(x):
                continue
            sizes = np.array([len(b) // 8 for b in batch.column("codes").to_pylist()])
            first = np.cumsum(sizes) - sizes
            known, at = x >= 0, np.maximum(x, 0)
            b = np.where(known, m["class"][at], -1)
            a = np.concatenate([[0], b[:-1]])
            both = (a >= 0) & (b >= 0)
            score = np.where(known, m["emit"][at], 0.0) + np.where(both, m["trans"][np.maximum(a, 0), np.maximum(b, 0)], 0.0)
            sums = lambda y: pa.array(np.add.reduceat(y, first))
            seen = known.astype(np.int64)
            seen[x == 0] = m["end"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "learn")), pa.array(sizes), sums(seen), sums(np.where(known, m["base"][at], 0.0)), sums(score)], names=["row", "doc_id", "learn", "n_tokens", "n_known", "base_score", "score"])

    whole = codes.mapInArrow(run, "row long, doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double")
    c = F.coalesce(F.col("c"), F.lit(0))
    at = lambda x, i: F.element_at(F.lit(np.asarray(x, np.float64).ravel()), i + 1)
    step = lambda a, b: at(model["trans"], F.col(a) * (CLASSES + 1) + F.col(b))
    emitted = F.when(c > 0, F.log10((c - at(off, F.col("class"))) / at(np.maximum(total, 1), F.col("class")))).otherwise(F.lit(new))
    into = F.when(F.col("before") >= 0, step("before", "class")).otherwise(0.0)
    rest = placed.groupBy("row").agg(F.count(F.when(c > 0, 1)).alias("_known"), F.sum(F.log10((c + 1) / F.lit(float(floor)))).alias("_base"), F.sum(emitted + into + step("class", "after")).alias("_score"))
    both = whole.join(rest, "row", "left")
    score = F.col("score") + F.coalesce("_score", F.lit(0.0))
    return both.select("doc_id", "learn", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
