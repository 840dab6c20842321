"""Document fingerprints: a homomorphic multiset hash in DataFrame functions alone.

A text is a multiset of paragraphs (its lines). A
paragraph is hashed whole to a vector of 128 lanes of 4 bits (eight 64-bit hashes); the vector of a document is the sum of its
paragraphs', lane by lane modulo 2**16. Sums do not depend on
the order, and paragraphs are put in or taken out by adding or subtracting their vectors, together with the number of
paragraphs, which is part of the fingerprint (modulo 2**32). Equal multisets have equal fingerprints; others differ but for hash
collisions.

Four lanes share a 64-bit word, 16 bits apart, so a plain sum adds four lanes. A document is summed in
blocks of 2048 paragraphs, in which no lane can reach its neighbour (15 * 2048 < 2**15), and lanes are taken modulo 2**16 where
blocks meet. A long document is thus many small partial sums.

Likeness: a text's sentences are summed in the same way, and a fingerprint holds both sums: number of paragraphs and their lanes, then number of sentences and theirs. The sentences' lanes, less
their mean of 7.5 a sentence, are random projections of the multiset, so the cosine of
two texts' lanes estimates that of the two multisets; below 0 counts as 0, and equal fingerprints have likeness 1. The
estimate's standard error is at most 1/sqrt(128); wrapped lanes (thousands of copies of one sentence) only blur it. `likeness_between` gives it for any two fingerprints, without their texts.

Defined cases: a null or empty text is one empty paragraph and sentence; repeated ones count as often as they stand; rows that repeat a
doc_id are fingerprinted each, and the next document of a doc_id is, of the rows of the next larger doc_id, the one that lies first in the table; a null doc_id
has no next document (likeness null, edited as if followed by an empty text); in a table with one doc_id the next document is
itself; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import written

HASHES = 8
WORDS = HASHES * 4
LANES = WORDS * 4
BLOCK = 2048
ENDS = r"\n|(?<=[.!?]) "
_LOW = 0x000F000F000F000F
_EVEN = 0x0000FFFF0000FFFF


def paragraphs() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), r"\n")


def sentences() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), ENDS)


def fingerprint(rows: DataFrame, keys: list[str], parts: Column | None = None) -> DataFrame:
    """`keys`, units (number of `parts`, paragraphs by default) and words (array of WORDS 64-bit integers, four lanes each) of each text; keys name a text."""
    units = rows.select(*keys, F.posexplode(paragraphs() if parts is None else parts).alias("_at", "_unit")).withColumn("_block", F.expr(f"_at div {BLOCK}"))
    for h in range(HASHES):
        units = units.withColumn(f"_h{h}", F.xxhash64(F.lit(h), "_unit"))
    # the sums of one block
    sums = [F.sum(F.shiftrightunsigned(f"_h{h}", 4 * j).bitwiseAND(F.lit(_LOW))).alias(f"_w{4 * h + j}") for h in range(HASHES) for j in range(4)]
    blocks = units.groupBy(*keys, "_block").agg(F.count("*").alias("units"), *sums)
    # blocks of a text: lanes two by two, 32 bits apart
    even = lambda c: c.bitwiseAND(F.lit(_EVEN))
    halves = [F.sum(even(c)).alias(f"_{k}{i}") for i in range(WORDS) for k, c in (("e", F.col(f"_w{i}")), ("o", F.shiftrightunsigned(f"_w{i}", 16)))]
    whole = blocks.groupBy(*keys).agg(F.sum("units").alias("units"), *halves)
    words = [F.col(f"_e{i}").bitwiseAND(F.lit(_EVEN)).bitwiseOR(F.shiftleft(F.col(f"_o{i}").bitwiseAND(F.lit(_EVEN)), 16)) for i in range(WORDS)]
    return whole.select(*keys, F.col("units").bitwiseAND(F.lit(0xFFFFFFFF)).alias("units"), F.array(*words).alias("words"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lane by lane a + b or a - b modulo 2**16: paragraphs put in or taken out."""
    even, odd = F.lit(_EVEN), lambda c: F.shiftrightunsigned(c, 16).bitwiseAND(F.lit(_EVEN))
    # a borrow bit above each lane keeps a difference from reaching its neighbour
    guard = F.lit(0x0001000000010000) if sign < 0 else F.lit(0)
    add = lambda x, y: (x.bitwiseOR(guard) + F.lit(sign) * y).bitwiseAND(even)
    return F.zip_with(a, b, lambda x, y: add(x.bitwiseAND(even), y.bitwiseAND(even)).bitwiseOR(F.shiftleft(add(odd(x), odd(y)), 16)))


def as_text(words: Column, units: Column) -> Column:
    """A sum in hexadecimal digits: the number of units, then the lanes."""
    return F.concat(F.lpad(F.hex(units), 8, "0"), F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


#: Digits of one of the two sums of a fingerprint.
DIGITS = 8 + 16 * WORDS


def sentence_sum(fingerprint: Column) -> Column:
    """units and words of the sentences, read from a fingerprint."""
    number = lambda at, n: F.conv(F.substring(fingerprint, at, n), 16, 10)
    half = lambda at: number(at, F.lit(8)).cast("long")  # noqa: E731  two halves, as a word may pass a signed integer
    words = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.shiftleft(half(F.lit(DIGITS + 9) + i * 16), 32).bitwiseOR(half(F.lit(DIGITS + 17) + i * 16)))
    return F.struct(half(F.lit(DIGITS + 1)).alias("units"), words.alias("words"))


def likeness_between(a: Column, b: Column) -> Column:
    """How like the texts of two fingerprints are, 0 to 1, from the fingerprints alone."""
    x, y = (lanes(sentence_sum(c)["words"], sentence_sum(c)["units"]) for c in (a, b))
    return likeness(x, y, _dot(x, x), _dot(y, y), a == b)


def lanes(words: Column, units: Column) -> Column:
    """Twice the lanes less their mean, signed, as doubles."""
    def centred(w: Column, j: int) -> Column:
        x = (F.shiftrightunsigned(w, 16 * j).bitwiseAND(F.lit(0xFFFF)) * 2 - units * 15).bitwiseAND(F.lit(0x1FFFF))
        return F.when(x >= 0x10000, x - 0x20000).otherwise(x).cast("double")

    return F.flatten(F.transform(words, lambda w: F.array(*[centred(w, j) for j in range(4)])))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, norm_a: Column, norm_b: Column, same: Column) -> Column:
    cosine = _dot(a, b) / F.sqrt(norm_a * norm_b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(same, 1.0).when(norm_a * norm_b == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def next_ids(docs: DataFrame) -> DataFrame:
    """For each distinct doc_id the next larger one, and the first after the last; a range of ids is ordered in each task."""
    spark = docs.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    ranged = written(ids.repartitionByRange(files, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("least"))  # a row per range
    after = F.lead("least").over(Window.orderBy("part"))
    follow = firsts.withColumn("_after", F.coalesce(after, F.min("least").over(Window.partitionBy(F.lit(1))))).drop("least")
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("_next", inside).join(F.broadcast(follow), "part").select("doc_id", F.coalesce("_next", "_after").alias("next_id"))


def edited(docs: DataFrame) -> DataFrame:
    """Rows of `docs` as key, row, doc_id, next_row, next_id, text and edited_text: the last quarter gives way to as much of the next document.

    `key` stands for doc_id and is never null. Both joins need the same columns of the texts partitioned by it, so that
    one shuffle of the texts serves both, and all that follows per text."""
    # a row without a doc_id has a key of its own, so that many of them do not meet
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))).alias("key")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").select("row", key, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    follow = next_ids(docs)
    # how much of each next document is wanted, and by whom
    most = base.groupBy("doc_id").agg(F.max(F.expr("length(text) div 4")).alias("most"))
    wanted = most.join(follow, "doc_id").select(F.col("doc_id").cast("string").alias("for_key"), F.col("next_id").cast("string").alias("key"), "most")
    heads = base.join(wanted, "key").select("for_key", F.struct("row", F.expr("left(text, cast(most as int))").alias("head"), F.col("doc_id").alias("next_id")).alias("h"))
    heads = heads.groupBy(F.col("for_key").alias("key")).agg(F.min("h").alias("h")).select("key", F.col("h.row").alias("next_row"), "h.next_id", "h.head")
    text = F.expr("concat(left(text, cast(length(text) - length(text) div 4 as int)), left(coalesce(head, ''), cast(length(text) div 4 as int)))")
    return base.join(heads, "key", "left").select("key", "row", "doc_id", "next_row", "next_id", "text", text.alias("edited_text"))


def compare(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = ["key", "row", "doc_id", "next_row", "next_id", "n_chars"]
    both_ways = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(k).alias("kind"), F.col(c).alias("text")) for v, c in enumerate(("text", "edited_text")) for k in (0, 1)])
    texts = edited(docs).select(*own[:-1], F.length("text").cast("long").alias("n_chars"), F.inline(both_ways))
    keyed = texts.withColumn("edited_sha256", F.when((F.col("version") == 1) & (F.col("kind") == 0), F.sha2(F.col("text").cast("binary"), 256)))
    parts = F.when(F.col("kind") == 0, paragraphs()).otherwise(sentences())
    # both versions of a text lie in one task, by paragraphs (p_) and by sentences
    of = lambda v, k, c: F.first(F.when((F.col("version") == v) & (F.col("kind") == k), F.col(c)), ignorenulls=True)
    sums = [of(v, k, c).alias(f"{a}{b}{c}") for v, a in enumerate(("", "e_")) for k, b in enumerate(("p_", "")) for c in ("units", "words")]
    both = fingerprint(keyed, [*own, "version", "kind", "edited_sha256"], parts).groupBy(*own).agg(F.max("edited_sha256").alias("edited_sha256"), *sums)
    prints = written(both.drop("key"), "fingerprints").withColumn("same", F.xxhash64("p_units", "p_words"))
    whole = lambda p: F.concat(as_text(F.col(f"{p}p_words"), F.col(f"{p}p_units")), as_text(F.col(f"{p}words"), F.col(f"{p}units")))
    near = lambda p, same: likeness(F.col("lanes"), F.col(f"{p}lanes"), _dot(F.col("lanes"), F.col("lanes")), _dot(F.col(f"{p}lanes"), F.col(f"{p}lanes")), same)
    of_lanes = lambda rows, *ps: rows.withColumns({f"{p}lanes": lanes(F.col(f"{p}words"), F.col(f"{p}units")) for p in ps})
    # the likeness to the edited text first, so that its sums do not move
    here = of_lanes(prints, "", "e_").withColumn("near_edited", near("e_", (F.col("p_words") == F.col("e_p_words")) & (F.col("p_units") == F.col("e_p_units")))).drop("lanes", "e_lanes")
    after = prints.select(F.col("row").alias("next_row"), F.col("units").alias("n_units"), F.col("words").alias("n_words"), F.col("same").alias("n_same"))
    row = of_lanes(here.join(after, "next_row", "left"), "", "n_").withColumn("near_next", near("n_", F.col("same") == F.col("n_same")))
    return row.select("doc_id", "n_chars", "edited_sha256", whole("").alias("fingerprint"), whole("e_").alias("edited_fingerprint"), "near_edited", "near_next")
