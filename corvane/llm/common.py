"""Shared pieces of the training-data operators: scratch tables, sources and tokenizers."""

from __future__ import annotations

import os
import re
import string
import uuid
from array import array
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import discard, shared_dir, ship_package, stored  # noqa: F401

PUNCTUATION = string.punctuation
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows per Arrow batch. A row may hold a whole document, so batches stay small.
ARROW_ROWS = 1000
ARROW_BYTES = "8m"
#: Bytes of chunks whose ids a worker keeps, and the longest chunk that it keeps, in characters.
KEEP_BYTES = 192 << 20
LONGEST_KEY = 64


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder. It cuts the lineage, and outlives executors; `discard` removes it."""
    return stored(df, name, compression="zstd")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Prepares a session for functions on Arrow batches: the package on the workers, few rows and bytes a batch."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def free_name(taken: Iterable[str], name: str) -> str:
    """`name`, or with a number after it, so that it is none of the columns `taken`."""
    taken = {x.lower() for x in taken}
    return next(x for i in range(len(taken) + 1) if (x := f"{name}{i or ''}") not in taken)


def ascii_lower(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, UPPER.lower())


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# fixed values: the splitting patterns of the public vocabularies
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def byte_stand_ins() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def word_and_marks(chunk: str) -> tuple[str, str]:
    """A chunk that is letters (after a blank, perhaps), then ASCII punctuation (perhaps): both patterns split it in these two. Else ("", "")."""
    word = chunk.rstrip(PUNCTUATION)
    letters = word[1:] if word[:1] == " " else word
    return (word, chunk[len(word) :]) if letters.isalpha() else ("", "")


class ChunkEncoder:
    """Encodes with the tokenizers library, chunk by chunk, keeping what frequent chunks encode to.

    A byte-level vocabulary never merges across the start of a white-space run, and a
    word vocabulary never across white space, so the ids of a text are those of its chunks in
    a row. The stores are bounded by `keep` bytes together; chunks met later are encoded each time. Texts with
    white space on which Python and the library disagree go to the library whole.
    """

    _known: dict[tuple[str, int], ChunkEncoder] = {}

    def __init__(self, path: str, keep: int = KEEP_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.by_word = "</w>" in (getattr(self.tokenizer.model, "end_of_word_suffix", None) or "")
        self.model = self.tokenizer.model
        self.stand_in = byte_stand_ins()
        self.blank = self.stand_in[0x20]
        self.split = regex.compile(WORD_PATTERN if self.by_word else BYTE_PATTERN).findall
        room = Room(keep)
        self.parts = _Kept(self._part, room)
        self.first = _Kept(self._chunk, room)
        self.rest = self.first if self.by_word else _Kept(self._after_blank, room)
        self.odd = re.compile(r"[\x1c-\x1f]").search
        self.other_space = re.compile(r"[^\S \n]").search
        self.chunks = re.compile(r"\s*\S+|\s+\Z").findall

    @classmethod
    def of(cls, path: str, keep: int = KEEP_BYTES) -> ChunkEncoder:
        if (path, keep) not in cls._known:
            cls._known[path, keep] = cls(path, keep)
        return cls._known[path, keep]

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of one match of the splitting pattern, from the library's model."""
        # of printable ASCII only the blank has a stand-in other than itself
        shown = part.replace(" ", self.blank) if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.stand_in)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of one chunk. Plain Latin chunks are split here, so that their parts are found again; others go to the library."""
        if not (chunk.isascii() or max(chunk) < "\u0250") or "<|" in chunk:
            return self._ids(chunk)
        if self.by_word:
            if "\u0130" in chunk:  # below U+0250 all is in normal form C, and this alone lower-cases to two
                return self._ids(chunk)
            chunk = chunk.lower()
        word, marks = word_and_marks(chunk)
        if word:
            if not marks:  # kept by who asks, under the chunk
                return self._part(word)
            bare = self.rest[word[1:]] if word[0] == " " else self.first[word]
            return bare + self.parts[marks]
        return b"".join(map(self.parts.__getitem__, self.split(chunk)))

    def _after_blank(self, piece: str) -> bytes:
        """The ids of a blank and `piece`, which has no blank. Words, the most frequent case, first."""
        word = piece.rstrip(PUNCTUATION)
        if word.isalpha():
            if word.isascii():
                if len(word) == len(piece):
                    return array("I", [t.id for t in self.model.tokenize(self.blank + piece)]).tobytes()
                if "<|" not in piece:
                    return self.rest[word] + self.parts[piece[len(word) :]]
        elif self.other_space(piece):
            raise _OtherSpace
        return self._chunk(" " + piece)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.by_word:
            return self._ids(text) if self.odd(text) else b"".join(map(self.first.__getitem__, text.split()))
        if not ("  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace()):
            head, *pieces = text.split(" ")
            if not self.other_space(head):
                try:  # a piece with other white space is never kept, so each one is noticed
                    return self.first[head] + b"".join(map(self.rest.__getitem__, pieces))
                except _OtherSpace:
                    pass
        return self._ids(text) if self.odd(text) else b"".join(map(self.first.__getitem__, self.chunks(text)))


class _OtherSpace(Exception):
    """White space other than blanks and line ends is in a piece."""


class Room:
    """Bytes that the stores of one encoder share."""

    def __init__(self, size: int):
        self.left = size


class _Kept(dict):
    """What `make` gives for a key, remembered for the first keys that `room` has bytes for. Long keys are not kept: they seldom recur."""

    def __init__(self, make, room: Room):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if self.room.left > 0 and (n := len(key)) <= LONGEST_KEY:
            # a dict's entry, a string of up to 4 bytes a character, and ids or the like, no more than characters or so
            self.room.left -= 180 + 6 * n
            self[key] = value
        return value


def texts_of(batch, name: str = "text") -> Iterable[str]:
    """The texts of an Arrow batch, null as empty."""
    return (x or "" for x in batch.column(name).to_pylist())


def ranked(rows: DataFrame, group: str, order: list) -> tuple[DataFrame, DataFrame]:
    """`rows`, stored, with `rank` (from 0) within each value of `group` (null is one) by `order`; and group, n of each value.

    Rows are dealt out by ranges of (group, order), so a hot group spreads over many tasks. Each task numbers what it has; how many rows of a group lie
    in the ranges before is added from a table of a row per range and group that meet, which is broadcast: at most partitions + groups rows.
    """
    spark = rows.sparkSession
    keys = [F.col(group).asc(), *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    numbered = written(numbered, "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = written(numbered.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "ranks")
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = numbered.join(F.broadcast(shift), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn("rank", F.col("_at") + F.col("_shift"))
    return out.select(*rows.columns, "rank"), sizes.groupBy(group).agg(F.sum("_n").alias("n"))
