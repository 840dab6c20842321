"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds the longest token at each place of a chunk. Tokens are taken greedily;
a token may follow another only if the pair is compatible, that is, if merging in the order of ranks
keeps their border. The test walks the merges that made both and is remembered per pair. If no
prefix of a match is compatible, the last token is taken back, and a bit per place keeps dead ends from being tried
twice: the time is linear in the chunk, and the result is exactly that of merging by rank. Decoding joins
the tokens' bytes, gathered from one buffer by a table of offsets.

Defined cases: a null text counts as empty and gives no ids; strings of special tokens give their id, as the library does;
repeated rows and empty tables need no care; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import BYTE_PATTERN, KEEP_BYTES, Room, _Kept, byte_stand_ins, small_batches, texts_of, tokenizer_path, word_and_marks

VOCABULARY = "byte_bpe_50k.json"


class BacktrackingBPE:
    _known: dict[str, BacktrackingBPE] = {}

    def __init__(self, path: str, keep: int = KEEP_BYTES):
        import ahocorasick
        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet = {c: b for b, c in byte_stand_ins().items()}
        vocabulary = data["model"]["vocab"]
        as_bytes = {t: bytes(map(alphabet.__getitem__, t)) for t in vocabulary}
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = max([*vocabulary.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for t, i in vocabulary.items():
            self.bytes[i] = as_bytes[t]
        for t, i in special.items():
            self.bytes[i] = t.encode()
        self.id = {b: vocabulary[t] for t, b in as_bytes.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves = {}
        for r, m in enumerate(data["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, pair = vocabulary[a + b], (vocabulary[a], vocabulary[b])
            self.merged[pair] = self.rank[i] = r
            self.halves[i] = pair
        # the automaton works on text, so a byte stands as the character of its number
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b) - 1, i))
        self.automaton.make_automaton()
        self.shorter = [None] * size  # the longest token that is a proper prefix
        for b, i in self.id.items():
            self.shorter[i] = next((self.id[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.id), None)
        self.lengths = list(map(len, self.bytes))
        self.pairs: dict[int, bool] = {}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.special_id = special
        self.split = regex.compile(BYTE_PATTERN).findall
        self.spaces = re.compile(r"\s*\S+|\s+\Z").findall
        self.odd, self.other_space = re.compile(r"[\x1c-\x1f]").search, re.compile(r"[^\S \n]").search
        self.room = Room(keep)
        self.first, self.rest = _Kept(self._both, self.room), _Kept(lambda piece: self._both(" " + piece), self.room)
        self.tokens = _Kept(self._encode, self.room)
        lengths = np.array(self.lengths, np.int64)
        self.decimals = [b"%d," % i for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.buffer = np.frombuffer(b"".join(self.bytes), np.uint8)

    @classmethod
    def of(cls, path: str) -> BacktrackingBPE:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between these tokens when they stand side by side."""
        known = self.pairs.get(left << 32 | right)
        return self._compare(left, right) if known is None else known

    def _compare(self, left: int, right: int) -> bool:
        a, b, limit = left, right, len(self.merged)
        rank, halves = self.rank, self.halves
        while True:
            # `limit`: merges from this rank on come after one side is whole, too late to join across the border
            if self.merged.get((a, b), limit) < limit:
                out = False
                break
            # undo the later merge of the two, which lies nearest in time
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                out = True
                break
            if ra > rb:  # of equal ranks the one on the left comes first
                limit, a = ra, halves[a][1]
            else:
                limit, b = rb + 1, halves[b][0]
        if self.room.left > 0:
            self.room.left -= 140
            self.pairs[left << 32 | right] = out
        return out

    def _encode(self, chunk: str) -> list[int]:
        """The ids of one chunk of the splitting pattern."""
        raw = chunk.encode("utf-8", "surrogatepass")
        whole = self.id.get(raw)
        if whole is not None and self._made(whole):
            return [whole]
        n = len(raw)
        longest: list[int | None] = [None] * n
        # ends ascend, so the last match that begins at a place is the longest there
        for end, (before, token) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - before] = token
        known, lengths, shorter = self.pairs.get, self.lengths, self.shorter
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            end = at + lengths[token]
            if alive[end]:
                if last < 0:
                    fits = True
                elif (fits := known(last << 32 | token)) is None:
                    fits = self._compare(last, token)
                if fits:
                    out.append(token)
                    at, last = end, token
                    if at < n:
                        token = longest[at]
                    continue
            if shorter[token] is not None:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
        return out

    def _made(self, token: int) -> bool:
        """Whether merging by rank makes this token of its own bytes: then it has no border inside."""
        a_b = self.halves.get(token)
        return a_b is None or self.compatible(*a_b) is False

    def _both(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and as decimals with a comma after each."""
        word, marks = word_and_marks(text)
        if word:  # letters and marks: no special token, and one chunk each
            ids = self.tokens[word] + self.tokens[marks] if marks else self.tokens[word]
            return array("I", ids).tobytes(), b"".join([self.decimals[i] for i in ids])
        ids: list[int] = []
        for part in self.special(text) if self.special else [text]:
            if part in self.special_id:
                ids.append(self.special_id[part])
            else:
                for chunk in self.split(part):
                    ids += self.tokens[chunk]
        return array("I", ids).tobytes(), b"".join([self.decimals[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, bytes]:
        if not text:
            return b"", b""
        if self.odd(text):
            got = [self._both(text)]
        elif self.other_space(text) or "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
            got = list(map(self.first.__getitem__, self.spaces(text)))
        else:
            head, *pieces = text.split(" ")
            got = [self.first[head], *map(self.rest.__getitem__, pieces)]
        return b"".join([x for x, _ in got]), b"".join([x for _, x in got])

    def decode(self, ids) -> bytes:
        """The bytes of an array of ids."""
        import numpy as np

        if not len(ids):
            return b""
        at, n = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(n)
        return self.buffer[np.arange(ends[-1]) + np.repeat(at - ends + n, n)].tobytes()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and its ids."""
    path = path or tokenizer_path(VOCABULARY)
    small_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe = BacktrackingBPE.of(path)
        for batch in batches:
            ids = [bpe.encode(t)[0] for t in texts_of(batch)]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids; bytes that are no UTF-8 become U+FFFD."""
    path = path or tokenizer_path(VOCABULARY)
    small_batches(rows.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe = BacktrackingBPE.of(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document, without moving the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or tokenizer_path(VOCABULARY)
    small_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe = BacktrackingBPE.of(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in texts_of(batch):
                ids, decimals = bpe.encode(text)
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(decimals[:-1]).hexdigest())
                decoded = bpe.decode(np.frombuffer(ids, "<u4").astype(np.int64)).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_offsets(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The offset table: token_id, start and length in the buffer of all tokens."""
    bpe = BacktrackingBPE.of(path or tokenizer_path(VOCABULARY))
    return spark.createDataFrame([(i, int(bpe.offsets[i]), int(bpe.offsets[i + 1] - bpe.offsets[i])) for i in range(len(bpe.bytes))], "token_id int, start long, length long")
