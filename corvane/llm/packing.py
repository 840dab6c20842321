"""Best-fit packing with Martello-Toth dominance reduction.

Documents become pieces of at most `capacity` tokens. Packing needs the lengths alone, and those lie in
1..capacity: the plan is made from a histogram of at most `capacity` rows, whatever the number of
documents, and is exact for all of them, as equal lengths are interchangeable. The reduction fixes sets of
at most three pieces that dominate every other filling with their largest piece; the rest is packed best-fit,
longest first. The plan is a table of runs (length, first rank, first sequence, offset); a piece finds
its run by its rank among the pieces of its length.

Bounds: the histogram has at most `capacity` rows; ranks come from counts per length and salt (at most
capacity * SALTS rows); the plan's runs depend on the histogram, each step of the packer using up a length or a
group of bins, and not on the number of documents.

Defined cases: a null text counts as empty; each document ends with `end_id`, so the empty one is a piece of
length 1; only documents longer than `capacity` are cut; repeated rows are packed each; an empty table gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.llm.common import ChunkEncoder, small_batches, texts_of, tokenizer_path, written

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Bytes of chunks whose ids a worker keeps, so that two workers fit beside the JVM.
KEEP_BYTES = 96 << 20
#: Pieces of one length that a task ranks, and the most such tasks there are in all besides one for each length.
SALT_ROWS, MOST_SALTS = 1000, 100_000


def reduce_and_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs `counts` pieces of each length: (lengths of a sequence, number of such sequences)."""
    left = {w: n for w, n in counts.items() if n > 0}
    fixed = dominating(left, capacity)
    return fixed + best_fit(left, capacity)


def dominating(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes out of `left` the sets that dominate, longest piece first.

    For a piece j, let one, two or more others fit beside it at the most. A set {j} dominates if no other fits. {j, k},
    k the largest that fits, dominates if it fills the sequence, if no two others fit, or if at most two fit and k is as
    long as the best two together. {j, a, b}, the best two that fit, dominates if at most two fit, a = k, and b is the
    longest that can stand beside them: every other filling exchanges part by part for it.
    """
    out = []
    sizes = sorted(left)

    def drop(w: int, n: int) -> None:
        left[w] -= n
        if not left[w]:
            del left[w]
            sizes.pop(bisect.bisect_left(sizes, w))

    def smallest(skip: int, n: int) -> list[int]:
        """The n smallest lengths, one piece of `skip` left out."""
        got: list[int] = []
        for w in sizes:
            got += [w] * min(n - len(got), left[w] - (w == skip))
            if len(got) == n:
                break
        return got

    def largest(room: int, but: dict[int, int]) -> int | None:
        i = bisect.bisect_right(sizes, room) - 1
        while i >= 0 and left[sizes[i]] <= but.get(sizes[i], 0):
            i -= 1
        return sizes[i] if i >= 0 else None

    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            k = largest(room, {j: 1})
            if k is None:
                out.append(((j,), n := left[j]))
                drop(j, n)
                continue
            low = smallest(j, 3)
            two, three = len(low) > 1 and sum(low[:2]) <= room, len(low) > 2 and sum(low) <= room
            n = left[j] // 2 if j == k else min(left[j], left[k])
            if k == room or not two:
                out.append(((j, k), n))
                drop(j, n)
                drop(k, n)
                continue
            if three:
                break
            best = None  # the best two that fit
            for a in reversed(sizes[: bisect.bisect_right(sizes, room)]):
                if best and 2 * a <= sum(best):
                    break
                if left[a] > (a == j) and (b := largest(min(a, room - a), {j: 1, a: 1} if a != j else {j: 2})) is not None:
                    best = max(best or (0, 0), (a, b), key=sum)
            if best is None or k >= sum(best):
                out.append(((j, k), 1))
                drop(j, 1)
                drop(k, 1)
            elif best[0] == k and best[1] == largest(room - low[0], {j: 1, k: 1}):
                out.append(((j, *best), 1))
                for w in (j, *best):
                    drop(w, 1)
            else:
                break
    return out


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, longest first; all pieces of a length at once."""
    full, bins, rooms = [], defaultdict(list), []  # bins: by the room left, (lengths, number)

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if n and not room:
            full.append((lengths, n))
        elif n:
            if not bins[room]:
                bisect.insort(rooms, room)
            bins[room].append((lengths, n))

    for w in sorted(left, reverse=True):
        need = left[w]
        while need:
            if (i := bisect.bisect_left(rooms, w)) == len(rooms):
                each, lengths, have, room = capacity // w, (), -(-need // (capacity // w)), capacity
            else:
                room = rooms[i]
                lengths, have = bins[room].pop()
                if not bins[room]:
                    rooms.pop(i)
                each = room // w
            whole = min(have, need // each)
            put(room - each * w, lengths + (w,) * each, whole)
            need -= whole * each
            if whole < have and need:
                put(room - need * w, lengths + (w,) * need, 1)
                need, whole = 0, whole + 1
            if lengths:
                put(room, lengths, have - whole)
    return full + [x for group in bins.values() for x in group]


def runs_of(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: first ranks (ascending), first sequences and offsets."""
    runs: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    rank: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, n in plan:
        at = 0
        for w in lengths:
            for column, x in zip(runs[w], (rank[w], base, at)):
                column.append(x)
            rank[w] += n
            at += w
        base += n
    return dict(runs)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path(VOCABULARY)
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        import pyarrow as pa

        encoder = ChunkEncoder.of(path, KEEP_BYTES)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = encoder.encode(text) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`parts` (with doc_id, piece and length) with sequence_id and offset."""
    spark = parts.sparkSession
    sizes = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    most = max(SALT_ROWS, sum(sizes.values()) // MOST_SALTS)
    salts = spark.createDataFrame([(w, -(-n // most)) for w, n in sizes.items()], "length long, _salts long")
    # a task ranks `most` pieces or so, however many pieces have one length
    parts = parts.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_salts")).cast("int")).drop("_salts").select(*parts.columns, "_salt")
    per = parts.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    counts = sorted((r["length"], r["_salt"], r["n"]) for r in per.collect())  # at most capacity + MOST_SALTS rows
    total: dict[int, int] = defaultdict(int)
    first = {}
    for w, salt, n in counts:
        first[w, salt] = total[w]
        total[w] += n
    runs = spark.sparkContext.broadcast(runs_of(reduce_and_fit(dict(total), capacity)))
    before = spark.createDataFrame([(w, s, n) for (w, s), n in first.items()], "length long, _salt int, _before long")
    nth = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    small_batches(spark)
    ranked = parts.withColumn("_nth", F.row_number().over(nth) - 1).join(F.broadcast(before), ["length", "_salt"]).withColumn("_rank", F.col("_nth") + F.col("_before")).drop("_salt", "_nth", "_before")
    names = [c for c in ranked.columns if c != "_rank"]

    schema = StructType([f for f in ranked.schema if f.name != "_rank"]).add("sequence_id", "long").add("offset", "long")

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        known = {w: tuple(map(np.asarray, x)) for w, x in runs.value.items()}
        for batch in batches:
            lengths, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for w in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == w)
                ranks, bases, offsets = known[w]
                i = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at], offset[at] = bases[i] + rank[at] - ranks[i], offsets[i]
            # the columns pass through as they are: a null beside a large doc_id changes nothing
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, schema).select(*[c for c in parts.columns if c != "_salt"], "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """All documents in sequences of at most `capacity` tokens: a row per piece."""
    return place(written(pieces(docs, capacity, end_id, path), "pieces"), capacity)
