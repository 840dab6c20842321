"""Merkle manifest of a dataset: distributed blocks, a small top tree on the driver, its suffix paths broadcast.

A row's leaf is the SHA-256 of its fields, each length-prefixed. Per language, leaves stand in the order of doc_id; every 8
consecutive nodes become one until one is left, the language's subroot, and subroots become the root alike.

1. Leaves are hashed in the scan, without a shuffle of texts, and numbered per language by ranges of (lang, doc_id), so a hot language spreads.
2. Blocks of 512 nodes (3 levels) are reduced to one node each, in rounds until at most TOP nodes are left: every round divides them by 512.
3. The driver builds the top tree over those nodes (at most TOP, or one per language), and broadcasts for each of them its suffix path: the siblings from it up
   to the root, 32 bytes each, some 900 bytes for 4 levels.
4. Block by block, executors put the lower part of the path before the suffix, hash the proof and fold a leaf with it to a root. Where it took more
   than one round, the paths of the rounds between are tables that meet their blocks in a shuffle; only the topmost are broadcast.

Defined cases: every null field is `-`, so null and empty texts differ; rows that repeat a doc_id stand in the order of their leaves (null doc_ids first), equal rows
in any order; a single leaf is its own subroot, a single subroot the root, and a path may be empty (its digest is that of no bytes); an empty table has no
rows and no root. Columns other than doc_id, source, lang, n_chars and text are not read. More than MOST_LANGS languages are refused.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, ranked, small_batches, written

ARITY = 8
#: Levels of a block, and the nodes that it has for that.
HEIGHT = 3
#: Nodes that the driver takes at the most (unless there are more languages): 4096 paths of some 900 bytes are 4 MB.
TOP = 4096
MOST_LANGS = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The digest of a row, 32 bytes; `instead` replaces columns."""
    return F.unhex(F.sha2(F.concat(*[field(instead.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256))


def levels(n: int) -> int:
    """Levels above `n` nodes until one is left."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


def joined(hexes: list[str]) -> list[str]:
    """The runs of a level, each as one string of digests."""
    return ["".join(hexes[i : i + ARITY]) for i in range(0, len(hexes), ARITY)]


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(hexes: list[str], up: int) -> list[list[str]]:
    """Runs of each of `up` levels, and at last the nodes above them."""
    out = []
    for _ in range(up):
        out.append(joined(hexes))
        hexes = [H(x) for x in out[-1]]
    return [*out, hexes]


def steps(runs: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The digests to the left and to the right of node `i` and of those above it, level by level."""
    out = []
    for level in runs:
        run, at = level[i // ARITY], 64 * (i % ARITY)
        out.append((run[:at], run[at + 64 :]))
        i //= ARITY
    return out


def packed(path: list[tuple[str, str]]) -> bytes:
    """A path as bytes: of each level the numbers of digests to the left and right, and the digests."""
    return b"".join(bytes((len(a) // 64, len(b) // 64)) + bytes.fromhex(a + b) for a, b in path)


def unpacked(path: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(path):
        a, b = path[at], path[at + 1]
        both = path[at + 2 : at + 2 + 32 * (a + b)].hex()
        out.append((both[: 64 * a], both[64 * a :]))
        at += 2 + 32 * (a + b)
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that `path` gives for a node."""
    for left, right in path:
        node = H(left + node + right)
    return node


def proof_sha256(path: list[tuple[str, str]]) -> str:
    return H("".join(a + b for a, b in path))


def _blocks(batches, columns: list[str], block: int):
    """Arrow batches that are sorted by (lang_no, at), as one block after the other: (lang_no, number), and a list per column."""
    key, held = None, [[] for _ in columns]
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in columns]
        owners = [(n, a // block) for n, a in zip(batch.column("lang_no").to_pylist(), batch.column("block_at").to_pylist())]
        start = 0
        for i in range(1, len(owners) + 1):
            if i < len(owners) and owners[i] == owners[start]:
                continue
            if owners[start] != key:
                if key is not None:
                    yield key, held
                key, held = owners[start], [[] for _ in columns]
            for h, v in zip(held, values):
                h.extend(v[start:i])
            start = i
    if key is not None:
        yield key, held


@dataclass
class Manifest:
    """leaves: lang, lang_no, at, doc_id, digest, other; rounds: nodes (lang_no, at, digest) after each round of blocks, and their number per language before it;
    subroots: by lang_no; paths: of the topmost nodes; root: hexadecimal, None without rows."""

    leaves: DataFrame
    langs: list
    rounds: list[DataFrame]
    counts: list[dict[int, int]]
    subroots: dict[int, str]
    paths: dict[tuple[int, int], bytes]
    root: str | None
    height: int

    def subroot_rows(self) -> DataFrame:
        """lang, n_leaves, subroot: a row per language."""
        spark = self.leaves.sparkSession
        return spark.createDataFrame([(x, self.counts[0][i], self.subroots[i]) for i, x in enumerate(self.langs)], "lang string, n_leaves long, subroot string")


def leaves_of(docs: DataFrame, text_now: Column | None = None) -> DataFrame:
    """lang, doc_id, digest and, where `text_now` differs from the text, other: the digest that the row has with it."""
    other = F.lit(None).cast("binary")
    if text_now is not None:
        other = F.when(~text_now.eqNullSafe(F.col("text")), leaf(text=text_now))
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), other.alias("other"))


def build(leaves: DataFrame, height: int = HEIGHT, top: int = TOP) -> Manifest:
    """The manifest of `leaves` (lang, doc_id, digest, other)."""
    spark = leaves.sparkSession
    small_batches(spark)
    rows, sizes = ranked(written(leaves, "leaves"), "lang", [F.col("doc_id").asc(), F.col("digest").asc()])
    sizes = {r["lang"]: r["n"] for r in sizes.limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    langs = sorted(sizes, key=lambda x: (x is not None, (x or "").encode()))
    numbers = spark.createDataFrame([(x, i) for i, x in enumerate(langs)], "_lang string, lang_no int")
    rows = rows.join(F.broadcast(numbers), F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "lang_no", F.col("rank").alias("at"), "doc_id", "digest", "other")
    counts, rounds, nodes = [{i: sizes[x] for i, x in enumerate(langs)}], [], rows
    while not rounds or sum(counts[-1].values()) > top and max(counts[-1].values()) > 1:
        nodes = written(reduced(nodes, counts[-1], height), f"nodes-{len(rounds)}")
        rounds.append(nodes)
        counts.append({i: -(-n // ARITY**height) for i, n in counts[-1].items()})
    by_lang: dict[int, list] = {}
    for r in sorted(nodes.collect()):  # at most `top` nodes, or one per language
        by_lang.setdefault(r["lang_no"], []).append(bytes(r["digest"]).hex())
    trees = {i: climb(x, levels(len(x))) for i, x in by_lang.items()}
    subroots = {i: t[-1][0] for i, t in trees.items()}
    above = climb([subroots[i] for i in sorted(subroots)], levels(len(subroots)))
    paths = {(i, k): packed(steps(trees[i][:-1], k) + steps(above[:-1], i)) for i, x in by_lang.items() for k in range(len(x))}
    return Manifest(rows, langs, rounds, counts, subroots, paths, above[-1][0] if subroots else None, height)


def by_block(nodes: DataFrame, block: int) -> DataFrame:
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.withColumn("block_at", F.col("at")).repartition(parts, "lang_no", F.floor(F.col("at") / block)).sortWithinPartitions("lang_no", "at")


def reduced(nodes: DataFrame, counts: dict[int, int], height: int) -> DataFrame:
    """The nodes `height` levels above `nodes`, or fewer where a language has one node before."""
    block = ARITY**height
    up = {i: min(height, levels(n)) for i, n in counts.items()}

    def run(batches):
        import pyarrow as pa

        for (no, number), (digests,) in _blocks(batches, ["digest"], block):
            nodes = climb([x.hex() for x in digests], up[no])[-1]
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([number], pa.int64()), pa.array([bytes.fromhex(nodes[0])], pa.binary())], names=["lang_no", "at", "digest"])

    return by_block(nodes.select("lang_no", "at", "digest"), block).mapInArrow(run, "lang_no int, at long, digest binary")


def _with_paths(nodes: DataFrame, counts: dict[int, int], height: int, suffixes: dict | DataFrame):
    """`nodes` by block, and the function that gives a block's path above it; `suffixes`: by key, or a table that joins each block as a row before its nodes."""
    block = ARITY**height
    up = {i: min(height, levels(n)) for i, n in counts.items()}
    if isinstance(suffixes, dict):
        shared = nodes.sparkSession.sparkContext.broadcast(suffixes)
        rows = by_block(nodes.withColumn("path", F.lit(None).cast("binary")).withColumn("is_path", F.lit(False)), block)
        return rows, up, lambda key, held: shared.value[key]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema if f.name not in ("lang_no", "at")]
    heads = suffixes.select("lang_no", (F.col("at") * block).alias("at"), *none, "path", F.lit(True).alias("is_path"))
    both = nodes.select("lang_no", "at", *[f.name for f in nodes.schema if f.name not in ("lang_no", "at")], F.lit(None).cast("binary").alias("path"), F.lit(False).alias("is_path")).unionByName(heads)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = both.withColumn("block_at", F.col("at")).repartition(parts, "lang_no", F.floor(F.col("at") / block)).sortWithinPartitions("lang_no", F.floor(F.col("at") / block), F.col("is_path").desc(), "at")
    return rows, up, lambda key, held: held


def paths_below(nodes: DataFrame, counts: dict[int, int], height: int, suffixes: dict | DataFrame) -> DataFrame:
    """lang_no, at, path of `nodes`, from the paths of the nodes that their blocks became."""
    rows, up, above = _with_paths(nodes.select("lang_no", "at", "digest"), counts, height, suffixes)

    def run(batches):
        import pyarrow as pa

        for key, (at, digests, paths, heads) in _blocks(batches, ["block_at", "digest", "path", "is_path"], ARITY**height):
            own = [i for i, h in enumerate(heads) if not h]
            suffix = above(key, paths[0])
            runs = climb([digests[i].hex() for i in own], up[key[0]])[:-1]
            out = [packed(steps(runs, k)) + suffix for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(own), pa.int32()), pa.array([at[i] for i in own], pa.int64()), pa.array(out, pa.binary())], names=["lang_no", "at", "path"])

    return rows.mapInArrow(run, "lang_no int, at long, path binary")


def proofs(m: Manifest, with_path: bool = False) -> DataFrame:
    """Per leaf: lang, doc_id, leaf, subroot, root, proof_sha256, folded_root (from `other` where it is set), verified; and `path`, packed, if asked for."""
    suffixes = m.paths
    for k in range(len(m.rounds) - 1, 0, -1):
        suffixes = written(paths_below(m.rounds[k - 1], m.counts[k], m.height, suffixes), f"paths-{k}")
    rows, up, above = _with_paths(m.leaves.select("lang_no", "at", "lang", "doc_id", "digest", "other"), m.counts[0], m.height, suffixes)
    subroots, root, block = m.subroots, m.root, ARITY**m.height

    def run(batches):
        import pyarrow as pa

        for key, (langs, ids, digests, others, paths, heads) in _blocks(batches, ["lang", "doc_id", "digest", "other", "path", "is_path"], block):
            own = [i for i, h in enumerate(heads) if not h]
            suffix = above(key, paths[0])
            upper = unpacked(suffix)
            tail = "".join(a + b for a, b in upper)
            hexes = [digests[i].hex() for i in own]
            runs = climb(hexes, up[key[0]])[:-1]
            proof, folded, packs = [], [], []
            for k, i in enumerate(own):
                lower = steps(runs, k)
                proof.append(H("".join(a + b for a, b in lower) + tail))
                folded.append(fold(fold(hexes[k] if others[i] is None else others[i].hex(), lower), upper))
                packs.append(packed(lower) + suffix if with_path else None)
            n = len(own)
            columns = [pa.array([langs[i] for i in own], pa.string()), pa.array([ids[i] for i in own], pa.int64()), pa.array(hexes), pa.array([subroots[key[0]]] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), pa.array([x == root for x in folded]), pa.array(packs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path"])

    out = rows.mapInArrow(run, "lang string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path binary")
    return out if with_path else out.drop("path")


def tampered_text(every: int = 3) -> Column:
    """The text, its letters A-Z lower-cased where `every` divides the checksum of doc_id."""
    return F.when(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % every == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
