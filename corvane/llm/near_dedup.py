"""Near-dedup by b-bit MinHash.

A document's set holds its distinct word shingles as 64-bit hashes. PERMUTATIONS minima of a set give BANDS bucket keys of
ROWS minima each and, by their low BITS bits, a packed signature. Equal sets are one node from the start. Candidate pairs
come from buckets; bit counts of the exclusive-or of signatures, corrected for chance matches, estimate their
similarity; what may reach the threshold (six standard errors of slack) is confirmed on the full sets. With five rows and 50
bands a pair at similarity 0.8 shares no bucket with probability 2.4e-9.

No bucket emits all its pairs. First every member is compared with one node of its bucket only, one near its middle; confirmed
links are merged to components. Buckets that still hold several components are then compared member by member inside
the task: signature against signature, across components only, each pair in the least bucket that it shares, leaving out those
already compared. Members of a bucket's largest component are not compared with each other. Members with a candidate meet again, with their full sets, and the task gives the links that join components, at most one
for each member. Buckets of more than BLOCK members are dealt in blocks, a pair of blocks a group. Two members of a bucket
are thus in one component, or have been compared: no link that a bucket holds is lost, and none is capped.

Components come from rounds of large-star and small-star steps, which never move more than the links.

Defined cases: a null text counts as empty; a document of fewer words than a shingle has one shingle, its whole sequence; one
without words has none and is linked with nothing; rows that share a doc_id are one document, linked as any of them is; a null doc_id
has no component, is kept and linked with nothing; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Room, _Kept, discard, free_name, small_batches, written

SHINGLE = 5
THRESHOLD = 80  # per cent
ROWS, BANDS, BITS = 5, 50, 2
PERMUTATIONS = ROWS * BANDS
SIG_WORDS = -(-PERMUTATIONS * BITS // 64)
SLACK = 0.18
#: Members of a bucket, and shingles of their sets, that a block of it holds or so: a task holds two blocks with their sets, some 16 MB.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Pairs of a hub that meet one copy of its row, and the most hubs there are.
SALT_ROWS, HUBS = 2000, 10_000
HOT_SHARE = 1000
#: Bytes of word hashes that a task keeps.
KEEP_BYTES = 24 << 20

_DRAW = np.random.Generator(np.random.PCG64(20240229))
_A = _DRAW.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _DRAW.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = _DRAW.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Made for each task; `keep` bytes of word hashes stay at hand, and go with the task."""

    def __init__(self, width: int, keep: int = KEEP_BYTES):
        import xxhash

        self.width, self.hash = width, _Kept(xxhash.xxh3_64_intdigest, Room(keep))

    def set_of(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingles of a text."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.array(list(map(self.hash.__getitem__, words)), np.uint64)
        n = min(self.width, len(h))
        x = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            x = _stir(x * _MIX[0] + h[i : len(h) - n + 1 + i])
        return np.unique(x)


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        out = np.minimum(out, (shingles[i : i + 256, None] * _A + _B).min(0))
    return out >> np.uint64(32)


def bands(low: np.ndarray) -> np.ndarray:
    x = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        x = _stir(x * _MIX[1] + low[i::ROWS][:BANDS])
    return x


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, in 64-bit words."""
    bits = np.zeros(SIG_WORDS * 64 // BITS, np.uint64)
    bits[: len(low)] = low & np.uint64((1 << BITS) - 1)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(bits.reshape(SIG_WORDS, -1) << shifts, axis=1)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set), sig and bands of each row."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        import xxhash

        shingler = Shingler(width)
        for batch in batches:
            n, ids, sigs, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler.set_of(text)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()))
                low = minima(s)
                sigs.append(packed(low).view(np.int64))
                keys.append(bands(low).view(np.int64))
            lists = lambda x, k: pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k, np.int32)), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), lists(sigs, SIG_WORDS), lists(keys, BANDS)], names=["doc_id", "n_shingles", "set_id", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for minima whose low bits agree by chance."""
    apart = F.lit(0)
    for i in range(SIG_WORDS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 2.0**-BITS
    return ((1 - apart / F.lit(float(PERMUTATIONS))) - chance) / (1 - chance)


def sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """id and shingles (64-bit integers in bytes) of the documents `ids` (doc_id)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")

    def shingle(batches):
        import pyarrow as pa

        shingler = Shingler(width)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingler.set_of(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "shingles"])

    return written(texts.mapInArrow(shingle, "id long, shingles binary"), "sets")


def beside(pairs: DataFrame, key: str, rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """`pairs` (a, b and more; those of the table `among`) joined with `rows` by the column `key` of both. A hub's row is copied once for every SALT_ROWS of its pairs,
    or for more where there are more than HUBS such hubs, so no task gets all pairs of one."""
    among = pairs if among is None else among
    least = max(SALT_ROWS, among.count() // HUBS)
    hubs = F.broadcast(among.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > least).select(key, F.ceil(F.col("n") / least).cast("int").alias("_copies")))  # at most HUBS rows
    spread = pairs.join(hubs, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("_copies")).cast("int"), F.lit(0))).drop("_copies")
    copied = rows.join(hubs, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1))).drop("_copies")
    return spread.join(copied, [key, "_salt"]).drop("_salt")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Of `pairs` (a < b, node ids; a table) those whose full sets reach the threshold."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, width)
    both = beside(pairs, "a", sets.select(F.col("id").alias("a"), F.col("shingles").alias("_of_a")))
    both = beside(both, "b", sets.select(F.col("id").alias("b"), F.col("shingles").alias("_of_b")), pairs).select("a", "b", "_of_a", "_of_b")

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            linked = []
            for x, y in zip(batch.column("_of_a"), batch.column("_of_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= threshold * (len(x) + len(y) - shared) and len(x) > 0)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    out = written(both.mapInArrow(compare, "a long, b long").distinct(), "linked")
    discard(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """id and least (the least id reachable) of every id in `links` (a, b); rounds of large-star and small-star steps."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    state = None
    while True:
        # large-star: each node links its larger neighbours to the least around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: each node links its smaller neighbours, and itself, to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        before, edges = edges, written(small, "links")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("least")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("least")).distinct())
        state = now


def unresolved(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, as key, node, component, lo and hi: their block is drawn from lo to hi - 1 of the bucket's blocks, `few` of which hold members outside its largest
    component, `blocks` in all."""
    spread = members.join(found.select(F.col("id").alias("node"), F.col("least").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = spread.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo != hi AND size > 2").select("key")
    rows = written(spread.join(mixed, "key").select("key", "node", "component", "n_shingles", "leader"), "mixed")
    each = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    largest = each.groupBy("key").agg(F.max(F.struct("n", (-F.col("component")).alias("minus"), "shingles")).alias("top"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    parts = lambda n, shingles: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    sized = largest.select("key", (-F.col("top.minus")).alias("_top"), parts(F.col("n") - F.col("top.n"), F.col("shingles") - F.col("top.shingles")).alias("few"), parts(F.col("top.n"), F.col("top.shingles")).alias("_many")).withColumn("blocks", F.col("few") + F.col("_many"))
    within = F.col("component") == F.col("_top")
    out = rows.filter("node != leader").join(sized, "key").select("key", "node", "component", F.when(within, F.col("few")).otherwise(0).alias("lo"), F.when(within, F.col("blocks")).otherwise(F.col("few")).alias("hi"), "few", "blocks")
    out = written(out, "unresolved")
    discard(rows)
    return out


def in_groups(rows: DataFrame) -> DataFrame:
    """`rows` of `unresolved` once for each group (key, i, j) of two blocks where they meet others, with `own`, their block. Members of a bucket's largest component do not meet each other, so
    they stand here once for each block of the others."""
    own = F.col("lo") + F.pmod(F.xxhash64("node"), F.col("hi") - F.col("lo")).cast("int")
    met = F.sequence(F.lit(0), F.when(F.col("lo") > 0, F.col("few")).otherwise(F.col("blocks")) - 1)
    spread = rows.withColumn("own", own).withColumn("_other", F.explode(met))
    return spread.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("lo", "hi", "few", "blocks", "_other")


def grouped(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def _groups(batches, columns):
    """(key, i, j) and the rows of each group, a group at a time."""
    group, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", *columns))):
            if row[:3] != group:
                if held:
                    yield group, held
                group, held = row[:3], []
            held.append(row[3:])
    if held:
        yield group, held


def _candidates(group, threshold, own, node, component, sig, bands):
    """Blocks of positions (left, right) that may be linked: in different components, near by estimate, and this key the least they share."""
    first, second = np.flatnonzero(own == group[1]), np.flatnonzero(own == group[2])
    chance = 2.0**-BITS
    for at in range(0, len(first), 128):
        left = first[at : at + 128]
        apart = np.zeros((len(left), len(second)), np.int64)
        for k in range(SIG_WORDS):
            x = sig[left, k][:, None] ^ sig[second, k][None, :]
            apart += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
        near = ((1 - apart / PERMUTATIONS) - chance) / (1 - chance) * 100 >= threshold - 100 * SLACK
        near &= component[left][:, None] != component[second][None, :]
        if group[1] == group[2]:
            near &= node[left][:, None] < node[second][None, :]
        i, j = np.nonzero(near)
        a, b = left[i], second[j]
        for part in range(0, len(a), 4096):
            x, y = a[part : part + 4096], b[part : part + 4096]
            shared = np.where(bands[x] == bands[y], bands[x], np.iinfo(np.int64).max).min(1)
            yield x[shared == group[0]], y[shared == group[0]]


_ARRAYS = ("own", "node", "component", "sig", "bands")


def _arrays(held):
    own, node, component, sig, bands = (np.array(x, np.int64) for x in zip(*(h[: len(_ARRAYS)] for h in held)))
    return own, node, component, sig.view(np.uint64), bands


def late_links(rows: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links (a, b) between components inside the buckets of `rows` (those of `unresolved`), whose signatures are in `nodes`. A task gives the links that join components, no others."""

    def involve(batches):
        import pyarrow as pa

        for group, held in _groups(batches, _ARRAYS):
            own, node, component, sig, bands = _arrays(held)
            some = [np.concatenate(x) for x in _candidates(group, threshold, own, node, component, sig, bands)]
            at = np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(at), group[k]), t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))), pa.array(node[at]), pa.array(own[at], pa.int32()), pa.array(component[at])], names=["key", "i", "j", "node", "own", "component"])

    signed = nodes.select("node", "sig", "bands")
    # signatures join before members are copied to their groups
    involved = written(grouped(in_groups(rows.join(signed, "node"))).mapInArrow(involve, "key long, i int, j int, node long, own int, component long"), "involved")
    sets_table = sets_of(involved.select(F.col("node").alias("doc_id")).distinct(), docs, width)
    full = involved.join(signed.join(sets_table.withColumnRenamed("id", "node"), "node"), "node")

    def link(batches):
        import pyarrow as pa

        for group, held in _groups(batches, (*_ARRAYS, "shingles")):
            own, node, component, sig, bands = _arrays(held)
            sets = [np.frombuffer(h[5], np.uint64) for h in held]
            size = np.array([len(s) for s in sets])
            top: dict[int, int] = {}

            def root(x):
                while top.get(x, x) != x:
                    x = top[x] = top.get(top[x], top[x])
                return x

            a, b = [], []
            for left, right in _candidates(group, threshold, own, node, component, sig, bands):
                few, many = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
                for x, y in zip(left[ok := 100 * few >= threshold * many].tolist(), right[ok].tolist()):
                    p, q = root(component[x]), root(component[y])
                    if p == q:
                        continue
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * shared >= threshold * (size[x] + size[y] - shared):
                        top[max(p, q)] = min(p, q)
                        a.append(min(node[x], node[y]))
                        b.append(max(node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    out = written(grouped(full).mapInArrow(link, "a long, b long").distinct(), "linked")
    discard(involved, sets_table)
    return out


def led(members: DataFrame) -> DataFrame:
    """`members` (key, node, n_shingles, leader, size) with a leader near the middle: of a bucket's nodes the one whose own buckets hold most.
    Near copies of one text share its minima, so it stands in larger buckets than they do. Buckets of two need no choice."""
    weight = F.sum(F.log2(F.col("size").cast("double"))).over(Window.partitionBy("node"))  # of BANDS rows at the most
    large = members.filter("size > 2").select("key", "node", weight.alias("weight"))
    best = large.groupBy("key").agg(F.max(F.struct(F.round("weight", 6).alias("w"), (-F.col("node")).alias("n"))).alias("best")).select("key", (-F.col("best.n")).alias("_leader"))
    return written(members.join(best, "key", "left").select("key", "node", "n_shingles", F.coalesce("_leader", "leader").alias("leader")), "members")


def attached(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with the columns of `groups` (one row per key, with `size`, the rows of the key). Keys of more than a HOT_SHARE-th
    of the `total` rows, HOT_SHARE at the most, are joined by broadcast."""
    hot = F.broadcast(groups.filter(F.col("size") * HOT_SHARE > F.lit(total)))
    cold = groups.filter(F.col("size") * HOT_SHARE <= F.lit(total))
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def mark(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    found = written(signatures(docs, width), "signatures")
    real = found.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    total = real.count()
    # equal sets are one node, named by the least doc_id
    groups = written(real.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count("*").alias("size")), "sets-of")
    nodes = real.join(groups.select("set_id", F.col("node").alias("doc_id")), ["set_id", "doc_id"], "left_semi")
    nodes = written(nodes.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    sigs = nodes.select("node", "sig").dropDuplicates(["node"])
    buckets = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    multi = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("size")).filter("leader != last").select("key", "leader", "size")
    chosen = written(buckets.join(multi, "key"), "members")
    members = led(chosen)
    discard(chosen)
    # rows that share a doc_id are one document
    same = real.select(F.col("doc_id"), "set_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    shared = real.join(same, "doc_id", "left_semi").join(groups, "set_id").select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b"))
    first = written(members.filter("node != leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct(), "first")
    candidates = written(screened(first, sigs, threshold), "candidates")
    links = written(confirm(candidates, docs, width, threshold).unionByName(shared), "confirmed")
    discard(first, candidates)
    joined = components(links)
    more = unresolved(members, joined)
    if more.limit(1).count():
        late = late_links(more, nodes, docs, width, threshold)
        if late.limit(1).count():
            joined = components(links.unionByName(late))
    by_set = groups.join(joined.withColumnRenamed("id", "node"), "node", "left").select("set_id", "size", F.coalesce("least", "node").alias("component_id"))
    by_set = written(by_set, "components")
    discard(members, nodes, groups, links, more, joined)
    linked = attached(real.select("doc_id", "n_shingles", "set_id"), by_set, "set_id", total).select("doc_id", "n_shingles", "component_id")
    rest = found.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def screened(pairs: DataFrame, sigs: DataFrame, threshold: int) -> DataFrame:
    """Of `pairs` (a table) those whose estimate may reach the threshold."""
    both = beside(pairs, "a", sigs.select(F.col("node").alias("a"), F.col("sig").alias("_a")))
    both = beside(both, "b", sigs.select(F.col("node").alias("b"), F.col("sig").alias("_b")), pairs)
    return both.filter(estimate(F.col("_a"), F.col("_b")) >= threshold / 100 - SLACK).select("a", "b")


def deduplicate(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` that stay, one document of each component, all columns unchanged."""
    name = free_name(docs.columns, "_gone")
    gone = mark(docs, width, threshold).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
