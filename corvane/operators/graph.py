"""Graph operators on edge tables (src, dst); fixpoints loop on the driver over distributed frontiers. Graphs of a checked size are walked on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import discard, stored

#: Edges that the driver may hold.
ON_DRIVER = 200_000


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, id, hop): all that each seed (column id) reaches, with the least number of hops; `most` bounds the hops."""
    seen = stored(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop")).distinct())
    fresh, hop = seen, 0
    while most is None or hop < most:
        hop += 1
        step = fresh.join(edges, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"), F.lit(hop).alias("hop")).distinct()
        fresh = stored(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) with a path from src to dst. Paths double in length each round, so rounds are the logarithm of the longest."""
    found = stored(edges.select("src", "dst").distinct())
    n = found.count()
    while True:
        step = found.alias("a").join(found.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        before, found = found, stored(found.union(step).distinct())
        discard(before)
        if (now := found.count()) == n:
            return found
        n = now


def cycles(edges: DataFrame, most: int = ON_DRIVER) -> DataFrame:
    """id and scc (the least member) of nodes in strongly connected components of more than one node.

    Nodes off all cycles are trimmed until at most `most` edges are left, which go to the driver. If more stay, they are cut by
    colours: each node takes the least node that reaches it; of a colour, what reaches that node is a component."""
    live, out = trimmed(edges, most), None
    kind = edges.schema["src"].dataType
    while True:
        n = live.count()
        if n <= most:
            rows = _components([tuple(r) for r in live.collect()])
            last = edges.sparkSession.createDataFrame(rows, f"id {kind.simpleString()}, scc {kind.simpleString()}")
            return last if out is None else out.unionByName(last)
        colour = _spread(live.select(F.col("src").alias("id")).union(live.select("dst")).distinct().withColumn("colour", F.col("id")), live, "src", "dst", "colour", F.min)
        same = live.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("_b")), "dst").filter("_a = _b").select("src", "dst")
        back = _spread(colour.withColumn("hit", F.col("id") == F.col("colour")), stored(same), "dst", "src", "hit", F.max)
        found = stored(back.filter("hit").select("id", F.col("colour").alias("scc")))
        large = found.join(found.groupBy("scc").count().filter("count > 1").select("scc"), "scc", "left_semi").select("id", "scc")
        out = large if out is None else out.unionByName(large)
        rest = live.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        live = trimmed(rest, most)


def _spread(nodes: DataFrame, edges: DataFrame, a: str, b: str, value: str, best) -> DataFrame:
    """`nodes` with `value` carried along `edges` from a to b until nothing changes; `best` picks among values."""
    nodes, others = stored(nodes), [c for c in nodes.columns if c != value]
    while True:
        sent = edges.join(nodes.select(F.col("id").alias(a), F.col(value).alias("_v")), a).groupBy(F.col(b).alias("id")).agg(best("_v").alias("_v"))
        pick = F.least if best is F.min else F.greatest
        after = stored(nodes.join(sent, "id", "left").select(*others, pick(F.col(value), F.coalesce("_v", value)).alias(value)))
        same = after.select("id", value).join(nodes.select("id", F.col(value).alias("_w")), "id").filter(~F.col(value).eqNullSafe(F.col("_w"))).isEmpty()
        discard(nodes)
        nodes = after
        if same:
            return nodes


def _components(edges: list[tuple]) -> list[tuple]:
    """(node, least of its component) for components of more than one node: two walks in depth, the second against the edges, in the order the first ends."""
    ahead, back = {}, {}
    for u, v in edges:
        ahead.setdefault(u, []).append(v)
        back.setdefault(v, []).append(u)
    seen, ended = set(), []
    for start in sorted({*ahead, *back}):
        if start in seen:
            continue
        seen.add(start)
        walk = [(start, iter(ahead.get(start, ())))]
        while walk:
            node, rest = walk[-1]
            for v in rest:
                if v not in seen:
                    seen.add(v)
                    walk.append((v, iter(ahead.get(v, ()))))
                    break
            else:
                ended.append(walk.pop()[0])
    out, taken = [], set()
    for start in reversed(ended):
        if start in taken:
            continue
        taken.add(start)
        group, todo = [], [start]
        while todo:
            group.append(node := todo.pop())
            fresh = [v for v in back.get(node, ()) if v not in taken]
            taken.update(fresh)
            todo += dict.fromkeys(fresh)
        if len(group) > 1:
            out += [(x, min(group)) for x in group]
    return out


def acyclic(edges: DataFrame) -> DataFrame:
    """`edges` without those inside a strongly connected component."""
    of = cycles(edges)
    a, b = of.select(F.col("id").alias("src"), F.col("scc").alias("_a")), of.select(F.col("id").alias("dst"), F.col("scc").alias("_b"))
    return edges.filter("src <> dst").join(a, "src", "left").join(b, "dst", "left").filter("_a IS NULL OR _b IS NULL OR _a <> _b").select("src", "dst")


def cycle_break(edges: DataFrame) -> DataFrame:
    """One edge of each component to leave out: from its least member to the least member of the same component that it points at. What is left may still have cycles; `acyclic` leaves out all edges inside components."""
    of = cycles(edges)
    inside = edges.join(of.select(F.col("id").alias("src"), "scc"), "src").join(of.select(F.col("id").alias("dst"), F.col("scc").alias("_b")), "dst").filter("scc = _b AND src <> dst")
    return inside.groupBy("scc").agg(F.min(F.struct("src", "dst")).alias("e")).select("scc", "e.src", "e.dst")


def trimmed(edges: DataFrame, enough: int = 0) -> DataFrame:
    """Edges that may lie on a cycle: nodes without a way in or out go, again and again, until all are gone or at most `enough` edges are left."""
    live = stored(edges.select("src", "dst").filter("src <> dst").distinct())
    n = live.count()
    while True:
        if n <= enough:
            return live
        live = stored(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if (now := live.count()) == n:
            return live
        n = now


def levels(edges: DataFrame, most: int = ON_DRIVER) -> DataFrame:
    """id and level of each node outside cycles and what depends on none: the longest path of dependencies below it."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    rest = stored(edges.select("src", "dst").distinct())
    kind = edges.schema["src"].dataType.simpleString()
    left, out, level = stored(nodes), None, 0
    while True:
        if rest.count() <= most:  # the rest is walked on the driver; what it does not name has nothing left below it
            rows = [(x, n + level) for x, n in _levels([tuple(r) for r in rest.collect()])]
            last = edges.sparkSession.createDataFrame(rows, f"id {kind}, level int")
            if out is None:
                return last
            alone = left.join(rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct(), "id", "left_anti")
            return out.unionByName(last).unionByName(alone.withColumn("level", F.lit(level)))
        ready = stored(left.join(rest.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
        if ready.isEmpty():
            break
        done = ready.withColumn("level", F.lit(level))
        out = done if out is None else out.unionByName(done)
        left, rest, gone = stored(left.join(ready, "id", "left_anti")), stored(rest.join(ready.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")), (left, rest)
        discard(*gone)
        level += 1
    return out if out is not None else nodes.withColumn("level", F.lit(0)).limit(0)


def _levels(edges: list[tuple]) -> list[tuple]:
    below, users = {}, {}
    for u, v in edges:
        below.setdefault(u, set()).add(v)
        below.setdefault(v, set())
        users.setdefault(v, []).append(u)
    left = {u: len(vs) for u, vs in below.items()}
    ready, out = [u for u, n in left.items() if not n], []
    level = 0
    while ready:
        out += [(u, level) for u in ready]
        after = []
        for v in ready:
            for u in users.get(v, ()):
                left[u] -= 1
                if not left[u]:
                    after.append(u)
        ready, level = after, level + 1
    return out


def dependency_first(edges: DataFrame, nodes: DataFrame, most: int = ON_DRIVER) -> DataFrame:
    """id and level, to be ordered by: every node after what it depends on; nodes on cycles or above them have the last level."""
    ranked = nodes.select("id").join(levels(edges, most), "id", "left")
    alone = nodes.select("id").join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "id", "left_anti").withColumn("_alone", F.lit(0))
    return ranked.join(alone, "id", "left").select("id", F.coalesce("level", "_alone", F.lit(2**31 - 1)).cast("int").alias("level"))
