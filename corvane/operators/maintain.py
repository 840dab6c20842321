"""Snapshots of a component graph: what changed, where new components belong, what each module's page has to be told.

Tables: components (id, name, component_type, relative_path, source_code, docstring, parameters, base_classes), edges (src, dst),
modules (path: array of names, ord: place in pre-order), listed (path, component_id), refs (page, kind: links, ids or names, ref).
A page is named by its module's path; the overview's path is empty.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import extract
from corvane.session import discard, stored

# fixed values
TAU_RENAME, TAU_NEIGHBOURS, TAU_GROW, HOPS, TAU_FULL, TAU_TREE = 0.95, 0.5, 0.33, 1, 0.5, 0.3
#: Rows that the driver may hold where one choice depends on the one before.
ON_DRIVER = 200_000

#: What the presets of an ablation switch off, by name.
PRESETS = {"0": {"match": "substring"}, "1": {"routing": False, "reports": False}, "2": {"reports": False}, "3": {}, "3b": {"hops": 2}}


def described(components: DataFrame) -> DataFrame:
    """id, component_type, relative_path, sig (name, parameters, bases; null and empty are alike), text (source with its docstring) and body (hash without white space)."""
    empty = F.array().cast("array<string>")
    sig = F.struct("name", F.coalesce("parameters", empty).alias("parameters"), F.coalesce("base_classes", empty).alias("base_classes"))
    text = F.coalesce(T.document_source(F.col("docstring"), F.coalesce("source_code", F.lit(""))), F.lit(""))
    return components.select("id", "component_type", "relative_path", sig.alias("sig"), text.alias("text"), T.body_hash(text).alias("body"))


def _deps(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))


def matched(pairs: DataFrame) -> DataFrame:
    """`pairs` (a, b, similarity) one to one, the best first; ties go to the larger names. Pairs that are the best of both their sides are taken, round by round, which is the same as going through all in order."""
    pairs = stored(pairs.select("a", "b", "similarity"))
    rank = F.struct("similarity", "a", "b")
    out = None
    while not pairs.isEmpty():
        best = lambda c: pairs.groupBy(c).agg(F.max(rank).alias("r")).select("r.*")
        taken = stored(best("a").intersect(best("b")).select("a", "b", "similarity"))
        out = taken if out is None else out.unionByName(taken)
        pairs = stored(pairs.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti"))
    return pairs if out is None else out


def rename_pairs(old: DataFrame, new: DataFrame, tau: float = TAU_RENAME) -> DataFrame:
    """a (gone), b (come) and similarity: of one type, of like length, whose texts agree to `tau`; one to one, the best first, ties to the larger names. `old` and `new` are described.

    Equal texts of a type are one class with members on either side; only classes are compared, those with members that are gone with those with members that come, and
    whole runs of members are assigned at once, so moving many copies of one text costs no more than its classes and members."""
    kind = F.xxhash64(F.lit(0), "component_type", F.sha2("text", 256))
    side = lambda df, other, n: df.filter("trim(text) <> ''").select("id", kind.alias("class"), F.lit(n).alias("side")).join(other.select("id"), "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("class", "side").orderBy(F.col("id").desc())) - 1
    members = stored(side(old, new, 0).unionByName(side(new, old, 1)).select("id", "side", "class", rank.alias("rank")), "members")
    classes = stored(members.groupBy("class").agg(F.count(F.when(F.col("side") == 0, 1)).alias("gone"), F.count(F.when(F.col("side") == 1, 1)).alias("come")), "classes")
    rows = old.select("component_type", "text").unionByName(new.select("component_type", "text")).filter("trim(text) <> ''").select(kind.alias("id"), "text", F.length("text").alias("n_chars"), "component_type")
    rows = extract.few(rows, classes.select(F.col("class").alias("id")), all_else=True)
    near = extract.similar_pairs(rows, ["component_type"], tau, classes.filter("gone > 0").select(F.col("class").alias("id")), classes.filter("come > 0").select(F.col("class").alias("id")))
    links = near.select("a", "b", "similarity").unionByName(classes.filter("gone > 0 AND come > 0").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity")))
    runs = assigned(links, members)
    # the members of a run, one to one
    left = members.filter("side = 0").select(F.col("class").alias("a"), F.col("id").alias("_a"), F.col("rank").alias("_ra"))
    right = members.filter("side = 1").select(F.col("class").alias("b"), F.col("id").alias("_b"), F.col("rank").alias("_rb"))
    out = runs.join(left, "a").filter("_ra >= from_a AND _ra < from_a + n").withColumn("_rb", F.col("_ra") - F.col("from_a") + F.col("from_b")).join(right, ["b", "_rb"])
    return out.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "similarity")


def assigned(links: DataFrame, members: DataFrame) -> DataFrame:
    """a, b, similarity, from_a, from_b, n: runs of members (class, side, id, rank: place by falling name) that are matched, of linked classes (a: gone, b: come), as if all pairs of members went through in order of
    similarity, name and name. Where a link is the best of both its classes and no other is as good, all members that both have left are matched at once; of links as good as each other, a pair of members a round. Links that the driver can hold, with the members of their classes, are gone through there."""
    name = members.select("class", "side", "rank", "id")
    size = members.groupBy("class", "side").agg(F.count("*").alias("n"))
    of = lambda s, c: size.filter(F.col("side") == s).select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.lit(0).cast("long").alias(f"from_{c}"))
    left = stored(links.join(of(0, "a"), "a").join(of(1, "b"), "b"), "links")
    out = None
    columns = ["a", "b", "similarity", "from_a", "from_b", "n"]
    while not left.isEmpty():
        if (rest := _assigned_here(left, name)) is not None:
            discard(left)
            return rest if out is None else out.unionByName(rest)
        best = lambda c: left.groupBy(c).agg(F.max("similarity").alias(f"top_{c}"))
        ranked = left.join(best("a"), "a").join(best("b"), "b")
        level = lambda c: left.groupBy(c, "similarity").agg(F.count("*").alias(f"even_{c}"))
        tops = ranked.filter("similarity = top_a AND similarity = top_b").join(level("a"), ["a", "similarity"]).join(level("b"), ["b", "similarity"])
        tops = stored(tops, "tops")
        alone = tops.filter("even_a = 1 AND even_b = 1").withColumn("n", F.least(F.col("n_a") - F.col("from_a"), F.col("n_b") - F.col("from_b")))
        # ties: the pair with the larger names, one member each, if it is the best of both classes
        tied = tops.filter("even_a > 1 OR even_b > 1")
        first = lambda s, c: name.filter(F.col("side") == s).select(F.col("class").alias(c), F.col("rank").cast("long").alias(f"from_{c}"), F.col("id").alias(f"id_{c}"))
        tied = tied.join(first(0, "a"), ["a", "from_a"]).join(first(1, "b"), ["b", "from_b"]).withColumn("_key", F.struct("id_a", "id_b"))
        one = tied.join(tied.groupBy("a").agg(F.max("_key").alias("_ka")), "a").join(tied.groupBy("b").agg(F.max("_key").alias("_kb")), "b").filter("_key = _ka AND _key = _kb").withColumn("n", F.lit(1).cast("long"))
        taken = stored(alone.select(*columns).unionByName(one.select(*columns)), "runs")
        out = taken if out is None else out.unionByName(taken)
        used = lambda c: taken.groupBy(c).agg(F.sum("n").alias(f"used_{c}"))
        after = left.join(used("a"), "a", "left").join(used("b"), "b", "left").fillna(0, ["used_a", "used_b"])
        before, left = left, stored(after.select("a", "b", "similarity", "n_a", (F.col("from_a") + F.col("used_a")).alias("from_a"), "n_b", (F.col("from_b") + F.col("used_b")).alias("from_b")).filter("from_a < n_a AND from_b < n_b"), "links")
        discard(before, tops)
    return left.select("a", "b", "similarity", "from_a", "from_b", F.col("n_a").alias("n")) if out is None else out


def _assigned_here(left: DataFrame, name: DataFrame) -> DataFrame | None:
    """The runs of all links that are `left` (see assigned), matched on the driver; None where there are more than it may hold."""
    links, steps = left.agg(F.count("*"), F.sum(F.col("n_a") - F.col("from_a"))).first()
    if links > ON_DRIVER or steps > 10 * ON_DRIVER:
        return None
    at = lambda s, c: left.groupBy(F.lit(s).alias("side"), F.col(c).alias("class")).agg(F.max(f"from_{c}").alias("_from"))
    held = stored(name.join(at(0, "a").unionByName(at(1, "b")), ["side", "class"]).filter("rank >= _from").select("side", "class", "rank", "id"), "held")
    if held.count() > ON_DRIVER:
        discard(held)
        return None
    members = defaultdict(list)
    for r in sorted(held.collect(), key=lambda r: r["rank"]):
        members[r["side"], r["class"]].append((r["id"], r["rank"]))
    discard(held)
    levels, place, found = defaultdict(lambda: defaultdict(list)), Counter(), []
    for r in left.select("similarity", "a", "b").collect():
        levels[r["similarity"]][r["a"]].append(r["b"])
    for similarity in sorted(levels, reverse=True):
        of = levels[similarity]
        for _, a in sorted(((x, a) for a in of for x, _ in members[0, a][place[0, a] :]), reverse=True):
            of[a] = [b for b in of[a] if place[1, b] < len(members[1, b])]
            if of[a]:
                b = max(of[a], key=lambda b: members[1, b][place[1, b]][0])
                found.append((a, b, similarity, members[0, a][place[0, a]][1], members[1, b][place[1, b]][1], 1))
                place[0, a] += 1
                place[1, b] += 1
    return left.sparkSession.createDataFrame(found, "a long, b long, similarity double, from_a long, from_b long, n long")


def changes(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame, tau: float | None = TAU_RENAME) -> DataFrame:
    """A row per change: id (the new one), change (interface, body, edge, added, deleted, renamed), old_id, similarity, edges_added, edges_removed.

    Of a component in both snapshots the first of interface, body and edge counts. A renamed one whose signature changed is an interface change, too."""
    a, b = described(old).join(_deps(old_edges), "id", "left"), described(new).join(_deps(new_edges), "id", "left")
    a, b = stored(a), stored(b)
    empty = F.array().cast("array<string>")
    o, n = a.alias("o"), b.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    was, now = F.coalesce("o.deps", empty), F.coalesce("n.deps", empty)
    kind = F.when(F.col("o.id").isNull(), "added").when(F.col("n.id").isNull(), "deleted").when(F.col("o.sig") != F.col("n.sig"), "interface").when(F.col("o.body") != F.col("n.body"), "body").when(was != now, "edge")
    common = F.col("o.id").isNotNull() & F.col("n.id").isNotNull()
    diff = both.select(F.coalesce("n.id", "o.id").alias("id"), kind.alias("change"), F.col("o.id").alias("old_id"), F.lit(None).cast("double").alias("similarity"), F.when(common, F.array_except(now, was)).otherwise(empty).alias("edges_added"), F.when(common, F.array_except(was, now)).otherwise(empty).alias("edges_removed")).filter("change IS NOT NULL")
    if tau is None:
        return diff
    pairs = rename_pairs(a, b, tau)
    sig = lambda df, c: df.select(F.col("id").alias(c), F.col("sig").alias(f"_{c}"))
    told = pairs.join(sig(a, "a"), "a").join(sig(b, "b"), "b")
    row = lambda name: [F.col("b").alias("id"), F.lit(name).alias("change"), F.col("a").alias("old_id"), "similarity", empty.alias("edges_added"), empty.alias("edges_removed")]
    left = diff.join(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).withColumn("_paired", F.lit(True)), "id", "left").filter("_paired IS NULL OR change NOT IN ('added', 'deleted')").drop("_paired")
    return left.unionByName(told.select(*row("renamed"))).unionByName(told.filter("_a <> _b").select(*row("interface")))


def class_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("change").agg(F.count("*").alias("n"))


def changed_diff(old: DataFrame, new: DataFrame, found: DataFrame, most_tokens: int = 8000) -> DataFrame:
    """id and diff: a unified diff of each changed text, two lines around each place; too long ones lose their middle."""
    a, b = described(old).select(F.col("id").alias("old_id"), F.col("text").alias("_old")), described(new).select("id", F.col("text").alias("_new"))
    rows = found.filter("change IN ('interface', 'body', 'renamed')").select("id", "old_id").distinct().join(a, "old_id", "left").join(b, "id", "left")

    def run(frames):
        for frame in frames:
            frame["diff"] = [extract.unified_diff(x, y) for x, y in zip(frame["_old"], frame["_new"])]
            yield frame[["id", "diff"]]

    extract.ship_package(rows.sparkSession)
    return rows.select("id", "_old", "_new").mapInPandas(run, "id string, diff string").withColumn("diff", T.head_and_tail(F.col("diff"), 4 * most_tokens))


# ---- owners


def owners(listed: DataFrame, modules: DataFrame) -> DataFrame:
    """component_id and path: the deepest module that lists it, the first in pre-order where several do."""
    nth = Window.partitionBy("component_id").orderBy(F.size("path").desc(), "ord")
    return listed.select("path", "component_id").distinct().join(modules.select("path", "ord"), "path").withColumn("_n", F.row_number().over(nth)).filter("_n = 1").select("component_id", "path")


def resolved_owners(ids: DataFrame, owned: DataFrame) -> DataFrame:
    """id and path: its owner, or that of the nearest enclosing name, one dot at a time; null where none has one."""
    name = F.split(F.element_at(F.split("id", "::", 2), -1), r"\.")
    file = F.substring_index("id", "::", 1)
    tries = ids.select("id").distinct().withColumn("_k", F.explode(F.sequence(F.size(name), F.lit(1), F.lit(-1)))).select("id", F.when(F.contains("id", F.lit("::")), F.concat(file, F.lit("::"), F.array_join(F.slice(name, F.lit(1), F.col("_k")), "."))).otherwise(F.col("id")).alias("component_id"), "_k")
    found = tries.join(owned, "component_id").groupBy("id").agg(F.max_by("path", "_k").alias("path"))
    return ids.select("id").distinct().join(found, "id", "left")


def units(modules: DataFrame, owned: DataFrame) -> DataFrame:
    """path of modules that are leaves or own a component themselves."""
    parents = modules.filter("size(path) > 1").select(F.expr("slice(path, 1, size(path) - 1)").alias("path")).distinct()
    leaves = modules.select("path").join(parents, "path", "left_anti")
    return leaves.union(modules.select("path").join(owned.select("path").distinct(), "path", "left_semi")).distinct()


# ---- routing


def routed(added: DataFrame, components: DataFrame, owned: DataFrame, edges: DataFrame, tau: float = TAU_NEIGHBOURS, decide=None) -> DataFrame:
    """id, rule and path of each of the `added` ids, in order of ids, each placement known to those after it. Rule 1: the leaf that owns most
    components of its file. 2: the one leaf that owns any in its directory. 3: the leaf with a share of `tau` or more of the owned neighbours.
    4: what `decide` (DataFrame of id to DataFrame of id, path) says; else untracked. What they meet (their files, directories, neighbours) is gathered first and
    must fit the driver, as each choice depends on those before."""
    spark = added.sparkSession
    place = lambda df: df.withColumn("file", F.substring_index("id", "::", 1)).withColumn("dir", F.regexp_extract(F.substring_index("id", "::", 1), "^(.*)/[^/]*$", 1))
    new = stored(place(added.select("id").distinct()))
    if (n := new.count()) > ON_DRIVER:
        raise ValueError(f"{n} added components are more than one driver routes in order; route them by directory")
    held = place(owned.select(F.col("component_id").alias("id"), "path"))
    by_file = held.join(F.broadcast(new.select("file").distinct()), "file").groupBy("file", "path").agg(F.count("*").alias("n")).collect()
    by_dir = held.join(F.broadcast(new.select("dir").distinct()), "dir").select("dir", "path").distinct().collect()
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).filter("id <> other").distinct()
    near = both.join(F.broadcast(new.select("id")), "id")
    near = near.join(resolved_owners(near.select(F.col("other").alias("id")), owned).select(F.col("id").alias("other"), "path"), "other", "left").collect()
    files, dirs, around, out = defaultdict(Counter), defaultdict(set), defaultdict(list), []
    for r in by_file:
        files[r["file"]][tuple(r["path"])] = r["n"]
    for r in by_dir:
        dirs[r["dir"]].add(tuple(r["path"]))
    for r in near:
        around[r["id"]].append((r["other"], tuple(r["path"]) if r["path"] else None))
    placed: dict[str, tuple] = {}
    for r in sorted(new.collect(), key=lambda r: r["id"]):
        votes = Counter(p for p in (placed.get(o, p) for o, p in around[r["id"]]) if p)
        first = lambda c: max(sorted(c.items()), key=lambda x: x[1])
        if files[r["file"]]:
            rule, path = "1", first(files[r["file"]])[0]
        elif len(dirs[r["dir"]]) == 1:
            rule, path = "2", next(iter(dirs[r["dir"]]))
        elif votes and first(votes)[1] >= tau * votes.total():
            rule, path = "3", first(votes)[0]
        else:
            out.append((r["id"], None, None))
            continue
        placed[r["id"]] = path
        files[r["file"]][path] += 1
        dirs[r["dir"]].add(path)
        out.append((r["id"], rule, list(path)))
    rows = spark.createDataFrame(out, "id string, rule string, path array<string>")
    if decide is not None and any(rule is None for _, rule, _ in out):
        said = decide(rows.filter("rule IS NULL").select("id")).select("id", F.col("path").alias("_said"))
        rows = rows.join(said, "id", "left").select("id", F.when(F.col("rule").isNull() & F.col("_said").isNotNull(), "4").otherwise(F.col("rule")).alias("rule"), F.coalesce("path", "_said").alias("path"))
    return rows.withColumn("rule", F.coalesce("rule", F.lit("untracked")))


def by_rules(ids: DataFrame, owned: DataFrame, edges: DataFrame, tau: float = TAU_NEIGHBOURS) -> DataFrame:
    """id, rule and path of `ids` (id), each on its own, by what is owned now: rules 1 to 3 of `routed` as joins; no row where none holds. Ties go to the path that sorts first."""
    place = lambda df: df.withColumn("file", F.substring_index("id", "::", 1)).withColumn("dir", F.regexp_extract(F.substring_index("id", "::", 1), "^(.*)/[^/]*$", 1))
    new, held = place(ids.select("id").distinct()), place(owned.select(F.col("component_id").alias("id"), "path"))
    most = lambda rows, *keys: rows.groupBy(*keys, "path").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "path")).alias("b"), F.sum("n").alias("total"))
    one = new.join(most(held, "file").select("file", F.col("b.path").alias("path")), "file").select("id", F.lit("1").alias("rule"), "path")
    dirs = held.groupBy("dir").agg(F.min("path").alias("path"), F.max("path").alias("_last")).filter("path = _last").select("dir", "path")
    two = new.join(dirs, "dir").select("id", F.lit("2").alias("rule"), "path")
    around = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).filter("id <> other").distinct().join(new.select("id"), "id", "left_semi")
    owner = resolved_owners(around.select(F.col("other").alias("id")), owned).filter("path IS NOT NULL").select(F.col("id").alias("other"), "path")
    votes = most(around.join(owner, "other"), "id").filter(-F.col("b.m") >= F.lit(tau) * F.col("total"))
    three = votes.select("id", F.lit("3").alias("rule"), F.col("b.path").alias("path"))
    return one.unionByName(two).unionByName(three).groupBy("id").agg(F.min(F.struct("rule", "path")).alias("b")).select("id", "b.rule", "b.path")


def adopted(found: DataFrame, old_owned: DataFrame, new_owned: DataFrame, old_edges: DataFrame, new_edges: DataFrame, left_out: DataFrame | None = None, tau: float = TAU_NEIGHBOURS, decide=None, modules: DataFrame | None = None) -> DataFrame:
    """id, rule, path and deleted of changed components that no module lists, in neither tree: the module that answers for them this time, though the tree stays as it is. `found` are the changes (id, change),
    `left_out` (id) what routing left untracked on purpose. Deleted ids go by the old graph and tree, all others by the new ones, each on its own, so no choice depends on another. What no rule places, but for deleted ids, may be placed by
    `decide` (DataFrame of id to DataFrame of id, path; rule 4), in a module of `modules` (path) that is there."""
    ids = stored(found.groupBy("id").agg(F.min(F.col("change") == "deleted").alias("deleted")), "changed")
    for owned in (new_owned, old_owned):
        ids = ids.join(resolved_owners(ids.select("id"), owned).filter("path IS NOT NULL").select("id"), "id", "left_anti")
    if left_out is not None:
        ids = ids.join(left_out.select("id"), "id", "left_anti")
    ids = stored(ids, "untracked")
    sides = [by_rules(ids.filter(F.col("deleted") == gone), owned, edges, tau).withColumn("deleted", F.lit(gone)) for gone, owned, edges in ((True, old_owned, old_edges), (False, new_owned, new_edges))]
    out = sides[0].unionByName(sides[1])
    if decide is not None and modules is not None:
        rest = stored(ids.filter("NOT deleted").join(out, "id", "left_anti").select("id"), "unplaced")
        said = decide(rest).join(rest, "id", "left_semi").join(modules.select("path"), "path", "left_semi")
        out = out.unionByName(said.select("id", F.lit("4").alias("rule"), "path", F.lit(False).alias("deleted")))
    return out


def checked_decisions(decisions: DataFrame, modules: DataFrame) -> DataFrame:
    """`decisions` (id, action: place, create or untracked; parent, name) with `path` and `fault`: places must exist, new modules need a parent that exists (or the root) and a name no sibling has."""
    at = F.when(F.col("action") == "place", F.col("parent")).when(F.col("action") == "create", F.concat(F.coalesce("parent", F.array().cast("array<string>")), F.array("name")))
    known = modules.select(F.col("path").alias("_path"))
    parents = modules.select(F.col("path").alias("_parent"))
    rows = decisions.withColumn("path", at).join(known, F.col("path") == F.col("_path"), "left").join(parents, F.col("parent") == F.col("_parent"), "left")
    fault = F.when(~F.col("action").isin("place", "create", "untracked"), "unknown action").when((F.col("action") == "place") & F.col("_path").isNull(), "no such module").when((F.col("action") == "create") & (F.coalesce(F.trim("name"), F.lit("")) == ""), "no name").when((F.col("action") == "create") & (F.size(F.coalesce("parent", F.array().cast("array<string>"))) > 0) & F.col("_parent").isNull(), "no such parent").when((F.col("action") == "create") & F.col("_path").isNotNull(), "name is taken")
    return rows.withColumn("fault", fault).select("id", "action", F.when(F.col("fault").isNull(), F.col("path")).alias("path"), "fault")


def repaired(listed: DataFrame, found: DataFrame, routes: DataFrame) -> DataFrame:
    """`listed` (path, component_id) of the new tree: deleted ids leave every node, renamed ones change their name, routed ones join their module and all its ancestors."""
    renamed = found.filter("change = 'renamed'").select(F.col("old_id").alias("component_id"), F.col("id").alias("_new"))
    kept = listed.join(found.filter("change = 'deleted'").select(F.col("id").alias("component_id")), "component_id", "left_anti").join(renamed, "component_id", "left").select("path", F.coalesce("_new", "component_id").alias("component_id"))
    placed = routes.filter("path IS NOT NULL").select(F.explode(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("path"), F.col("id").alias("component_id"))
    return kept.union(placed).distinct()


def surviving(modules: DataFrame, listed: DataFrame) -> DataFrame:
    """Modules that hold a component, themselves or below; emptied parents go with their last child."""
    alive = listed.select(F.explode(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("path")).distinct()
    return modules.join(alive, "path", "left_semi")


def growth(routes: DataFrame, owned: DataFrame, created: DataFrame | None = None, tau: float = TAU_GROW) -> DataFrame:
    """path, entered, now_n, ratio and flagged: leaves whose newly routed components are a share of `tau` or more; not those that are new. `owned` is of the repaired tree."""
    entered = routes.filter("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("entered"))
    out = entered.join(owned.groupBy("path").agg(F.count("*").alias("now_n")), "path").withColumn("ratio", F.col("entered") / F.col("now_n")).withColumn("flagged", F.col("ratio") >= tau)
    return out if created is None else out.join(created.select("path", F.lit(True).alias("_new")), "path", "left").withColumn("flagged", F.col("flagged") & F.col("_new").isNull()).drop("_new")


def topmost(flagged: DataFrame) -> DataFrame:
    """Of the `flagged` (path) modules those under no other one: they are to be clustered again as a whole."""
    above = flagged.select("path").join(flagged.select(F.col("path").alias("_up")), F.expr("size(_up) < size(path) AND slice(path, 1, size(_up)) = _up"), "left_semi")
    return flagged.select("path").distinct().join(above, "path", "left_anti")


# ---- reports


def dependents(edges: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """seed and id: what uses each seed within `hops` steps, itself excluded."""
    step = seeds.select(F.col("id").alias("seed"), "id").distinct()
    out = None
    for _ in range(hops):
        step = step.join(edges, F.col("id") == F.col("dst")).select("seed", F.col("src").alias("id")).distinct()
        out = step if out is None else out.union(step)
    return out.filter("seed <> id").distinct()


def reports(found: DataFrame, old_owned: DataFrame, new_owned: DataFrame, old_edges: DataFrame, new_edges: DataFrame, refs: DataFrame, old_units: DataFrame, new_units: DataFrame, routes: DataFrame, hops: int = HOPS, names: DataFrame | None = None) -> DataFrame:
    """A row per unit: path, mode (create, delete, edit), own, up, context, refch, entered: sorted arrays.

    Own: changed ids that it owned or owns. Up: ids whose contract moved (interface, deleted, renamed) and that something it owns uses within `hops`
    steps of the old or new graph. Context: changed ids without an owner, at the units of their neighbours. RefCh: what its page names of the changed: ids, pages that go, and
    names (`names`: name, id; each of one component) whose contract moved; not its own."""
    owned = stored(old_owned.union(new_owned).distinct())
    hit = stored(found.select("id", "change", "old_id").withColumn("ids", F.array_distinct(F.filter(F.array("id", "old_id"), lambda x: x.isNotNull()))))
    by = hit.select("id", F.explode("ids").alias("any_id"), "change")
    all_owned = stored(resolved_owners(by.select(F.col("any_id").alias("id")), owned).filter("path IS NOT NULL").select(F.col("id").alias("any_id"), "path"))
    own = stored(by.join(all_owned.union(by.select("any_id").join(owned, F.col("any_id") == F.col("component_id")).select("any_id", "path")).distinct(), "any_id").select("path", "id").distinct())
    edges = stored(old_edges.select("src", "dst").union(new_edges.select("src", "dst")).distinct())
    moved = hit.filter("change IN ('interface', 'deleted', 'renamed')").select("id", F.explode("ids").alias("any_id")).distinct()
    reach = dependents(edges, moved.select(F.col("any_id").alias("id")), hops).select(F.col("seed").alias("any_id"), F.col("id").alias("user"))
    users = reach.join(moved.withColumnRenamed("id", "moved"), "any_id").select("moved", "user").distinct()
    user_owner = resolved_owners(users.select(F.col("user").alias("id")), owned).filter("path IS NOT NULL").select(F.col("id").alias("user"), "path")
    up = users.join(user_owner, "user").select("path", F.col("moved").alias("id")).distinct().join(own, ["path", "id"], "left_anti")
    homeless = hit.select("id").distinct().join(own.select("id"), "id", "left_anti")
    near = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).join(homeless, "id")
    near_owner = resolved_owners(near.select(F.col("other").alias("id")), owned).filter("path IS NOT NULL").select(F.col("id").alias("other"), "path")
    context = near.join(near_owner, "other").select("path", "id").distinct()
    gone = old_units.join(new_units, "path", "left_anti")
    told = moved.select(F.col("id").alias("of"), F.col("any_id").alias("ref"), F.lit("ids").alias("kind")).union(hit.select(F.col("id").alias("of"), F.explode("ids").alias("ref"), F.lit("ids").alias("kind"))).union(gone.select(F.array_join("path", "/").alias("of"), F.array_join("path", "/").alias("ref"), F.lit("links").alias("kind")))
    if names is not None:
        told = told.union(moved.join(names.select("name", F.col("id").alias("any_id")), "any_id").select(F.col("id").alias("of"), F.col("name").alias("ref"), F.lit("names").alias("kind")))
    refch = refs.withColumnRenamed("page", "path").join(told.distinct(), ["kind", "ref"]).select("path", "ref", "of").distinct()
    refch = refch.join(own.select("path", F.col("id").alias("of")), ["path", "of"], "left_anti").select("path", F.col("ref").alias("id"))
    every = old_units.withColumn("o", F.lit(1)).join(new_units.withColumn("n", F.lit(1)), "path", "full_outer").select("path", F.when(F.col("n").isNull(), "delete").when(F.col("o").isNull(), "create").otherwise("edit").alias("mode"))
    out = every
    for name, part in (("own", own), ("up", up), ("context", context), ("refch", refch), ("entered", routes.filter("path IS NOT NULL").select("path", "id"))):
        out = out.join(part.groupBy("path").agg(F.array_sort(F.collect_set("id")).alias(name)), "path", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def active(told: DataFrame) -> DataFrame:
    """Units with something to do; context alone is nothing to do."""
    return told.filter("mode <> 'edit' OR size(own) + size(up) + size(refch) + size(entered) > 0")


def ratios(told: DataFrame, new_units: DataFrame) -> DataFrame:
    """n_active, n_leaves, n_structural, r_leaf and r_tree: units that go count as active, not among the leaves, so r_leaf may exceed 1."""
    on = active(told)
    counts = on.agg(F.count("*").alias("n_active"), F.count(F.when(F.col("mode") != "edit", 1)).alias("n_structural"))
    return counts.crossJoin(new_units.agg(F.count("*").alias("n_leaves"))).withColumn("r_leaf", F.col("n_active") / F.greatest(F.lit(1), F.col("n_leaves"))).withColumn("r_tree", F.col("n_structural") / F.greatest(F.lit(1), F.col("n_leaves")))


def starts_anew(rates: DataFrame, whole: bool = False, tokens: Column | int = 0, limit: int = 36_369) -> DataFrame:
    """Whether to build everything again: too many active or structural units; with one unit for the whole repository, by its size alone."""
    return rates.withColumn("start_anew", F.lit(tokens) > limit if whole else (F.col("r_leaf") >= TAU_FULL) | (F.col("r_tree") >= TAU_TREE))


def working_order(told: DataFrame, edges: DataFrame, owned: DataFrame, modules: DataFrame) -> DataFrame:
    """path and ord of the active units: what is used before what uses it, by pre-order where free; a cycle lets its first go; units that go come last. Modules are few: the driver orders them."""
    on = [(tuple(r["path"]), r["mode"]) for r in active(told).select("path", "mode").collect()]
    place = {tuple(r["path"]): r["ord"] for r in modules.select("path", "ord").collect()}
    a, b = (owned.select(F.col("component_id").alias(c), F.col("path").alias(f"_{c}")) for c in ("src", "dst"))
    lifted = {(tuple(r[0]), tuple(r[1])) for r in edges.join(a, "src").join(b, "dst").filter("_src <> _dst").select("_src", "_dst").distinct().collect()}
    live = sorted((p for p, mode in on if mode != "delete"), key=lambda p: (place.get(p, 1 << 30), p))
    needs = {p: {q for s, q in lifted if s == p and q in live and q != p} for p in live}
    out = []
    while live:
        nxt = next((p for p in live if not needs[p]), live[0])
        live.remove(nxt)
        out.append(nxt)
        for rest in needs.values():
            rest.discard(nxt)
    out += sorted((p for p, mode in on if mode == "delete"), key=lambda p: (place.get(p, 1 << 30), p))
    return told.sparkSession.createDataFrame([(list(p), i) for i, p in enumerate(out)], "path array<string>, ord int")


def write_set(told: DataFrame, edges: DataFrame, owned: DataFrame, refs: DataFrame) -> DataFrame:
    """path and roles of pages to write: active leaves, their ancestors, the overview, units that use them, pages that refer to them; not those that go."""
    on = active(told)
    doomed = on.filter("mode = 'delete'").select("path")
    leaf = on.filter("mode <> 'delete'").select("path")
    up = on.select(F.explode(F.expr("transform(sequence(0, size(path) - 1), k -> slice(path, 1, k))")).alias("path")).distinct()
    a, b = (owned.select(F.col("component_id").alias(c), F.col("path").alias(f"_{c}")) for c in ("src", "dst"))
    uses = edges.join(a, "src").join(b, "dst").filter("_src <> _dst").join(on.select(F.col("path").alias("_dst")), "_dst", "left_semi").select(F.col("_src").alias("path")).distinct()
    refer = refs.filter("kind = 'links'").join(on.select(F.array_join("path", "/").alias("ref")), "ref", "left_semi").select(F.col("page").alias("path")).distinct()
    parts = [p.withColumn("role", F.lit(r)) for p, r in ((leaf, "leaf"), (up.filter("size(path) > 0"), "ancestor"), (up.filter("size(path) = 0"), "overview"), (uses, "dependent"), (refer, "referrer"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.join(doomed, "path", "left_anti").groupBy("path").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def cascade(touched: DataFrame) -> DataFrame:
    """path and why of pages that a change in modules (path) concerns: each, its ancestors, the overview."""
    rows = touched.select("path").distinct().select("path", F.explode(F.expr("transform(sequence(0, size(path)), k -> slice(path, 1, k))")).alias("at"))
    return rows.select(F.col("at").alias("path"), F.when(F.size("at") == 0, "overview").when(F.size("at") == F.size("path"), "module").otherwise("ancestor").alias("why")).distinct()


def touched_modules(files: DataFrame, modules: DataFrame) -> DataFrame:
    """path and file: modules (path, path_hint) of changed `files` (file): the hint is the file, its end, a folder above it or below it. Both sides meet by the folders that a file is in, and by its last names."""
    parts = F.split("file", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    hints = modules.select("path", F.rtrim(F.col("path_hint"), F.lit("/")).alias("hint")).filter("hint <> ''")
    of_file = files.select("file", F.explode(F.array_distinct(F.concat(heads, tails))).alias("hint")).join(hints, "hint")
    above = F.split("hint", "/")
    of_hint = hints.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(above)), lambda k: F.array_join(F.slice(above, F.lit(1), k), "/"))).alias("file")).join(files, "file")
    return of_file.select("path", "file").union(of_hint.select("path", "file")).distinct()


def touched_by_substring(files: DataFrame, modules: DataFrame) -> DataFrame:
    """The old rule, kept to compare with: a file and a hint of which one contains the other. Modules are broadcast, ON_DRIVER at the most, more are refused; files stay where they are."""
    hints = modules.filter("path_hint <> ''").select("path", "path_hint")
    if (n := hints.limit(ON_DRIVER + 1).count()) > ON_DRIVER:
        raise ValueError(f"more than {n - 1} modules: compare them by folders and names (touched_modules)")
    return files.join(F.broadcast(hints), F.contains("file", F.col("path_hint")) | F.contains("path_hint", F.col("file"))).select("path", "file").distinct()


# ---- pages that have gone stale


def unique_names(components: DataFrame) -> DataFrame:
    """name and id of names that one component alone bears, of five letters or more."""
    return components.filter(F.length("name") >= 5).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").select("name", "id")


def stale_items(refs: DataFrame, found: DataFrame, pages: DataFrame, names: DataFrame) -> DataFrame:
    """page, kind, old and new: ids that were renamed or deleted, unique names of them, links to pages that are gone; the first of each. `pages` (page: path as text)."""
    moved = found.filter("change IN ('renamed', 'deleted')").select(F.col("old_id").alias("ref"), F.when(F.col("change") == "renamed", F.col("id")).alias("new"))
    ids = refs.filter("kind = 'ids'").join(moved, "ref").select("page", F.lit("id").alias("kind"), F.col("ref").alias("old"), "new")
    by_name = names.join(moved.withColumnRenamed("ref", "id"), "id").select(F.col("name").alias("ref"), F.element_at(F.split(F.substring_index("new", "::", -1), r"\."), -1).alias("new"))
    called = refs.filter("kind = 'names'").join(by_name, "ref").filter("new IS NULL OR new <> ref").select("page", F.lit("name").alias("kind"), F.col("ref").alias("old"), "new")
    up = F.regexp_replace("ref", "/?[^/]*$", "")
    dead = refs.filter("kind = 'links'").join(pages.select(F.col("page").alias("ref")), "ref", "left_anti").select("page", F.lit("link").alias("kind"), F.col("ref").alias("old"), F.when(up != "", up).alias("up"))
    dead = dead.join(pages.select(F.col("page").alias("up"), F.col("page").alias("new")), "up", "left").select("page", "kind", "old", "new")
    return ids.union(called).union(dead).dropDuplicates(["page", "kind", "old"])


def changed_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """page of texts (page, text) that differ, came or went."""
    h = lambda df, c: df.select("page", F.sha1("text").alias(c))
    return h(before, "_a").join(h(after, "_b"), "page", "full_outer").filter("NOT (_a <=> _b)").select("page")


def reconciled(verdicts: DataFrame, changed: DataFrame) -> DataFrame:
    """`verdicts` (page, verdict) held against the pages that did change: no-op with a change is a patch, patch without one a no-op; pages without a verdict get one."""
    rows = verdicts.join(changed.select("page", F.lit(True).alias("_changed")), "page", "full_outer")
    return rows.select("page", F.when(F.col("_changed").isNotNull() & F.coalesce(F.col("verdict") == "no-op", F.lit(True)), "patch").when(F.col("_changed").isNull() & (F.col("verdict") == "patch"), "no-op").otherwise(F.col("verdict")).alias("verdict"), F.col("verdict").alias("said"))


def may_write(paths: DataFrame, allowed: DataFrame) -> DataFrame:
    """`paths` (page) with `allowed`: whether it is in the write set."""
    return paths.join(allowed.select("page", F.lit(True).alias("_ok")).distinct(), "page", "left").select("page", F.col("_ok").isNotNull().alias("allowed"))


def stale_pages(modules: DataFrame, listed: DataFrame, touched: DataFrame) -> DataFrame:
    """path of pages that list, themselves or below, a component of a touched file (file)."""
    hit = listed.select("path", F.substring_index("component_id", "::", 1).alias("file")).join(touched.select("file").distinct(), "file", "left_semi")
    return hit.select(F.explode(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("path")).distinct().join(modules.select("path"), "path", "left_semi")


def overlay(snapshot: DataFrame, live: DataFrame, touched: DataFrame) -> DataFrame:
    """Components (id, relative_path, deps) of a snapshot, those of `touched` files (file) replaced by the live ones, which keep the dependencies they had besides."""
    old = snapshot.select("id", F.col("deps").alias("_deps"))
    fresh = live.join(old, "id", "left").withColumn("deps", F.array_sort(F.array_union("deps", F.coalesce("_deps", F.array().cast("array<string>"))))).drop("_deps").withColumn("live", F.lit(True))
    kept = snapshot.join(touched.select(F.col("file").alias("relative_path")), "relative_path", "left_anti").join(live.select("id"), "id", "left_anti").withColumn("live", F.lit(False))
    return kept.unionByName(fresh.select(*kept.columns))


def record(found: DataFrame, told: DataFrame, preset: str = "3") -> DataFrame:
    """One row of a run's history: its preset, counts by class and by mode; to be appended to a table."""
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1)).alias(v)
    a = found.agg(*[n("change", v) for v in ("interface", "body", "edge", "added", "deleted", "renamed")])
    b = active(told).agg(*[n("mode", v).alias(f"to_{v}") for v in ("create", "delete", "edit")])
    return a.crossJoin(b).withColumn("preset", F.lit(preset)).withColumn("options", F.lit(str(PRESETS[preset])))


def rendered(told: DataFrame) -> DataFrame:
    """path and text: the report of a unit as lines."""
    line = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(f"{c}: "), F.array_join(c, ", ")))
    return told.select("path", F.concat_ws("\n", F.concat_ws(" ", F.array_join("path", "/"), F.concat(F.lit("("), "mode", F.lit(")"))), *[line(c) for c in ("own", "entered", "up", "refch", "context")]).alias("text"))


def virtual_leaf(spark: SparkSession, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """modules and listed of a repository that is documented as a whole: one unit owns everything."""
    modules = spark.createDataFrame([(["repository"], 0)], "path array<string>, ord int")
    return modules, components.select(F.array(F.lit("repository")).alias("path"), F.col("id").alias("component_id"))
