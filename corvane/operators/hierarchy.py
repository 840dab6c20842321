"""The tree of modules as tables: modules (path: array of names, ord_path: array of places among siblings), listed (path, component_id, ord); parents list what their children do."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.maintain import owners
from corvane.session import ship_package


def flattened(spark: SparkSession, tree: dict) -> tuple[DataFrame, DataFrame]:
    """modules and listed of a nested tree {name: {components, path, children}}. Trees are read by the driver; they are as large as a table of contents."""
    modules, listed = [], []

    def go(level: dict, path: list, place: list) -> None:
        for i, (name, node) in enumerate(level.items()):
            modules.append(([*path, name], [*place, i], node.get("path") or ""))
            listed.extend(([*path, name], c, k) for k, c in enumerate(node.get("components") or []))
            go(node.get("children") or {}, [*path, name], [*place, i])

    go(tree, [], [])
    return spark.createDataFrame(modules, "path array<string>, ord_path array<int>, path_hint string"), spark.createDataFrame(listed, "path array<string>, component_id string, ord int")


def nested(modules: DataFrame, listed: DataFrame, components: bool = True) -> dict:
    """The nested tree of the tables, in order; without components where they are not asked for."""
    out: dict = {}
    held: dict = {}
    if components:
        for r in listed.orderBy("path", "ord").collect():
            held.setdefault(tuple(r["path"]), []).append(r["component_id"])
    for r in modules.orderBy("ord_path").collect():
        level = out
        for name in r["path"][:-1]:
            level = level[name]["children"]
        level[r["path"][-1]] = ({"path": r["path_hint"]} if "path_hint" in r else {}) | ({"components": held.get(tuple(r["path"]), [])} if components else {}) | {"children": {}}
    return out


def ordered(modules: DataFrame, children_first: bool = False) -> DataFrame:
    """Modules in pre-order or, children first, in post-order: a sort by their places, which no single task has to do."""
    key = F.concat("ord_path", F.array(F.lit(2**31 - 1))) if children_first else F.col("ord_path")
    return modules.withColumn("key", key).orderBy("key")


def leaves(modules: DataFrame) -> DataFrame:
    return modules.join(modules.filter("size(path) > 1").select(F.expr("slice(path, 1, size(path) - 1)").alias("path")).distinct(), "path", "left_anti")


def node(modules: DataFrame, path: list[str]) -> DataFrame:
    return modules.filter(F.col("path") == F.array(*map(F.lit, path)))


def ancestors(modules: DataFrame) -> DataFrame:
    """path, ancestor and distance: those above each module, the nearest first."""
    return modules.filter("size(path) > 1").select("path", F.posexplode(F.expr("transform(sequence(size(path) - 1, 1, -1), k -> slice(path, 1, k))")).alias("distance", "ancestor"))


def counts(modules: DataFrame, listed: DataFrame) -> DataFrame:
    """n_modules, n_components and names of the whole tree."""
    return modules.agg(F.count("*").alias("n_modules"), F.array_sort(F.collect_set(F.element_at("path", -1))).alias("names")).crossJoin(listed.agg(F.countDistinct("component_id").alias("n_components")))


def files_of(listed: DataFrame) -> DataFrame:
    """path and files: how many different files the components of a module, or below it, are in."""
    return listed.groupBy("path").agg(F.countDistinct(F.substring_index("component_id", "::", 1)).alias("files"))


def listed_at(listed: DataFrame, ids: DataFrame) -> DataFrame:
    """`listed` with `ids` (path, component_id) at their module and all above it."""
    more = ids.select(F.explode(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("path"), "component_id")
    return listed.select("path", "component_id").union(more).distinct()


def unlisted(listed: DataFrame, ids: DataFrame) -> DataFrame:
    return listed.join(ids.select("component_id"), "component_id", "left_anti")


def renamed(listed: DataFrame, names: DataFrame) -> DataFrame:
    """`listed` with the new names of `names` (component_id, new)."""
    return listed.join(names, "component_id", "left").withColumn("component_id", F.coalesce("new", "component_id")).drop("new").distinct()


def sane(name: Column) -> Column:
    """A name without slashes, control signs and dots at its ends; `module` where nothing is left."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>|\x00-\x1f]+', " "), r"\s+", " ")), r"^\.+|\.+$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", "module").otherwise(plain)


def unique_name(name: str, parent: str, taken: set[str]) -> str:
    """The name, else with its parent's before it, else with a number behind it; `taken` is compared without regard to case."""
    low = {x.lower() for x in taken}
    tries = [name, f"{parent} {name}".strip(), *(f"{name}_{i}" for i in range(2, len(taken) + 3))]
    return next(x for x in tries if x.lower() not in low)


def inserted(modules: DataFrame, parent: list[str], name: str) -> DataFrame:
    """`modules` with a leaf under `parent`, last among its siblings, its name made fit and unique."""
    spark = modules.sparkSession
    name = spark.range(1).select(sane(F.lit(name)).alias("n")).first()["n"]
    below = modules.filter((F.size("path") == len(parent) + 1) & (F.slice("path", 1, len(parent)) == F.array(*map(F.lit, parent)) if parent else F.size("path") == 1))
    rows = below.select("path", "ord_path").collect()  # siblings
    every = {r["n"] for r in modules.select(F.element_at("path", -1).alias("n")).distinct().collect()}
    place = node(modules, parent).select("ord_path").first()["ord_path"] if parent else []
    own = unique_name(name, parent[-1] if parent else "", every)
    fresh = spark.createDataFrame([([*parent, own], [*place, 1 + max((r["ord_path"][-1] for r in rows), default=-1)])], "path array<string>, ord_path array<int>")
    return modules.unionByName(fresh, allowMissingColumns=True)


def sub_plan(asked: DataFrame, modules: DataFrame) -> DataFrame:
    """`asked` (parent, name, ord) modules that are new under their parent: a name that is there, or was asked for before, is skipped, never numbered."""
    rows = asked.withColumn("path", F.concat("parent", F.array(sane(F.col("name"))))).withColumn("_low", F.transform("path", F.lower))
    there = modules.select(F.transform("path", F.lower).alias("_low"))
    return rows.join(there, "_low", "left_anti").groupBy("_low").agg(F.min_by("path", "ord").alias("path"), F.min("ord").alias("ord")).select("path", "ord")


def related(path: list[str], modules: DataFrame, listed: DataFrame, edges: DataFrame) -> DataFrame:
    """path and why of the modules next to one: those above it, its siblings, its children, owners of the code it uses and of code that uses it."""
    own = F.array(*map(F.lit, path))
    size = len(path)
    rows = modules.select("path", F.when((F.size("path") < size) & (F.expr(f"slice({_literal(path)}, 1, size(path))") == F.col("path")), "ancestor").when((F.size("path") == size) & (F.slice("path", 1, size - 1) == F.slice(own, 1, size - 1) if size > 1 else F.size("path") == 1) & (F.col("path") != own), "sibling").when((F.size("path") == size + 1) & (F.slice("path", 1, size) == own), "child").alias("why")).filter("why IS NOT NULL")
    held = owners(listed, modules.withColumn("ord", F.col("ord_path")))
    mine = listed.filter(F.col("path") == own).select("component_id")
    uses = edges.join(mine.withColumnRenamed("component_id", "src"), "src").join(held.withColumnRenamed("component_id", "dst"), "dst").select("path", F.lit("used").alias("why"))
    used = edges.join(mine.withColumnRenamed("component_id", "dst"), "dst").join(held.withColumnRenamed("component_id", "src"), "src").select("path", F.lit("user").alias("why"))
    return rows.unionByName(uses).unionByName(used).filter(F.col("path") != own).distinct()


def _literal(path: list[str]) -> str:
    return "array(" + ", ".join("'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in path) + ")"


def outline(modules: DataFrame, listed: DataFrame | None = None, detail: DataFrame | None = None, stale: DataFrame | None = None) -> DataFrame:
    """key and line, in order: names by depth, a mark for stale pages (path), summaries (column summary, where there is one), and the components of modules in `detail` (path)."""
    rows = modules
    if stale is not None:
        rows = rows.join(stale.select("path", F.lit(" [stale]").alias("_mark")).distinct(), "path", "left")
    mark = F.coalesce(F.col("_mark"), F.lit("")) if stale is not None else F.lit("")
    text = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.lit("- "), F.element_at("path", -1), mark, *([F.coalesce(F.concat(F.lit(": "), "summary"), F.lit(""))] if "summary" in modules.columns else []))
    out = rows.select(F.concat("ord_path", F.array(F.lit(-2))).alias("key"), text.alias("line"))
    if listed is not None and detail is not None:
        inner = listed.join(detail.select("path"), "path", "left_semi").join(modules.select("path", "ord_path"), "path")
        out = out.unionByName(inner.select(F.concat("ord_path", F.array(F.lit(-1), F.col("ord"))).alias("key"), F.concat(F.repeat(F.lit("  "), F.size("path")), F.lit("* "), F.col("component_id")).alias("line")))
    return out.orderBy("key")


def page_path(path: Column, layout: str = "hierarchical") -> Column:
    """Where a module's page lies: in folders of its ancestors, or flat by its name; the overview for no path."""
    name = F.regexp_replace(F.element_at(path, -1), r"[^\w.-]+", "_")
    folders = F.transform(F.slice(path, F.lit(1), F.greatest(F.lit(0), F.size(path) - 1)), lambda x: F.regexp_replace(x, r"[^\w.-]+", "_"))
    deep = F.concat_ws("/", folders, F.concat(name, F.lit(".md"))) if layout == "hierarchical" else F.concat(name, F.lit(".md"))
    return F.when(F.size(path) == 0, "overview.md").otherwise(deep)


def layout_of(metadata: DataFrame) -> DataFrame:
    """The layout (recorded, else flat for documents that are older than version 2, else hierarchical) of `metadata` (docs, layout, version)."""
    return metadata.select("docs", F.coalesce("layout", F.when(F.col("version") < 2, "flat"), F.lit("hierarchical")).alias("layout"))


def relative_link(from_page: str, to_page: str) -> str:
    return posixpath.relpath(to_page, posixpath.dirname(from_page) or ".")


def located(modules: DataFrame, files: DataFrame) -> DataFrame:
    """path and page: where the page of each module is, in either layout, or the one file of its name anywhere."""
    there = files.select(F.col("path").alias("_file"), F.element_at(F.split("path", "/"), -1).alias("_name"))
    one = there.groupBy("_name").agg(F.count("*").alias("n"), F.min("_file").alias("_any")).filter("n = 1").drop("n")
    rows = modules.select("path", page_path(F.col("path")).alias("_deep"), page_path(F.col("path"), "flat").alias("_flat"))
    a, b = there.select(F.col("_file").alias("_deep"), F.lit(1).alias("_a")), there.select(F.col("_file").alias("_flat"), F.lit(1).alias("_b"))
    return rows.join(a, "_deep", "left").join(b, "_flat", "left").join(one.withColumnRenamed("_name", "_flat"), "_flat", "left").select("path", F.when(F.col("_a") == 1, F.col("_deep")).when(F.col("_b") == 1, F.col("_flat")).otherwise(F.col("_any")).alias("page"))


def tree_pages(modules: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are pages: Markdown in the root, and the nested page of each module."""
    return files.filter(F.col("path").rlike(r"^[^/]+\.md$")).select("path").union(files.select("path").join(modules.select(page_path(F.col("path")).alias("path")), "path", "left_semi")).distinct()


def nearest_page(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """path and at: the nearest module above (or at) each path that still has a page (path)."""
    up = paths.select("path", F.explode(F.expr("transform(sequence(size(path), 0, -1), k -> slice(path, 1, k))")).alias("at"))
    return paths.join(up.join(pages.select(F.col("path").alias("at")), "at").groupBy("path").agg(F.max_by("at", F.size("at")).alias("at")), "path", "left")


def common_prefix(files: DataFrame) -> DataFrame:
    """grp and prefix: the folders that all paths of a group (grp, path) share: those of its least and its greatest path."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    ends = files.groupBy("grp").agg(F.min(folders).alias("a"), F.max(folders).alias("b"))
    same = F.transform(F.sequence(F.lit(1), F.size("a")), lambda k: F.slice("a", F.lit(1), k) == F.slice("b", F.lit(1), k))
    n = F.when(F.size("a") == 0, 0).otherwise(F.size(F.filter(same, lambda x: x)))
    return ends.select("grp", F.array_join(F.slice("a", F.lit(1), n), "/").alias("prefix"))


def merged_trees(batches: DataFrame) -> DataFrame:
    """`batches` (batch, name, component_id, file, ord) as one tree: groups of one name are one, ids once in the order first met; name, components, prefix."""
    first = batches.groupBy("name", "component_id", "file").agg(F.min(F.struct("batch", "ord")).alias("at"))
    ids = first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "component_id"))), lambda x: x["component_id"]).alias("components"))
    return ids.join(common_prefix(first.select(F.col("name").alias("grp"), F.col("file").alias("path"))).withColumnRenamed("grp", "name"), "name")


def joined_trees(shared: DataFrame, more: DataFrame) -> DataFrame:
    """`shared` modules and those of `more` that are not among them: nothing is changed or taken away."""
    return shared.unionByName(more.join(shared.select("path"), "path", "left_anti"), allowMissingColumns=True)


def fitted(modules: DataFrame, listed: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A saved tree on today's code: ids that are gone leave it; of files that nobody lists, each goes to the leaf with the most components in its folder, else in the nearest folder above. Gives listed and the ids that found no place."""
    kept = listed.select("path", "component_id").join(components.select(F.col("id").alias("component_id")), "component_id", "left_semi")
    free = components.select(F.col("id").alias("component_id"), F.substring_index("id", "::", 1).alias("file")).join(kept.select(F.substring_index("component_id", "::", 1).alias("file")).distinct(), "file", "left_anti")
    leaf = kept.join(leaves(modules).select("path"), "path", "left_semi").withColumn("file", F.substring_index("component_id", "::", 1))
    up = lambda df: df.withColumn("_d", F.explode(F.expr("transform(sequence(0, size(split(file, '/')) - 1), k -> array_join(slice(split(file, '/'), 1, k), '/'))")))
    votes = up(leaf).groupBy("_d", "path").agg(F.count("*").alias("n"))
    best = up(free.select("file").distinct()).join(votes, "_d").groupBy("file").agg(F.max(F.struct(F.length("_d").alias("near"), "n", "path")).alias("b")).select("file", F.col("b.path").alias("path"))
    adopted = free.join(best, "file").select("path", "component_id")
    return listed_at(kept, adopted), free.join(best, "file", "left_anti").select("component_id")


def tree_check(listed: DataFrame, components: DataFrame) -> DataFrame:
    """fault and component_id: ids of no component, components in no module, and those that several leaves claim."""
    ids = components.select(F.col("id").alias("component_id"))
    unknown = listed.select("component_id").distinct().join(ids, "component_id", "left_anti").select(F.lit("unmatched").alias("fault"), "component_id")
    left = ids.join(listed.select("component_id"), "component_id", "left_anti").select(F.lit("leftover").alias("fault"), "component_id")
    inner = listed.select("path", "component_id").distinct().alias("a")
    below = listed.select(F.col("path").alias("p"), F.col("component_id").alias("c")).distinct()
    deepest = inner.join(below, F.expr("c = component_id AND size(p) > size(path) AND slice(p, 1, size(path)) = path"), "left_anti")
    twice = deepest.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("claimed twice").alias("fault"), "component_id")
    return unknown.union(left).union(twice)


#: Claims that one task sorts, or so.
PART_CLAIMS = 500_000


def reclaimed(claims: DataFrame) -> DataFrame:
    """grp, component_id and first: claims (grp, ord, component_id) of an id that an earlier group has."""
    # one shuffle by id, whose parts are sorted: nearly all claims differ, so sums made before it would only fill memory; there are as many parts as keep each to some PART_CLAIMS
    rows = claims.filter("component_id IS NOT NULL AND ord IS NOT NULL").select("grp", "component_id", "ord")
    parts = max(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_CLAIMS))
    by = Window.partitionBy("component_id").orderBy("ord", "grp")
    ranked = rows.repartition(parts, "component_id").select("grp", "component_id", "ord", F.first("ord").over(by).alias("_ord"), F.first("grp").over(by).alias("first"))
    return ranked.filter("ord > _ord").select("grp", "component_id", "first").distinct()


def ownership_report(claims: DataFrame, components: DataFrame) -> DataFrame:
    """grp and line: how many ids a group claims, how many are unknown, how many were claimed before it."""
    known = components.select(F.col("id").alias("component_id"), F.lit(1).alias("_k"))
    late = reclaimed(claims).groupBy("grp").agg(F.countDistinct("component_id").alias("late"))
    n = claims.join(known, "component_id", "left").groupBy("grp").agg(F.countDistinct("component_id").alias("n"), F.count(F.when(F.col("_k").isNull(), 1)).alias("unknown"))
    return n.join(late, "grp", "left").select("grp", F.format_string("%s: %d components, %d unknown, %d claimed before", "grp", "n", "unknown", F.coalesce("late", F.lit(0).cast("long"))).alias("line"))


def navigation(modules: DataFrame, titles: DataFrame | None = None, layout: str = "hierarchical") -> DataFrame:
    """key, depth, title and page of a site's menu, in order; titles (path, title) where pages have one."""
    rows = modules.select("path", "ord_path")
    if titles is not None:
        rows = rows.join(titles, "path", "left")
    title = F.coalesce("title", F.element_at("path", -1)) if titles is not None else F.element_at("path", -1)
    return rows.select(F.col("ord_path").alias("key"), F.size("path").alias("depth"), title.alias("title"), page_path(F.col("path"), layout).alias("page")).orderBy("key")


def source_url(repository: Column, revision: Column, file: Column, line: Column) -> Column:
    """Where a line is to be seen on the web: the address of the repository without user, `.git` and a slash at its end."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(repository, r"^git@([^:]+):", "https://$1/"), r"^(https?://)[^/@]+@", "$1"), r"(\.git)?/*$", "")
    return F.concat(base, F.lit("/blob/"), F.coalesce(revision, F.lit("HEAD")), F.lit("/"), file, F.coalesce(F.concat(F.lit("#L"), line.cast("string")), F.lit("")))


# ---- moving pages


def _outside_fences(text: str, change) -> str:
    out, fence = [], None
    for line in text.split("\n"):
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if m and fence is None:
            fence = m[1]
        elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            fence = None
        elif fence is None:
            line = change(line)
        out.append(line)
    return "\n".join(out)


def relinked(text: str, old: str, new: str, moved: dict[str, str]) -> str:
    """A page that goes from `old` to `new`, its links to pages (`moved`: old to new) set right; code and addresses stay."""

    def link(m):
        target, _, anchor = m[2].partition("#")
        if not target.endswith(".md") or re.match(r"[a-z]+:|/", target):
            return m[0]
        there = posixpath.normpath(posixpath.join(posixpath.dirname(old), target))
        return f"{m[1]}({relative_link(new, moved.get(there, there))}{'#' + anchor if anchor else ''})"

    line = lambda x: "".join(p if i % 2 else re.sub(r"(\[[^\]]*\])\(([^)\s]+)\)", link, p) for i, p in enumerate(re.split(r"(`[^`]*`)", x)))
    return _outside_fences(text, line)


def relocated(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """`pages` (page, text) at their new places (moves: old, new), links among them rewritten; the moves of a documentation are as many as its pages, and are broadcast."""
    moved = {r["old"]: r["new"] for r in moves.collect()}
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(moved)

    def run(frames):
        for frame in frames:
            new = [shared.value.get(p, p) for p in frame["page"]]
            yield frame.assign(page=new, text=[relinked(t or "", p, n, shared.value) for p, n, t in zip(frame["page"], new, frame["text"])])

    return pages.select("page", "text").mapInPandas(run, "page string, text string")
