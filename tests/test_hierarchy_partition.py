import pytest
from pyspark.sql import functions as F

from corvane.operators import hierarchy as H
from corvane.operators import partition as P

TREE = {"core": {"path": "src", "components": ["src/a/x.py::X", "src/a/y.py::Y", "src/b/z.py::Z"], "children": {"left": {"components": ["src/a/x.py::X", "src/a/y.py::Y"]}, "right": {"components": ["src/b/z.py::Z"]}}}, "jobs": {"components": ["jobs/n.py::N", "old.py::O"]}}


@pytest.fixture(scope="module")
def tree(spark):
    return H.flattened(spark, TREE)


def names(df, c="path"):
    return ["/".join(r[c]) for r in df.collect()]


def test_walks(spark, tree):
    modules, listed = tree
    assert names(H.ordered(modules)) == ["core", "core/left", "core/right", "jobs"] and names(H.ordered(modules, True)) == ["core/left", "core/right", "core", "jobs"]
    assert set(names(H.leaves(modules))) == {"core/left", "core/right", "jobs"} and H.node(modules, ["core", "left"]).count() == 1
    assert [("/".join(r.path), r.distance, r.ancestor) for r in H.ancestors(modules.filter("get(path, 1) = 'left'")).collect()] == [("core/left", 0, ["core"])]
    assert list(H.nested(modules, listed)["core"]["children"]) == ["left", "right"] and "components" not in H.nested(modules, listed, False)["core"]
    row = H.counts(modules, listed).first()
    assert (row.n_modules, row.n_components, row.names) == (4, 5, ["core", "jobs", "left", "right"])
    assert {"/".join(r.path): r.files for r in H.files_of(listed).collect()}["core"] == 3
    lines = [r.line for r in H.outline(modules, listed, modules.filter("path[0] = 'jobs'"), modules.filter("get(path, 1) = 'left'")).collect()]
    assert lines == ["- core", "  - left [stale]", "  - right", "- jobs", "  * jobs/n.py::N", "  * old.py::O"]
    edges = spark.createDataFrame([("src/a/x.py::X", "jobs/n.py::N"), ("src/b/z.py::Z", "src/a/x.py::X")], "src string, dst string")
    assert {("/".join(r.path), r.why) for r in H.related(["core", "left"], modules, listed, edges).collect()} == {("core", "ancestor"), ("core/right", "sibling"), ("jobs", "used"), ("core/right", "user")}


def test_changes_of_the_tree(spark, tree):
    modules, listed = tree
    more = H.listed_at(listed, spark.createDataFrame([(["core", "left"], "new::C")], "path array<string>, component_id string"))
    assert {"/".join(r.path) for r in more.filter("component_id = 'new::C'").collect()} == {"core", "core/left"}
    assert H.unlisted(more, spark.createDataFrame([("new::C",)], "component_id string")).count() == listed.count()
    assert H.renamed(listed, spark.createDataFrame([("old.py::O", "o.py::O")], "component_id string, new string")).filter("component_id = 'o.py::O'").count() == 1
    one = lambda x: spark.range(1).select(H.sane(F.lit(x)).alias("n")).first().n
    assert [one(x) for x in ("a/b:c", " .. ", "x  y.", None)] == ["a b c", "module", "x y", "module"]
    assert H.unique_name("left", "jobs", {"Left"}) == "jobs left" and H.unique_name("left", "", {"left"}) == "left_2"
    put = H.inserted(modules, ["jobs"], "left")
    assert "jobs/jobs left" in names(put) and names(H.ordered(put))[-1] == "jobs/jobs left" and "top" in names(H.inserted(modules, [], "top"))
    asked = spark.createDataFrame([(["core"], "LEFT", 0), (["core"], "mid", 1), (["core"], "Mid", 2)], "parent array<string>, name string, ord int")
    assert names(H.sub_plan(asked, modules)) == ["core/mid"]
    comps = spark.createDataFrame([("src/a/x.py::X",), ("src/a/y.py::Y",), ("src/b/z.py::Z",), ("src/a/w.py::W",), ("jobs/n.py::N",), ("far/f.py::F",)], "id string")
    fit, rest = H.fitted(modules, listed, comps)
    got = {(r.component_id, "/".join(r.path)) for r in fit.collect()}
    assert ("src/a/w.py::W", "core/left") in got and not any(c == "old.py::O" for c, _ in got) and rest.count() == 0
    assert {(r.fault, r.component_id) for r in H.tree_check(listed, comps).collect()} == {("unmatched", "old.py::O"), ("leftover", "src/a/w.py::W"), ("leftover", "far/f.py::F")}
    claims = spark.createDataFrame([("g1", 0, "a"), ("g2", 1, "a"), ("g2", 1, "b")], "grp string, ord int, component_id string")
    assert [tuple(r) for r in H.reclaimed(claims).collect()] == [("g2", "a", "g1")]
    assert {r.line for r in H.ownership_report(claims, spark.createDataFrame([("a",)], "id string")).collect()} == {"g1: 1 components, 0 unknown, 0 claimed before", "g2: 2 components, 1 unknown, 1 claimed before"}
    batches = spark.createDataFrame([(0, "A", "s/a/x::1", "s/a/x", 0), (1, "A", "s/b/y::2", "s/b/y", 0), (1, "A", "s/a/x::1", "s/a/x", 1), (1, "B", "q::3", "q", 2)], "batch int, name string, component_id string, file string, ord int")
    assert {r.name: (r.components, r.prefix) for r in H.merged_trees(batches).collect()} == {"A": (["s/a/x::1", "s/b/y::2"], "s"), "B": (["q::3"], "")}
    assert H.joined_trees(modules, put).count() == 5


def test_pages_of_modules(spark, tree):
    modules, _ = tree
    files = spark.createDataFrame([("overview.md",), ("core.md",), ("core/left.md",), ("deep/right.md",), ("notes.txt",), ("stray/x.md",)], "path string")
    assert {"/".join(r.path): r.page for r in H.located(modules, files).collect()} == {"core": "core.md", "core/left": "core/left.md", "core/right": "deep/right.md", "jobs": None}
    assert {r.path for r in H.tree_pages(modules, files).collect()} == {"overview.md", "core.md", "core/left.md"}
    assert H.nearest_page(spark.createDataFrame([(["core", "gone"],)], "path array<string>"), modules).first()["at"] == ["core"]
    assert [r.page for r in H.navigation(modules, spark.createDataFrame([(["jobs"], "Jobs!")], "path array<string>, title string")).collect()] == ["core.md", "core/left.md", "core/right.md", "jobs.md"]
    assert {r.docs: r.layout for r in H.layout_of(spark.createDataFrame([("a", "flat", 2), ("b", None, 1), ("c", None, None)], "docs string, layout string, version int")).collect()} == {"a": "flat", "b": "flat", "c": "hierarchical"}
    url = spark.range(1).select(H.source_url(F.lit("git@host:me/x.git"), F.lit(None).cast("string"), F.lit("a.py"), F.lit(3)).alias("u")).first().u
    assert url == "https://host/me/x/blob/HEAD/a.py#L3"
    text = "[a](left.md#s) [b](https://x/y.md) `[c](left.md)`\n```\n[d](left.md)\n```\n[e](../core.md)"
    pages = spark.createDataFrame([("core/right.md", text)], "page string, text string")
    moves = spark.createDataFrame([("core/right.md", "right.md"), ("core/left.md", "left.md")], "old string, new string")
    row = H.relocated(pages, moves).first()
    assert (row.page, row.text) == ("right.md", text.replace("../core.md", "core.md"))
    assert H.relative_link("a/b/c.md", "a/d.md") == "../d.md"


def test_partitions(spark):
    files = {"src/a.c": (990, 2), "src/b.c": (1000, 2), "lib/c.c": (1000, 2)}
    groups = {p: [p] for p in files}
    assert P.coalesced(groups, files, 1000, 4000) == {"src/b.c": ["src/a.c", "src/b.c"], "lib/c.c": ["lib/c.c"]} and len(P.coalesced(groups, files, 900)) == 3
    tight = {"src/t.c": (100, 1), "src/huge.c": (4000, 1), "lib/room.c": (1000, 1)}
    assert P.coalesced({p: [p] for p in tight}, tight, 1000, 4000)["lib/room.c"] == ["lib/room.c", "src/t.c"]
    ids = {"a::1": "src/a.c", "a::2": "src/a.c", "b::1": "src/b.c", "c::1": "lib/c.c"}
    got = P.normalised([("Zed", "a::1"), ("Zed", "nope"), ("Ann", "a::2"), ("Oth", "c::1"), (None, "b::1")], files, ids)
    assert got == {"Ann": ["src/a.c", "src/b.c"], "Oth": ["lib/c.c"]}
    P.validated(got, files)
    for bad in ({"x": ["src/a.c"]}, {"x": [*files, "src/a.c"]}, {"x": [*files, "q"]}):
        with pytest.raises(ValueError):
            P.validated(bad, files)
    many = {f"d{i % 3}/e{i % 2}/f{i}.py": (10, 1) for i in range(20)}
    batches = P.by_folder(many, lambda s: len(s) <= 5)
    assert sorted(p for b in batches for p in b) == sorted(many) and all(len(b) <= 5 for b in batches)
    assert [len(b) for b in P.by_folder({f"x{i}": (1, 1) for i in range(8)}, lambda s: len(s) <= 2)] == [2, 2, 2, 2]
    assert P.next_fit({"a": (5, 1), "b": (7, 1), "c": (3, 1)}, 12) == [["a", "b"], ["c"]]
    assert P.fits(8192)({"a": (0, 600)}) is False and P.fits(8192)({"a": (0, 60)})
    assert P.splits(8000, 2, 1, 3) and not P.splits(8000, 1, 1, 3) and not P.splits(10**6, 9, 3, 3) and P.splits(10**6, 9, 4, 3, overflows=True)
    assert P.folder_names([["a/x", "a/y"], ["a/z"], ["q"]]) == {"a": ["a/x", "a/y"], "a_2": ["a/z"], "root": ["q"]}
    assert P.super_groups([("G", "a"), ("H", "a"), ("G", "b"), ("S", "c"), ("G", "zz")], ["a", "b", "c", "d"]) == {"G": ["a", "b"], "c": ["c"], "d": ["d"]} and P.super_groups([("G", "a")], ["a", "b"]) is None
    assert P.sub_groups([("A", "a::1"), ("B", "c::1")], files, ids, {"src/b.c"}, 900) == {"A": ["src/a.c"], "B": ["lib/c.c"]} and P.sub_groups([], files, ids, set(files)) is None
    comps = spark.createDataFrame([(f"d{i % 3}/f{i}.py::C{k}", 900, "class", None) for i in range(30) for k in range(2)] + [("d0/f0.py::__file__", 1, "file", "script")], "id string, tokens long, component_type string, artifact_class string")
    tree = P.clustered(P.files_of(comps))
    assert sorted(p for n in tree.values() for p in n["files"]) == sorted({f"d{i % 3}/f{i}.py" for i in range(30)}) and len(tree) >= 2
    calls = []

    def broken(batch):
        calls.append(len(batch))
        raise OSError

    assert len(P.clustered(P.files_of(comps), broken)) >= 2 and len(calls) <= 3
    by_last = P.clustered(P.files_of(comps), lambda b: [("odd" if int(p[4:-3]) % 2 else "even", p) for p in b])
    assert set(by_last) == {"odd", "even"} and P.clustered(P.files_of(comps.limit(4))) == {}
    assert P.representatives(comps, spark.createDataFrame([("d0/f0.py::C0",)], "id string")).count() == 30
    assert P.scoped_tokens(comps, comps.limit(2).union(comps.limit(2))).first().tokens == 1800
    assert "[script]" in P.prompt_table(comps).filter("path = 'd0/f0.py'").first().line
    rows = spark.createDataFrame([("g", "a", 5), ("g", "b", 9), ("g", "c", 1)], "grp string, path string, tokens int")
    assert {r.path for r in P.fitting(rows, 6).filter("kept").collect()} == {"a", "c"} and P.prompt_fits(5, 5, 5, 5)
