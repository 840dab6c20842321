"""Two snapshots of a small shop: one body changes, one signature, one class goes, one comes."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import maintain as M

COMPONENT = "id string, name string, component_type string, relative_path string, source_code string, docstring string, parameters array<string>, base_classes array<string>"


def comp(id_, source, parameters=None, bases=None, kind="function"):
    path, name = id_.split("::")
    return (id_, name, kind, path, source, None, parameters, bases)


OLD = [
    comp("shop/cart/add.py::add_item", "def add_item(cart, sku): return check(cart)", ["cart", "sku"]),
    comp("shop/cart/add.py::check", "def check(cart): return len(cart) < 9", ["cart"]),
    comp("shop/cart/price.py::reprice", "def reprice(cart): return 1", ["cart"]),
    comp("shop/web/views.py::page", "def page(request): return reprice(request.cart)", ["request"]),
    comp("shop/store/rows.py::Order", "class Order(Base): pass", None, ["Base"], "class"),
    comp("shop/jobs/night.py::Sweep", "class Sweep: pass", None, None, "class"),
]
NEW = [
    OLD[0],
    comp("shop/cart/add.py::check", "def check(cart): log('check'); return len(cart) < 9", ["cart"]),
    comp("shop/cart/price.py::reprice", "def reprice(cart, day): return day", ["cart", "day"]),
    OLD[3],
    OLD[5],
    comp("shop/cart/coupon.py::Coupon", "class Coupon:\n    def use(self): reprice(1, 2)", None, None, "class"),
]
EDGES = [("shop/cart/add.py::add_item", "shop/cart/add.py::check"), ("shop/web/views.py::page", "shop/cart/price.py::reprice")]
TREE = {("front",): 0, ("front", "cart"): 1, ("front", "web"): 2, ("stock",): 3, ("jobs",): 4}
OWN = {("front", "cart"): ["shop/cart/add.py::add_item", "shop/cart/add.py::check", "shop/cart/price.py::reprice"], ("front", "web"): ["shop/web/views.py::page"], ("stock",): ["shop/store/rows.py::Order"], ("jobs",): ["shop/jobs/night.py::Sweep"]}
REFS = [(["front", "web"], "links", "front/cart"), (["front", "web"], "ids", "shop/cart/price.py::reprice"), (["jobs"], "links", "front/cart"), (["jobs"], "names", "reprice"), (["stock"], "names", "Order"), ([], "links", "stock"), ([], "links", "front")]


@pytest.fixture(scope="module")
def toy(spark):
    edges = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    listed = [(list(p), c) for p, cs in OWN.items() for c in cs] + [(["front"], c) for p, cs in OWN.items() if p[0] == "front" for c in cs]
    return {
        "old": spark.createDataFrame(OLD, COMPONENT), "new": spark.createDataFrame(NEW, COMPONENT), "old_edges": edges(EDGES), "new_edges": edges([*EDGES, ("shop/cart/coupon.py::Coupon", "shop/cart/price.py::reprice")]),
        "modules": spark.createDataFrame([(list(p), i) for p, i in TREE.items()], "path array<string>, ord int"), "listed": spark.createDataFrame(listed, "path array<string>, component_id string"),
        "refs": spark.createDataFrame(REFS, "page array<string>, kind string, ref string"),
    }


def run(t, hops=1):
    found = M.changes(t["old"], t["new"], t["old_edges"], t["new_edges"])
    owned = M.owners(t["listed"], t["modules"])
    routes = M.routed(found.filter("change = 'added'"), t["new"], owned.join(found.filter("change = 'deleted'").select(F.col("id").alias("component_id")), "component_id", "left_anti"), t["new_edges"])
    listed = M.repaired(t["listed"], found, routes)
    modules = M.surviving(t["modules"], listed)
    after = M.owners(listed, modules)
    told = M.reports(found, owned, after, t["old_edges"], t["new_edges"], t["refs"], M.units(t["modules"], owned), M.units(modules, after), routes, hops, M.unique_names(t["old"].union(t["new"]).dropDuplicates(["id"])))
    return found, owned, routes, listed, modules, after, told


def test_one_update_from_end_to_end(spark, toy):
    found, owned, routes, listed, modules, after, told = run(toy)
    assert {(r.id, r.change) for r in found.collect()} == {("shop/cart/add.py::check", "body"), ("shop/cart/price.py::reprice", "interface"), ("shop/cart/coupon.py::Coupon", "added"), ("shop/store/rows.py::Order", "deleted")}
    assert {r.change: r.n for r in M.class_counts(found).collect()} == {"body": 1, "interface": 1, "added": 1, "deleted": 1}
    assert {r.component_id: tuple(r.path) for r in owned.collect()} == {c: p for p, cs in OWN.items() for c in cs}
    assert {tuple(r.path) for r in M.units(toy["modules"], owned).collect()} == set(OWN)
    assert [(r.rule, r.path) for r in routes.collect()] == [("2", ["front", "cart"])]
    assert ("stock",) not in {tuple(r.path) for r in modules.collect()} and listed.filter("size(path) = 1 AND path[0] = 'front'").count() == 5
    grown = M.growth(routes, after).first()
    assert (grown.entered, grown.now_n, grown.ratio, grown.flagged) == (1, 4, 0.25, False)
    by = {tuple(r.path): r for r in told.collect()}
    assert by["front", "cart"].own == ["shop/cart/add.py::check", "shop/cart/coupon.py::Coupon", "shop/cart/price.py::reprice"] and by["front", "cart"].entered == ["shop/cart/coupon.py::Coupon"] and by["front", "cart"].mode == "edit"
    assert by["front", "web"].own == [] and by["front", "web"].up == ["shop/cart/price.py::reprice"] and by["front", "web"].refch == ["shop/cart/price.py::reprice"]
    assert by["jobs",].up == [] and by["jobs",].refch == ["reprice"]
    assert by["stock",].mode == "delete" and by["stock",].own == ["shop/store/rows.py::Order"]
    assert {tuple(r.path) for r in M.active(told).collect()} == set(OWN)
    rate = M.ratios(told, M.units(modules, after)).first()
    assert (rate.n_leaves, rate.n_active, rate.n_structural) == (3, 4, 1) and rate.r_leaf > 1
    assert M.starts_anew(M.ratios(told, M.units(modules, after))).first().start_anew and not M.starts_anew(M.ratios(told, M.units(modules, after)), True, 100).first().start_anew
    order = [tuple(r.path) for r in M.working_order(told, toy["new_edges"], after, toy["modules"]).orderBy("ord").collect()]
    assert order.index(("front", "cart")) < order.index(("front", "web")) and order[-1] == ("stock",)
    roles = {tuple(r.path): r.roles for r in M.write_set(told, toy["new_edges"], after, toy["refs"]).collect()}
    assert roles[()] == ["overview", "referrer"] and roles["front",] == ["ancestor"] and roles["front", "web"] == ["dependent", "leaf", "referrer"] and ("stock",) not in roles
    assert "own: shop/store/rows.py::Order" in {tuple(r.path): r.text for r in M.rendered(told).collect()}["stock",]
    row = M.record(found, told, "3b").first()
    assert (row.added, row.renamed, row.to_delete, row.preset) == (1, 0, 1, "3b")
    diffs = {r.id: r["diff"] for r in M.changed_diff(toy["old"], toy["new"], found).collect()}
    assert "+def reprice(cart, day): return day" in diffs["shop/cart/price.py::reprice"]


def test_only_a_body(spark, toy):
    t = toy | {"new": spark.createDataFrame([*OLD[:1], NEW[1], *OLD[2:]], COMPONENT), "new_edges": toy["old_edges"]}
    assert [tuple(r.path) for r in M.active(run(t)[-1]).collect()] == [("front", "cart")]
    same = spark.createDataFrame([OLD[0][:4] + ("def add_item(cart, sku):\n    return   check(cart)",) + OLD[0][5:], *OLD[1:]], COMPONENT)
    assert M.changes(toy["old"], same, toy["old_edges"], toy["old_edges"]).count() == 0
    edge = M.changes(toy["old"], toy["old"], toy["old_edges"], toy["old_edges"].limit(1)).collect()
    assert [(r.change, r.edges_removed) for r in edge] == [("edge", ["shop/cart/price.py::reprice"])]


def test_renames(spark, toy):
    body = "def f(a, b):\n" + "\n".join(f"    x{i} = a + {i} * b" for i in range(30))
    a = [comp("m.py::f", body, ["a", "b"]), comp("m.py::g", body.replace("def f", "def g"), ["a", "b"]), comp("m.py::K", body, kind="class")]
    b = [comp("n.py::f", body.replace("* b", "* b ", 1).replace("x3 ", "y3 "), ["a", "b", "c"]), comp("n.py::h", body.replace("def f", "def h"), ["a", "b"])]
    old, new = spark.createDataFrame(a, COMPONENT), spark.createDataFrame(b, COMPONENT)
    none = spark.createDataFrame([], "src string, dst string")
    got = {(r.change, r.old_id, r.id) for r in M.changes(old, new, none, none).collect()}
    assert ("renamed", "m.py::g", "n.py::h") in got or ("renamed", "m.py::f", "n.py::h") in got
    assert sum(c == "renamed" for c, _, _ in got) == 2 and ("deleted", "m.py::K", "m.py::K") in got and ("interface", [o for c, o, i in got if c == "renamed" and i == "n.py::f"][0], "n.py::f") in got
    assert {r.change for r in M.changes(old, new, none, none, 0.9999).collect()} == {"added", "deleted"}
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.9), ("b", "y", 0.9), ("b", "x", 0.8), ("c", "x", 0.99)], "a string, b string, similarity double")
    left, best, want = pairs.collect(), None, []
    while left:
        best = max(left, key=lambda r: (r.similarity, r.a, r.b))
        want.append((best.a, best.b))
        left = [r for r in left if r.a != best.a and r.b != best.b]
    assert {(r.a, r.b) for r in M.matched(pairs).collect()} == set(want)


def test_routing_in_order(spark, toy):
    owned = M.owners(toy["listed"], toy["modules"])
    edges = spark.createDataFrame([("lib/x.py::A", "shop/cart/price.py::reprice"), ("lib/x.py::A", "shop/web/views.py::page"), ("lib/x.py::A", "shop/jobs/night.py::Sweep"), ("zoo/z.py::Z", "lib/x.py::A")], "src string, dst string")
    added = spark.createDataFrame([("lib/x.py::A",), ("zoo/z.py::Z",), ("shop/web/views.py::more",), ("far/q.py::Q",)], "id string")
    route = lambda tau, decide=None: {r.id: (r.rule, r.path) for r in M.routed(added, toy["new"], owned, edges, tau, decide).collect()}
    got = route(0.5)
    assert got["shop/web/views.py::more"] == ("1", ["front", "web"]) and got["lib/x.py::A"] == ("untracked", None) and got["far/q.py::Q"][0] == "untracked"
    got = route(0.3)
    assert got["lib/x.py::A"] == ("3", ["front", "cart"]) and got["zoo/z.py::Z"] == ("3", ["front", "cart"])  # by a neighbour that was placed just before
    assert route(0.5, lambda ids: ids.filter("id = 'far/q.py::Q'").withColumn("path", F.array(F.lit("jobs"))))["far/q.py::Q"] == ("4", ["jobs"])
    ids = spark.createDataFrame([("shop/cart/add.py::check.inner.deep",), ("x.py::no",)], "id string")
    assert {r.id: r.path for r in M.resolved_owners(ids, owned).collect()} == {"shop/cart/add.py::check.inner.deep": ["front", "cart"], "x.py::no": None}
    said = spark.createDataFrame([("a", "place", ["jobs"], None), ("b", "place", ["nowhere"], None), ("c", "create", ["front"], "new"), ("d", "create", ["front"], "web"), ("e", "jump", None, None), ("f", "create", None, " ")], "id string, action string, parent array<string>, name string")
    assert {r.id: r.fault for r in M.checked_decisions(said, toy["modules"]).collect()} == {"a": None, "b": "no such module", "c": None, "d": "name is taken", "e": "unknown action", "f": "no name"}


def test_pages_and_files(spark, toy):
    found = run(toy)[0]
    refs = spark.createDataFrame([("p", "ids", "shop/store/rows.py::Order"), ("p", "names", "Order"), ("p", "links", "front/gone"), ("p", "links", "front"), ("p", "ids", "shop/store/rows.py::Order")], "page string, kind string, ref string")
    pages = spark.createDataFrame([("front",), ("p",)], "page string")
    assert {tuple(r) for r in M.stale_items(refs, found, pages, M.unique_names(toy["old"])).collect()} == {("p", "id", "shop/store/rows.py::Order", None), ("p", "name", "Order", None), ("p", "link", "front/gone", "front")}
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "page string, text string")
    b = spark.createDataFrame([("x", "1"), ("y", "0"), ("w", "4")], "page string, text string")
    changed = M.changed_pages(a, b)
    assert {r.page for r in changed.collect()} == {"y", "z", "w"}
    verdicts = spark.createDataFrame([("x", "patch"), ("y", "no-op"), ("z", "rewrite")], "page string, verdict string")
    assert {r.page: r.verdict for r in M.reconciled(verdicts, changed).collect()} == {"x": "no-op", "y": "patch", "z": "rewrite", "w": "patch"}
    assert {r.page: r.allowed for r in M.may_write(pages, spark.createDataFrame([("p",)], "page string")).collect()} == {"front": False, "p": True}
    assert {tuple(r.path) for r in M.stale_pages(toy["modules"], toy["listed"], spark.createDataFrame([("shop/web/views.py",)], "file string")).collect()} == {("front",), ("front", "web")}
    hints = spark.createDataFrame([(["a"], "src/cart/"), (["b"], "views.py"), (["c"], "src/web/views.py/inner"), (["d"], "art")], "path array<string>, path_hint string")
    files = spark.createDataFrame([("src/cart/add.py",), ("src/web/views.py",)], "file string")
    assert {(r.path[0], r.file) for r in M.touched_modules(files, hints).collect()} == {("a", "src/cart/add.py"), ("b", "src/web/views.py"), ("c", "src/web/views.py")}
    assert ("d", "src/cart/add.py") in {(r.path[0], r.file) for r in M.touched_by_substring(files, hints).collect()}
    assert {(tuple(r.path), r.why) for r in M.cascade(spark.createDataFrame([(["front", "web"],)], "path array<string>")).collect()} == {((), "overview"), (("front",), "ancestor"), (("front", "web"), "module")}
    assert {tuple(r.path) for r in M.topmost(spark.createDataFrame([(["a"],), (["a", "b"],), (["ab"],)], "path array<string>")).collect()} == {("a",), ("ab",)}
    snap = spark.createDataFrame([("f::a", "f", ["x"]), ("f::b", "f", []), ("g::c", "g", ["y"])], "id string, relative_path string, deps array<string>")
    live = spark.createDataFrame([("f::a", "f", ["z"])], snap.schema)
    got = {r.id: (r.deps, r.live) for r in M.overlay(snap, live, spark.createDataFrame([("f",)], "file string")).collect()}
    assert got == {"f::a": (["x", "z"], True), "g::c": (["y"], False)}
    modules, listed = M.virtual_leaf(spark, toy["new"])
    assert M.owners(listed, modules).count() == 6
