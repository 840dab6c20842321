import importlib.util
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import languages as L
from corvane.operators import resolve as R

SAMPLES = {
    "javascript": ("import x from 'y';\n/** Adds. */\nexport function add(a, b) { return total(a) + b; }\nclass Cart extends Base {\n  total() { return this.sum(new Item(1)); }\n  pick = (k) => helper(k);\n}\nconst run = async () => { add(1); };\n// gone()\n", "add Cart Cart.total Cart.pick run", "add>total Cart>Base Cart.total>Cart.sum Cart.total>Item Cart.pick>helper run>add"),
    "typescript": ("export interface Shape extends Base { area(): number; }\ntype Id = string;\nenum Mode { A }\nexport class Box implements Shape {\n  private w: Width;\n  area(): number { return mul(this.w); }\n}\n", "Shape Id Mode Box Box.area", "Shape>Base Box>Shape Box>Width Box.area>mul"),
    "java": ("package a;\npublic class Cart extends Base implements Sum {\n  private Item item;\n  public Cart(Item i) { this.item = i; }\n  public int total(int k) { return item.price() + new Tax().of(k); }\n  enum Mode { A, B }\n}\ninterface Sum { int total(int k); }\n", "Cart Cart.Cart Cart.total Cart.Mode Sum", "Cart>Base Cart>Sum Cart.total>item.price Cart.total>Tax Cart>Item"),
    "csharp": ("namespace A {\n public class Cart : Base, ISum {\n  public Item Item { get; set; }\n  public int Total(int k) { return Item.Price() + new Tax().Of(k); }\n }\n}\n", "Cart Cart.Item Cart.Total", "Cart>Base Cart>ISum Cart.Total>Item.Price Cart.Total>Tax"),
    "c": ("struct node { int x; };\nstatic int *find(struct node *n, int k) {\n  return look(n, k);\n}\nint main(void) { /* no() */ find(0, 1); return 0; }\n", "node find main", "find>look main>find find>node"),
    "cpp": ("class API_EXPORT Cart : public Base {\n public:\n  int total() const { return sum(items); }\n  Item item;\n};\nint Cart::price(int k) { return tax(k); }\nusing Id = int;\n", "Cart Cart.total Cart.price Id", "Cart>Base Cart.total>sum Cart.price>tax Cart>Item"),
    "kotlin": ("data class Item(val price: Money) : Base(), Sum {\n  fun total(k: Int): Int = add(k)\n  companion object Maker {\n    fun make() { Item() }\n  }\n}\n", "Item Item.total Item.Maker Item.Maker.make", "Item>Base Item>Sum Item.total>add Item.Maker.make>Item Item>Money"),
    "php": ("<?php\nnamespace A;\ntrait T { }\nclass Cart extends Base implements Sum {\n  use T;\n  public function total(Item $i) { return $this->add(new Tax()) + Rate::of(1); }\n}\n", "T Cart Cart.total", "Cart>Base Cart>Sum Cart>T Cart.total>Cart.add Cart.total>Tax Cart.total>Rate"),
    "ruby": ("module Shop\n  class Cart < Base\n    include Sum\n    def total(k)\n      if k\n        add(k)\n      end\n      Tax.new(1)\n    end\n  end\nend\n", "Shop Shop.Cart Shop.Cart.total", "Shop.Cart>Base Shop.Cart>Sum Shop.Cart.total>add Shop.Cart.total>Tax"),
    "scala": ("trait Sum { def total(k: Int): Int }\ncase class Cart(item: Item) extends Base with Sum {\n  def total(k: Int): Int = { add(k) }\n}\nobject Cart {\n  def make() = new Cart(null)\n}\n", "Sum Cart Cart.total Cart$", "Cart>Base Cart>Sum Cart.total>add Cart>Item"),
    "rust": ("pub struct Cart { item: Item }\npub trait Sum { fn total(&self) -> i32; }\nimpl Sum for Cart {\n  fn total(&self) -> i32 { self.add(1); helper(2) }\n}\n#[cfg(test)]\nmod tests { fn gone() {} }\nfn helper(k: i32) -> i32 { k }\n", "Cart Sum Cart.total helper", "Cart>Sum Cart.total>Cart.add Cart.total>helper Cart>Item"),
    "dart": ("class Page extends StatelessWidget with M {\n  final Item item;\n  Page(this.item);\n  int get size => 1;\n  Widget build(BuildContext c) { return Text(item.name()); }\n}\n", "Page Page.Page Page.size Page.build", "Page>StatelessWidget Page>M Page.build>Text Page>Item"),
    "go": ("package a\ntype Cart struct {\n\tBase\n\titem *Item\n}\ntype Sum interface {\n\tTotal(k int) int\n}\nfunc (c *Cart) Total(k int) int {\n\treturn c.add(k) + other.Of(k)\n}\nfunc New() *Cart { return &Cart{} }\n", "Cart Sum Cart.Total New", "Cart>Base Cart>Item Cart.Total>Cart.add Cart.Total>other.Of New>Cart"),
    "zig": ('const std = @import("std");\npub const Cart = struct {\n  item: Item,\n  pub fn total(self: *Cart, k: i32) i32 { return add(k); }\n};\nfn add(k: i32) i32 { return k; }\n', "Cart Cart.total add", "Cart.total>add Cart>Item"),
    "vue": ('<template>\n  <my-item :x="1"/>\n</template>\n<script>\nexport default {\n  methods: {\n    load() { fetchAll(); },\n  },\n};\nfunction fetchAll() { get(1); }\n</script>\n', "a a.load fetchAll", "a>MyItem fetchAll>get"),
    "python": ("from pkg.util import helper\nimport os\nclass A(Base):\n    def run(self, x: Item):\n        y = Tax()\n        y.of(1)\n        self.stop()\n        return helper(x) + len(x) + os.getcwd()\n    def stop(self): super().stop()\ndef go(): A().run(1)\n", "A A.run A.stop go", "A>Base A.run>Tax.of A.run>src/a.x::A.stop A.run>pkg.util.helper A.stop>Base.stop A.run>Item go>src/a.x::A"),
}


@pytest.mark.parametrize("language", SAMPLES)
def test_components_and_calls(language):
    text, want, calls = SAMPLES[language]
    rows = L.read_file("src/a.x", text, language) if language != "vue" else L.read_file("src/a.vue", text, language)
    short = lambda i: i.split("::", 1)[1]
    assert set(want.split()) <= {short(r["id"]) for r in rows if r["row_kind"] == "component"}
    got = {f"{short(r['id'])}>{r['callee']}" for r in rows if r["row_kind"] == "call"}
    assert set(calls.split()) <= got, got
    assert not any("gone" in x or "no(" in x for x in got)
    for r in rows:
        if r["row_kind"] == "component" and r["source_code"]:
            assert text.split("\n")[r["start_line"] - 1].strip() and r["end_line"] >= r["start_line"]


def test_no_file_is_lost(spark):
    files = spark.createDataFrame([("a.py", "def broken(:", "python"), ("b.go", None, "go"), ("c.txt", "x", "text"), ("d.js", "// nothing", "javascript"), ("e.java", "class E { void f() { g(); } }", "java")], "path string, text string, language string")
    rows = L.extract(files).collect()
    assert {r.id for r in rows if r.component_type == "file"} == {"a.py::__file__", "b.go::__file__", "d.js::__file__"} and {r.id for r in rows if r.path == "e.java" and r.row_kind == "component"} == {"e.java::E"} | {r.id for r in rows if r.id == "e.java::E.f"}
    kinds = spark.createDataFrame([(["State<Page>"],), (["Foo", "_$Cubit"],), (None,)], "b array<string>").select(L.ui_kind(F.col("b")).alias("k")).collect()
    assert [r.k for r in kinds] == ["state", "bloc", None]


COMPONENTS = [("a.py::Cart", "Cart", "class", "python"), ("a.py::Cart.add", "add", "method", "python"), ("b.py::add", "add", "function", "python"), ("c.java::shop.Cart", "Cart", "class", "java"), ("c.java::shop.Cart.add", "add", "method", "java"), ("d.java::shop.Tax", "Tax", "class", "java"), ("e.java::far.Tax", "Tax", "class", "java"), ("f.go::only", "only", "function", "go")]


@pytest.fixture
def components(spark):
    return spark.createDataFrame([(i, n, t, i.split("::")[0], x) for i, n, t, x in COMPONENTS], "id string, name string, component_type string, relative_path string, language string")


def test_resolution(spark, components):
    calls = [("b.py::add", "a.py::Cart", 1, "python"), ("b.py::add", "Cart.add", 2, "python"), ("b.py::add", "x.y.Cart", 3, "python"), ("a.py::Cart", "add", 4, "python"), ("c.java::shop.Cart.add", "Tax", 5, "java"), ("c.java::shop.Cart.add", "only", 6, "java"), ("f.go::only", "missing", 7, "go"), ("b.py::add", "print", 8, "python"), ("b.py::add", "nowhere", 9, "python"), ("b.py::add", "a.py::Cart", 10, "python")]
    rows = spark.createDataFrame(calls, "caller string, callee string, call_line int, language string")
    got = {r.call_line: (r.resolved, r.rule) for r in R.resolved(rows, components).collect()}
    assert got[1] == ("a.py::Cart", 1) and got[2] == ("a.py::Cart.add", 1) and got[3] == ("a.py::Cart", 5) and got[5] == ("d.java::shop.Tax", 6) and got[6] == ("f.go::only", 11)
    assert got[4] == (None, None) and got[7] == (None, None)
    bound = {r.call_line: (r.resolved, r.rule) for r in R.bound(rows, components).collect()}
    assert bound[4] == ("a.py::Cart.add", 20) and 7 not in bound and 8 not in bound and bound[9] == (None, None) and 10 not in bound
    assert ("b.py::add", "a.py::Cart") in {tuple(r) for r in R.edges(rows, components).collect()}
    assert {r.id: r.called_by for r in R.call_summary(R.edges(rows, components)).collect()}["f.go::only"] == ["c.java::shop.Cart.add"]
    assert R.entry_points(components, R.edges(rows, components), 1).first().id == "a.py::Cart" and R.picture(components, R.edges(rows, components)).count() > 8
    assert {tuple(r) for r in R.project_packages(components).filter("language = 'java'").collect()} == {("java", "shop"), ("java", "far")}


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(R.is_macro(F.lit(x))) for x in ("MAX_LEN", "ABC", "ABCD", "NULL", "Max")] == [True, False, True, False, False]
    assert [one(R.is_private(F.lit(x))) for x in ("_a", "a._b", "a_b", "x::_a")] == [True, True, False, False]
    assert one(R.is_external(F.lit("java.util.List"), F.lit("java"))) and not one(R.is_external(F.lit("shop.Cart"), F.lit("java")))
    paths = spark.createDataFrame([("a/b.py",), ("a/__init__.py",), ("x.js",)], "path string")
    assert {r.module for r in R.python_modules(paths).collect()} == {"a.b", "a"}
    names = spark.createDataFrame([("a.b.c",), ("ab",), ("b",)], "name string")
    assert {r.name for r in R.imports_of_project(names, R.python_modules(paths)).collect()} == {"a.b.c", "b"}


def test_go_dart_and_bases(spark, components):
    members = spark.createDataFrame([("p", "Base", "Run", "p::Base.Run"), ("p", "Deep", "Stop", "p::Deep.Stop"), ("p", "Cart", "Add", "p::Cart.Add"), ("p", "Other", "Run", "p::Other.Run")], "dir string, type string, name string, id string")
    embeds = spark.createDataFrame([("p", "Cart", "Base"), ("p", "Base", "Deep"), ("p", "Two", "Base"), ("p", "Two", "Other")], "dir string, type string, embedded string")
    got = {(r.type, r.name): r.id for r in R.promoted(members, embeds).collect()}
    assert got["Cart", "Run"] == "p::Base.Run" and got["Cart", "Stop"] == "p::Deep.Stop" and ("Two", "Run") not in got and got["Two", "Stop"] == "p::Deep.Stop"
    faces = spark.createDataFrame([("p", "Runner", "Run"), ("p", "Both", "Run"), ("p", "Both", "Halt"), ("q", "Far", "Run")], "dir string, interface string, name string")
    assert {(r.type, r.interface) for r in R.implementers(members, faces).collect()} == {("Base", "Runner"), ("Other", "Runner")}
    imports, exports = spark.createDataFrame([("m", "a")], "src string, dst string"), spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    parts = spark.createDataFrame([("m", "m2")], "library string, part string")
    scope = R.visible(imports, exports, parts)
    assert {(r.file, r.sees, r.whole) for r in scope.collect() if r.file == "m2"} == {("m2", "m2", True), ("m2", "m", True), ("m2", "a", False), ("m2", "b", False), ("m2", "c", False)}
    there = spark.createDataFrame([("c::f", "f", "function", "c", "dart"), ("c::_g", "_g", "function", "c", "dart"), ("m::_g", "_g", "function", "m", "dart")], components.schema)
    calls = spark.createDataFrame([("m2::x", "f"), ("m2::x", "_g"), ("c::y", "zz")], "caller string, callee string")
    assert {r.callee: r.resolved for r in R.bound_in_scope(calls, there, scope).collect()} == {"f": "c::f", "_g": "m::_g", "zz": None}
    owners = spark.createDataFrame([("B", "m", "B.m"), ("C", "m", "C.m"), ("C", "k", "C.k")], "class string, name string, id string")
    bases = spark.createDataFrame([("A", "B", 0), ("A", "C", 1)], "class string, base string, ord int")
    wanted = spark.createDataFrame([("A", "m"), ("A", "k"), ("A", "z")], "class string, name string")
    assert {r.name: r.id for r in R.inherited(owners, bases, wanted).collect()} == {"m": "B.m", "k": "C.k", "z": None}


def test_leaves(spark, components):
    gate = R.leaf_types(components).first()
    assert (gate.n_oop, gate.n_func, gate.with_functions) == (4, 2, False)
    edges = spark.createDataFrame([("b.py::add", "a.py::Cart")], "src string, dst string")
    assert R.leaves(components, edges).count() == 4 and R.leaves(components, edges, 1).count() == 3
    ids = spark.createDataFrame([("a.py::Cart", 0), ("a.py::Cart", 1), ("bad", 2)], "id string, ord int")
    assert [r.ord for r in R.known_leaves(ids, components).collect()] == [0]
