"""Renames by classes, ownership closure, stale texts, receivers, ignore rules: against plain versions."""

import difflib
import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from corvane.operators import extract, languages, maintain, packing, resolve, stale
from corvane.operators.receivers import followed
from corvane.sources import files

DESCRIBED = "id string, component_type string, text string"


def _greedy(old, new, tau):
    tokens = lambda t: re.findall(r"\w+|[^\w\s]", t)
    gone, come = [r for r in old if r[0] not in {x[0] for x in new}], [r for r in new if r[0] not in {x[0] for x in old}]
    pairs = []
    for a, ka, ta in gone:
        for b, kb, tb in come:
            if ka == kb and ta.strip() and tb.strip() and min(len(ta), len(tb)) >= 0.9 * tau * max(len(ta), len(tb)):
                if (s := difflib.SequenceMatcher(None, tokens(ta), tokens(tb), autojunk=False).ratio()) >= tau:
                    pairs.append((s, a, b))
    out, used = [], set()
    for s, a, b in sorted(pairs, reverse=True):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.append((a, b, round(s, 9)))
    return sorted(out)


def _texts(rng, n, side):
    base = [" ".join(rng.choices("def get set run item price total x y z ( ) : + = return".split(), k=60)) for _ in range(4)]
    out = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice("aa bb cc".split())
        out.append((f"{side}{i:03d}" if rng.random() < 0.9 else f"same{i}", rng.choice(["function", "class"]), rng.choice([" ", "  ", "\n"]).join(words) if rng.random() < 0.95 else " "))
    return out


def test_renames_by_classes_equal_the_greedy_ones(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        rng2 = random.Random(seed)
        old, new = _texts(rng, 60, "old/"), _texts(rng2, 45, "new/")  # the same texts by and large, so classes are large and tie
        got = maintain.rename_pairs(spark.createDataFrame(old, DESCRIBED), spark.createDataFrame(new, DESCRIBED), 0.95)
        assert sorted((r.a, r.b, round(r.similarity, 9)) for r in got.collect()) == _greedy(old, new, 0.95)


def test_a_move_of_many_copies_has_few_classes(spark):
    old = spark.range(3000).select(F.concat(F.lit("a/f"), F.col("id")).alias("id"), F.lit("function").alias("component_type"), F.concat(F.lit("def f ( x ) : return x + "), F.col("id") % 3).alias("text"))
    new = old.withColumn("id", F.regexp_replace("id", "^a/", "b/"))
    got = maintain.rename_pairs(old, new)
    assert got.count() == 3000 and got.select("a").distinct().count() == got.select("b").distinct().count() == 3000 and got.filter("similarity < 1").count() == 0
    assert maintain.rename_pairs(old, old).count() == 0 and maintain.rename_pairs(old.limit(0), new).count() == 0


def test_similar_classes_do_not_pair_copies(spark):
    rows = spark.range(200).select("id", F.lit("one two three four five six seven eight nine ten").alias("text"), F.lit(50).alias("n_chars"), F.lit("en").alias("lang")).unionByName(spark.createDataFrame([(500, "one two three four five six seven eight nine ten.", 51, "en"), (501, None, None, "en")], "id long, text string, n_chars int, lang string"))
    members, links = extract.similar_classes(rows, ["lang"], 0.9)
    assert {(r["class"], r["count"]) for r in members.groupBy("class").count().collect()} == {(0, 200), (500, 1), (501, 1)}
    assert [(r.a, r.b) for r in links.collect()] == [(0, 500)]


def test_ownership_closure(spark):
    owned = spark.createDataFrame([("a/x.py::A", ["m"]), ("a/x.py::B", ["m"]), ("a/x.py::C", ["n"]), ("b/y.py::D", ["n"]), ("c/u.py::E", ["m"]), ("c/v.py::F", ["n"]), ("k/K.py::K", ["k"])], "component_id string, path array<string>")
    edges = spark.createDataFrame([("d/w.py::G", "a/x.py::A"), ("d/w.py::G", "c/u.py::E"), ("c/v.py::F", "d/w.py::G"), ("d/w.py::H", "c/v.py::F"), ("a/x.py::A", "d/w.py::H"), ("q/q.py::Q", "a/x.py::A.run"), ("z/z.py::Z", "k/K.py::K")], "src string, dst string")
    found = [("a/x.py::New", "added"), ("a/x.py::A.run", "body"), ("b/z.py::Z", "edge"), ("d/w.py::G", "body"), ("d/w.py::H", "interface"), ("q/q.py::Q", "body"), ("z/z.py::Z", "deleted"), ("lone.py::L", "body"), ("gone.py::X", "deleted"), ("a/x.py::Out", "added")]
    rows = spark.createDataFrame(found, "id string, change string")
    old = owned.filter("component_id <> 'k/K.py::K'")
    got = maintain.adopted(rows, owned, old, edges, edges, left_out=spark.createDataFrame([("a/x.py::Out",)], "id string"))
    assert {(r.id, r.rule, r.path[0], r.deleted) for r in got.collect()} == {("a/x.py::New", "1", "m", False), ("b/z.py::Z", "2", "n", False), ("d/w.py::G", "3", "m", False), ("d/w.py::H", "3", "m", False), ("q/q.py::Q", "3", "m", False), ("z/z.py::Z", "3", "k", True)}
    modules = spark.createDataFrame([(["m"],), (["n"],)], "path array<string>")
    more = maintain.adopted(rows, owned, old, edges, edges, decide=lambda ids: ids.select("id", F.when(F.col("id") == "lone.py::L", F.array(F.lit("n"))).otherwise(F.array(F.lit("nowhere"))).alias("path")), modules=modules)
    assert {(r.id, r.path[0]) for r in more.filter("rule = '4'").collect()} == {("lone.py::L", "n")}


def test_stale_texts(spark):
    rng = random.Random(4)
    ids = [f"a/f{i}.py::C{i}" for i in range(30)]
    text = lambda: " ".join(rng.choice([f"({rng.choice(ids)})", f"`name{rng.randrange(30)}`", f"[x](P{rng.randrange(8)}.md#a)", f"[y](d/P{rng.randrange(8)}.md)", "word"]) for _ in range(12))
    pages = [(f"P{i}", text()) for i in range(6)] + [("N", None)]
    found = [(ids[i], "renamed" if i % 2 else "deleted", f"b/g.py::D{i}" if i % 2 else ids[i]) for i in range(12)] + [(ids[20], "body", ids[20])]
    names = [(ids[i], f"name{i}") for i in range(30) if i != 4]
    removed = [("P7", "P1")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = [frame(pages, "page string, text string"), frame(found, "old_id string, change string, id string"), frame(names, "id string, name string"), frame(removed, "page string, replacement string")]
    want = set()
    for page, t in pages:
        if page == "P2":
            continue
        for old, change, new in found:
            name, new = dict(names).get(old), new if change == "renamed" else None
            if change in ("renamed", "deleted") and t and old in t:
                want.add((page, change, old, new))
            elif change in ("renamed", "deleted") and t and name and f"`{name}`" in t:
                want.add((page, change, name, new and new.split("::")[1]))
        for to in re.findall(r"\]\(([^)#]+)\.md", t or ""):
            stem = to.split("/")[-1]
            if stem == "P7" or stem not in dict(pages) and "/" not in to:
                want.add((page, "deleted_page", stem, "P1" if stem == "P7" else None))
    got = stale.scanned(*args, written=frame([("P2",)], "page string"))
    assert {tuple(r) for r in got.select("page", "kind", "old", "new").collect()} == want and got.count() == len(want)
    some = frame([(f"`name{i}`",) for i in range(30)] + [("",)], "pattern string")
    one, many = ({tuple(r) for r in stale.hits(args[0], some, most).collect()} for most in (10_000, 40))
    assert one == many and one and stale.hits(args[0], some.limit(0)).count() == 0


FILES = [
    ("java/S.java", "class S extends Up { private Repo repo; List<Item> list; void go(Item i) { this.repo.inner.load(); repo.inner.load(); i.pay(); helper().load(); up.load(); list.add(1); var q = new Store(); q.load(); } Store helper() { return null; } }", "java"),
    ("java/Repo.java", "class Repo { Store inner; }", "java"), ("java/Store.java", "class Store extends Deep { void other() {} }", "java"), ("java/Deep.java", "class Deep { void load() {} }", "java"), ("java/Up.java", "class Up { Store up; void add(int k) {} }", "java"), ("java/Item.java", "class Item { void pay() {} }", "java"),
    ("ts/s.ts", "class S { private repo: Repo; go(i: Item) { this.repo.inner.load(); i.pay(); const q = new Store(); q.load(); mk().load(); } }\nfunction mk(): Store { return null }\nclass Repo { inner: Store }\nclass Store { load() { x(); } }\nclass Item { pay() { x(); } }", "typescript"),
    ("cs/s.cs", "class S { Repo repo; void Go(Item i) { this.repo.Inner.Load(); i.Pay(); } }\nclass Repo { public Store Inner { get; set; } }\nclass Store { void Load() { X(); } }\nclass Item { void Pay() { X(); } }", "csharp"),
    ("go/a.go", "package a\ntype S struct {\n\trepo *Repo\n}\nfunc (s *S) Go(i Item) {\n\ts.repo.inner.Load()\n\ti.Pay()\n\tq := NewStore()\n\tq.Load()\n}\n", "go"),
    ("go/b.go", "package a\ntype Repo struct {\n\tinner Store\n}\ntype Store struct {\n\tDeep\n}\ntype Item struct {}\nfunc (Item) Pay() {}\ntype Deep struct {}\nfunc (d *Deep) Load() {}\nfunc NewStore() *Store { return nil }\n", "go"),
]


def test_receivers_are_followed_through_two_fields(spark):
    rows = languages.extract(spark.createDataFrame(FILES, "path string, text string, language string")).cache()
    comps = rows.filter("row_kind = 'component'").select("id", "name", "component_type", F.col("path").alias("relative_path"), "language")
    calls = rows.filter("row_kind = 'call'").select(F.col("id").alias("caller"), "callee", "relation", "call_line", "language")
    got = {(r.caller, r.callee): (r.resolved, r.external) for r in followed(calls, comps, rows.filter("row_kind = 'binding'")).filter("relation IN ('call', 'chain')").collect()}
    deep, go = "java/Deep.java::Deep.load", "java/S.java::S.go"
    assert {c: got[go, c][0] for c in ("S.repo.inner.load", "repo.inner.load", "i.pay", "helper().load", "up.load", "q.load")} == {"S.repo.inner.load": deep, "repo.inner.load": deep, "i.pay": "java/Item.java::Item.pay", "helper().load": deep, "up.load": deep, "q.load": deep}
    assert got[go, "list.add"] == (None, True)  # a list of the language's library, not a project's add
    assert {c: got["ts/s.ts::S.go", c][0] for c in ("S.repo.inner.load", "i.pay", "q.load", "mk().load")} == {"S.repo.inner.load": "ts/s.ts::Store.load", "i.pay": "ts/s.ts::Item.pay", "q.load": "ts/s.ts::Store.load", "mk().load": "ts/s.ts::Store.load"}
    assert got["cs/s.cs::S.Go", "S.repo.Inner.Load"][0] == "cs/s.cs::Store.Load" and got["cs/s.cs::S.Go", "i.Pay"][0] == "cs/s.cs::Item.Pay"
    assert {c: got["go/a.go::S.Go", c][0] for c in ("S.repo.inner.Load", "i.Pay", "q.Load")} == {"S.repo.inner.Load": "go/b.go::Deep.Load", "i.Pay": "go/b.go::Item.Pay", "q.Load": "go/b.go::Deep.Load"}
    bound = {(r.caller, r.callee): (r.resolved, r.rule) for r in resolve.bound(calls, comps, rows.filter("row_kind = 'binding'")).collect()}
    assert (go, "list.add") not in bound and bound[go, "i.pay"] == ("java/Item.java::Item.pay", 0) and bound["java/S.java::S", "Repo"] == ("java/Repo.java::Repo", 1)


RULES = ["*.log", "!keep.log", "/root.txt", "build/", "a\\*b", "foo\\ ", "bar  ", "\\#x", "\\!y", "doc/**/z", "**/deep", "t?p", "[ab].c", "[!a].d", "mid/*.o", "end\\", "sp ace", "q\\\\r"]
PATHS = ["x.log", "s/x.log", "keep.log", "root.txt", "s/root.txt", "build/a", "s/build/b", "build2/a", "a*b", "axb", "foo ", "foo", "bar", "#x", "!y", "doc/z", "doc/1/2/z", "deep", "s/deep", "tip", "t/p", "a.c", "c.c", "b.d", "a.d", "mid/x.o", "mid/s/x.o", "sp ace", "end", "q\\r", "qr"]


def test_ignore_rules_as_git_has_them(spark, tmp_path):
    subprocess.run(["git", "init", "-q", tmp_path], check=True)
    (tmp_path / ".gitignore").write_text("\n".join(RULES) + "\n")
    said = subprocess.run(["git", "-C", tmp_path, "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(PATHS).encode() + b"\0", capture_output=True).stdout.decode().split("\0")
    got = files.ignored(spark.createDataFrame([(p,) for p in PATHS], "path string"), spark.createDataFrame([("", "\n".join(RULES))], "dir string, text string"))
    assert {r.path for r in got.filter("ignored").collect()} == set(said) - {""}


def test_reading_without_a_size_takes_nothing(spark):
    rows = spark.createDataFrame([(1, "a", 0, None), (1, "b", 1, 30), (1, "c", 2, -5), (1, "d", 3, 90), (1, "e", 4, 60)], "grp int, id string, ord int, tokens long")
    assert {r.id: r.taken for r in packing.skip_greedy(rows, 100).collect()} == {"b": 30, "e": 60}


@pytest.mark.parametrize("n", [3])
def test_more_modules_than_a_broadcast_takes_are_refused(spark, monkeypatch, n):
    monkeypatch.setattr(maintain, "ON_DRIVER", n)
    modules = spark.createDataFrame([([str(i)], f"d{i}") for i in range(n + 1)], "path array<string>, path_hint string")
    paths = spark.createDataFrame([("d1/x",)], "file string")
    assert maintain.touched_by_substring(paths, modules.limit(n)).count() == 1
    with pytest.raises(ValueError):
        maintain.touched_by_substring(paths, modules)
