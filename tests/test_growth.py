"""What grew faster than its input: results are as before, and the step that grew is bounded."""

import random
from collections import Counter

from corvane.operators import extract, graph, hierarchy, impact, languages, ledger, resolve, search
from corvane.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_texts_that_share_words_but_are_not_near_do_not_meet(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [(i, 1, " ".join(["rare", "seldom", *rng.choices(words[:200], k=80), *rng.choices(words, k=20)])) for i in range(300)]
    rows = spark.createDataFrame(texts, "id long, block long, text string")
    assert extract.candidates(rows, 0.95).count() == 0


def test_bags_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for size in (1, 2, 9, 10, 19, 30, 41, 120, 700):
        for kinds in (2, 7, 400):  # few words, often repeated, leave parts empty
            base = [f"w{rng.randrange(kinds)}" for _ in range(size)]
            for _ in range(8):
                words = base[:]
                for _ in range(rng.choice([0, 1, size // 20, size // 10])):
                    if words and rng.random() < 0.4:
                        words.pop(rng.randrange(len(words)))
                    else:
                        words.insert(rng.randrange(len(words) + 1), rng.choice(["x", "w0", "w1"]))
                texts.append((len(texts), rng.choice(["en", "en", None]), words))
    members, near = extract.bags_classes(spark.createDataFrame(texts, "id long, block string, words array<string>"), 95)
    cls = {}
    for i, k, w in texts:
        if k and w:
            cls.setdefault((k, tuple(sorted(w))), i)
    assert {(r.id, r["class"]) for r in members.collect()} == {(i, cls[k, tuple(sorted(w))]) for i, k, w in texts if k and w}
    bag = [(i, k, Counter(w)) for (k, w), i in cls.items()]
    want = {(a, b) for a, k, x in bag for b, m, y in bag if a < b and k == m and 200 * (x & y).total() >= 95 * (x.total() + y.total())}
    assert {(r.a, r.b) for r in near.collect()} == want and len(want) > 100


def test_a_new_component_meets_one_row_of_its_path(spark):
    plan = QUERIES["route_same_file"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.rindex("count(1)")  # votes are counted below the join


def test_implementers_against_brute_force(spark):
    rng = random.Random(2)
    methods = [(rng.choice("pq"), f"t{rng.randrange(30)}", rng.choice("abcde")) for _ in range(150)]
    faces = [m for m in methods if m[1] < "t2"]
    rows = spark.createDataFrame(methods, "dir string, type string, name string")
    got = resolve.implementers(rows, spark.createDataFrame(faces, "dir string, interface string, name string"))
    of = lambda found: {(d, t): {n for e, u, n in found if (e, u) == (d, t)} for d, t, _ in found}
    want = {(d, t, i) for (d, t), has in of(methods).items() for (e, i), asked in of(faces).items() if d == e and t != i and asked <= has}
    assert sorted((r.dir, r.type, r.interface) for r in got.collect()) == sorted(want) and want
    assert "Join Inner" in got._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()  # pairs are not counted


def test_containing_against_brute_force(spark):
    rng = random.Random(4)
    sets = {o: {rng.randrange(12) for _ in range(rng.choice([1, 2, 3, 5, 9]))} for o in range(60)} | {60: set(range(20)), 61: set(range(18))}
    rows = [(o, m) for o, ms in sets.items() for m in ms] + [(62, 1), (62, 2), (62, None), (None, 1)]
    want = {(a, b) for a, x in (sets | {62: {1, 2}}).items() for b, y in sets.items() if a != b and len(y) > 1 and y <= x}
    assert {(r.typ, r.iface) for r in resolve.containing(spark.createDataFrame(rows, "o long, m long")).collect()} == want


def test_reclaimed_and_makespans(spark):
    claims = spark.createDataFrame([("a", 1, 7), ("b", 2, 7), ("b", 3, 7), ("c", 4, 7), ("c", 4, 8), ("d", 5, None)], "grp string, ord long, component_id long")
    assert sorted(tuple(r) for r in hierarchy.reclaimed(claims).collect()) == [("b", 7, "a"), ("c", 7, "a")]
    jobs = [(run, f"{run}-{i}", f"{run}-0" if i and i < 3 else None, float(i + 1), i) for run in range(40) for i in range(run % 6 + 1)]
    frame = ledger.makespans(spark.createDataFrame(jobs, "run long, id string, parent string, seconds double, ord long"), [1, 4])
    got = {(r.run, r.slots): (r.makespan, r.serial) for r in frame.collect()}
    assert len(got) == 80 and all(got[run, 1] == (sum(range(1, run % 6 + 2)), sum(range(1, run % 6 + 2))) for run in range(40)) and got[2, 4][0] == 4.0
    assert "FlatMapGroups" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_the_index_sums_keys_in_one_pass(spark):
    comps = spark.createDataFrame([("p::A.f", "f", "method", "java"), ("q::A.f", "f", "method", "java"), ("q::B", "B", "class", "go"), ("q::B", "B", "class", "go")], "id string, name string, component_type string, language string")
    idx = resolve.index(comps)
    assert {r.key for r in idx.filter("kind = 'exact' AND language IS NULL").collect()} == {"p::A.f", "q::A.f", "q::B", "B"}
    assert "count(distinct" not in idx._jdf.queryExecution().analyzed().toString()


def test_calls_keep_their_numbers(spark):
    comps = spark.createDataFrame([("p::A", "A", "class", "java")], "id string, name string, component_type string, language string")
    calls = spark.createDataFrame([("p::A", "A", 1, "java")], "caller string, callee string, call_line int, language string").repartition(3)
    plan = resolve.resolved(calls, comps)._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "strategy=merge" in plan


def test_calls_that_come_in_another_order_at_each_reading(spark):
    n, languages_ = 120, ("java", "go", "php")
    lang = lambda k: languages_[k % 3]
    comps = spark.createDataFrame([r for k in range(n) for r in ((f"s/{k}::C{k}", f"C{k}", "class", lang(k)), (f"s/{k}::C{k}.run{k}", f"run{k}", "method", lang(k)))], "id string, name string, component_type string, language string")
    uses = [(k, d) for k in range(n) for d in {(k * 7 + 1) % n, (k * 5 + 3) % n, (k + 3) % n} - {k}]
    rows = [r for k, d in uses for r in ((f"s/{k}::C{k}", f"C{d}", "type", d, lang(k)), (f"s/{k}::C{k}.run{k}", f"C{k}.f{d}.run{d}", "call", d, lang(k)))] + [(f"s/{k}::C{k}.run{k}", "log", "call", 0, lang(k)) for k in range(n)]
    schema = "caller string, callee string, relation string, call_line int, language string"

    def mixed(frames):
        import os

        for frame in frames:
            yield frame.sample(frac=1, random_state=int.from_bytes(os.urandom(4)))

    calls = spark.createDataFrame(rows, schema).coalesce(1).mapInPandas(mixed, schema)
    types = {(f"s/{k}::C{k}", f"C{d}", f"s/{d}::C{d}", 1 if lang(k) == lang(d) else 11) for k, d in uses}
    plain = resolve.resolved(calls.filter("relation = 'type'"), comps).collect()
    assert len(plain) == len(uses) and {(r.caller, r.callee, r.resolved, r.rule) for r in plain} == types
    fields = spark.createDataFrame([(f"s/{k}::C{k}", f"f{d}", f"C{d}", "field", d, lang(k)) for k, d in uses], "id string, name string, callee string, relation string, call_line int, language string")
    got = resolve.bound(calls, comps, fields).filter("resolved IS NOT NULL").collect()
    want = types | {(f"s/{k}::C{k}.run{k}", f"C{k}.f{d}.run{d}", f"s/{d}::C{d}.run{d}", 0) for k, d in uses if lang(k) == lang(d)}
    assert len(got) == len(want) and {(r.caller, r.callee, r.resolved, r.rule) for r in got} == want and len(want) > len(types)


def test_occurrences_are_counted_where_their_unit_is_read(spark):
    rows = [(1, "Run the runner", "src/runner.py", "run run RUN getUser get user"), (2, None, "", "   "), (3, "x", "the", None), (1, "again", "src/runner.py", "run other"), (None, "stray", "", "run"), (None, "stray", "", None)]
    units = spark.createDataFrame(rows, "id long, title string, path string, content string")
    counted = search.counts(units)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    got = Counter((r.id, f.field, f.len, t.term, t.freq) for r in counted.collect() for f in r.fields for t in f.terms)
    seen = Counter((i, *x) for i, *texts in rows for r in [spark.createDataFrame([(0, *texts)], "id long, title string, path string, content string")] for x in ((o.field, o.len, o.term) for o in search.fields(r).collect()))
    assert sum(n * k[4] for k, n in got.items()) == sum(seen.values()) and {k[:4] for k in got} == set(seen)
    index = search.Index.build(units)
    held = {r.id: ({*r.terms}, {s.field: s.len for s in r.sizes}) for r in index.units().collect()}
    by_field = lambda i: {f: sum(n for k, n in seen.items() if k[0] == i and k[1] == f) for f in {k[1] for k in seen if k[0] == i}}
    assert held == {i: ({k[3] for k in seen if k[0] == i}, by_field(i)) for i in (1, 2, 3)} | {None: (set(), {})} and index.n == 4
    assert {r.term: r.df for r in index.vocabulary().collect()} == Counter(t for i in (1, 2, 3) for t in {k[3] for k in seen if k[0] == i})


def test_files_are_read_in_as_many_tasks_as_the_session_has(spark):
    files = spark.createDataFrame([(f"src/C{i}.java", f"class C{i} {{ void run() {{ }} }}", "java") for i in range(40)], "path string, text string, language string").coalesce(1)
    rows = languages.extract(files)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and rows.filter("row_kind = 'component'").count() == 80


def test_a_report_ranks_no_more_than_it_shows(spark):
    rows = [("usages", f"p{i:03d}", 1, "read", "t", None) for i in range(70)] + [("tests", f"p{i:03d}", None, "test", "", None) for i in range(15)] + [("docs", f"p{i:03d}", None, "page", "a", None) for i in range(17)]
    shown = impact.rendered(spark.createDataFrame(rows, "section string, path string, line int, kind string, text string, id string"))
    lines = {(r.section, r.ord): r.line for r in shown.collect()}
    assert Counter(s for s, _ in lines) == {"usages": 61, "tests": 15, "docs": 16} and lines["usages", 61] == "... 10 more" and lines["docs", 16] == "... 2 more" and lines["usages", 60] == "p059:1 read t"
    assert "WindowGroupLimit" in shown._jdf.queryExecution().executedPlan().toString()


def test_levels_end_on_the_driver_as_soon_as_the_rest_fits(spark, monkeypatch):
    calls, kept = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, *a: calls.append(1) or kept(df, *a))
    pairs = [(i + 1, i) for i in range(12)] + [(20, 0), (21, 20), (30, 31), (31, 30), (31, 3), (40, 30)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    want = {i: i for i in range(13)} | {20: 1, 21: 2}
    for most in (14, 100):
        calls.clear()
        assert {r.id: r.level for r in graph.levels(edges, most).collect()} == want and len(calls) <= 10
    calls.clear()
    assert graph.trimmed(edges, 100).count() == len(pairs) and len(calls) == 1
    assert {(r.id, r.scc) for r in graph.cycles(edges, 100).collect()} == {(30, 30), (31, 30)}


def test_claims_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "PART_CLAIMS", 100)
    rng = random.Random(6)
    rows = [(f"g{g}", g, rng.randrange(300)) for g in (rng.randrange(40) for _ in range(5000))]
    first = {}
    for g, o, c in rows:
        first[c] = min(first.get(c, (o, g)), (o, g))
    got = hierarchy.reclaimed(spark.createDataFrame(rows, "grp string, ord long, component_id long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted({(g, c, first[c][1]) for g, o, c in rows if o > first[c][0]})
    assert got.rdd.getNumPartitions() == 50
