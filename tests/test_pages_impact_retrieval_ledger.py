import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import impact as I
from corvane.operators import ledger as L
from corvane.operators import pages as P
from corvane.operators import retrieval as R


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_markdown(spark):
    line = lambda x: one(spark, P.plain(F.lit(x)))
    assert line("- **Bold** [link](x.md) and `code` <br> | cell |") == "Bold link and code cell" and line("> quoted _x_name") == "quoted _x_name"
    assert one(spark, P.heading(F.lit("`Run` the [tool](t.md) ##"))) == "Run the tool"
    text = "x\n```mermaid\ngraph TD\n  A[call(x)] --> B[ok]\n```\ny\n~~~py\n# no\n"
    assert [(f[0], f[3]) for f in P.fences(text)] == [("mermaid", "graph TD\n  A[call(x)] --> B[ok]\n"), ("py", "# no\n")] and text[slice(*P.fences(text)[0][1:3])].endswith("```\n")
    assert P.quoted_labels("graph TD\n  A[call(x)] --> B[ok]\n  C[[sub]]\n  D[x(y]") == 'graph TD\n  A["call(x)"] --> B[ok]\n  C[[sub]]\n  D["x(y"]'
    page = "# One\nFirst. Second.\n```\n# no\n```\n## Two\nText here\n"
    assert P.outline_of(page) == "# One\nFirst\n## Two\nText here" and P.first_title("```\n# a\n```\n# B") == "B"
    assert P.overview_fault("text") == "no heading" and P.overview_fault("# A\n- x") == "no prose" and P.overview_fault("# A\n" + "word " * 30) is None and P.overview_fault("# A\nI will " + "word " * 30) == "a plan"
    got = P.described(spark.createDataFrame([("p", "<!-- summary: short -->\n" + page), ("q", None)], "page string, text string")).orderBy("page").collect()
    assert (got[0].title, got[0].summary, got[0].n_sections, got[1].title) == ("One", "short", 2, None)
    sections = spark.createDataFrame([("p", "a", 1, "run", 0), ("p", "b", 2, "How run works", 1), ("p", "c", 3, "run it", 2)], "page string, anchor string, level int, title string, ord int")
    assert P.best_headings(sections, spark.createDataFrame([("run",)], "name string")).first().anchor == "c"


def test_references(spark):
    pages = spark.createDataFrame([("p", "see [x](../core/left.md#a), notes.md and a\\b.py::C, `run()` `other` https://e/x.md")], "page string, text string")
    ids, names = spark.createDataFrame([("a/b.py::C",)], "id string"), spark.createDataFrame([("run",)], "name string")
    refs = P.references(pages, ids, names)
    assert {(r.kind, r.ref) for r in refs.collect()} == {("links", "core/left"), ("links", "notes"), ("ids", "a/b.py::C"), ("names", "run")}
    listed = spark.createDataFrame([(["p"], "z::gone"), (["q", "r"], "a/b.py::C")], "path array<string>, component_id string")
    assert {tuple(r) for r in P.page_components(listed, refs, ids).collect()} == {("p", "a/b.py::C"), ("q/r", "a/b.py::C")}


def test_links(spark):
    pages = [("core/left.md", "# Left\n## Deep part\nSee [r](Right.md), [gone](nope.md), ![i](x.md), [a](#Deep Part), [b](#none), `[c](nope.md)`, [w](https://w/x.md).\n"), ("core/right.md", "# Right\nThe Ledger and the Ledger. `Ledger`\n## More\nLedger again\n### Ledger\nLedger"), ("ledger.md", "# Ledger\nLedger itself\n")]
    df = spark.createDataFrame(pages, "page string, text string")
    terms = spark.createDataFrame([("Ledger", "ledger.md", "ledger"), ("Twice", "a.md", ""), ("Twice", "b.md", "")], "term string, page string, anchor string")
    rel = spark.createDataFrame([("core/right.md", "Used by", "core/left.md", 0), ("core/right.md", "Used by", "ledger.md", 1)], "page string, how string, other string, ord int")
    once = P.crosslinked(df, terms, rel)
    got = {r.page: r.text for r in once.collect()}
    assert got["core/left.md"].split("\n")[2] == "See [r](right.md), gone, ![i](x.md), [a](#Deep Part), b, `[c](nope.md)`, [w](https://w/x.md)."
    lines = got["core/right.md"].split("\n")
    assert lines[1] == "The [Ledger](../ledger.md#ledger) and the Ledger. `Ledger`" and lines[3] == "[Ledger](../ledger.md#ledger) again" and lines[4:6] == ["### Ledger", "Ledger"]
    assert "- Used by: [left](left.md)" in lines and "[ledger](" not in got["core/right.md"]
    assert {r.page: r.text for r in P.crosslinked(once, terms, rel).collect()} == got
    edges = spark.createDataFrame([(["a"], ["b"], 2), (["a"], ["c"], 2), (["a"], ["a", "x"], 9), (["a"], ["d"], 1)], "src array<string>, dst array<string>, n int")
    assert [r.dst for r in P.related_modules(edges, 2).orderBy("dst").collect()] == [["b"], ["c"]]


def test_values_in_prose():
    assert P.json_in('text ```json\n{"a": [1, 2,], "b": "}"}\n``` more') == {"a": [1, 2], "b": "}"} and P.json_in("none {bad") is None and P.json_in('x {oops} then {"k": 1}') == {"k": 1}
    assert P.dict_in("plan: {'a': ['x'], 'b': None} end") == {"a": ["x"], "b": None} and P.dict_in("{open('x')}") is None and P.dict_in(None) is None


CODE = '''from lib import LIMIT
LIMIT = 3
__all__ = ["LIMIT"]


def use(x=LIMIT):
    return x + LIMIT


def other():
    LIMIT = 4
    return LIMIT


def dyn(o):
    # LIMIT in words
    o.LIMIT = 1
    call(LIMIT=2)
    return getattr(o, "LIMIT")
'''


def test_impact(spark):
    assert {k: v[0] for k, v in I.labelled(CODE, "LIMIT").items()} == {1: "import", 2: "definition", 3: "public", 6: "read", 7: "read", 11: "other scope", 12: "other scope", 17: "write", 18: "keyword", 19: "dynamic"}
    assert I.parameters_of("def f(a, b: int = 2, *c): pass") == ["a", "b", "c"] and I.parameters_of("int f(int a, char b) {") == ["a", "b"]
    files = spark.createDataFrame([("pkg/a.py", CODE), ("tests/test_a.py", "from pkg.a import LIMIT\n"), ("conf/x.yaml", "LIMIT: 4\n"), ("doc/x.md", "LIMIT is\n"), ("b.js", "let y = LIMIT;\n// LIMIT\nLIMITS\n"), ("broken.py", "def (LIMIT\n"), ("n.py", None)], "path string, text string")
    found = {(r.path, r.line): r.kind for r in I.sites(files, "LIMIT").collect()}
    assert found["pkg/a.py", 16] == "textual" and found["conf/x.yaml", 1] == "config" and found["doc/x.md", 1] == "textual" and found["b.js", 1] == "reference" and found["b.js", 2] == "textual" and ("b.js", 3) not in found and found["broken.py", 1] == "reference"
    comps = spark.createDataFrame([("pkg/a.py::use", "pkg/a.py", 6, 7, ["x"]), ("pkg/a.py::all", "pkg/a.py", 1, 19, []), ("z.py::call", "z.py", 1, 2, ["LIMIT"])], "id string, relative_path string, start_line int, end_line int, parameters array<string>")
    edges = spark.createDataFrame([("z.py::call", "pkg/a.py::use"), ("y.py::far", "z.py::call"), ("x.py::too", "y.py::far")], "src string, dst string")
    sections = spark.createDataFrame([("Limits.md", "how", "the LIMIT of all")], "file string, anchor string, content string")
    rows = I.report("LIMIT", files, comps, edges, sections)
    by = {}
    for r in rows.collect():
        by.setdefault(r.section, []).append(r)
    assert [r.line for r in by["definitions"]] == [2] and {r.id for r in by["usages"] if r.line == 7} == {"pkg/a.py::use"} and {r.path for r in by["tests"]} == {"tests/test_a.py"}
    assert {(r.id, r.kind) for r in by["callers"]} == {("z.py::call", "hop 1"), ("y.py::far", "hop 2")} and by["docs"][0].path == "Limits.md" and len(by["other scope"]) == 2
    assert I.is_parameter("LIMIT", I.sites(files, "LIMIT"), comps).count() == 0 and I.is_parameter("LIMIT", I.sites(files.filter("path = 'b.js'"), "LIMIT"), comps).first().id == "z.py::call"
    many = spark.createDataFrame([("dynamic", "p", i, "k", "", None) for i in range(20)], rows.schema)
    lines = I.rendered(many).orderBy("ord").collect()
    assert len(lines) == 16 and lines[-1].line == "... 5 more"


def test_reading(spark):
    text = "def big(a,\n        b):\n" + "\n".join(f"    step{i}()" for i in range(40))
    assert R.signature_of("# c\n@deco\n" + text) == "def big(a, b):"
    units = spark.createDataFrame([("f::big", "code", "big", "big", "f", 1, 42, 200, text), ("f::in", "code", "in", "in", "f", 5, 9, 20, "inner"), ("s#a", "section", "a", "A", "p.md", None, None, 30, "Words here. More."), ("g::x", "code", "x", "x", "g", 1, 1, 500, "x" * 1800)], "id string, kind string, name string, title string, file string, start_line int, end_line int, tokens int, text string")
    asked = spark.createDataFrame([("f::big", 0), ("f::in", 1), ("g::x", 2), ("s#a", 3), ("no::no", 4)], "id string, ord int")
    assert {r.id: (r.taken, r.cut) for r in R.assembled(asked.filter("id <> 'no::no'"), units, 240).collect()} == {"f::big": (200, False), "s#a": (30, False)}
    assert {r.id: r.cut for r in R.assembled(asked.filter("id = 'g::x'"), units, 50).collect()} == {"g::x": True}
    near = spark.createDataFrame([("f::big", "h::y"), ("f::big", "s#a")], "id string, near string")
    got = {(r.id, r.state): r.text for r in R.read(asked, units, near, 240, ["step30"]).collect()}
    assert got["f::big", "read"].startswith(" 1  def big(a,") and got["s#a", "read"] == "Words here. More." and {k for k in got if k[1] != "read"} == {("g::x", "skipped"), ("f::in", "skipped"), ("no::no", "missing"), ("h::y", "related")}
    cut = R.reader(text, "code", 1, 100, ["step30"])
    assert "step30" in cut and cut.startswith(" 1  def big") and "... " in cut
    rows = {r.id: r for r in R.described(units, units.filter("id = 's#a'")).collect()}
    assert (rows["s#a"].stale, rows["s#a"].snippet, rows["f::in"].location) == (True, "Words here.", "f:5-9")
    files = spark.createDataFrame([("f", "a\nhit one\nb\nhit two", 0), ("q", "hit outside", 1)], "path string, text string, ord int")
    comps = spark.createDataFrame([("f::c", "f", 1, 4), ("f::d", "f", 2, 2)], "id string, relative_path string, start_line int, end_line int")
    assert {r.id: (r.hits, r.n) for r in R.grep(files, comps, "hit").collect()} == {"f::d": (["2: hit one"], 1), "f::c": (["4: hit two"], 1)} and R.grep(files, comps, "hit", most_hits=1).count() == 1
    edges, pages = spark.createDataFrame([("a", "b")], "src string, dst string"), spark.createDataFrame([("p", "a")], "page string, component_id string")
    secs = spark.createDataFrame([("p#1", "p", 2), ("p#2", "p", 3)], "id string, page string, level int")
    assert {tuple(r) for r in R.neighbours(edges, pages, secs).collect()} == {("a", "b"), ("b", "a"), ("a", "p#1"), ("p#1", "a"), ("p#2", "a")}
    assert [one(spark, R.budget_for(c, n)) for c, n in ((50, 1000), (100, 10**6), (0, 0))] == [12000, 36000, 3000]
    rounds = spark.createDataFrame([(1, 0, 90, 100, 0, 5), (1, 1, 90, 200, 1, 5), (2, 0, 10, 100, 1, 5), (2, 1, 10, 1100, 1, 5), (2, 2, 11, 2100, 1, 5), (3, 0, 10, 9999, 1, 5), (4, 0, 10, 1, 1, 5), (4, 1, 60, 2, 1, 0)], "run int, round int, confidence int, tokens int, kept int, leads int")
    assert {r.run: (r.round, r.reason) for r in R.stops(rounds, 5000).collect()} == {1: (1, "confident"), 2: (2, "low gain"), 3: (0, "budget"), 4: (1, "no more leads")}
    cand = spark.createDataFrame([("f::in", 9.0), ("s#a", 1.0), ("zz", 10.0)], "id string, priority double")
    assert [r.id for r in R.pool(cand, units, units.filter("id = 's#a'")).collect()] == ["s#a", "f::in"]
    assert "2.0k in" in R.answer_statistics(spark.createDataFrame([(2000, 10, 0.5)], "prompt_tokens int, output_tokens int, cost double")).first().footer
    assert R.freshness(spark.createDataFrame([("a", "deleted")], "path string, status string")).first().line.startswith("0 changed, 1 deleted")
    assert R.names_in("why does Index.open_all call fetch() with HTTPServer?") == ["Index.open_all", "open_all", "fetch", "HTTPServer"]
    assert {(r.id, r.found) for r in R.components_by_id(spark.createDataFrame([("a\\b::C", 0), ("q", 1)], "id string, ord int"), spark.createDataFrame([("a/b::C",)], "id string")).collect()} == {("a/b::C", True), ("q", False)}


def test_ledger(spark):
    cols = "phase string, target string, model string, asked_model string, provider string, seconds double, input_tokens long, output_tokens long, cache_read long, cache_write long, cost double, cost_source string"
    rows = [("plan", "t", "m", "m", "p", 1.0, 1000, 200, 400, 100, None, None), ("plan", "t", "m-old", "m", "p", 1.0, 1000, 200, 400, 100, None, None), ("write", "u", "z", "z", "p", 2.0, 10, 1, None, None, None, None), ("write", "u", "m", "m", "p", 2.0, 10, 1, 20, None, None, None), ("write", "u", "f", "f", "q", 2.0, 0, 0, None, None, 0.0, None), ("write", "u", "f", "f", "q", 2.0, 5, 0, None, None, 0.25, "provider")]
    prices = spark.createDataFrame([("p", "m", 1.0, 2.0, 0.25, 1.5), ("p", "n", 2.0, 3.0, None, None)], "provider string, model string, input double, output double, cache_read double, cache_write double")
    done = L.priced(spark.createDataFrame(rows, cols), prices)
    assert sorted((round(r.cost, 9) if r.cost is not None else -1, r.cost_source) for r in done.collect()) == [(-1, "unknown"), (-1, "unknown"), (0.0, "provider"), (0.00115, "configured"), (0.00115, "configured"), (0.25, "provider")]
    half = L.priced(spark.createDataFrame([("x", "t", "n", "n", "p", 1.0, 100, 10, 50, None, None, None)], cols), prices).first()
    assert half.cost == pytest.approx(230 / 1e6)
    told = {(r.level, r.name): r for r in L.summary(done).collect()}
    assert told["all", None].calls == 6 and told["all", None].status == "partial" and told["phase", "plan"].status == "complete" and told["model", "z"].status == "unknown" and told["phase", "write"].unpriced_models == ["m", "z"]
    calls = spark.createDataFrame([('{"prompt_tokens": 5, "completion_tokens": 2}',), ('{"usage": {"input_tokens": 7}, "cost_usd": 0.5}',), ("{}",), (None,)], "usage string")
    assert [(r.input_tokens, r.output_tokens, r.cost, r.reported) for r in L.normalised(calls).collect()] == [(5, 2, None, True), (7, None, 0.5, True), (None, None, None, False), (None, None, None, False)]
    phases = spark.createDataFrame([(1, 0, None, "run"), (1, 1, "a", "run"), (1, 2, None, "run")], "run int, ord int, task_phase string, run_phase string")
    assert [r.phase for r in L.phased(phases).orderBy("ord").collect()] == ["run", "a", "a"]
    assert [r.total_input for r in L.running_totals(spark.createDataFrame([(1, 0, 5, 1), (1, 1, None, 1)], "run int, ord int, input_tokens long, output_tokens long")).orderBy("ord").collect()] == [5, 5]


def test_progress_and_jobs(spark):
    timings = spark.createDataFrame([(1, "a", 10.0), (1, "b", 20.0), (1, "c", 1.0), (2, "a", 30.0)], "run int, target string, seconds double")
    runs = spark.createDataFrame([(1, 10, 3, 1, 60.0, 2, 0.0), (2, 5, 1, 0, 30.0, 4, 7.0), (3, 5, 0, 0, 1.0, 4, 0.0)], "run int, total int, done int, failed int, elapsed double, concurrency int, paused double")
    assert {r.run: r.eta for r in L.left(timings, runs).collect()} == {1: 180.0, 2: 37.0, 3: None}
    assert [r.target for r in L.slowest(timings, 2).collect()] == ["a", "b"]
    assert L.overall(spark.createDataFrame([(1, "analyse", 1.0), (1, "write", 0.5), (1, "odd", 1.0)], "run int, stage string, done double")).first().share == pytest.approx(0.45)
    assert L.status_line(spark.createDataFrame([(1, 9, 2, 1, 61.0)], "run int, total int, done int, failed int, eta double")).first().line == "2/9 done, 1 failed, about 1m 01s left"
    jobs = spark.createDataFrame([(1, "root", None, 1.0, 9), (1, "a", "root", 4.0, 0), (1, "b", "root", 3.0, 1), (1, "c", "root", 2.0, 2)], "run int, id string, parent string, seconds double, ord int")
    assert {r.slots: (r.makespan, r.serial, r.critical) for r in L.makespans(jobs, [1, 2, 3]).collect()} == {1: (10.0, 10.0, 5.0), 2: (6.0, 10.0, 5.0), 3: (5.0, 10.0, 5.0)}
    logs = spark.createDataFrame([(1, "turns=4"), (1, "ERROR x"), (1, "retrying; turns: 6")], "run int, line string")
    assert tuple(L.log_statistics(logs).first()) == (1, 3, 1, 1, 5.0)
    at = lambda s: F.lit(s).cast("timestamp")
    table = spark.createDataFrame([("k1", "1", "processing", "2024-01-01 00:00:00"), ("k2", "2", "failed", "2024-01-01 00:09:00"), ("k3", "3", "failed", "2024-01-01 00:01:00"), ("k4", "4", "completed", "2023-01-01 00:00:00"), ("k5", "5", "queued", "2024-01-01 00:00:00"), ("k6", "6", "queued", "2024-01-01 00:00:01")], "key string, job_id string, status string, at string").withColumn("at", F.col("at").cast("timestamp"))
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",), ("k9",)], "key string")
    cache = spark.createDataFrame([("k4",)], "key string")
    assert {r.key: (r.action, r.job_id) for r in L.intake(asked, table, cache, at("2024-01-01 00:10:00")).collect()} == {"k1": ("join", "1"), "k2": ("wait", "2"), "k3": ("queue", None), "k4": ("done", None), "k9": ("queue", None)}
    assert L.purged(table, at("2024-01-02 00:00:00")).count() == 5 and [r.job_id for r in L.recent(table, 1).collect()] == ["2"]
    assert {r.job_id: (r.place, r.accepted) for r in L.queue(table, 1).collect()} == {"5": (1, True), "6": (None, False)}
    tools = spark.createDataFrame([(1, i, t, r) for i, (t, r) in enumerate([("read", None), ("read", None), ("edit", "a"), ("edit", "b"), ("edit", "c"), ("edit", "d")])], "run int, ord int, tool string, rejected string")
    row = L.activity(tools).first()
    assert (row.tools, row.rejections) == (["edit 4", "read 2"], ["b", "c", "d"])


def test_budgets(spark):
    errors = spark.createDataFrame([("m", "This model's maximum context length is 8,192 tokens; your messages resulted in 9000 tokens", 4500), ("m", "prompt is too long: 300 tokens > 200 maximum", 100), ("n", "other", 1)], "model string, text string, estimated int")
    got = {r.model: (r.limit, r.ratio) for r in L.learned_limits(errors).collect()}
    assert got == {"m": (200, 3.0), "n": (None, None)} and L.limit_in("context window of 1,000") == 1000
    rows = [(1, 0, "user", "q" * 36), (1, 1, "tool", "r" * 3600), (1, 2, "tool", "s" * 3600), (1, 3, "assistant", "t" * 720)]
    out = L.trimmed(spark.createDataFrame(rows, "run int, ord int, role string, text string"), 700).orderBy("ord").collect()
    assert out[0].text == rows[0][3] and out[1].text == "[older result left out]" and "[...]" in out[2].text and sum(int(len(r.text) / 3.6) + 9 for r in out) <= 700
    pages = spark.createDataFrame([("g", 1, "# A\nshort"), ("g", 2, "# B\nFirst. " + "word " * 2000)], "grp string, id int, text string")
    short = {r.id: r.text for r in L.condensed(pages, 100).collect()}
    assert short[1] == "# A\nshort" and short[2] == "# B\nFirst"


def test_scalars(spark):
    x = lambda c: one(spark, c)
    assert [x(T.in_thousands(F.lit(n))) for n in (950, 1234, 3_400_000)] == ["950", "1.2k", "3.4M"] and [x(T.duration(F.lit(n))) for n in (45, 185, 7620)] == ["45s", "3m 05s", "2h 07m"]
    assert [x(T.human_size(F.lit(n))) for n in (10, 2048, 5 << 20)] == ["10 B", "2.0 KB", "5.0 MB"] and [x(T.dollars(F.lit(v).cast("double"))) for v in (0.0042, 1.25, None)] == ["$0.0042", "$1.25", "unknown"]
    assert tuple(x(T.file_parts(F.lit("a/b/.c.tar.GZ")))) == ("a/b", ".c.tar.GZ", ".c.tar", ".gz") and tuple(x(T.file_parts(F.lit(".env")))) == ("", ".env", ".env", "")
    assert x(T.epoch(F.lit("1970-01-01T00:01:00Z"))) == 60.0 and x(T.epoch(F.lit("bad"))) is None and x(T.age_days(F.lit("1970-01-01T00:00:00+00:00"), F.lit("1970-01-03 01:00:00"))) == 2
    assert x(T.day_name("qa", F.lit("2024-02-03 04:05:06").cast("timestamp"))) == "qa-2024-02-03" and x(T.clean_list(F.array(F.lit(" a "), F.lit(""), F.lit("b"), F.lit("c")), 2)) == ["a", "b"]
    assert x(T.origin(F.lit("HTTPS://me@Host.org:443/x"))) == "https://host.org" and x(T.origin(F.lit("x"))) is None
    assert {x(T.repository(F.lit(u))) for u in ("git@h.org:Me/x.git", "https://u@h.org/me/X/", "ssh://git@h.org/me/x.git")} == {"h.org/me/x"}
    assert [x(T.language_tag(F.lit(n))) for n in ("German", "pt_br", "", "xx")] == ["de", "pt-BR", "en", "xx"]
    assert x(T.clipped(F.lit("one two three"), 2)) == "one" and x(T.message_tokens(F.array(F.lit("abc"), F.lit("")))) == 18
    assert x(T.counters_merged(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))) == {"a": 3, "b": 3}


SCOPES = '''import os, pkg.max_age as m
from pkg import (a, max_age)
options = {"max_age": 1, "other": "max_age"}
def f(*max_age, **kw): return max_age
def g(a, /, b=max_age, *, max_age: int = 2): max_age = a; return lambda max_age: max_age
obj.setattr(x, "max_age", 1); getattr(x, "y", "max_age")
class C:
    max_age = 1
    def h(self):
        global max_age
        max_age += 1
        return [max_age for max_age in self.max_age]
def outer():
    def inner(): return max_age
    max_age = 1
for i, max_age in pairs: pass
with open(x) as max_age: print(f"{max_age} max_age")
x = rows["max_age"]; y = (max_age := 3); call(max_age=1)(max_age)
self.max_age, z = 1, 2
__all__ = ["max_age"]
__all__ += ("max_age",)
del max_age
@max_age
def k(): "max_age"
max_age: int = 3
'''


def test_labels_follow_scopes():
    got = I.labelled(SCOPES, "max_age")
    want = {1: "import", 2: "import", 3: "dynamic", 4: "definition", 5: "definition", 6: "dynamic", 8: "definition", 11: "write", 12: "attribute", 14: "other scope", 15: "other scope", 16: "definition", 17: "definition", 18: "definition", 19: "write", 20: "public", 21: "public", 22: "definition", 23: "read", 25: "definition"}
    assert {k: v[0] for k, v in got.items()} == want
    assert got[4] == ("definition", "parameter") and got[5] == ("definition", "parameter") and got[8] == ("definition", "")
    assert I.parameters_of("def f(a, /, b: int = 2, *c, d, **e): pass") == ["a", "b", "c", "d", "e"]


def test_paths_of_tests(spark):
    from corvane.operators.search import is_test_path

    paths = {"Tests/Foo.cs": True, "specs/a.rb": True, "testing/x.py": False, "a/test_x.py": True, "a/x_test.go": True, "a/x.spec.ts": True, "a/conftest.py": False, "latest/x.py": False, "__tests__/a.js": True}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", is_test_path(F.col("p")).alias("t")).collect()
    assert {r.p: r.t for r in rows} == paths
