import json

from pyspark.sql import functions as F

from corvane.operators import artifacts as A
from corvane.sources import files as S

REPO = {
    "pyproject.toml": "[project]\nname = 'x'\n[project.scripts]\nshop = 'shop.cli:main'\n", "package.json": json.dumps({"scripts": {"zip": "tar", "build": "node tools/pack.js"}}, indent=1),
    "Makefile": "all: build\n\tpython -m shop.jobs\nbuild test:\n\tnpm run zip\n%.o: %.c\n", "Dockerfile": "FROM a AS base\nFROM b\nRUN make build\n", ".github/workflows/ci.yml": "on: push\njobs:\n  lint:\n    run: tools/pack.js\n  check:\n    run: x\n",
    "shop/jobs.py": "def go(): pass\n", "tools/pack.js": "x\n", "yarn.lock": "x", "docs/a.yml": "x: 1", ".gitignore": "*.log\n!keep.log\n/out/\ndeep/**/x.txt\n", "a.log": "x", "keep.log": "x", "out/y.py": "x", "sub/.gitignore": "keep.log\n", "sub/keep.log": "x", "deep/q/x.txt": "x",
}


def test_scan_and_ignore(spark, tmp_path):
    for p, t in REPO.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "bin.dat").write_bytes(b"a\x00\xff")
    found = S.scan(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {*REPO, "bin.dat"}
    assert "content" not in found.columns and S.summary(found).first().files == len(REPO) + 1
    texts = S.head(S.scan(spark, str(tmp_path), True), 100)
    by = {r.path: r for r in texts.collect()}
    assert by["bin.dat"].is_binary and by["bin.dat"].total == 3 and by["bin.dat"]["head"].endswith("�") and not by["a.log"].is_binary
    specs = texts.filter("name = '.gitignore'").select("dir", F.col("head").alias("text"))
    assert {r.path for r in S.ignored(found, specs).filter("ignored").collect()} == {"a.log", "out/y.py", "sub/keep.log", "deep/q/x.txt"}
    gone = spark.createDataFrame([("out/",), ("a.log",)], "path string")
    assert {r.path for r in S.not_listed(found, gone).collect()} == {*REPO, "bin.dat"} - {"out/y.py", "a.log"}
    assert S.changed_since(found, F.lit("2000-01-01").cast("timestamp")).count() == len(REPO) + 1
    code = S.routed(texts)
    assert {(r.path, r.language) for r in code.collect()} == {("shop/jobs.py", "python"), ("tools/pack.js", "javascript"), ("out/y.py", "python")}
    assert [tuple(r) for r in S.histogram(S.supported(code)).collect()] == [("python", 2), ("javascript", 1)]


def test_patterns_and_headers(spark):
    paths = spark.createDataFrame([(p,) for p in ("src/a.py", "src/a.pyc", "node_modules/x/a.js", "lib/gen/b.py", "x.lock", "notes.md")], "path string")
    kept = lambda c: {r.path for r in paths.filter(c).collect()}
    assert kept(S.included(F.col("path"), ["*.py"])) == {"src/a.py", "lib/gen/b.py"} and len(kept(S.included(F.col("path")))) == 6
    assert kept(S.excluded(F.col("path"), ["gen/", "src/a.p?"])) == {"lib/gen/b.py", "src/a.py"}
    assert kept(~S.left_out(F.col("path"), user=["lib/"], listed=F.col("path") == "x.lock", own=["notes.md"])) == {"src/a.py", "x.lock"}
    files = spark.createDataFrame([("a.h", "class X {"), ("b.h", "int x;"), ("c.c", ""), ("d_test.go", "")], "path string, head string")
    assert {r.path: r.language for r in S.routed(files).collect()} == {"a.h": "cpp", "b.h": "c", "c.c": "c"}
    assert {r.language for r in S.routed(spark.createDataFrame([("b.h", "int x;"), ("c.cc", "")], files.schema)).collect()} == {"cpp"}


def test_tables(spark, tmp_path):
    comps = spark.createDataFrame([("/r/b.py::B", "B", "/r/b.py"), ("/r/a.py::A", "A", "/r/a.py")], "id string, name string, relative_path string")
    S.write_graph(comps, spark.createDataFrame([("/r/a.py::A", "/r/b.py::B")], "src string, dst string"), f"{tmp_path}/g", "/r")
    back, edges = S.read_graph(spark, f"{tmp_path}/g")
    assert {r.relative_path for r in back.collect()} == {"a.py", "b.py"} and [tuple(r) for r in edges.collect()] == [("/r/a.py::A", "/r/b.py::B")]
    snaps = spark.createDataFrame([("p1", "x", 1), ("p2", "y", 9), ("p3", "x", 5)], "path string, name string, modified int")
    assert S.previous(snaps, "x").first().path == "p3" and S.previous(snaps, "q").first().path == "p2" and [r.path for r in S.superseded(snaps).collect()] == ["p1"]
    feed = spark.createDataFrame([("m/a.py", "M"), ("m/b.py", "D"), ("n/c.py", "A"), ("m/docs/p.md", "??"), ("m/b.py", "D")], "path string, code string")
    assert {tuple(r) for r in S.changed(feed, "m", ("docs/",)).collect()} == {("a.py", "changed"), ("b.py", "deleted")}
    lines = spark.createDataFrame([(1, 1, "[23:59:50] start a"), (1, 2, "noise"), (1, 3, "[00:00:10] start b"), (1, 4, "[00:00:15] done b")], "run long, ord long, line string")
    assert [(r.t, r.target, r.span) for r in S.parsed_log(lines).orderBy("ord").collect()] == [(86390, "a", 20), (86410, "b", 5), (86415, "b", 0)]
    entries = spark.createDataFrame([("http://a", "2024-01-01", "old"), ("http://a", "2024-03-01", "new"), ("http://b", "2023-01-01", "gone")], "url string, created string, value string").select(F.substring(F.sha2("url", 256), 1, 16).alias("cache_key"), F.col("created").cast("timestamp").alias("created"), "value")
    got = {r.url: r.value for r in S.cached(entries, spark.createDataFrame([("http://a",), ("http://b",)], "url string"), F.lit("2024-03-05").cast("timestamp")).collect()}
    assert got == {"http://a": "new", "http://b": None}
    jobs = spark.createDataFrame([("j1", "queued")], "job_id string, status string")
    assert {tuple(r) for r in S.restored_jobs(jobs, spark.createDataFrame([("j1",), ("j2",)], "job_id string")).collect()} == {("j1", "queued"), ("j2", "completed")}
    n, first = S.full_and_first(spark.range(50), f"{tmp_path}/full")
    assert n == 50 and first.count() == 20
    S.append_log(spark.createDataFrame([("2024-01-02 03:04:05", 1)], "ts string, n int"), f"{tmp_path}/log")
    assert (tmp_path / "log" / "day=2024-01-02").exists()
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int"), spark.createDataFrame([("a", 2), ("c", 2)], "path string, v int")
    assert {tuple(r) for r in S.replaced(old, new, spark.createDataFrame([("a",)], "path string")).collect()} == {("a", 2), ("b", 1)}
    hit = spark.createDataFrame([(["core"],)], "path array<string>")
    e = S.envelope(None, new.select("path"), hit).first()
    assert (e.method, e.changed, e.affected) == ("time", 2, ["core"]) and S.envelope(new.limit(0), new, hit).first().hint == "no changes"
    assert S.readme(old.select(F.lit("README.rst").alias("path"))).first().path == "README.rst" and {tuple(r) for r in S.walk_order(old, new).collect()} == {("a", 0), ("b", 0), ("c", 1)}
    there = spark.createDataFrame([("r2", "a")], "root string, path string")
    assert S.root_of(spark.createDataFrame([("r1", 0), ("r2", 1)], "root string, ord int"), there, old).first().root == "r2"


def test_artifact_classes(spark):
    want = {
        ".github/workflows/x.yaml": "ci", "ci/run.sh": "ci", "Jenkinsfile": "ci", "Dockerfile.dev": "container", "docker/gunicorn.conf.py": "container", "compose.prod.yml": "container", "packages/a/package.json": "manifest", "requirements-dev.txt": "manifest", "x.csproj": "manifest",
        "conftest.py": "test_infra", "vite.config.ts": "build", "jest.config.js": "test_infra", "src/main.py": None, "debian/control": "packaging", "app.service": "packaging", "m4/x.m4": "build", "a/b/x.m4": None, "rules.mk": "build", ".babelrc": "build",
        "api.proto": "schema", "openapi.v1.yaml": "schema", "schemas/x.json": "schema", "a.toml": "config", "a/b/c.toml": None, "config/a/b.ini": "config", ".editorconfig": "config", "tools/x/y/z.sh": "script", "a/b/c/d.sh": None, "README.md": None, "yarn.lock": None, "vendor/x/Makefile": None, "CODEOWNERS": None,
    }
    rows = spark.createDataFrame([(p, 1, None) for p in want] + [("bin/run", 1, "#!/bin/sh"), ("bin/data", 1, "x"), ("empty.toml", 0, None)], "path string, size int, line string")
    got = {r.path: r.c for r in rows.select("path", A.artifact_class(F.col("path"), F.col("size"), F.col("line")).alias("c")).collect()}
    assert got == want | {"bin/run": "script", "bin/data": None, "empty.toml": None}
    prose = rows.select("path", A.artifact_class(F.lit("README.md"), F.lit(1), prose=True).alias("a"), A.artifact_class(F.lit("docs/x.md"), F.lit(1), prose=True).alias("b")).first()
    assert (prose.a, prose.b) == ("prose", "prose")


def test_artifact_pass(spark):
    files = spark.createDataFrame([(p, len(t), t) for p, t in REPO.items()], "path string, size int, head string")
    nodes, edges = A.artifact_pass(files)
    ids = {r.id for r in nodes.collect()}
    assert {"pyproject.toml::shop", "package.json::build", "Makefile::all", "Makefile::test", "Dockerfile::base", "Dockerfile::stage-1", ".github/workflows/ci.yml::lint"} <= ids
    assert not any("%" in i or "yarn.lock" in i or i.startswith("docs/") for i in ids)
    pairs = {tuple(r) for r in edges.collect()}
    assert {("Makefile::file", "Makefile::all"), ("Makefile::file", "shop/jobs.py::__file__"), ("package.json::file", "tools/pack.js::__file__"), ("Makefile::file", "package.json::zip"), ("Dockerfile::file", "Makefile::build"), (".github/workflows/ci.yml::file", "tools/pack.js::__file__")} <= pairs
    text = {r.artifact_class: r.text for r in A.artifact_index(nodes, shown=2).collect()}
    assert "Makefile: all, build, ... 1 more" in text["build"]
    listed = spark.createDataFrame([(["a"], "Makefile::file")], "path array<string>, component_id string")
    assert A.coverage(nodes, listed).first().share < 0.8 and A.guaranteed(nodes, listed).filter("path[0] = 'Build and deployment'").count() >= 4
    many = spark.createDataFrame([(f"d{i}/x.toml", "config", 30) for i in range(50)] + [("Makefile", "build", 90)], "path string, artifact_class string, tokens int")
    kept, rest = A.capped(many)
    assert kept.count() == 41 and rest.count() == 10
    assert {r.path for r in A.within_budget(many, 130).collect()} == {"Makefile", "d0/x.toml"}


def test_unit_parsers():
    assert A.units_of("configure.ac", "AC_ARG_ENABLE([fast], [x])\nAC_ARG_WITH(zlib)")[1] == ("--with-zlib", "option", 2)
    assert [u[0] for u in A.units_of("Makefile.am", "bin_PROGRAMS = a \\\n  b\nlib_LTLIBRARIES = c.la\n")] == ["a", "b", "c.la"]
    assert [u[0] for u in A.units_of("Makefile", "zz:\nall:\n" + "".join(f"t{i}:\n" for i in range(40)))][:2] == ["all", "zz"] and len(A.units_of("Makefile", "".join(f"t{i}:\n" for i in range(40)))) == 25
    assert A.call_end("A([x)], (y)) z", 0) == 12 and A.units_of("package.json", "{bad") == []
    assert A.references_of("npm run zip && npm install && docker build -f a/Dockerfile .") == [("script", "zip", 1), ("image", "a/Dockerfile", 1)]


def test_references_are_words_of_commands():
    got = A.references_of('{"scripts": {"zip": "node web/app.js && make -C sub all",\n "b": "python3 -m shop.cart:main"}, "main": "lib/x.js"}')
    assert got == [("path", "web/app.js", 1), ("target", "all", 1), ("module", "shop.cart:main", 2), ("path", "lib/x.js", 2)]
    text = 'all: build\n\t@python -m shop.cart\nbuild: src/x.c https://e/x.py $(D)/y.py /abs/z.py\n\t-sh tools/pack.sh # see gone.sh\n\tmake -j 4 one two X=1 \\\n  three\n\techo "make coffee" a@b.py x.py:3\n\tcp y.py z.txt\n'
    want = [("module", "shop.cart", 2), ("path", "src/x.c", 3), ("path", "tools/pack.sh", 4), ("target", "one", 5), ("target", "two", 5), ("target", "three", 5), ("path", "x.py", 7), ("path", "y.py", 8)]
    assert A.references_of(text) == want
    steps = "steps:\n  - run: yarn build && ./ci/go.sh --config=conf/a.toml\n  - run: |\n      pnpm lint\n      npm run test\n      npm test\n      bash -c 'make inner'\n"
    assert A.references_of(steps) == [("script", "build", 2), ("path", "./ci/go.sh", 2), ("path", "conf/a.toml", 2), ("script", "lint", 4), ("script", "test", 5), ("target", "inner", 7)]
    assert A.references_of("RUN FOO=1 docker buildx build --file=img/D .\ndocker build -t x -f two .") == [("image", "img/D", 1), ("image", "two", 2)] and A.references_of("") == []
