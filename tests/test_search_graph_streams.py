import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, ledger, search
from corvane.streaming import sessions


def test_search(spark):
    units = spark.createDataFrame([(1, "merge", "", "joins two sorted runs"), (2, "spill", "", "merge is what follows a spill"), (3, "RunWriter.flush_page", "io", "x"), (4, None, None, None)], "id long, title string, path string, content string")
    index = search.Index.build(units, buckets=4)
    assert search.top(index.scores(search.query_terms(spark, "merging")), 2).first().id == 1  # a title weighs more, and queries are stemmed
    assert [r.id for r in index.scores(search.query_terms(spark, "writer page")).collect()] == [3]  # parts of names are indexed
    assert index.scores(["spil"]).count() == 1 and index.scores(["zz", "sp"]).count() == 0 and index.scores([]).count() == 0
    assert index.n == 4 and search.Index(spark, index.path).expanded(["mer"]) == {"merg": (0.5, 2)}
    plan = index.postings(["merg"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    stamps = iter([1, 1, 2])
    first = search.Index.fresh(units, "t", lambda: next(stamps))
    assert search.Index.fresh(units, "t", None) is first  # not looked at again so soon


def test_rankings(spark):
    ranked = spark.createDataFrame([(i, float(10 - i)) for i in range(8)], "id long, score double")
    units = spark.createDataFrame([(i, n, n, k, f) for i, n, k, f in [(5, "open", "function", "src/a.py"), (6, "open", "function", "tests/test_a.py"), (7, "_open", "function", "src/a.py"), (9, "open", "method", "src/b.py")]], "id long, name string, qualified string, kind string, file string")
    assert [r.id for r in search.pinned(ranked, units, ["open", "_open"], 6).collect()] == [5, 6, 7, 9, 0, 1]
    a = spark.createDataFrame([(1, 1.0, ["query"], ["h1", "h2"])], "id long, score double, via array<string>, hits array<string>")
    b = spark.createDataFrame([(1, 3.0, ["grep"], ["h3", "h4"]), (2, 1.0, ["grep"], [])], a.schema)
    assert {tuple(r) for r in search.merged([a, b]).select("id", "score", F.concat_ws(" ", "via").alias("v"), F.concat_ws(" ", "hits").alias("h")).collect()} == {(1, 3.0, "grep query", "h1 h2 h3"), (2, 1.0, "grep", "")}
    with pytest.raises(ValueError):
        search.of_kind(units, "prose")
    best = search.reranked(spark.createDataFrame([(1, 2.0, 0, 800), (2, 1.0, 1, 0)], "id long, score double, hits int, tokens int")).collect()
    assert {r.id: round(r.priority, 3) for r in best} == {1: 1.15, 2: 1.4}


def test_cycles_by_either_way(spark):
    rng = random.Random(3)
    edges = list({(rng.randrange(40), rng.randrange(40)) for _ in range(70)})
    e = spark.createDataFrame(edges, "src long, dst long")
    by_driver, by_colour = ({(r.id, r.scc) for r in graph.cycles(e, most).collect()} for most in (1000, 5))
    assert by_driver == by_colour and by_driver
    free = graph.acyclic(e)
    assert {tuple(r) for r in graph.levels(free).collect()} == {tuple(r) for r in graph.levels(free, 0).collect()}
    assert graph.cycles(free).count() == 0 and graph.cycle_break(e).count() == len({s for _, s in by_driver})
    last = {r.id: r.level for r in graph.dependency_first(free, spark.range(45)).collect()}
    assert all(last[u] > last[v] for u, v in map(tuple, free.collect())) and last[44] == 0


def test_streams(spark, tmp_path):
    rows = [("a", i, t) for i, t in enumerate([0, 10, 59, 60, 61, 130])] + [("b", 9, 5)]
    told = sessions.throttled(spark.createDataFrame(rows, "key string, id long, ts long")).collect()
    assert {(r.key, r.ts, r.n) for r in told} == {("a", 0, 1), ("a", 60, 4), ("a", 130, 6), ("b", 5, 1)}
    pauses = sessions.paused_until(spark.createDataFrame([("k", 1, 0, 50), ("k", 2, 10, 30), ("k", 3, 60, None)], "key string, id long, ts long, until long")).orderBy("ts").collect()
    assert [(r.paused, r.wait) for r in pauses] == [(50, 50), (50, 40), (50, 0)]
    done = sessions.progress(spark.createDataFrame([(1, "x", "added", 0.0), (1, "y", "added", 0.0), (1, "x", "done", 5.0), (1, "y", "done", 1.0), (1, "z", "failed", 9.0)], "run long, target string, kind string, seconds double")).first()
    assert (done.total, done.done, done.failed, done.cached, done.timed, done.seconds) == (2, 2, 1, 1, 1, 5.0)
    events = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "a"), (1, 2, "2024-01-01 02:00:01", "b"), (1, 3, "2024-01-01 04:00:01", "c"), (2, 4, "2024-01-01 00:00:00", "d")], "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    at = f"file://{tmp_path}/events.parquet"
    events.coalesce(1).write.parquet(f"{tmp_path}/folder")
    next(p for p in (tmp_path / "folder").iterdir() if p.suffix == ".parquet").rename(tmp_path / "events.parquet")
    assert {tuple(r) for r in sessions.run_to_end(spark, at).collect()} == {(1, 1, 1), (1, 2, 2), (2, 1, 1)}
    states = sessions.into_table(sessions.latest_state(sessions.read_stream(spark, at)))
    assert {tuple(r) for r in states.collect()} == {(1, "c"), (2, "d")}
    told = sessions.into_table(sessions.throttled_stream(sessions.read_stream(spark, at).select(F.col("user_id").alias("key"), "ts")), "update")
    assert {(r.key, r.n) for r in told.collect()} == {(1, 1), (1, 2), (1, 3), (2, 1)}


def test_answer_lines(spark):
    events = spark.createDataFrame([(1, 1, "step", "x"), (1, 2, "answer", 'q"\n'), (1, 3, "end", None), (1, 4, "late", "y"), (2, 1, "step", None), (2, 2, "answer", "z")], "ask long, n long, type string, text string")
    stops = spark.createDataFrame([(2, 1), (2, 2)], "ask long, n long")
    both = [tuple(r) for r in sessions.answer_lines(events, stops).orderBy("ask", "n").collect()]
    assert both == [(1, 1, '{"type":"step","text":"x"}'), (1, 2, '{"type":"answer","text":"q\\"\\n"}'), (2, 1, '{"type":"step"}')]
    assert sessions.answer_lines(events).count() == 4 and sessions.answer_lines(events.limit(0)).count() == 0


def test_lent_slots(spark):
    kinds = ["hold", "lend", "hold", "hold", "note", "release", "resume", "release", "release"]
    rows = ledger.slots_held(spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)], "run string, ord long, kind string"), 1).orderBy("ord").collect()
    assert [r.held for r in rows] == [1, 0, 1, 2, 2, 1, 2, 1, 0] and [r.over for r in rows] == [0, 0, 0, 1, 1, 0, 1, 0, 0]


def _units(rng, ids):
    words = [f"w{int(1.2**k)}x{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randrange(n)))
    return [(i, text(5), rng.choice([None, "src io", ""]), text(60)) for i in ids]


def test_updates_of_an_index_equal_a_full_build(spark):
    rng, schema = random.Random(11), "id long, title string, path string, content string"
    now = {u[0]: u for u in _units(rng, range(300))}
    index = search.Index.build(spark.createDataFrame(list(now.values()), schema), buckets=5)
    for step in range(4):
        new = _units(rng, [*rng.sample(range(300), 9), 1000 + step])
        gone = [(i,) for i in rng.sample(sorted(set(now) - {u[0] for u in new}), 3)] + [(99_999,)]
        now = {i: u for i, u in (now | {u[0]: u for u in new}).items() if (i,) not in gone}
        index = index.update(spark.createDataFrame(new, schema), spark.createDataFrame(gone, "id long"))
    whole = search.Index.build(spark.createDataFrame(list(now.values()), schema))
    assert (index.n, index.total, index.average) == (whole.n, whole.total, whole.average) and 1 < len(index.segments) < 5
    assert sorted(map(tuple, index.vocabulary().collect())) == sorted(map(tuple, whole.vocabulary().collect()))
    for query in (["w1x0", "w9x12"], ["w1x"], ["src", "w2x4"]):
        one, two = ({r.id: round(r.score, 9) for r in x.scores(query).collect()} for x in (index, whole))
        assert one == two and one
    again = search.Index(spark, index.path)
    assert again.n == index.n and len(again.segments) == len(index.segments)
    merged = again.merged(0)
    assert len(merged.segments) == 1 and {r.id: round(r.score, 9) for r in merged.scores(["w1x0"]).collect()} == {r.id: round(r.score, 9) for r in whole.scores(["w1x0"]).collect()}


def test_an_index_of_nothing(spark):
    schema = "id string, title string, path string, content string"
    for rows in ([], [("a", "the of", None, "and the")]):
        index = search.Index.build(spark.createDataFrame(rows, schema))
        assert index.n == len(rows) and index.scores(["merg"]).count() == 0 and index.vocabulary().count() == 0
        index = index.update(spark.createDataFrame([("b", "merge", "", "")], schema), spark.createDataFrame([("a",)], "id string"))
        assert index.n == 1 and [r.id for r in index.scores(["merg"]).collect()] == ["b"]


def test_buckets_are_even_whatever_the_terms(spark):
    rows = spark.range(4000).select(F.col("id"), F.lit("").alias("title"), F.lit("").alias("path"), F.concat(F.lit("every "), F.when(F.col("id") % 2 == 0, "second ").otherwise(""), F.concat(F.lit("x"), F.col("id") % 50), F.lit(" y"), F.col("id")).alias("content"))
    index = search.Index.build(rows, buckets=8)
    sizes = sorted(r["count"] for r in index._postings(index.segments[0]).groupBy("bucket").count().collect())
    assert len(sizes) == 8 and sizes[-1] < 1.3 * sizes[4] and any(len(b) > 1 for b in index.segments[0].hot.values())
    assert index.scores(["every"]).count() == 4000 and index.scores(["y17"]).count() == 1
