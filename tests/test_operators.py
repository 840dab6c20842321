import random

from corvane.operators import extract, graph, packing
from corvane.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    assert {r[0] for r in graph.cycles(e).collect()} == {1, 2, 3}
    assert graph.closure(e).count() == 3 * 5 + 1
    assert {(r.id, r.level) for r in graph.levels(e.filter("src > 2 and dst > 3")).collect()} == {(5, 0), (4, 1), (3, 2)}
    assert {(r.id, r.hop) for r in graph.reach(e, e.select("src").limit(0).withColumnRenamed("src", "id")).collect()} == set()


def test_packing(spark):
    rows = spark.createDataFrame([("g", i, i, t) for i, t in enumerate([5, 7, 3, 9])], "grp string, id long, ord long, tokens long")
    assert [r.taken for r in packing.skip_greedy(rows, 15).orderBy("id").collect()] == [5, 7, 3]
    assert [r.bin for r in packing.next_fit(rows, 12).orderBy("id").collect()] == [0, 0, 1, 1]
    assert [r.share for r in packing.water_fill(rows, 16).orderBy("id").collect()] == [4, 4, 3, 4]


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for size in (3, 12, 40, 900):  # the last are longer than 4000 characters
        base = [f"w{rng.randrange(60)}é" for _ in range(size)]
        for i in range(9):
            words = base[:]
            for _ in range(rng.choice([0, 1, size // 40, size // 20])):
                words[rng.choice([0, rng.randrange(size)])] = rng.choice(["x", "w1é", "!", "y z"])
            texts.append((len(texts), rng.choice(["en", "en", None]), " ".join(words)))
    texts += [(len(texts), "en", None), (len(texts) + 1, "en", "")]
    rows = spark.createDataFrame(texts, "id long, lang string, text string").selectExpr("*", "length(text) AS n_chars")
    want = {(i, j) for i, k, t in texts for j, m, u in texts if i < j and k == m and t and u and min(len(t), len(u)) >= 0.9 * 0.95 * max(len(t), len(u)) and extract.ratio(t, u) >= 0.95}
    assert {(r.a, r.b) for r in extract.similar_pairs(rows, ["lang"], 0.95).collect()} == want
    by = {i: t for i, _, t in texts}
    assert any(len(by[i]) > 4000 for i, _ in want) and any(by[i][:12] != by[j][:12] for i, j in want)


def test_similarity_ratio_finds_long_texts(spark):
    long = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars >= 4000").collect()}
    pairs = QUERIES["similarity_ratio"](spark, SF).collect()
    assert any(r.a in long for r in pairs)


def test_sections_and_python():
    page = "# Card\nIntro.\n## Setup\n```\n# no\n```\nA\n## Setup\n"
    assert [s[:2] for s in extract.sections_of(page)] == [("card", 1), ("setup", 2), ("setup-1", 2)]
    assert [r["id"] for r in extract._python_rows("a.py", "def f(:")] == ["a.py::__file__"]
    assert extract.window_of("x\nthe der\nthe", ["the", "der"], 12) == (2, 3, 3)


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


#: Seconds each on the smallest tables, as their loops start many jobs; graphs of their kind are tested above.
SLOW = {"similarity_ratio"}


def test_every_query_gives_what_its_sql_gives(spark):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wrong = []
    for name in sorted(set(QUERIES) - SLOW):
        rows = QUERIES[name](spark, SF)
        got = rows.collect()
        if name not in ORACLE_SQL:
            continue
        want = con.sql(ORACLE_SQL[name])
        key = sorted(rows.columns)
        if key != sorted(want.columns) or sorted(repr([_plain(r[c]) for c in key]) for r in got) != sorted(repr([_plain(r[want.columns.index(c)]) for c in key]) for r in want.fetchall()):
            wrong.append(name)
    assert not wrong
