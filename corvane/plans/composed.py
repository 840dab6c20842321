"""Queries made of the library's DataFrame operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import extract, graph, packing, resolve, search
from corvane.plans.dialect import SPARK
from corvane.sources.tables import load, register
from corvane.streaming import sessions

QUESTION, QUERY = "error signup the der tho", ["error", "signup", "der", "tho"]


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr("left(text, 40)").alias("title"), F.concat_ws(" ", "source", "lang").alias("path"), F.col("text").alias("content"))


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of the documents, kept for the application until their table changes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    status = lambda: at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    return search.Index.fresh(_units(spark, sf_dir), sf_dir, lambda: (status().getModificationTime(), status().getLen()))


def bm25f_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best units for a question, with prefix expansion."""
    return search.top(_index(spark, sf_dir).scores(search.query_terms(spark, QUESTION)), 10)


def bm25f_topk_docs_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among units of one kind; English ones stand for documents."""
    kinds = _units(spark, sf_dir).select("id", F.when(F.col("path").endswith(" en"), "section").otherwise("code").alias("kind"))
    return search.top(_index(spark, sf_dir).scores(search.query_terms(spark, QUESTION), search.of_kind(kinds, "docs")), 10)


def bm25f_stale_before_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale units are discounted before the cut."""
    stale = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).filter("id % 7 = 0")
    return search.top(search.discounted(_index(spark, sf_dir).scores(search.query_terms(spark, QUESTION)), stale), 10)


def fused_two_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question at 1.0 and keywords at 0.8, the larger counts."""
    index = _index(spark, sf_dir)
    return search.top(search.fused([(index.scores(search.query_terms(spark, "error der")), 1.0), (index.scores(search.query_terms(spark, "tho les")), 0.8)]), 10)


def _bm25_parts(query: list[str]) -> str:
    """The common tables of the ranking in SQL, the last of them `ranked` (id, score)."""
    stop = "('" + "', '".join(search.T.STOPWORDS) + "')"
    p = "CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN substring(w, 1, length(w) - 1) ELSE w END"
    b = "CASE WHEN length(p) > 5 AND p LIKE '%ing' THEN substring(p, 1, length(p) - 3) WHEN length(p) > 4 AND p LIKE '%ed' AND NOT p LIKE '%eed' THEN substring(p, 1, length(p) - 2) ELSE p END"
    e = "CASE WHEN b LIKE '%e' AND NOT b LIKE '%ee' THEN substring(b, 1, length(b) - 1) ELSE b END"
    s = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN concat(substring(w, 1, length(w) - 3), 'y') WHEN NOT regexp_matches(b, '^[A-Za-z]+$') OR length(b) <= 3 THEN b WHEN right(e, 1) = substring(e, length(e) - 1, 1) AND NOT contains('aeioulsfz', right(e, 1)) THEN substring(e, 1, length(e) - 1) ELSE e END"
    occ = " UNION ALL ".join(f"SELECT doc_id AS id, '{f}' AS field, {w} AS wt, unnest(regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS raw FROM documents" for f, w, x in (("title", 4, "left(text, 40)"), ("path", 2, "concat(source, ' ', lang)"), ("content", 1, "text")))
    pieces = "list_transform(flatten(list_transform(string_split(raw, '_'), lambda c: CASE WHEN regexp_matches(c, '^[\\x00-\\x7F]*$') THEN regexp_extract_all(regexp_replace(c, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') ELSE [c] END)), lambda x: lower(x))"
    asked = " UNION ALL ".join(f"SELECT '{t}' AS q" for t in query)
    return f"""
    r AS ({occ}), g AS (SELECT DISTINCT raw, {pieces} AS parts FROM r), whole AS (SELECT raw, CASE WHEN parts = [lower(raw)] THEN [lower(raw)] ELSE list_concat([lower(raw)], parts) END AS ws FROM g),
    o AS (SELECT id, field, wt, unnest(ws) AS w FROM r JOIN whole USING (raw)), o1 AS (SELECT *, {p} AS p FROM o WHERE length(w) > 1 AND w NOT IN {stop}), o2 AS (SELECT *, {b} AS b FROM o1), o3 AS (SELECT *, {e} AS e FROM o2),
    post AS (SELECT id, field, wt, {s} AS term, count(*) AS freq FROM o3 GROUP BY ALL),
    len AS (SELECT id, field, sum(freq) AS len FROM post GROUP BY ALL), av AS (SELECT field, greatest(1.0::DOUBLE, sum(len) / (SELECT count(*) FROM documents)::DOUBLE) AS avg FROM len GROUP BY field),
    voc AS (SELECT DISTINCT term FROM post), asked AS ({asked}), hit AS (SELECT term, 1.0::DOUBLE AS q FROM voc JOIN asked ON term = q),
    miss AS (SELECT q FROM asked WHERE q NOT IN (SELECT term FROM voc) AND length(q) >= 3),
    near AS (SELECT term, 0.5::DOUBLE AS q FROM (SELECT q, term, row_number() OVER (PARTITION BY q ORDER BY term) AS k FROM miss JOIN voc ON term >= q) x WHERE k <= 6 AND starts_with(term, q)),
    wanted AS (SELECT term, max(q) AS q FROM (SELECT * FROM hit UNION ALL SELECT * FROM near) GROUP BY term),
    tf AS (SELECT post.id, post.term, q, sum(wt * freq / (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) AS tf FROM post JOIN wanted USING (term) JOIN len ON len.id = post.id AND len.field = post.field JOIN av ON av.field = post.field GROUP BY ALL),
    df AS (SELECT term, count(DISTINCT id) AS df FROM post WHERE term IN (SELECT term FROM wanted) GROUP BY term),
    ranked AS (SELECT id, sum(q * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (1.2::DOUBLE + tf)) AS score FROM tf JOIN df USING (term) GROUP BY id)"""


def _bm25_sql(query: list[str], where: str = "", factor: str = "1") -> str:
    return f"WITH {_bm25_parts(query)} SELECT id, round(score * {factor}, 6) AS score FROM ranked {where} ORDER BY 2 DESC, 1 LIMIT 10"


def transitive_closure_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a component reaches."""
    register(spark, sf_dir)
    return graph.closure(spark.table("edge"))


def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of cycles, by the least of their component."""
    register(spark, sf_dir)
    return graph.cycles(spark.table("edge"))


def reach_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each component reaches in three steps, with the least number of them."""
    register(spark, sf_dir)
    found = graph.reach(spark.table("edge"), spark.table("comp").select(F.col("pk").alias("id")), 3)
    return found.filter("hop > 0").select("seed", "id", F.col("hop").cast("long").alias("hop"))


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest path of dependencies below a component, along all edges but those inside cycles."""
    register(spark, sf_dir)
    return graph.levels(graph.acyclic(spark.table("edge"))).select("id", F.col("level").cast("long").alias("level"))


def expand_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best pass half their score to neighbours."""
    register(spark, sf_dir)
    seeds = spark.table("comp").filter("tokens > 45").select(F.col("pk").alias("id"), (F.col("tokens") + (F.col("pk") % 97) / 100).cast("double").alias("score"))
    return search.frontier(seeds, spark.table("edge"))


def pack_skip_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a source in order, those skipped that do not fit into 12000 tokens."""
    register(spark, sf_dir)
    return packing.skip_greedy(spark.table("units").select(F.col("source").alias("grp"), "id", F.col("id").alias("ord"), "tokens"), 12000).select("grp", "id", F.col("taken").cast("long").alias("taken"))


def pack_next_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a directory in order, in groups of at most 400 tokens."""
    register(spark, sf_dir)
    files = spark.table("comp").groupBy("dir", "path").agg(F.sum("tokens").alias("tokens"))
    return packing.next_fit(files.select(F.col("dir").alias("grp"), F.col("path").alias("id"), F.col("path").alias("ord"), "tokens"), 400)


def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of one language by sequence ratio: pairs of classes (how: near), and the members of each class of copies (how: copy)."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text", F.length("text").alias("n_chars"))
    members, near = extract.similar_classes(docs, ["lang"], 0.95)
    copies = members.filter("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit("copy").alias("how"))
    return copies.unionByName(near.withColumn("how", F.lit("near")))


def rename_candidates_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one language with a Dice score of 0.95 or more on their words, between classes of equal words (how: near), and the members of each class (how: copy). Its SQL is in the catalog."""
    register(spark, sf_dir)
    rows = spark.sql(f"SELECT id, lang AS block, {SPARK.words('text')} AS words FROM units")
    members, near = extract.bags_classes(rows, 95)
    copies = members.filter("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit("copy").alias("how"))
    return copies.unionByName(near.withColumn("how", F.lit("near")))


def implements_by_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose parts hold all parts of a smaller order. Its SQL is in the catalog."""
    return resolve.containing(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("m")))


def best_window_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of lines within 300 characters that holds most query words."""
    return extract.best_window(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ["the", "der", "les"], 300)


def water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget shared fairly over the units of a source."""
    register(spark, sf_dir)
    return packing.water_fill(spark.table("units").select(F.col("source").alias("grp"), "id", "tokens"), 20000)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of two hours' inactivity, from a stream over the events."""
    return sessions.run_to_end(spark, f"{sf_dir}/events.parquet")


QUERIES = {f.__name__: f for f in (bm25f_topk, bm25f_topk_docs_only, bm25f_stale_before_cut, fused_two_query, transitive_closure_bounded, scc_members, reach_hops, topo_levels, expand_frontier, pack_skip_greedy, pack_next_fit, similarity_ratio, rename_candidates_blocked, implements_by_containment, best_window_cut, water_fill, stream_sessions)}

_REACH = "WITH RECURSIVE r(src, dst) AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM r JOIN edge e ON r.dst = e.src)"
ORACLE_SQL = {
    "bm25f_topk": _bm25_sql(QUERY),
    "bm25f_topk_docs_only": _bm25_sql(QUERY, "WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "bm25f_stale_before_cut": _bm25_sql(QUERY, factor="CASE WHEN id % 7 = 0 THEN 0.5::DOUBLE ELSE 1 END"),
    "transitive_closure_bounded": f"{_REACH} SELECT DISTINCT src, dst FROM r",
    "scc_members": f"{_REACH} SELECT a.src AS id, least(a.src, min(a.dst)) AS scc FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src",
    "reach_hops": "WITH RECURSIVE r(seed, id, hop) AS (SELECT pk, pk, CAST(0 AS BIGINT) FROM comp UNION SELECT seed, dst, hop + 1 FROM r JOIN edge ON id = src WHERE hop < 3) SELECT seed, id, min(hop) AS hop FROM r GROUP BY seed, id HAVING min(hop) > 0",
    "topo_levels": f"{_REACH}, m AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS scc FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src), d AS (SELECT e.src, e.dst FROM edge e LEFT JOIN m x ON e.src = x.id LEFT JOIN m y ON e.dst = y.id WHERE x.scc IS NULL OR y.scc IS NULL OR x.scc <> y.scc), l(id, level) AS (SELECT src, CAST(0 AS BIGINT) FROM d UNION SELECT dst, 0 FROM d UNION SELECT d.src, level + 1 FROM l JOIN d ON l.id = d.dst) SELECT id, max(level) AS level FROM l GROUP BY id",
    "expand_frontier": "WITH s AS (SELECT pk AS id, CAST(tokens + (pk % 97) / 100.0::DOUBLE AS DOUBLE) AS score FROM comp WHERE tokens > 45), b AS (SELECT id, score FROM s ORDER BY round(score, 6) DESC, id LIMIT 10), n AS (SELECT dst AS id, max(round(score, 6)) * 0.5 AS score FROM b JOIN edge ON b.id = src WHERE dst NOT IN (SELECT id FROM s) GROUP BY dst) SELECT id, round(score, 6) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM n) u ORDER BY 2 DESC, 1 LIMIT 30",
    "fused_two_query": "WITH a AS (WITH " + _bm25_parts(["error", "der"]) + " SELECT id, score FROM ranked), b AS (WITH " + _bm25_parts(["tho", "les"]) + " SELECT id, score * 0.8::DOUBLE AS score FROM ranked) SELECT id, round(max(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY id ORDER BY 2 DESC, 1 LIMIT 10",
    "water_fill": "WITH RECURSIVE o AS (SELECT source AS grp, id, tokens, row_number() OVER (PARTITION BY source ORDER BY tokens, id) AS k, count(*) OVER (PARTITION BY source) AS n FROM units), f(grp, k, id, tokens, spent, share) AS (SELECT grp, k, id, tokens, CAST(0 AS BIGINT), least(tokens, 20000 // n) FROM o WHERE k = 1 UNION ALL SELECT o.grp, o.k, o.id, o.tokens, f.spent + f.share, CASE WHEN f.share < f.tokens THEN f.share ELSE least(o.tokens, (20000 - f.spent - f.share) // (n - o.k + 1)) END FROM f JOIN o ON o.grp = f.grp AND o.k = f.k + 1) SELECT grp, id, tokens, CAST(share AS BIGINT) AS share FROM f",
    "stream_sessions": "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 7200 THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, session",
    "pack_skip_greedy": "WITH RECURSIVE o AS (SELECT source AS grp, id, tokens, row_number() OVER (PARTITION BY source ORDER BY id) AS k FROM units), r(grp, k, id, used, taken) AS (SELECT grp, k, id, least(tokens, 12000), least(tokens, 12000) FROM o WHERE k = 1 UNION ALL SELECT o.grp, o.k, o.id, CASE WHEN used + tokens <= 12000 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 12000 THEN tokens ELSE 0 END FROM r JOIN o ON o.grp = r.grp AND o.k = r.k + 1) SELECT grp, id, CAST(taken AS BIGINT) AS taken FROM r WHERE taken > 0",
    "pack_next_fit": "WITH RECURSIVE f AS (SELECT dir AS grp, path AS id, CAST(sum(tokens) AS BIGINT) AS tokens FROM comp GROUP BY dir, path), o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS k FROM f), r(grp, k, id, bin, used) AS (SELECT grp, k, id, CAST(0 AS BIGINT), tokens FROM o WHERE k = 1 UNION ALL SELECT o.grp, o.k, o.id, CASE WHEN used + tokens > 400 THEN bin + 1 ELSE bin END, CASE WHEN used + tokens > 400 THEN tokens ELSE used + tokens END FROM r JOIN o ON o.grp = r.grp AND o.k = r.k + 1) SELECT grp, id, bin FROM r",
}
