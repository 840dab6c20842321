"""Queries that apply the library's functions to relations bound to the tables, with their SQL where it can say them; source files, pages and build files are derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import artifacts, extract, hierarchy, impact, languages, ledger, maintain, pages, partition, resolve, retrieval, search, stale
from corvane.session import stored
from corvane.sources import code
from corvane.sources import files as sources
from corvane.sources.tables import load, register
from corvane.streaming import sessions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(text)


# ---- the tree of regions and nations; parents list what their children do

_MODULES = "SELECT DISTINCT array(parent) AS path, array(pk) AS ord_path, pk * 100 AS ord FROM module UNION ALL SELECT array(parent, name), array(pk, mk), pk * 100 + mk + 1 FROM module"
_LISTED = "SELECT array(parent, name) AS path, cid AS component_id, CAST(weight AS INT) AS ord FROM owned JOIN module USING (mk) UNION ALL SELECT array(parent), cid, CAST(weight AS INT) FROM owned JOIN module USING (mk)"
_USES = "SELECT DISTINCT concat('c', CAST(o_custkey AS STRING)) AS src, concat('s', CAST(l_suppkey AS STRING)) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00'"


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _sql(spark, sf_dir, _MODULES), spark.sql(_LISTED)


def _flat(df: DataFrame) -> DataFrame:
    """Paths as text, as the SQL has them."""
    return df.select(*[F.array_join(c, "/").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])


@query("SELECT cid AS component_id, path FROM owned JOIN module USING (mk)")
def tree_owners(spark, sf_dir):
    """The deepest module that lists a component."""
    modules, listed = _tree(spark, sf_dir)
    return _flat(maintain.owners(listed, modules))


@query("SELECT path FROM module")
def tree_units(spark, sf_dir):
    """Leaves and modules that own something themselves."""
    modules, listed = _tree(spark, sf_dir)
    return _flat(maintain.units(modules, maintain.owners(listed, modules)))


@query("SELECT path, CAST(0 AS INT) AS distance, parent AS ancestor FROM module")
def tree_ancestors(spark, sf_dir):
    """Modules above each, the nearest first."""
    return _flat(hierarchy.ancestors(_tree(spark, sf_dir)[0]))


@query("SELECT (SELECT count(*) + count(DISTINCT parent) FROM module) AS n_modules, (SELECT string_agg(n, '/' ORDER BY n) FROM (SELECT parent AS n FROM module UNION SELECT name FROM module) x) AS names, (SELECT count(DISTINCT cid) FROM owned) AS n_components")
def tree_counts(spark, sf_dir):
    """Modules, names and components of the tree."""
    return _flat(hierarchy.counts(*_tree(spark, sf_dir)))


@query("SELECT path, concat(regexp_replace(parent, '[^\\w.-]+', '_', 'g'), '/', regexp_replace(name, '[^\\w.-]+', '_', 'g'), '.md') AS page FROM module UNION ALL SELECT DISTINCT parent, concat(regexp_replace(parent, '[^\\w.-]+', '_', 'g'), '.md') FROM module")
def tree_page_paths(spark, sf_dir):
    """Where the page of a module lies."""
    return _flat(_tree(spark, sf_dir)[0].select("path", hierarchy.page_path(F.col("path")).alias("page")))


@query("SELECT DISTINCT parent AS title, CAST(1 AS INT) AS depth, pk AS first FROM module UNION ALL SELECT name, 2, mk FROM module")
def tree_navigation(spark, sf_dir):
    """The menu of a site, in order."""
    return hierarchy.navigation(_tree(spark, sf_dir)[0]).select("title", "depth", F.element_at("key", -1).alias("first"))


@query("WITH t AS (SELECT DISTINCT path, parent FROM owned JOIN module USING (mk) WHERE weight > 9900) SELECT path, 'module' AS why FROM t UNION SELECT parent, 'ancestor' FROM t UNION SELECT '', 'overview' FROM t")
def tree_cascade(spark, sf_dir):
    """Pages that a change concerns: modules, their ancestors, the overview."""
    modules, listed = _tree(spark, sf_dir)
    return _flat(maintain.cascade(listed.filter("size(path) = 2 AND ord >= 9900").join(spark.table("owned").filter("weight > 9900").select(F.col("cid").alias("component_id")), "component_id").select("path")))


@query("WITH t AS (SELECT DISTINCT path, parent FROM owned JOIN module USING (mk) WHERE cid LIKE 's%') SELECT path FROM t UNION SELECT parent FROM t")
def tree_pruned(spark, sf_dir):
    """Modules that hold a supplier, themselves or below; emptied parents go."""
    modules, listed = _tree(spark, sf_dir)
    return _flat(maintain.surviving(modules, listed.filter("size(path) = 2 AND startswith(component_id, 's')")).select("path"))


@query("SELECT cid AS component_id, path FROM owned JOIN module USING (mk) WHERE cid NOT LIKE 's%' UNION ALL SELECT cid, parent FROM owned JOIN module USING (mk) WHERE cid NOT LIKE 's%' UNION ALL SELECT concat('n', cid), path FROM owned JOIN module USING (mk) WHERE cid LIKE 's%' UNION ALL SELECT concat('n', cid), parent FROM owned JOIN module USING (mk) WHERE cid LIKE 's%'")
def tree_renamed(spark, sf_dir):
    """Components under new names at their module and all above it."""
    _, listed = _tree(spark, sf_dir)
    names = spark.table("owned").filter("startswith(cid, 's')").select(F.col("cid").alias("component_id"), F.concat(F.lit("n"), "cid").alias("new"))
    return _flat(hierarchy.renamed(listed.select("path", "component_id"), names))


@query()
def tree_related(spark, sf_dir):
    """Modules next to one: above, beside, below it, and those of code it uses."""
    modules, listed = _tree(spark, sf_dir)
    return _flat(hierarchy.related(["ASIA", "CHINA"], modules, listed, spark.sql(_USES)))


@query("SELECT fault, count(*) AS n FROM (SELECT 'leftover' AS fault, concat('s', CAST(s_suppkey AS STRING)) AS c FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'unmatched', cid FROM owned WHERE cid LIKE 'c%') x GROUP BY fault")
def tree_check(spark, sf_dir):
    """Ids of no component, components in no module."""
    _, listed = _tree(spark, sf_dir)
    suppliers = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), "s_acctbal")
    listed = listed.join(suppliers.filter("s_acctbal < 0").select(F.col("id").alias("component_id")), "component_id", "left_anti")
    return hierarchy.tree_check(listed, suppliers).groupBy("fault").agg(F.count("*").alias("n"))


@query("SELECT b.l_suppkey AS grp, count(DISTINCT b.l_partkey) AS n FROM lineitem b JOIN (SELECT l_partkey, min(l_suppkey) AS f FROM lineitem GROUP BY l_partkey) a ON a.l_partkey = b.l_partkey AND b.l_suppkey > a.f GROUP BY b.l_suppkey")
def reclaimed_ids(spark, sf_dir):
    """Ids that an earlier group has claimed."""
    claims = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_suppkey").alias("ord"), F.col("l_partkey").alias("component_id"))
    return hierarchy.reclaimed(claims).groupBy("grp").agg(F.count("component_id").alias("n"))  # its rows are distinct, and an id has one first group


@query("WITH u AS (" + _USES + "), m AS (SELECT cid, path FROM owned JOIN module USING (mk)) SELECT a.path AS src, b.path AS dst, count(*) AS n FROM u JOIN m a ON src = a.cid JOIN m b ON dst = b.cid WHERE a.path <> b.path GROUP BY a.path, b.path")
def module_edges(spark, sf_dir):
    """Dependencies between modules, through the owners of components."""
    modules, listed = _tree(spark, sf_dir)
    own = maintain.owners(listed, modules)
    a, b = (own.select(F.col("component_id").alias(c), F.array_join("path", "/").alias(f"_{c}")) for c in ("src", "dst"))
    return spark.sql(_USES).join(a, "src").join(b, "dst").filter("_src <> _dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.count("*").alias("n"))


@query("WITH u AS (" + _USES + ") SELECT dst AS seed, src AS id FROM u WHERE dst IN (SELECT concat('s', CAST(s_suppkey AS STRING)) FROM supplier WHERE s_acctbal > 5000)")
def dependents_of(spark, sf_dir):
    """What uses the changed components within one step."""
    seeds = load(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return maintain.dependents(_sql(spark, sf_dir, _USES), seeds)


@query("SELECT path FROM (SELECT parent AS path, max(weight) AS w FROM owned JOIN module USING (mk) GROUP BY parent) p WHERE w > 9990 UNION ALL SELECT path FROM (SELECT path, parent, max(weight) AS w FROM owned JOIN module USING (mk) GROUP BY path, parent) c WHERE w > 9900 AND parent NOT IN (SELECT parent FROM owned JOIN module USING (mk) WHERE weight > 9990)")
def topmost_flagged(spark, sf_dir):
    """Flagged modules that lie under no other flagged one."""
    _, listed = _tree(spark, sf_dir)
    best = listed.join(spark.table("owned").select(F.col("cid").alias("component_id"), "weight"), "component_id").groupBy("path").agg(F.max("weight").alias("w"))
    return _flat(maintain.topmost(best.filter("(size(path) = 1 AND w > 9990) OR (size(path) = 2 AND w > 9900)")))


# ---- components of parts

_COMPONENTS = "SELECT id, name, CASE WHEN kind LIKE 'STANDARD%' THEN 'class' WHEN kind LIKE 'ECONOMY%' THEN 'function' WHEN kind LIKE 'PROMO%' THEN 'artifact' ELSE 'method' END AS component_type, path AS relative_path, CASE WHEN pk % 2 = 0 THEN 'python' ELSE 'java' END AS language, dir, pk FROM comp"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _COMPONENTS)


@query(
    "WITH c AS (" + _COMPONENTS + "), k AS (SELECT language, id, unnest(list_distinct([id, substring(id, strpos(id, '::') + 2), name])) AS key FROM c UNION ALL SELECT NULL, id, unnest(list_distinct([id, substring(id, strpos(id, '::') + 2), name])) FROM c) SELECT coalesce(language, 'all') AS language, count(*) AS n FROM (SELECT language, key FROM k GROUP BY language, key HAVING count(DISTINCT id) = 1) u GROUP BY language"
)
def resolution_index(spark, sf_dir):
    """Keys that name one component, by language and over all."""
    return resolve.index(_components(spark, sf_dir)).filter("kind = 'exact'").groupBy(F.coalesce("language", F.lit("all")).alias("language")).agg(F.count("*").alias("n"))


@query("WITH c AS (" + _COMPONENTS + "), call AS (SELECT id AS caller, language, CASE pk % 3 WHEN 0 THEN id WHEN 1 THEN name ELSE substring(id, strpos(id, '::') + 2) END AS callee FROM c), one AS (SELECT language, name, min(id) AS id FROM c GROUP BY language, name HAVING count(*) = 1), every AS (SELECT name, min(id) AS id FROM c GROUP BY name HAVING count(*) = 1) SELECT caller, callee, CASE WHEN callee = k.id OR callee = substring(k.id, strpos(k.id, '::') + 2) THEN k.id WHEN one.id IS NOT NULL THEN one.id ELSE every.id END AS resolved FROM call JOIN c k ON k.id = caller LEFT JOIN one ON one.name = callee AND one.language = call.language LEFT JOIN every ON every.name = callee")
def calls_resolved(spark, sf_dir):
    """Calls bound by the first rule whose key is unique, in the caller's language, then over all."""
    rows = _components(spark, sf_dir)
    callee = F.when(F.col("pk") % 3 == 0, F.col("id")).when(F.col("pk") % 3 == 1, F.col("name")).otherwise(resolve.dotted_name(F.col("id")))
    calls = rows.select(F.col("id").alias("caller"), callee.alias("callee"), F.lit(1).alias("call_line"), "language")
    return resolve.resolved(calls, rows.drop("dir", "pk")).select("caller", "callee", "resolved")


@query("WITH c AS (" + _COMPONENTS + ") SELECT count(CASE WHEN component_type = 'class' THEN 1 END) AS n_oop, count(CASE WHEN component_type = 'function' THEN 1 END) AS n_func, count(CASE WHEN component_type = 'class' THEN 1 END) = 0 OR (count(CASE WHEN component_type = 'class' THEN 1 END) < 20 AND count(CASE WHEN component_type = 'function' THEN 1 END) > count(CASE WHEN component_type = 'class' THEN 1 END)) OR (count(CASE WHEN component_type = 'function' THEN 1 END) > 0 AND count(CASE WHEN component_type = 'class' THEN 1 END) < 0.2 * count(CASE WHEN component_type IN ('class', 'function') THEN 1 END)) AS with_functions FROM c")
def leaf_types(spark, sf_dir):
    """Whether functions count as leaves."""
    return resolve.leaf_types(_components(spark, sf_dir))


@query("WITH c AS (" + _COMPONENTS + "), v AS (SELECT id, pk FROM c WHERE component_type IN ('class', 'artifact')) SELECT id FROM v WHERE (SELECT count(*) FROM v) < 400 OR NOT EXISTS (SELECT 1 FROM edge JOIN c s ON s.pk = src WHERE dst = v.pk AND s.component_type <> 'artifact')")
def leaves_selected(spark, sf_dir):
    """Components of a valid type that nothing but artifacts depends on."""
    rows = _components(spark, sf_dir)
    of = lambda c: rows.select(F.col("pk").alias(c), F.col("id").alias(f"_{c}"))
    edges = spark.table("edge").join(of("src"), "src").join(of("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    return resolve.leaves(rows, edges)


@query(
    "SELECT coalesce(a.id, b.id) AS id, coalesce(calls, 0) AS calls, coalesce(called_by, 0) AS called_by FROM (SELECT src AS id, count(DISTINCT dst) AS calls FROM edge GROUP BY src) a FULL OUTER JOIN (SELECT dst AS id, count(DISTINCT src) AS called_by FROM edge GROUP BY dst) b ON a.id = b.id"
)
def call_summary(spark, sf_dir):
    """What each component calls and is called by."""
    n = lambda c: F.size(F.coalesce(c, F.array().cast("array<bigint>"))).cast("long").alias(c)
    return resolve.call_summary(_sql(spark, sf_dir, "SELECT * FROM edge")).select("id", n("calls"), n("called_by"))


@query("WITH c AS (" + _COMPONENTS + "), d AS (SELECT id, count(DISTINCT o) AS degree FROM (SELECT src AS id, dst AS o FROM edge UNION ALL SELECT dst, src FROM edge) x GROUP BY id) SELECT c.id, coalesce(degree, 0) AS degree FROM c LEFT JOIN d ON d.id = pk ORDER BY degree DESC NULLS LAST, c.id LIMIT 10")
def entry_points(spark, sf_dir):
    """Components that look like a start or are most connected."""
    rows = _components(spark, sf_dir)
    of = lambda c: rows.select(F.col("pk").alias(c), F.col("id").alias(f"_{c}"))
    edges = spark.table("edge").join(of("src"), "src").join(of("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    return resolve.entry_points(rows, edges).select("id", "degree")


@query("SELECT 'node' AS kind, count(*) AS n FROM comp UNION ALL SELECT 'edge', count(*) FROM edge")
def graph_picture(spark, sf_dir):
    """Nodes and edges for drawing."""
    rows = _components(spark, sf_dir)
    return resolve.picture(rows, spark.table("edge").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT DISTINCT n_regionkey AS r, s_suppkey AS t, l_partkey % 7 AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity < 3), i AS (SELECT * FROM m WHERE t % 5 = 0), z AS (SELECT r, t, count(*) AS n FROM i GROUP BY r, t) SELECT CAST(m.r AS STRING) AS dir, CAST(m.t AS STRING) AS type, CAST(i.t AS STRING) AS interface FROM m JOIN i ON m.r = i.r AND m.x = i.x AND m.t <> i.t JOIN z ON z.r = i.r AND z.t = i.t GROUP BY m.r, m.t, i.t, z.n HAVING count(*) = z.n")
def implementers(spark, sf_dir):
    """Types whose methods hold all of an interface's, in one package."""
    rows = _sql(spark, sf_dir, "SELECT DISTINCT CAST(n_regionkey AS STRING) AS dir, CAST(s_suppkey AS STRING) AS type, CAST(l_partkey % 7 AS STRING) AS name, s_suppkey % 5 = 0 AS face FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity < 3")
    return resolve.implementers(rows, rows.filter("face").select("dir", F.col("type").alias("interface"), "name"))


@query("SELECT dir AS grp, CASE WHEN count(DISTINCT path) = 1 THEN dir ELSE dir END AS prefix FROM comp GROUP BY dir")
def shared_folder(spark, sf_dir):
    """The folders that all paths of a group share."""
    return hierarchy.common_prefix(_sql(spark, sf_dir, "SELECT dir AS grp, path FROM comp"))


@query("SELECT path, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM comp GROUP BY path")
def file_tokens(spark, sf_dir):
    """Tokens and components of files."""
    return partition.files_of(_sql(spark, sf_dir, "SELECT id, tokens FROM comp"))


@query("WITH f AS (SELECT dir AS grp, path, sum(tokens) AS tokens FROM comp GROUP BY dir, path) SELECT grp, path, sum(tokens) OVER (PARTITION BY grp ORDER BY tokens, path ROWS UNBOUNDED PRECEDING) <= 300 AS kept FROM f")
def files_that_fit(spark, sf_dir):
    """The largest files go first until the rest fits."""
    return partition.fitting(_sql(spark, sf_dir, "SELECT dir AS grp, path, CAST(sum(tokens) AS BIGINT) AS tokens FROM comp GROUP BY dir, path"), 300).select("grp", "path", "kept")


@query("SELECT min(id) AS id FROM comp c WHERE NOT EXISTS (SELECT 1 FROM comp b WHERE b.path = c.path AND b.tokens >= 50) GROUP BY path")
def uncovered_files(spark, sf_dir):
    """One component for each file without a chosen one."""
    rows = _components(spark, sf_dir)
    return partition.representatives(rows, spark.table("comp").filter("tokens >= 50").select("id"))


@query()
def module_tree(spark, sf_dir):
    """A module tree of all files, by folders and tokens."""
    tree = partition.clustered(partition.files_of(_sql(spark, sf_dir, "SELECT id, tokens * 20 AS tokens FROM comp")))
    rows = [(k, len(v["files"]), len(v["children"])) for k, v in tree.items()]
    return spark.createDataFrame(rows, "module string, files int, children int")


# ---- pages and paths

_PATHS = "SELECT page_id, concat(CASE page_id % 9 WHEN 0 THEN '.github/workflows/w' WHEN 1 THEN 'docker/d' WHEN 2 THEN 'src/pkg/s' WHEN 3 THEN 'debian/c' WHEN 4 THEN 'config/a/b' WHEN 5 THEN 'scripts/run' WHEN 6 THEN 'vendor/x' WHEN 7 THEN 'a/b/c/d' ELSE 'schemas/t' END, CAST(page_id AS STRING), CASE page_id % 7 WHEN 0 THEN '.yml' WHEN 1 THEN '.py' WHEN 2 THEN '.sh' WHEN 3 THEN '.json' WHEN 4 THEN '.toml' WHEN 5 THEN '.md' ELSE '.proto' END) AS path FROM pages"


@query("SELECT page_id, path, CASE WHEN path LIKE 'vendor/%' OR path LIKE '%.md' THEN NULL WHEN path LIKE '.github/workflows/%.yml' THEN 'ci' WHEN path LIKE 'docker/%.yml' OR path LIKE 'docker/%.sh' THEN 'container' WHEN path LIKE '%.py' THEN NULL WHEN path LIKE 'debian/%' THEN 'packaging' WHEN path LIKE '%.proto' OR (path LIKE 'schemas/%' AND (path LIKE '%.json' OR path LIKE '%.yml')) THEN 'schema' WHEN (path LIKE '%.toml' OR path LIKE '%.yml') AND (length(path) - length(replace(path, '/', '')) <= 1 OR split_part(path, '/', 1) IN ('config', '.github')) THEN 'config' WHEN path LIKE 'config/%.json' THEN 'config' WHEN path LIKE '%.sh' AND (length(path) - length(replace(path, '/', '')) <= 2 OR path LIKE 'scripts/%') THEN 'script' END AS cls FROM (" + _PATHS + ") p")
def artifact_classes(spark, sf_dir):
    """The class of a file, by the first rule that holds."""
    return _sql(spark, sf_dir, _PATHS).withColumn("cls", artifacts.artifact_class(F.col("path"), F.lit(1)))


@query("SELECT page_id, (path LIKE 'src/%' OR path LIKE '%.md') OR (NOT path LIKE '%.yml' AND (path LIKE 'vendor/%' OR path LIKE '%.toml')) OR path LIKE 'a/b/%' AS gone FROM (" + _PATHS + ") p")
def paths_left_out(spark, sf_dir):
    """What the user excludes goes, defaults yield to the white list, ignored files go last."""
    p = F.col("path")
    return _sql(spark, sf_dir, _PATHS).select("page_id", sources.left_out(p, user=["src/", "*.md"], defaults=["vendor/", "*.toml"], listed=sources.included(p, ["*.yml"]), ignored=p.startswith("a/b/")).alias("gone"))


@query("SELECT language, count(*) AS n FROM (SELECT CASE WHEN path LIKE '%.py' THEN 'python' END AS language FROM (" + _PATHS + ") p) x WHERE language IS NOT NULL GROUP BY language")
def language_histogram(spark, sf_dir):
    """Files by language."""
    return sources.histogram(sources.supported(sources.routed(_sql(spark, sf_dir, _PATHS).withColumn("head", F.lit("")))))


@query("WITH c AS (SELECT page_id, path, CASE WHEN path LIKE 'debian/%' AND path NOT LIKE '%.md' AND path NOT LIKE '%.py' THEN 'packaging' WHEN path LIKE 'schemas/%' AND (path LIKE '%.json' OR path LIKE '%.yml') THEN 'schema' END AS cls FROM (" + _PATHS + ") p), r AS (SELECT cls, row_number() OVER (PARTITION BY cls ORDER BY length(path) - length(replace(path, '/', '')), path) AS k FROM c WHERE cls IS NOT NULL) SELECT cls, count(CASE WHEN k <= 10 THEN 1 END) AS kept, count(CASE WHEN k > 10 THEN 1 END) AS omitted FROM r GROUP BY cls")
def artifact_caps(spark, sf_dir):
    """Of each class the first files by depth, then path."""
    p = F.col("path")
    rows = _sql(spark, sf_dir, _PATHS).withColumn("artifact_class", F.when(p.startswith("debian/") & ~p.rlike(r"\.(md|py)$"), "packaging").when(p.startswith("schemas/") & p.rlike(r"\.(json|yml)$"), "schema")).filter("artifact_class IS NOT NULL")
    kept, out = artifacts.capped(rows, 10)
    return kept.withColumn("k", F.lit(1)).unionByName(out.withColumn("k", F.lit(0))).groupBy(F.col("artifact_class").alias("cls")).agg(F.count(F.when(F.col("k") == 1, 1)).alias("kept"), F.count(F.when(F.col("k") == 0, 1)).alias("omitted"))


@query("SELECT page_id, lower(regexp_extract(url, '^(https?://[^/]+)', 1)) AS origin FROM pages")
def url_origins(spark, sf_dir):
    """scheme and host of addresses."""
    return load(spark, sf_dir, "pages").select("page_id", T.origin(F.col("url")).alias("origin"))


@query("SELECT coalesce(a.page_id, b.page_id) AS page FROM (SELECT page_id, html FROM pages WHERE page_id % 5 <> 0) a FULL OUTER JOIN (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(html, '.') ELSE html END AS html FROM pages WHERE page_id % 7 <> 0) b ON a.page_id = b.page_id WHERE a.page_id IS NULL OR b.page_id IS NULL OR a.html <> b.html")
def pages_changed(spark, sf_dir):
    """Pages whose text differs, that came or went."""
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("text"))
    return maintain.changed_pages(rows.filter("page % 5 <> 0"), rows.filter("page % 7 <> 0").withColumn("text", F.when(F.col("page") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))))


@query("WITH v AS (SELECT page_id AS page, CASE page_id % 3 WHEN 0 THEN 'patch' WHEN 1 THEN 'no-op' ELSE 'rewrite' END AS said FROM pages WHERE page_id % 4 <> 0), c AS (SELECT page_id AS page FROM pages WHERE page_id % 2 = 0) SELECT coalesce(v.page, c.page) AS page, CASE WHEN c.page IS NOT NULL AND coalesce(said, 'no-op') = 'no-op' THEN 'patch' WHEN c.page IS NULL AND said = 'patch' THEN 'no-op' ELSE said END AS verdict FROM v FULL OUTER JOIN c ON v.page = c.page")
def verdicts_reconciled(spark, sf_dir):
    """Verdicts held against the pages that did change."""
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").alias("page"))
    verdicts = rows.filter("page % 4 <> 0").withColumn("verdict", F.expr("CASE page % 3 WHEN 0 THEN 'patch' WHEN 1 THEN 'no-op' ELSE 'rewrite' END"))
    return maintain.reconciled(verdicts, rows.filter("page % 2 = 0")).select("page", "verdict")


# ---- ledger, sessions, jobs

_USAGE = "SELECT ts, event_id AS ord, event_type AS phase, concat('m', CAST(user_id % 3 AS STRING)) AS model, 'p' AS provider, concat('m', CAST(user_id % 2 AS STRING)) AS asked_model, user_id AS run, CAST(floor(value) AS BIGINT) AS input_tokens, CAST(floor(value / 2) AS BIGINT) AS output_tokens FROM events"


@query("WITH u AS (" + _USAGE + "), p AS (SELECT *, model = 'm0' AS k FROM u) SELECT 'all' AS level, NULL AS name, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(CAST(k AS INT)) AS BIGINT) AS priced, CASE WHEN bool_and(k) THEN 'complete' WHEN bool_or(k) THEN 'partial' ELSE 'unknown' END AS status FROM p UNION ALL SELECT 'phase', phase, count(*), sum(input_tokens), sum(CAST(k AS INT)), CASE WHEN bool_and(k) THEN 'complete' WHEN bool_or(k) THEN 'partial' ELSE 'unknown' END FROM p GROUP BY phase UNION ALL SELECT 'model', model, count(*), sum(input_tokens), sum(CAST(k AS INT)), CASE WHEN bool_and(k) THEN 'complete' WHEN bool_or(k) THEN 'partial' ELSE 'unknown' END FROM p GROUP BY model")
def usage_summary(spark, sf_dir):
    """Totals, by phase and by model, with what is priced, in one pass."""
    u = _sql(spark, sf_dir, _USAGE).withColumn("seconds", F.lit(0.0)).withColumn("cost", F.when(F.col("model") == "m0", 1.0)).withColumn("cost_source", F.lit(None).cast("string"))
    return ledger.summary(u).select("level", "name", "calls", "input_tokens", "priced", "status")


@query("WITH u AS (" + _USAGE + ") SELECT ord, cost_source, CASE WHEN cost_source = 'configured' THEN CAST(floor(micro + 0.5) AS BIGINT) END AS micro FROM (SELECT ord, CASE WHEN model IN ('m0', 'm1') OR asked_model IN ('m0', 'm1') THEN 'configured' ELSE 'unknown' END AS cost_source, CASE WHEN model = 'm0' OR (model = 'm2' AND asked_model = 'm0') THEN input_tokens * 2 + output_tokens * 4 ELSE input_tokens * 3 + output_tokens * 6 END AS micro FROM u) x")
def usage_priced(spark, sf_dir):
    """The price of a call by its model, else by the model that was asked for; unknown stays unknown."""
    prices = spark.createDataFrame([("p", "m0", 2.0, 4.0, None, None), ("p", "m1", 3.0, 6.0, 1.0, 1.0)], "provider string, model string, input double, output double, cache_read double, cache_write double")
    u = _sql(spark, sf_dir, _USAGE).withColumns({"cache_read": F.lit(None).cast("long"), "cache_write": F.lit(None).cast("long"), "cost": F.lit(None).cast("double"), "cost_source": F.lit(None).cast("string")})
    return ledger.priced(u, prices).select("ord", "cost_source", F.floor(F.col("cost") * 1_000_000 + 0.5).cast("long").alias("micro"))


@query("WITH u AS (" + _USAGE + ") SELECT run, ord, CAST(sum(input_tokens) OVER (PARTITION BY run ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_input FROM u")
def usage_so_far(spark, sf_dir):
    """What a run has used so far."""
    return ledger.running_totals(_sql(spark, sf_dir, _USAGE)).select("run", "ord", "total_input")


@query("SELECT event_id AS ord, coalesce(last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'run') AS phase FROM events")
def phases_told(spark, sf_dir):
    """The phase of work, else the last one told, else the run's."""
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).alias("task_phase"), F.lit("run").alias("run_phase"))
    return ledger.phased(rows).select("ord", "phase")


@query("SELECT target, CAST(round(s * 100) AS BIGINT) AS cents FROM (SELECT user_id AS target, sum(value) AS s FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 3) x")
def slowest_targets(spark, sf_dir):
    """The three that took longest."""
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("target"), F.col("value").alias("seconds"))
    return ledger.slowest(rows).select("target", F.round(F.col("seconds") * 100).cast("long").alias("cents"))


@query("WITH t AS (SELECT user_id AS run, count(*) AS n, avg(value) AS mean FROM events WHERE value >= 2 GROUP BY user_id), r AS (SELECT user_id AS run, count(*) + 5 AS total, count(*) AS done, CAST(100 AS DOUBLE) AS elapsed FROM events GROUP BY user_id) SELECT r.run, CASE WHEN n IS NULL THEN NULL WHEN n >= 8 THEN CAST(floor(5 * elapsed / n * 1000 + 0.5) AS BIGINT) ELSE CAST(floor(5 * mean / 5 * 1000 + 0.5) AS BIGINT) END AS millis FROM r LEFT JOIN t ON r.run = t.run")
def time_left(spark, sf_dir):
    """What is left at the pace of all, or by the mean of few; cached work says nothing."""
    e = load(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("run")).agg((F.count("*") + 5).alias("total"), F.count("*").alias("done")).withColumns({"failed": F.lit(0), "elapsed": F.lit(100.0), "concurrency": F.lit(8), "paused": F.lit(0.0)})
    return ledger.left(e.select(F.col("user_id").alias("run"), F.col("value").alias("seconds")), runs).select("run", F.floor(F.col("eta") * 1000 + 0.5).cast("long").alias("millis"))


@query("WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)), event_id) AS k FROM events), r(key, k, id, ts, told, keep) AS (SELECT key, k, id, ts, ts, true FROM e WHERE k = 1 UNION ALL SELECT e.key, e.k, e.id, e.ts, CASE WHEN e.ts - told >= 86400 THEN e.ts ELSE told END, e.ts - told >= 86400 FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1) SELECT key, id, CAST(k AS BIGINT) AS n FROM r WHERE keep")
def notices_throttled(spark, sf_dir):
    """One notice in a time, with the count so far."""
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    return sessions.throttled(rows, 86_400).select("key", "id", "n")


@query("SELECT user_id AS run, count(CASE WHEN event_type = 'view' THEN 1 END) AS total, count(CASE WHEN event_type = 'click' THEN 1 END) AS done, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, count(CASE WHEN event_type = 'click' AND value < 2 THEN 1 END) AS cached FROM events GROUP BY user_id")
def progress_counts(spark, sf_dir):
    """What was added, done, failed and cached of a run."""
    kind = F.expr("CASE event_type WHEN 'view' THEN 'added' WHEN 'click' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("target"), kind.alias("kind"), F.col("value").alias("seconds"))
    return sessions.progress(rows).select("run", "total", "done", "failed", "cached")


@query("SELECT event_id AS job_id, CASE WHEN k <= 100 THEN CAST(k AS INT) END AS place, k <= 100 AS accepted FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'view') x")
def job_queue(spark, sf_dir):
    """Waiting jobs in the order they came; beyond the room none is taken."""
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "view", "queued").otherwise("completed").alias("status"), F.col("ts").alias("at"))
    return ledger.queue(rows)


@query("WITH j AS (SELECT user_id AS key, event_id AS job_id, ts AS told, CASE event_type WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM events), l AS (SELECT key, job_id, status, told FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY told DESC, job_id DESC) AS k FROM j) x WHERE k = 1) SELECT c.c_custkey AS key, CASE WHEN status = 'processing' THEN 'join' WHEN status = 'failed' AND told > TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 3 MINUTE THEN 'wait' WHEN c.c_custkey % 2 = 0 THEN 'done' ELSE 'queue' END AS action FROM customer c LEFT JOIN l ON l.key = c.c_custkey")
def job_intake(spark, sf_dir):
    """Running jobs are joined, fresh failures wait, cached results are done, the rest is queued."""
    status = F.expr("CASE event_type WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END")
    jobs = load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("at"))
    keys = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return ledger.intake(keys, jobs, keys.filter("key % 2 = 0"), F.to_timestamp_ntz(F.lit("2024-01-29 00:00:00"))).select("key", "action")


@query("SELECT conv_id, CAST(sum(8 + greatest(1, CAST(floor(length(coalesce(text, '')) / CAST(3.6 AS DOUBLE)) AS BIGINT) + 1)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def message_tokens(spark, sf_dir):
    """Tokens of a conversation's messages."""
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.approx_tokens(F.length(F.coalesce("text", F.lit("")))) + 8).alias("tokens"))
    return rows


@query()
def messages_trimmed(spark, sf_dir):
    """The messages of a conversation within a budget."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("ord"), F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), "text")
    return ledger.trimmed(rows, 200).groupBy("run").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# ---- retrieval

@query("WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM documents), h AS (SELECT * FROM l WHERE regexp_matches(t, 'the') ), f AS (SELECT DISTINCT doc_id FROM h ORDER BY 1 LIMIT 40), k AS (SELECT h.* FROM h JOIN f USING (doc_id) ORDER BY doc_id, line LIMIT 120) SELECT concat(CAST(doc_id AS STRING), '::', CAST((line - 1) // 10 AS STRING)) AS id, count(*) AS n FROM k GROUP BY 1")
def grep_hits(spark, sf_dir):
    """Lines that match, in the order of files, mapped to components."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", F.col("doc_id").alias("ord"))
    blocks = docs.select(F.col("path").alias("relative_path"), F.explode(F.sequence(F.lit(0), F.floor((F.size(F.split("text", "\n")) - 1) / 10).cast("int"))).alias("b")).select(F.concat("relative_path", F.lit("::"), F.col("b").cast("string")).alias("id"), "relative_path", (F.col("b") * 10 + 1).alias("start_line"), (F.col("b") * 10 + 10).alias("end_line"))
    return retrieval.grep(docs, blocks, "the").select("id", "n")


@query("WITH r AS (SELECT DISTINCT l_orderkey AS run, l_linenumber AS round FROM lineitem WHERE l_orderkey < 400) SELECT run, CAST(min(round) AS INT) AS round, arg_min(reason, round) AS reason FROM (SELECT run, round, CASE WHEN (run % 97 + round * 10) >= 85 AND (round > 0) THEN 'confident' WHEN round * 3000 >= 12000 THEN 'budget' WHEN round >= 3 THEN 'rounds' END AS reason FROM r) x WHERE reason IS NOT NULL GROUP BY run")
def rounds_stopped(spark, sf_dir):
    """Where rounds of reading end, and why."""
    rows = _sql(spark, sf_dir, "SELECT DISTINCT l_orderkey AS run, l_linenumber AS round FROM lineitem WHERE l_orderkey < 400").select("run", "round", (F.col("run") % 97 + F.col("round") * 10).alias("confidence"), (F.col("round") * 3000).alias("tokens"), F.lit(1).alias("kept"), F.lit(1).alias("leads"))
    return retrieval.stops(rows, 12_000)


@query("SELECT doc_id AS id, CAST(least(60000, floor(12000 * (0.5::DOUBLE + (doc_id % 101) / 100.0::DOUBLE) * least(2.0::DOUBLE, greatest(0.5::DOUBLE, 0.5::DOUBLE + n_chars / 2000.0::DOUBLE)))) AS INT) AS budget FROM documents")
def question_budgets(spark, sf_dir):
    """Tokens to read for a question."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), retrieval.budget_for(F.col("doc_id") % 101, F.col("n_chars")).alias("budget"))


@query("SELECT CAST(event_id AS STRING) AS file, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'changed' END AS status FROM events WHERE user_id % 2 = 0 AND event_type <> 'view'")
def change_feed(spark, sf_dir):
    """One folder of a change feed, without our own output."""
    rows = load(spark, sf_dir, "events").select(F.concat(F.when(F.col("user_id") % 2 == 0, "app/").otherwise("lib/"), F.when(F.col("event_type") == "view", "docs/").otherwise(""), F.col("event_id").cast("string")).alias("path"), F.when(F.col("event_type") == "error", "D").otherwise("M").alias("code"))
    return sources.changed(rows, "app", ("docs/",)).select(F.col("path").alias("file"), "status")


@query("SELECT doc_id AS id, CASE WHEN n_chars < 1000 THEN CAST(n_chars AS STRING) ELSE concat(CAST((n_chars + 50) // 1000 AS STRING), '.', CAST((n_chars + 50) % 1000 // 100 AS STRING), 'k') END AS shown, CASE WHEN n_chars < 60 THEN concat(CAST(n_chars AS STRING), 's') WHEN n_chars < 3600 THEN printf('%dm %02ds', n_chars // 60, n_chars % 60) ELSE printf('%dh %02dm', n_chars // 3600, n_chars % 3600 // 60) END AS took FROM documents")
def shown_numbers(spark, sf_dir):
    """counts and durations as people write them."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.in_thousands(F.col("n_chars")).alias("shown"), T.duration(F.col("n_chars")).alias("took"))


# ---- texts that Spark derives from the tables

_NAMED = "concat(name, '.f', CAST(dst AS STRING), '.run', CAST(dst AS STRING))"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The derived files, their components, calls and variables."""
    files = code.files(spark, sf_dir)
    rows = stored(languages.extract(files), "extracted")
    comps = rows.filter("row_kind = 'component'").select("id", "name", "component_type", F.col("path").alias("relative_path"), "language", "start_line", "end_line", "parameters")
    calls = rows.filter("row_kind = 'call'").select(F.col("id").alias("caller"), "callee", "relation", "call_line", "language")
    return files, comps, calls, rows.filter("row_kind = 'binding'")


@query(f"""WITH {code.CODE}
SELECT 'component' AS row_kind, type_id AS id, kind AS component_type, CAST(NULL AS VARCHAR) AS callee, CAST(NULL AS VARCHAR) AS relation FROM code
UNION ALL SELECT 'component', method_id, 'method', NULL, NULL FROM code
UNION ALL SELECT 'call', method_id, NULL, 'log', 'call' FROM code
UNION ALL SELECT 'call', type_id, NULL, concat('C', CAST(dst AS STRING)), 'type' FROM code JOIN edge ON src = pk
UNION ALL SELECT 'call', method_id, NULL, {_NAMED}, 'call' FROM code JOIN edge ON src = pk
UNION ALL SELECT 'binding', type_id, NULL, concat('C', CAST(dst AS STRING)), 'field' FROM code JOIN edge ON src = pk""")
def language_extract(spark, sf_dir):
    """Components, calls and types of variables of source files in ten languages."""
    return languages.extract(code.files(spark, sf_dir)).select("row_kind", "id", "component_type", "callee", "relation")


@query(f"""WITH {code.CODE}, pair AS (SELECT a.type_id, a.method_id, a.name, a.language AS la, dst, b.type_id AS to_type, b.method_id AS to_method, b.language AS lb FROM code a JOIN edge ON src = a.pk JOIN code b ON b.pk = dst)
SELECT type_id AS caller, concat('C', CAST(dst AS STRING)) AS callee, to_type AS resolved, CASE WHEN la = lb THEN 1 ELSE 11 END AS rule FROM pair
UNION ALL SELECT method_id, {_NAMED}, to_method, 0 FROM pair WHERE la = lb""")
def source_graph(spark, sf_dir):
    """From files to a graph of components; methods are found by the types of their receivers, and a receiver of another language's type leads nowhere."""
    _, comps, calls, variables = _graph(spark, sf_dir)
    return resolve.bound(calls, comps, variables).filter("resolved IS NOT NULL").select("caller", "callee", "resolved", "rule")


_LOG_LINES = " ".join(f"WHEN '{x}' THEN {t[1].split('log(')[0].count(chr(10)) + 1}" for x, t in code.TEMPLATES.items())


@query(f"WITH {code.CODE} SELECT path, CAST(CASE language {_LOG_LINES} END + greatest(coalesce(n, 1), 1) - 1 AS INTEGER) AS line, 'reference' AS kind FROM code LEFT JOIN (SELECT src, count(*) AS n FROM edge GROUP BY src) e ON src = pk")
def impact_sites(spark, sf_dir):
    """Every line of the sources that names a function."""
    return impact.sites(code.files(spark, sf_dir), "log").select("path", "line", "kind")


@query()
def impact_report(spark, sf_dir):
    """What a change of a type touches: its places, and what uses it within two steps."""
    files, comps, calls, variables = _graph(spark, sf_dir)
    used = resolve.bound(calls, comps, variables).filter("resolved IS NOT NULL").select(F.col("caller").alias("src"), F.col("resolved").alias("dst"))
    sections = load(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("anchor"), F.col("text").alias("content"))
    return impact.rendered(impact.report("C1", files, comps, stored(used, "used"), sections))


_SUPPLIED = "SELECT s_suppkey AS k, concat('S', CAST(s_suppkey AS STRING)) AS s, s_nationkey AS n FROM supplier"
_MAKE = f"make AS (SELECT *, concat('s', CAST(k AS STRING), '/Makefile') AS path, concat('tools/t', CAST(k AS STRING), '.sh') AS tool, row_number() OVER (ORDER BY concat('s', CAST(k AS STRING), '/Makefile')) <= 40 AS kept, row_number() OVER (ORDER BY concat('tools/t', CAST(k AS STRING), '.sh')) <= 40 AS tool_kept FROM ({_SUPPLIED}) x)"


@query(f"""WITH {_MAKE}
SELECT concat(path, '::file') AS src, concat(path, '::all') AS dst FROM make WHERE kept UNION ALL SELECT concat(path, '::file'), concat(path, '::build', CAST(k AS STRING)) FROM make WHERE kept
UNION ALL SELECT concat(path, '::file'), concat(tool, CASE WHEN tool_kept THEN '::file' ELSE '::__file__' END) FROM make WHERE kept
UNION ALL SELECT concat(path, '::file'), concat('pkg/s', CAST(k AS STRING), '.py::__file__') FROM make WHERE kept""")
def artifact_graph(spark, sf_dir):
    """Build files (the first 40 of a class, which is the rule), their units and what they name; a supplier's files stand for a project's."""
    register(spark, sf_dir)
    files = spark.sql(
        f"""SELECT path, CAST(length(head) AS INT) AS size, head FROM ({_SUPPLIED}) x LATERAL VIEW inline(array(
        named_struct('path', concat('s', k, '/Makefile'), 'head', concat('all: build', k, '\n\t@python -m pkg.s', k, ' # tools/gone.sh\nbuild', k, ':\n\tsh ../tools/../tools/none.txt && sh tools/t', k, '.sh\n')),
        named_struct('path', concat('tools/t', k, '.sh'), 'head', 'echo "pkg/base.py stays"\n'), named_struct('path', concat('pkg/s', k, '.py'), 'head', 'x = 1\n'))) AS path, head"""
    )
    return artifacts.artifact_pass(files)[1]


_PAGE = f"page AS (SELECT k, n, concat('d', CAST(n AS STRING), '/supp', CAST(k AS STRING), '.md') AS page FROM ({_SUPPLIED}) x)"


@query(f"""WITH {_PAGE}
SELECT a.page, concat('# S', CAST(a.k AS STRING), chr(10), 'See ', CASE WHEN b.k IS NULL THEN 'other' ELSE concat('[other](', CASE WHEN a.n = b.n THEN '' ELSE concat('../d', CAST(b.n AS STRING), '/') END, 'supp', CAST(b.k AS STRING), '.md)') END,
  ' and gone, the [Ledger](../ledger.md). Ledger', chr(10), chr(10), '{pages.RELATED[0]}', chr(10), '- Parent: [home](../home.md)', chr(10), '{pages.RELATED[1]}', chr(10)) AS text
FROM page a LEFT JOIN page b ON b.k = a.k + 1 UNION ALL SELECT 'ledger.md', concat('# Ledger', chr(10)) UNION ALL SELECT 'home.md', concat('# Home', chr(10))""")
def pages_linked(spark, sf_dir):
    """Links repaired, first mentions linked, relations appended; a supplier's page stands for a module's."""
    register(spark, sf_dir)
    rows = spark.sql(f"WITH {_PAGE} SELECT page, concat('# S', k, '\nSee [other](SUPP-', k + 1, '.md) and [gone](x', k, '.md), the Ledger. Ledger\n') AS text FROM page UNION ALL SELECT 'ledger.md', '# Ledger\n' UNION ALL SELECT 'home.md', '# Home\n'")
    terms = spark.createDataFrame([("Ledger", "ledger.md", "")], "term string, page string, anchor string")
    relations = rows.filter("page LIKE 'd%'").select("page", F.lit("Parent").alias("how"), F.lit("home.md").alias("other"), F.lit(0).alias("ord"))
    return pages.crosslinked(rows, terms, relations)


@query(f"""WITH s AS ({_SUPPLIED}), p AS (SELECT *, concat('pkg/s', CAST(k AS STRING), '.py') AS path FROM s)
SELECT 'component' AS row_kind, concat(path, '::__file__') AS id, 'file' AS component_type, CAST(NULL AS VARCHAR) AS callee, CAST(NULL AS INTEGER) AS line FROM p WHERE k % 7 = 3
UNION ALL SELECT 'component', concat(path, '::', s), 'class', NULL, 2 FROM p WHERE k % 7 <> 3 UNION ALL SELECT 'call', concat(path, '::', s), NULL, concat('Base', CAST(n AS STRING)), 2 FROM p WHERE k % 7 <> 3
UNION ALL SELECT 'component', concat(path, '::', s, '.run'), 'method', NULL, 4 FROM p WHERE k % 7 <> 3 UNION ALL SELECT 'call', concat(path, '::', s, '.run'), NULL, concat('help', CAST(k AS STRING)), 5 FROM p WHERE k % 7 <> 3
UNION ALL SELECT 'component', concat(path, '::help', CAST(k AS STRING)), 'function', NULL, 6 FROM p WHERE k % 7 <> 3 UNION ALL SELECT 'call', concat(path, '::help', CAST(k AS STRING)), NULL, 'os.path.join', 7 FROM p WHERE k % 7 <> 3""")
def py_extract(spark, sf_dir):
    """Components and calls of Python sources, some of which do not parse; a supplier's module stands for a project's."""
    register(spark, sf_dir)
    text = "concat('import os\nclass ', s, '(Base', n, '):\n    \"class Gone(): pass\"\n    def run(self, x):\n        return help', k, '(x)\ndef help', k, '(y):\n    return os.path.join(y)  # gone(1)\n')"
    files = spark.sql(f"SELECT concat('pkg/s', k, '.py') AS path, CASE WHEN k % 7 = 3 THEN 'def broken(:' ELSE {text} END AS text FROM ({_SUPPLIED}) x")
    found = extract.python_components(files)
    return found.select("row_kind", "id", "component_type", "callee", F.when(F.col("component_type") == "file", F.lit(None)).otherwise(F.coalesce("start_line", "call_line")).cast("int").alias("line"))


@query(f"""WITH s AS ({_SUPPLIED}), p AS (SELECT concat('S', CAST(k AS STRING), '.md') AS file, CAST(k AS STRING) AS k, lower(n_name) AS slug, n_name FROM s JOIN nation ON n_nationkey = n)
SELECT file, concat('card-', k) AS anchor, 1 AS level, concat('Card ', k) AS title, concat('Intro ', k, '.') AS content FROM p UNION ALL SELECT file, 'setup', 2, 'Setup', 'Text' FROM p UNION ALL SELECT file, 'setup-1', 2, 'Setup', 'More' FROM p
UNION ALL SELECT file, concat('run-', slug), 3, concat('Run ', n_name), '' FROM p""")
def markdown_sections(spark, sf_dir):
    """Sections of pages, fenced headings left out, repeated anchors numbered; a supplier's page stands for a module's."""
    register(spark, sf_dir)
    page = "concat('# Card ', k, '\nIntro ', k, '.\n## Setup\n```\n# no heading\n```\nText\n## Setup\nMore\n### `Run` [', n_name, '](x.md)\n')"
    return extract.sections(spark.sql(f"SELECT concat('S', k, '.md') AS file, {page} AS text FROM ({_SUPPLIED}) x JOIN nation ON n_nationkey = n"))


_PARTS = "WITH p AS (SELECT pk, id, path, dir, kind, pk % 5 = 0 AS changed, pk % 10 = 0 AS gone FROM comp)"
_LISTED_NOW = "pk % 5 <> 0 AND dir <> 'Brand#3' AND (dir <> 'Brand#4' OR kind = 'PROMO')"
_OWNED = f"owned_now AS (SELECT id, path, dir, kind, pk FROM p WHERE {_LISTED_NOW})"
_BOTH = "both_ways AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge)"


@query(f"""{_PARTS}, {_OWNED}, {_BOTH},
one AS (SELECT id, kind AS owner FROM (SELECT n.id, o.kind, row_number() OVER (PARTITION BY n.id ORDER BY count(*) DESC, o.kind) AS k FROM p n JOIN owned_now o ON n.path = o.path WHERE n.changed GROUP BY n.id, o.kind) t WHERE k = 1),
two AS (SELECT n.id, o.owner FROM p n JOIN (SELECT dir, min(kind) AS owner FROM owned_now GROUP BY dir HAVING count(DISTINCT kind) = 1) o ON n.dir = o.dir WHERE n.changed),
votes AS (SELECT n.id, o.kind AS owner, count(*) AS v FROM p n JOIN both_ways ON a = n.pk JOIN owned_now o ON o.pk = b WHERE n.changed AND a <> b GROUP BY n.id, o.kind),
three AS (SELECT id, owner FROM (SELECT id, owner, v, sum(v) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY v DESC, owner) AS k FROM votes) t WHERE k = 1 AND 2 * v >= total)
SELECT p.id, CASE WHEN one.id IS NOT NULL THEN '1' WHEN two.id IS NOT NULL THEN '2' ELSE '3' END AS rule, coalesce(one.owner, two.owner, three.owner) AS owner, p.gone AS deleted
FROM p LEFT JOIN one ON one.id = p.id LEFT JOIN two ON two.id = p.id LEFT JOIN three ON three.id = p.id WHERE p.changed AND coalesce(one.owner, two.owner, three.owner) IS NOT NULL""")
def ownership_closure(spark, sf_dir):
    """Who answers for changed components that no module lists; a fifth of the parts is changed, half of them deleted; the others are listed under their kind, but for some brands."""
    register(spark, sf_dir)
    comp, near = spark.table("comp"), spark.table("edge")
    found = comp.filter("pk % 5 = 0").select("id", F.when(F.col("pk") % 10 == 0, "deleted").otherwise("body").alias("change"))
    listed = comp.filter(_LISTED_NOW).select(F.col("id").alias("component_id"), F.array("kind").alias("path"))
    ids = comp.select("pk", "id")
    edges = near.join(ids.select(F.col("pk").alias("src"), F.col("id").alias("_a")), "src").join(ids.select(F.col("pk").alias("dst"), F.col("id").alias("_b")), "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))
    return maintain.adopted(found, listed, listed, edges, edges).select("id", "rule", F.element_at("path", 1).alias("owner"), "deleted")


_ORDERS = (
    "o AS (SELECT concat('o', CAST(l_orderkey AS STRING)) AS page, l_linenumber AS line, CASE WHEN l_linenumber % 2 = 1 THEN concat('Uses `name_', CAST(pk AS STRING), '`') ELSE concat('Uses (', id, ')') END AS use,"
    " concat(' of [s](', CASE WHEN l_linenumber % 3 = 0 THEN 'd/' ELSE '' END, 'S', CAST(l_suppkey AS STRING), '.md#x).') AS link FROM lineitem JOIN comp ON l_partkey = pk)"
)
_MOVED = "moved AS (SELECT id AS old_id, CASE WHEN pk % 50 = 0 THEN 'renamed' ELSE 'deleted' END AS change, CASE WHEN pk % 50 = 0 THEN concat(path, '::new_', CAST(pk AS STRING)) END AS id, concat('name_', CAST(pk AS STRING)) AS name, CASE WHEN pk % 50 = 0 THEN concat('new_', CAST(pk AS STRING)) END AS new_name FROM comp WHERE pk % 50 < 2)"


@query(f"""WITH {_ORDERS}, {_MOVED}, texts AS (SELECT page, string_agg(use || link, chr(10) ORDER BY line, use, link) AS text FROM o GROUP BY page), look AS (SELECT * FROM texts WHERE NOT page LIKE '%7'),
by_id AS (SELECT page, change AS kind, old_id AS old, id AS new FROM look JOIN moved ON contains(text, old_id)),
by_name AS (SELECT page, change AS kind, name AS old, new_name AS new FROM look JOIN moved ON contains(text, '`' || name || '`') WHERE NOT EXISTS (SELECT 1 FROM by_id b WHERE b.page = look.page AND b.old = old_id)),
target AS (SELECT DISTINCT page, 'S' || l_suppkey AS old, l_suppkey AS k, l_linenumber % 3 <> 0 AS plain FROM lineitem JOIN (SELECT DISTINCT page FROM look) p ON page = 'o' || l_orderkey)
SELECT * FROM by_id UNION ALL SELECT * FROM by_name UNION ALL SELECT DISTINCT page, 'deleted_page', old, CASE WHEN k % 20 = 0 THEN 'S' || (k + 1) END FROM target WHERE k % 20 = 0 OR (k % 10 = 0 AND plain)""")
def stale_texts(spark, sf_dir):
    """What pages still say of parts that moved or went, and links to pages that are no more; an order stands for a page that tells of its parts and links their suppliers."""
    register(spark, sf_dir)
    text = F.transform(F.array_sort(F.collect_list(F.struct("line", "use", "link"))), lambda x: F.concat(x["use"], x["link"]))
    orders = spark.sql(f"WITH {_ORDERS} SELECT * FROM o").groupBy("page").agg(F.array_join(text, "\n").alias("text"))
    there = spark.sql("SELECT concat('S', s_suppkey) AS page, '' AS text FROM supplier WHERE s_suppkey % 10 <> 0")
    every = stored(orders.unionByName(there), "pages")
    moved = spark.sql(f"WITH {_MOVED} SELECT * FROM moved")
    removed = spark.sql("SELECT concat('S', s_suppkey) AS page, concat('S', s_suppkey + 1) AS replacement FROM supplier WHERE s_suppkey % 20 = 0")
    return stale.scanned(every, moved, moved.select(F.col("old_id").alias("id"), "name"), removed, every.filter("page LIKE '%7' AND page LIKE 'o%'").select("page"))


@query()
def renames_by_classes(spark, sf_dir):
    """Documents of a source that moved to another, matched one to one by their texts; copies move as one class."""
    docs = load(spark, sf_dir, "documents")
    at = lambda part: docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part).select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("component_type"), F.coalesce("text", F.lit("")).alias("text"))
    return maintain.rename_pairs(at(0), at(1))


@query()
def pages_described(spark, sf_dir):
    """Titles, outlines, diagrams and faults of pages; documents stand for them."""
    return pages.described(load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page"), "text")).select("page", "title", "fault", "diagrams", "n_sections")


@query()
def schedules(spark, sf_dir):
    """How long recorded work takes with so many slots, and its longest chain; orders of a customer stand for jobs."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.floor("o_totalprice").alias("seconds"), F.col("o_orderkey").alias("ord"))
    return ledger.makespans(rows, [1, 4])


@query("""SELECT user_id AS run, event_id AS ord, held, greatest(0, held - 2) AS over FROM (SELECT user_id, event_id, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS held FROM events)""")
def slots_lent(spark, sf_dir):
    """Slots held by jobs that lend theirs while children run; events of a user stand for a run's."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "hold", "view", "resume", "purchase", "lend", "error", "release", "signup", "wait")]), F.col("event_type"))
    return ledger.slots_held(load(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), kind.alias("kind")), 2).drop("kind")


@query("""SELECT user_id AS ask, event_id AS n, '{"type":"' || event_type || '","id":' || event_id || '}' AS line FROM events
LEFT JOIN (SELECT user_id, min(event_id) AS ended FROM events WHERE event_type = 'signup' AND value > 100 GROUP BY user_id) USING (user_id)
LEFT JOIN (SELECT user_id, min(event_id) AS gone FROM events WHERE event_type = 'error' AND value > 100 GROUP BY user_id) USING (user_id)
WHERE (ended IS NULL OR event_id < ended) AND (gone IS NULL OR event_id <= gone)""")
def answer_stream(spark, sf_dir):
    """Events of answers as lines, up to their end or to where the reader left; events of a user stand for an answer's."""
    rows = load(spark, sf_dir, "events")
    high = F.col("value") > 100
    sent = rows.select(F.col("user_id").alias("ask"), F.col("event_id").alias("n"), F.when(high & (F.col("event_type") == "signup"), "end").otherwise(F.col("event_type")).alias("type"), F.col("event_id").alias("id"))
    return sessions.answer_lines(sent, rows.filter(high & (F.col("event_type") == "error")).select(F.col("user_id").alias("ask"), F.col("event_id").alias("n")))


@query()
def answer_reading(spark, sf_dir):
    """What is read of the best units under a budget, and what is left."""
    docs = load(spark, sf_dir, "documents")
    units = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("section").alias("kind"), F.col("source").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), T.approx_tokens(F.col("n_chars")).alias("tokens"), "text")
    asked = units.orderBy("id").limit(20).select("id", F.col("id").cast("int").alias("ord"))
    near = asked.select("id", F.concat("id", F.lit("0")).alias("near"))
    return retrieval.read(asked, units.withColumn("file", F.col("id")), near, 4000, ["the"]).select("id", "state", F.length("text").alias("chars"))


@query()
def candidates_pinned(spark, sf_dir):
    """Units that bear a name of the question first, then by score."""
    rows = _components(spark, sf_dir).select("id", "name", F.col("id").alias("qualified"), F.col("component_type").alias("kind"), F.col("relative_path").alias("file"), "pk")
    ranked = rows.select("id", (F.col("pk") % 97).cast("double").alias("score"))
    name = rows.agg(F.min("name")).first()[0]
    return search.pinned(ranked, rows.drop("pk"), [name], 10)
