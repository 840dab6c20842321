"""Functions of the library on relations bound to the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import maintain, pages, resolve, retrieval, search
from corvane.sources import files as sources
from corvane.sources.tables import load, register

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


_LINES = "string_split(left(text, 120), chr(10))"


@query(f"""SELECT doc_id AS id, CAST(length(left(text, 100)) - length(replace(left(text, 100), chr(10), '')) + 1 AS BIGINT) AS line,
  array_to_string(list_transform({_LINES}, lambda x, i: lpad(CAST(97 + i AS VARCHAR), CAST(length(CAST(97 + len({_LINES}) AS VARCHAR)) AS INTEGER), ' ') || '  ' || x), chr(10)) AS numbered,
  left(regexp_replace(left(text, 260), '[^A-Za-z0-9._-]+', '_', 'g'), 180) || '-' || left(sha1(left(text, 260)), 8) AS file_name,
  CASE WHEN length(text) <= 100 THEN text ELSE left(text, 50) || chr(10) || '...' || chr(10) || right(text, 50) END AS ends,
  CASE WHEN doc_id % 5 = 0 THEN 7 ELSE greatest(0, least(100, n_chars - 500)) END AS score,
  CASE WHEN length(text) <= 72 THEN text ELSE regexp_replace(left(text, 72), '\\s+\\S*$', '') END AS clip,
  left(CASE WHEN regexp_extract(text, '(?s)^(.+?[.!?])(\\s|$)', 1) = '' THEN text ELSE regexp_extract(text, '(?s)^(.+?[.!?])(\\s|$)', 1) END, 160) AS sentence,
  array_to_string(list_slice(list_filter(list_transform(string_split(left(text, 60), ','), lambda x: trim(x)), lambda x: x <> ''), 1, 4), '|') AS items,
  CASE doc_id % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'pt-BR' WHEN 2 THEN 'zh-CN' WHEN 3 THEN 'de' WHEN 4 THEN 'en' ELSE 'klingon' END AS tag,
  n_chars + CASE WHEN lang = 'en' THEN 5 ELSE 0 END AS merged, regexp_matches(text, '(^|[^\\w$])de($|[^\\w$])') AS has_de,
  CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') + 3600 * (doc_id % 20) AS DOUBLE) AS seconds, 'qa-' || strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') AS day,
  CASE WHEN doc_id % 2 = 0 THEN text ELSE 'Doc ' || doc_id || chr(10) || text END AS source, 'a/' || source || '.py::x\\y' AS fixed FROM documents""")
def text_functions(spark, sf_dir):
    """The scalar functions on every text."""
    docs = load(spark, sf_dir, "documents")
    text, i = F.col("text"), F.col("doc_id")
    tags = F.array(*map(F.lit, ("English", "pt_br", "zh-cn", "German", " ", "Klingon")))
    hour = F.concat(F.lit("2024-01-01T"), F.lpad((i % 20).cast("string"), 2, F.lit("0")), F.lit(":00:00Z"))
    return docs.select(
        i.alias("id"), T.line_of(text, F.lit(100)).alias("line"), T.numbered(F.left(text, F.lit(120)), F.lit(98)).alias("numbered"), T.safe_file_name(F.left(text, F.lit(260))).alias("file_name"), T.head_and_tail(text, 100).alias("ends"),
        T.clamp_score(F.when(i % 5 == 0, "none").otherwise(F.concat(F.lit(" "), (F.col("n_chars") - 500).cast("string"), F.lit(" points"))), 7).alias("score"), T.clipped(text, 20).alias("clip"), T.first_sentence(text).alias("sentence"),
        F.array_join(T.clean_list(F.split(F.left(text, F.lit(60)), ","), 4), "|").alias("items"), T.language_tag(F.element_at(tags, (i % 6 + 1).cast("int"))).alias("tag"), F.element_at(T.counters_merged(F.create_map("lang", "n_chars"), F.create_map(F.lit("en"), F.lit(5).cast("long"))), F.col("lang")).alias("merged"),
        T.word_boundary(text, "de").alias("has_de"), T.epoch(hour).alias("seconds"), T.day_name("qa", F.date_add(F.lit("2024-01-01").cast("date"), (i % 400).cast("int"))).alias("day"),
        T.document_source(F.when(i % 2 == 0, F.left(text, F.lit(5))).otherwise(F.concat(F.lit("Doc "), i.cast("string"))), text).alias("source"), T.normal_id(F.concat(F.lit("a\\"), "source", F.lit(".py::x\\y"))).alias("fixed"),
    )


_TEST_PATH = "concat(CASE pk % 4 WHEN 0 THEN 'Tests/' WHEN 1 THEN 'src/testing/' WHEN 2 THEN 'specs/a/' ELSE 'lib/' END, CASE pk % 5 WHEN 0 THEN 'test_x' ELSE 'x' END, CASE pk % 3 WHEN 0 THEN '_test.go' WHEN 1 THEN '.spec.ts' ELSE '.py' END)"
_MACRO = "CASE WHEN pk % 3 = 0 THEN upper(replace(name, ' ', '_')) WHEN pk % 3 = 1 THEN upper(left(name, 3)) ELSE name END"


@query(f"""SELECT id, {_MACRO} AS macro, regexp_matches({_MACRO}, '^[A-Z][A-Z0-9_]*$') AND (length({_MACRO}) >= 4 OR contains({_MACRO}, '_')) AS is_macro, pk % 3 <> 2 AS is_private,
  pk % 4 IN (0, 2) OR pk % 5 = 0 OR pk % 3 < 2 AS is_test, 'a.b' AS package, CASE WHEN pk % 2 = 0 THEN 'java' ELSE 'go' END AS language, 'src/' || kind AS dir, 'x.tar.GZ' AS file, 'x.tar' AS stem, '.gz' AS ending FROM comp""")
def name_predicates(spark, sf_dir):
    """What names and paths say."""
    register(spark, sf_dir)
    rows = spark.sql(f"SELECT id, kind, {_MACRO} AS macro, {_TEST_PATH} AS test, CASE pk % 3 WHEN 0 THEN '_x.y' WHEN 1 THEN 'x._y' ELSE 'x_.y' END AS name, CASE WHEN pk % 2 = 0 THEN 'java' END AS language FROM comp")
    parts = T.file_parts(F.concat(F.lit("src/"), "kind", F.lit("/x.tar.GZ")))
    return rows.select(
        "id", "macro", resolve.is_macro(F.col("macro")).alias("is_macro"), resolve.is_private(F.col("name")).alias("is_private"), search.is_test_path(F.col("test")).alias("is_test"), resolve.package_of(F.concat(F.lit("f::a.b."), "kind", F.lit(".run")), F.lit("method")).alias("package"),
        resolve.language_or_ending(F.col("language"), F.lit("x/y.go")).alias("language"), parts["dir"].alias("dir"), parts["name"].alias("file"), parts["stem"].alias("stem"), parts["ending"].alias("ending"),
    )


_TYPES = "t AS (SELECT DISTINCT dir, kind AS type FROM comp), e AS (SELECT * FROM (SELECT dir, type, lead(type) OVER (PARTITION BY dir ORDER BY type) AS embedded FROM t) x WHERE embedded IS NOT NULL)"


@query(f"""WITH {_TYPES}, reach AS (SELECT dir, type, type AS at, 0 AS depth FROM t UNION ALL SELECT dir, type, embedded, 1 FROM e UNION ALL SELECT a.dir, a.type, b.embedded, 2 FROM e a JOIN e b ON a.dir = b.dir AND a.embedded = b.type
  UNION ALL SELECT a.dir, a.type, c.embedded, 3 FROM e a JOIN e b ON a.dir = b.dir AND a.embedded = b.type JOIN e c ON b.dir = c.dir AND b.embedded = c.type),
near AS (SELECT r.dir, r.type, m.name, depth, count(DISTINCT m.id) AS n, min(m.id) AS id FROM reach r JOIN comp m ON m.dir = r.dir AND m.kind = r.at GROUP BY r.dir, r.type, m.name, depth)
SELECT dir, type, name, id FROM near QUALIFY row_number() OVER (PARTITION BY dir, type, name ORDER BY depth) = 1 AND n = 1""")
def promoted_members(spark, sf_dir):
    """What a type of a package answers to, also through types that it embeds; kinds of a brand, in order, stand for types."""
    register(spark, sf_dir)
    members = spark.sql("SELECT dir, kind AS type, name, id FROM comp")
    return resolve.promoted(members, spark.sql(f"WITH {_TYPES} SELECT dir, type, embedded FROM e"))


_CLASSES = "c AS (SELECT DISTINCT dir, kind FROM comp), p AS (SELECT dir, kind, concat(dir, '/', kind) AS class, row_number() OVER (PARTITION BY dir ORDER BY kind) AS pos FROM c)"


@query(f"""WITH {_CLASSES}, o AS (SELECT p.dir, p.pos, name, min(id) AS id FROM comp JOIN p ON p.dir = comp.dir AND p.kind = comp.kind GROUP BY p.dir, p.pos, name), w AS (SELECT p.*, n.name FROM p JOIN (SELECT DISTINCT dir, name FROM comp) n ON n.dir = p.dir)
SELECT class, w.name, (SELECT arg_min(o.id, o.pos) FROM o WHERE o.dir = w.dir AND o.name = w.name AND o.pos BETWEEN w.pos AND w.pos + 5) AS id FROM w""")
def inherited_methods(spark, sf_dir):
    """The method that answers for a class, its own or that of the nearest base; kinds of a brand, in order, stand for classes and bases."""
    register(spark, sf_dir)
    classes = f"WITH {_CLASSES} "
    owners = spark.sql(classes + "SELECT class, name, min(id) AS id FROM comp JOIN p ON p.dir = comp.dir AND p.kind = comp.kind GROUP BY class, name")
    bases = spark.sql(classes + "SELECT a.class, b.class AS base, 0 AS ord FROM p a JOIN p b ON a.dir = b.dir AND b.pos = a.pos + 1")
    return resolve.inherited(owners, bases, spark.sql(classes + "SELECT class, name FROM p JOIN (SELECT DISTINCT dir, name FROM comp) n ON n.dir = p.dir"))


_SNAPSHOT = "SELECT id, path, dir, pk, d.deps FROM comp LEFT JOIN (SELECT src, {list} AS deps FROM edge GROUP BY src) d ON src = pk"


@query("""WITH d AS (SELECT src, list(CAST(dst AS VARCHAR)) AS deps FROM edge GROUP BY src), s AS (SELECT id, path, dir, pk, coalesce(deps, []) AS deps FROM comp LEFT JOIN d ON src = pk)
SELECT id, true AS live, array_to_string(list_sort(list_distinct(list_concat(deps, ['x']))), ',') AS deps FROM s WHERE dir = 'Brand#1' AND pk % 2 = 0
UNION ALL SELECT id, false, array_to_string(list_sort(deps), ',') FROM s WHERE dir <> 'Brand#1'""")
def overlay_snapshot(spark, sf_dir):
    """A snapshot in which the components of touched files give way to those that were read again; one brand's files are touched, and half of their components still there."""
    register(spark, sf_dir)
    deps = spark.sql("SELECT src AS pk, collect_list(CAST(dst AS STRING)) AS deps FROM edge GROUP BY src")
    rows = spark.table("comp").join(deps, "pk", "left").select("id", F.col("path").alias("relative_path"), "dir", "pk", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))
    live = rows.filter("dir = 'Brand#1' AND pk % 2 = 0").withColumn("deps", F.array(F.lit("x")))
    out = maintain.overlay(rows.drop("dir", "pk"), live.drop("dir", "pk"), rows.filter("dir = 'Brand#1'").select(F.col("relative_path").alias("file")).distinct())
    return out.select("id", "live", F.array_join(F.array_sort("deps"), ",").alias("deps"))


@query("SELECT path AS page, max(CASE WHEN pk % 37 = 0 THEN 1 ELSE 0 END) = 1 AS allowed FROM comp GROUP BY path")
def write_permissions(spark, sf_dir):
    """Which pages a run may write."""
    register(spark, sf_dir)
    comp = spark.table("comp")
    return maintain.may_write(comp.select(F.col("path").alias("page")).distinct(), comp.filter("pk % 37 = 0").select(F.col("path").alias("page")))


@query("SELECT DISTINCT dir AS page FROM comp WHERE path IN (SELECT path FROM comp WHERE pk % 397 = 0) UNION SELECT DISTINCT concat(dir, '/', kind) FROM comp WHERE path IN (SELECT path FROM comp WHERE pk % 397 = 0)")
def pages_to_refresh(spark, sf_dir):
    """Pages that list, themselves or below, a component of a touched file."""
    register(spark, sf_dir)
    modules = spark.sql("SELECT DISTINCT array(dir) AS path FROM comp UNION SELECT array(dir, kind) FROM comp")
    listed = spark.sql("SELECT array(dir, kind) AS path, id AS component_id FROM comp")
    return maintain.stale_pages(modules, listed, spark.sql("SELECT path AS file FROM comp WHERE pk % 397 = 0")).select(F.array_join("path", "/").alias("page"))


@query("SELECT id, pk AS ord FROM comp")
def ids_in_order(spark, sf_dir):
    """Known ids once each after their paths are normalised, unknown ones left out, the first place counts."""
    register(spark, sf_dir)
    rows = spark.sql(r"SELECT replace(id, '/', '\\') AS id, pk AS ord FROM comp UNION ALL SELECT id, pk + 1000000000 FROM comp UNION ALL SELECT concat(id, 'x'), pk FROM comp")
    return resolve.known_leaves(rows, spark.table("comp")).select("id", "ord")


_MODULES = "SELECT DISTINCT concat('pkg/', replace(dir, '#', ''), CASE WHEN pk % 3 = 0 THEN '/__init__' ELSE concat('/', lower(kind)) END, '.py') AS path FROM comp"
_IMPORTS = "SELECT DISTINCT CASE pk % 5 WHEN 0 THEN concat('pkg.', replace(dir, '#', ''), '.', lower(kind), '.f') WHEN 1 THEN concat('pkg.', replace(dir, '#', '')) WHEN 2 THEN lower(kind) WHEN 3 THEN concat('pkg.', replace(dir, '#', ''), 'x.y') ELSE 'os.path' END AS name FROM comp"


@query(f"""WITH m AS (SELECT DISTINCT replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '(^|/)__init__$', ''), '/', '.') AS module FROM ({_MODULES}) x), i AS ({_IMPORTS})
SELECT name FROM i WHERE EXISTS (SELECT 1 FROM m WHERE name = module OR starts_with(name, module || '.') OR name = regexp_extract(module, '([^.]+)$', 1))""")
def project_imports(spark, sf_dir):
    """Imports that lie in the project's own modules, on borders of dots."""
    register(spark, sf_dir)
    return resolve.imports_of_project(spark.sql(_IMPORTS), resolve.python_modules(spark.sql(_MODULES)))


@query("""WITH s AS (SELECT source AS page, CAST(doc_id AS VARCHAR) AS anchor, doc_id AS ord, left(text, 40) AS title FROM documents WHERE doc_id % 4 <> 0), w AS (SELECT DISTINCT page, anchor, ord, title, unnest(regexp_extract_all(title, '[\\w$]+')) AS name FROM s)
SELECT page, name, arg_min(anchor, [length(title), ord]) AS anchor FROM w WHERE name IN ('the', 'de', 'Le', 'aile', 'der') GROUP BY page, name""")
def headings_of_names(spark, sf_dir):
    """The shortest heading of a page, below the first level, that mentions a name; starts of texts stand for headings."""
    docs = load(spark, sf_dir, "documents")
    sections = docs.select(F.col("source").alias("page"), F.col("doc_id").cast("string").alias("anchor"), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(2).alias("level"), F.left("text", F.lit(40)).alias("title"), F.col("doc_id").alias("ord"))
    return pages.best_headings(sections, spark.createDataFrame([(x,) for x in ("the", "de", "Le", "aile", "der")], "name string"))


@query("""WITH a AS (SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS score FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS id, 1000.0::DOUBLE AS score FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(a.id, b.id) AS id, greatest(coalesce(a.score, 0), coalesce(b.score, 0)) AS score, CASE WHEN a.id IS NULL THEN 'grep' WHEN b.id IS NULL THEN 'query' ELSE 'grep,query' END AS via,
  CASE WHEN a.id IS NULL THEN 'g1,g2' WHEN b.id IS NULL THEN 'q1,q2' ELSE 'q1,q2,g1' END AS hits FROM a FULL JOIN b ON a.id = b.id""")
def candidates_merged(spark, sf_dir):
    """Candidate lists as one: the best score, every way, three hits."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    of = lambda rows, way, hits: rows.withColumn("via", F.array(F.lit(way))).withColumn("hits", F.array(*map(F.lit, hits)))
    out = search.merged([of(docs.filter("id % 2 = 0"), "query", ("q1", "q2")), of(docs.filter("id % 3 = 0").withColumn("score", F.lit(1000.0)), "grep", ("g1", "g2"))])
    return out.select("id", "score", F.array_join("via", ",").alias("via"), F.array_join("hits", ",").alias("hits"))


_PATHS = "SELECT concat(CASE pk % 7 WHEN 0 THEN 'build/' WHEN 1 THEN 'src/build/' WHEN 2 THEN 'docs/' ELSE 'src/' END, lower(kind), pk, CASE pk % 4 WHEN 0 THEN '.log' WHEN 1 THEN '.tmp' WHEN 2 THEN '*b ' ELSE '.c' END) AS path, pk FROM comp"


@query(f"""SELECT path, pk % 7 IN (0, 1) OR (pk % 4 = 0 AND NOT starts_with(path, 'docs/') AND NOT starts_with(path, 'src/standard')) OR pk % 4 = 2 OR (pk % 4 = 1 AND starts_with(path, 'src/')) AS ignored FROM ({_PATHS}) x""")
def ignored_paths(spark, sf_dir):
    r"""Ignore files of a root and two folders: later lines and deeper files win, nothing comes back from an ignored folder, a backslash takes letters as they are."""
    register(spark, sf_dir)
    specs = spark.createDataFrame([("", "# all\n*.log\nbuild/\n*\\*b\\ \n!/src/standard*.log\n"), ("docs", "!*.log\n"), ("src", "/*.tmp\n!build/\n/build\n")], "dir string, text string")
    return sources.ignored(spark.sql(_PATHS).select("path"), specs)


@query("SELECT count(*) AS files, round(sum(length(html)) / 1024.0, 2) AS size_kb FROM pages")
def scan_summary(spark, sf_dir):
    """How many files a scan has, and their size."""
    return sources.summary(load(spark, sf_dir, "pages").select("url", F.length("html").alias("size_bytes")))


_ADDRESSES = "SELECT s_suppkey AS k, concat(CASE s_suppkey % 4 WHEN 0 THEN ' https://github.com/' WHEN 1 THEN 'http://www.github.com/' WHEN 2 THEN '' ELSE 'github.com/' END, 'o', CAST(s_nationkey AS STRING), CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('/r', CAST(s_suppkey AS STRING), CASE s_suppkey % 3 WHEN 0 THEN '.git' WHEN 1 THEN '/tree/main/src' ELSE '' END) END) AS url FROM supplier"


@query(f"""SELECT k, CASE WHEN k % 5 = 0 THEN url ELSE concat(CASE WHEN k % 4 = 1 THEN 'http://' ELSE 'https://' END, 'github.com/', regexp_extract(url, 'o[0-9]+'), '/r', CAST(k AS VARCHAR)) END AS address FROM ({_ADDRESSES}) x""")
def clone_addresses(spark, sf_dir):
    """Where a repository would be cloned from, for addresses in any form (nothing is cloned)."""
    register(spark, sf_dir)
    return spark.sql(_ADDRESSES).select("k", T.clone_address(F.col("url")).alias("address"))


@query("SELECT path AS file, bool_or(pk % 61 = 0) AS touched, bool_or(pk % 89 = 0) AS hit FROM comp GROUP BY path")
def files_touched(spark, sf_dir):
    """Files of which any unit was touched, or found."""
    register(spark, sf_dir)
    comp = spark.table("comp")
    return retrieval.touched_any(comp.select("id", F.col("path").alias("file")), comp.filter("pk % 61 = 0"), comp.filter("pk % 89 = 0"))
