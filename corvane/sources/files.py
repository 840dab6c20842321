"""Files of a repository as tables: scan, ignore rules, patterns, languages, heads; snapshots, logs and caches as stored tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.languages import EXTENSIONS, language_of
from corvane.session import ship_package

#: Folders that no scan goes into, unless other patterns are given.
EXCLUDED = (".git/", "node_modules/", "__pycache__/", ".venv/", "venv/", "dist/", "build/", "target/", ".idea/", ".vscode/", "*.min.js", "*.map", "*.lock", "*.pyc", "*.png", "*.jpg", "*.gif", "*.pdf", "*.zip")


def _hidden(spark: SparkSession, root, content: bool, skip: tuple[str, ...]) -> list[tuple]:
    """(path, length, modified) and content of what Spark's readers pass over: names that start with a dot or underscore, and all below them. Few, so the driver lists them; a folder is visited once."""
    jvm = spark.sparkContext._jvm
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [(root, False)]
    while todo:
        folder, inside = todo.pop()
        for x in fs.listStatus(folder):
            name, dark = x.getPath().getName(), inside or x.getPath().getName()[:1] in "._"
            if x.isDirectory():
                if name not in skip:
                    todo.append((x.getPath(), dark))
            elif dark:
                data = None
                if content:
                    stream = fs.open(x.getPath())
                    data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                    stream.close()
                out.append((x.getPath().toString(), x.getLen(), x.getModificationTime(), data))
    return out


def scan(spark: SparkSession, root: str, content: bool = False, skip: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """path (from the root), name, ext, dir, depth, size_bytes, modified, and content where asked for, of all files under `root`, wherever Spark reads; hidden ones, too, but for folders named in `skip`. Without content no file is opened."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.unix_millis("modificationTime").alias("t"), *(["content"] if content else []))
    dark = spark.createDataFrame([x if content else x[:3] for x in _hidden(spark, base, content, skip)], "path string, length long, t long" + (", content binary" if content else ""))
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    rel = F.substring(bare(F.col("path")), len(re.sub("^[a-z0-9]+:/+", "/", base.toString().rstrip("/"))) + 2, 1 << 30)
    out = rows.unionByName(dark).select(rel.alias("path"), F.col("length").alias("size_bytes"), F.timestamp_millis("t").alias("modified"), *(["content"] if content else []))
    out = out.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip)))) if skip else out
    return out.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))).withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("depth", F.size(F.split("path", "/")) - 1)


def text_of(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 is replaced."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def head(files: DataFrame, most: int = 16_384) -> DataFrame:
    """`files` (with content) with head (the first bytes as text), total (size) and is_binary (a zero byte in the head)."""
    first = F.substring("content", 1, most)
    return files.withColumn("head", text_of(first)).withColumn("total", F.length("content")).withColumn("is_binary", F.expr(f"locate('00', regexp_replace(hex(substring(content, 1, {most})), '(..)', '$1 ')) > 0")).drop("content")


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression for a whole name; a star crosses slashes."""
    out = ""
    for part in re.findall(r"\[!?[^\]]+\]|.", pattern, re.S):
        out += ".*" if part == "*" else "." if part == "?" else "[^" + part[2:] if part.startswith("[!") else part if len(part) > 1 else re.escape(part)
    return f"^(?:{out})$"


def included(path: Column, patterns: Iterable[str] = ()) -> Column:
    """Whether a path or its last name fits one of the patterns; without patterns everything does."""
    name = F.element_at(F.split(path, "/"), -1)
    out = None
    for p in patterns:
        c = path.rlike(glob(p)) | name.rlike(glob(p))
        out = c if out is None else out | c
    return F.lit(True) if out is None else out


def excluded(path: Column, patterns: Iterable[str] = EXCLUDED) -> Column:
    """Whether a path fits a pattern, lies in a folder of that name or under that path, or has it as one of its names."""
    out = F.lit(False)
    for p in patterns:
        bare = p.rstrip("/")
        out = out | included(path, [p]) | path.startswith(bare + "/") | (path == bare) | F.array_contains(F.split(path, "/"), bare)
    return out


def left_out(path: Column, user: Iterable[str] = (), defaults: Iterable[str] = EXCLUDED, listed: Column | None = None, ignored: Column | None = None, own: Iterable[str] = ()) -> Column:
    """What the user excludes goes in any case, and so does what we write ourselves; defaults yield to the white list; ignored files go last."""
    keep = listed if listed is not None else F.lit(False)
    gone = ignored if ignored is not None else F.lit(False)
    return excluded(path, [*user, *own]) | (excluded(path, defaults) & ~F.coalesce(keep, F.lit(False))) | F.coalesce(gone, F.lit(False))


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression from the folder of the file on, whether it takes back, whether for folders alone) of one line of an ignore file."""
    line, end, i = line.rstrip("\r\n"), 0, 0
    while i < len(line):  # blanks at the end count only after a backslash
        i += 2 if line[i] == "\\" else 1
        end = min(i, len(line)) if line[min(i, len(line)) - 1] != " " or line[i - 2 : i - 1] == "\\" else end
    line = line[:end]
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:]
    only_dirs, rooted = line.endswith("/"), "/" in line.rstrip("/")
    line, out, i = line.strip("/"), "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "\\":  # the next letter stands for itself; a backslash at the end matches nothing
            if i + 1 == len(line):
                return "(?!)", back, only_dirs
            out, i = out + re.escape(line[i + 1]), i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            out, i = out + "[" + ("^" if line[i + 1] == "!" else "") + line[i + 1 + (line[i + 1] == "!") : end] + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("" if rooted else "(?:.*/)?") + out, back, only_dirs


def ignored(paths: DataFrame, specs: DataFrame) -> DataFrame:
    """`paths` (path) with `ignored`, by `specs` (dir, text: the ignore file in it): deeper files and later lines win, and nothing comes back from an ignored folder. The lines of ignore files are few and are broadcast."""
    rules = []
    for r in sorted(specs.collect(), key=lambda r: (r["dir"].count("/") + bool(r["dir"]), r["dir"])):
        base = r["dir"].strip("/")
        for line in (r["text"] or "").split("\n"):
            if rule := ignore_rule(line):
                rules.append((base + "/" if base else "", *rule))
    spark = paths.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(rules)

    def run(frames):
        known = [(base, re.compile(p + r"\Z"), back, dirs) for base, p, back, dirs in shared.value]
        for frame in frames:
            out = []
            for path in frame["path"]:
                names, gone = path.split("/"), False
                for k in range(1, len(names) + 1):
                    at, folder = "/".join(names[:k]), k < len(names)
                    for base, p, back, dirs in known:
                        if at.startswith(base) and (folder or not dirs) and p.match(at[len(base) :]):
                            gone = not back
                    if gone and folder:
                        break
                out.append(gone)
            yield frame.assign(ignored=out)

    return paths.select("path").mapInPandas(run, "path string, ignored boolean")


def not_listed(paths: DataFrame, listed: DataFrame, untracked: bool = False) -> DataFrame:
    """`paths` without those that a version control names as ignored: `listed` (path; folders end in a slash). With `untracked` nothing stays: all is ignored."""
    if untracked:
        return paths.limit(0)
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))
    hit = paths.select("path", F.explode(folders).alias("at")).join(listed.select(F.rtrim(F.col("path"), F.lit("/")).alias("at")).distinct(), "at", "left_semi").select("path")
    return paths.join(hit, "path", "left_anti")


CPP_SIGNS = r"(?m)^\s*(class\s+\w+\s*[:{]|namespace\b|template\s*<|using\s+\w|public:|private:|protected:)|\bstd::|\bvirtual\b|#include\s*<(string|vector|memory|iostream|map)>"


def routed(files: DataFrame) -> DataFrame:
    """`files` (path, head) of known languages with `language`. A header is C++ where its text says so, or where the repository has C++ and no C; tests and caches that a language sets apart are left out."""
    rows = files.withColumn("language", language_of(F.col("path"))).filter("language IS NOT NULL")
    rows = rows.filter(~F.col("path").rlike(r"_test\.go$|(^|/)vendor/.*\.go$|(^|/)(zig-cache|\.zig-cache|zig-out)/|\.(blade|tpl|phtml)\.php$|(^|/)templates?/.*\.php$"))
    has = rows.agg(F.coalesce(F.bool_or(F.col("path").rlike(r"(?i)\.(cpp|cc|cxx|hpp|hh|hxx)$")), F.lit(False)).alias("_cpp"), F.coalesce(F.bool_or(F.col("path").rlike(r"\.c$")), F.lit(False)).alias("_c"))
    header = F.col("path").endswith(".h")
    return rows.crossJoin(F.broadcast(has)).withColumn("language", F.when(header & (F.coalesce(F.col("head").rlike(CPP_SIGNS), F.lit(False)) | (F.col("_cpp") & ~F.col("_c"))), "cpp").otherwise(F.col("language"))).drop("_cpp", "_c")


def supported(files: DataFrame) -> DataFrame:
    return files.filter(F.col("language").isin(sorted(set(EXTENSIONS.values()))))


def histogram(files: DataFrame) -> DataFrame:
    """language and n, most files first."""
    return files.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def summary(files: DataFrame) -> DataFrame:
    """files and size_kb of a scan."""
    return files.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum("size_bytes"), F.lit(0)) / 1024, 2).alias("size_kb"))


def readme(files: DataFrame) -> DataFrame:
    """The first of four names that stands in the root."""
    names = ["README.md", "readme.md", "README.rst", "README.txt"]
    return files.filter(F.col("path").isin(names)).orderBy(F.array_position(F.array(*map(F.lit, names)), F.col("path"))).limit(1)


def root_of(candidates: DataFrame, there: DataFrame, sample: DataFrame) -> DataFrame:
    """root: the first of `candidates` (root, ord) that holds any of twenty sample files; there (root, path), sample (path)."""
    some = sample.select("path").distinct().orderBy("path").limit(20)
    return candidates.join(there.join(F.broadcast(some), "path").select("root").distinct(), "root", "left_semi").orderBy("ord").limit(1).select("root")


def walk_order(indexed: DataFrame, every: DataFrame) -> DataFrame:
    """path and ord to search by: indexed files first, then the rest."""
    return indexed.select("path", F.lit(0).alias("ord")).distinct().unionByName(every.select("path").distinct().join(indexed.select("path"), "path", "left_anti").withColumn("ord", F.lit(1)))


# ---- changes


def changed_since(files: DataFrame, when: Column) -> DataFrame:
    """path and status of files that were written after a time."""
    return files.filter(F.col("modified") > when).select("path", F.lit("changed").alias("status"))


def changed(feed: DataFrame, prefix: str = "", own: tuple[str, ...] = ()) -> DataFrame:
    """path and status (changed, deleted) of a version control's feed (path, code: A, M, D, R..., ??): of one folder of it, named from there; what we write ourselves is left out. The last word on a path counts."""
    rows = feed.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
    if prefix:
        rows = rows.filter(F.col("path").startswith(prefix.rstrip("/") + "/")).withColumn("path", F.substring("path", len(prefix.rstrip("/")) + 2, 1 << 30))
    rows = rows.filter(~excluded(F.col("path"), own)) if own else rows
    return rows.groupBy("path").agg(F.max(F.when(F.col("code").startswith("D"), 0).otherwise(1)).alias("_alive")).select("path", F.when(F.col("_alive") == 1, "changed").otherwise("deleted").alias("status"))


def envelope(by_version: DataFrame | None, by_time: DataFrame, modules_hit: DataFrame) -> DataFrame:
    """One row: how changes were found (version or time), how many files, which modules they concern, and what to do."""
    found = by_time if by_version is None else by_version
    n = found.agg(F.count("*").alias("changed"))
    m = modules_hit.agg(F.array_sort(F.collect_set(F.array_join("path", "/"))).alias("affected"))
    return n.crossJoin(m).select(F.lit("time" if by_version is None else "version").alias("method"), "changed", "affected", F.when(F.col("changed") == 0, "no changes").when(F.size("affected") == 0, "changes outside all modules").otherwise("update the affected modules, then their ancestors").alias("hint"))


def replaced(snapshot: DataFrame, live: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of a snapshot with those of `touched` files (path) taken from `live`."""
    return snapshot.join(touched.select("path"), "path", "left_anti").unionByName(live.join(touched.select("path"), "path", "left_semi"), allowMissingColumns=True)


# ---- stored tables


def write_graph(components: DataFrame, edges: DataFrame, to: str, root: str = "") -> None:
    """The graph as JSON lines: components with their sorted dependencies, in order of ids, paths from the root."""
    deps = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    rows = components.join(deps, "id", "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))
    if root and "relative_path" in rows.columns:
        rows = rows.withColumn("relative_path", F.regexp_replace("relative_path", "^" + re.escape(root.rstrip("/")) + "/", ""))
    rows.sort("id").write.mode("overwrite").json(to)


def read_graph(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """components and edges of a stored graph; a missing id is made of path and name, unknown columns stay."""
    rows = spark.read.json(at)
    if "relative_path" in rows.columns and "name" in rows.columns:
        rows = rows.withColumn("id", F.coalesce("id", F.concat_ws("::", "relative_path", "name")))
    return rows.drop("depends_on"), rows.select(F.col("id").alias("src"), F.explode("depends_on").alias("dst"))


def previous(snapshots: DataFrame, own: str) -> DataFrame:
    """The snapshot (path, name, modified) to compare with: that of the same name, else the newest."""
    return snapshots.orderBy((F.col("name") != own).cast("int"), F.desc("modified"), "path").limit(1)


def superseded(snapshots: DataFrame, keep: int = 1) -> DataFrame:
    """Snapshots of a name that newer ones replace: all but the newest `keep`."""
    return snapshots.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("modified"), "path"))).filter(F.col("_n") > keep).drop("_n")


def append_log(rows: DataFrame, to: str, enabled: bool = True) -> None:
    """Appends `rows` (with ts) as JSON lines, a folder a day."""
    if enabled:
        rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(to)


LOG_LINE = r"^\[?(\d\d):(\d\d):(\d\d)\]?\s+(\w+)\s+(.*)$"


def parsed_log(lines: DataFrame, pattern: str = LOG_LINE) -> DataFrame:
    """run, ord, t (seconds; a clock that runs back has passed midnight), kind, target and span (to the next event, none for the last) of `lines` (run, ord, line); other lines are left out."""
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = lines.filter(F.col("line").rlike(pattern)).select("run", "ord", (part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")).alias("_c"), part(4).alias("kind"), part(5).alias("target"))
    by = Window.partitionBy("run").orderBy("ord")
    back = F.when(F.col("_c") < F.lag("_c").over(by), 1).otherwise(0)
    timed = rows.withColumn("_b", back).withColumn("t", F.col("_c") + 86_400 * F.sum("_b").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return timed.withColumn("span", F.coalesce(F.greatest(F.lit(0), F.lead("t").over(by) - F.col("t")), F.lit(0))).drop("_c", "_b")


def cached(entries: DataFrame, urls: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """`urls` (url) with the newest entry (cache_key, created, value) that is not past its time, and its new last_accessed."""
    live = entries.filter(F.col("created") > now - F.expr(f"INTERVAL {days} DAYS")).groupBy("cache_key").agg(F.max_by("value", "created").alias("value"))
    return urls.withColumn("cache_key", F.substring(F.sha2("url", 256), 1, 16)).join(live, "cache_key", "left").withColumn("last_accessed", F.when(F.col("value").isNotNull(), now))


def restored_jobs(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """`jobs` (job_id, status) and, for results that no job stands for, finished ones made of the cache (job_id)."""
    return jobs.select("job_id", "status").unionByName(cache.select("job_id").distinct().join(jobs, "job_id", "left_anti").withColumn("status", F.lit("completed")))


def full_and_first(df: DataFrame, to: str, most: int = 20) -> tuple[int, DataFrame]:
    """Writes all of `df`; gives its number of rows and the first of them."""
    df.write.mode("overwrite").parquet(to)
    rows = df.sparkSession.read.parquet(to)
    return rows.count(), rows.limit(most)
