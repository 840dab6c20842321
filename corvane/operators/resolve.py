"""Binding of calls to components over any component table.

components: id (path::dotted name), name, component_type, relative_path, language; calls: caller, callee, call_line, language. A key binds only
if it is unique; rules are tried in order, first in the caller's language, then over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import stored

#: Languages whose own rules are the last word: a call that they do not resolve is dropped.
AUTHORITATIVE = ("dart", "go")

# fixed values: names that belong to a language or its libraries, by language
EXTERNAL = {
    "python": "print len range str int dict list set tuple isinstance super open sorted enumerate zip map filter",
    "javascript": "console Math JSON Object Array Promise Date parseInt parseFloat require setTimeout fetch Symbol Map Set",
    "typescript": "console Math JSON Object Array Promise Date parseInt parseFloat require setTimeout fetch Record Partial",
    "java": "System String Integer Long Double Object Math List Map Set Optional Arrays Collections",
    "csharp": "Console String Math Task List Dictionary Enumerable Convert Exception",
    "go": "fmt strings errors len make append panic new cap copy",
    "c": "printf malloc free memcpy strlen sizeof memset fopen", "cpp": "std printf malloc free memcpy move make_unique make_shared",
    "kotlin": "println listOf mapOf setOf require check String Int", "php": "array count strlen isset empty implode explode printf",
    "ruby": "puts require raise attr_accessor attr_reader lambda proc", "scala": "println List Map Option Some Seq Future",
    "rust": "println vec format panic Some Ok Err Box Vec String", "dart": "print List Map Future Stream String Duration", "zig": "std",
}
EXTERNAL_PREFIXES = {"java": ("java.", "javax.", "org.junit."), "csharp": ("System.", "Microsoft."), "kotlin": ("kotlin.", "java."), "scala": ("scala.", "java."), "rust": ("std::", "core::"), "cpp": ("std::",), "php": ("Symfony\\",)}
#: Into how many parts the types of one set of methods are dealt.
SPREAD = 32
#: Capitals that are no macros.
NO_MACROS = ("NULL", "TRUE", "FALSE", "MAIN")


def dotted_name(id_: Column) -> Column:
    return F.element_at(F.split(id_, "::", 2), -1)


def package_of(id_: Column, kind: Column) -> Column:
    """The package or namespace of a qualified name: without its type, for methods without type and method."""
    parts = F.split(dotted_name(id_), r"\.")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - F.when(kind.isin("method", "constructor"), 2).otherwise(1))), ".")


def language_or_ending(language: Column, path: Column) -> Column:
    from corvane.operators.languages import language_of

    return F.coalesce(language, language_of(path))


def is_macro(name: Column) -> Column:
    """ALL_CAPS of four letters or more, or with an underscore."""
    return name.rlike(r"^[A-Z][A-Z0-9_]*$") & ((F.length(name) >= 4) | F.contains(name, F.lit("_"))) & ~name.isin(*NO_MACROS)


def is_private(name: Column) -> Column:
    """Whether any segment of a dotted name starts with an underscore; ids are not names."""
    return name.rlike(r"(^|\.)_") & ~F.contains(name, F.lit("::"))


def is_external(callee: Column, language: Column) -> Column:
    """Whether a callee belongs to the language or its libraries: by its first name, by a namespace, or a macro in C and C++."""
    head = F.regexp_extract(callee, r"^[\w$]+", 0)
    out = language.isin("c", "cpp") & is_macro(callee)
    for lang, names in EXTERNAL.items():
        out = out | ((language == lang) & head.isin(names.split()))
    for lang, prefixes in EXTERNAL_PREFIXES.items():
        for p in prefixes:
            out = out | ((language == lang) & callee.startswith(p))
    return out


def project_packages(components: DataFrame) -> DataFrame:
    """language and package of all that the project defines."""
    return components.select("language", package_of(F.col("id"), F.col("component_type")).alias("package")).filter("package <> ''").distinct()


def python_modules(paths: DataFrame) -> DataFrame:
    """module: dotted names of the Python files among `paths` (path); a package is named by its folder."""
    name = F.replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))
    return paths.filter(F.col("path").endswith(".py")).select(name.alias("module")).filter("module <> ''").distinct()


def imports_of_project(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """`imports` (name) that name a module of the project or lie in one, on borders of dots."""
    parts = F.split("name", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    found = imports.select("name", F.explode(heads).alias("module")).join(modules, "module", "left_semi").select("name")
    tail = modules.select(F.regexp_extract("module", r"([^.]+)$", 1).alias("name"))
    return found.union(imports.select("name").join(tail, "name", "left_semi")).distinct()


def index(components: DataFrame) -> DataFrame:
    """language, kind (exact, simple or package), key and id of keys that name one component; language is null over all."""
    name = dotted_name(F.col("id"))
    parts = F.split(name, r"\.")
    last_two = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), ".")
    exact = F.transform(F.array_distinct(F.array("id", name, "name")), lambda k: F.struct(F.lit("exact").alias("kind"), k.alias("key")))
    simple = F.transform(F.array_distinct(F.array("name", F.element_at(parts, -1), last_two)), lambda k: F.struct(F.lit("simple").alias("kind"), k.alias("key")))
    package = F.array(F.struct(F.lit("package").alias("kind"), F.concat_ws(":", package_of(F.col("id"), F.col("component_type")), "name").alias("key")))
    spread = components.repartition(int(components.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")  # each component gives a dozen keys, and many may lie in one file
    keys = spread.select("id", F.explode(F.array("language", F.lit(None))).alias("language"), F.inline(F.concat(exact, simple, package)))
    unique = keys.filter("NOT (language IS NULL AND kind = 'package')").groupBy("language", "kind", "key").agg(F.max("id").alias("_last"), F.min("id").alias("id"))
    return unique.filter("id = _last").select("language", "kind", "key", "id")


def resolved(calls: DataFrame, components: DataFrame) -> DataFrame:
    """`calls` with `resolved` (an id or null) and `rule`: exact; what stands after `::`, exact or simple; the whole or last part of a dotted name; the same package (Java, C#); the plain name; each in the caller's language (1 to 7), then over all (11 to 17)."""
    # stored: numbers of rows that were shuffled differ from one reading to the next
    calls = stored(calls.withColumn("_n", F.monotonically_increasing_id()), "calls")
    callee = F.col("callee")
    tail = F.element_at(F.split(callee, "::"), -1)
    parts = F.split(tail, r"\.")
    last_two = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), ".")
    try_ = lambda rule, kind, key: F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), key.alias("key"))
    packaged = F.when(F.col("language").isin("java", "csharp"), F.concat_ws(":", package_of(F.col("caller"), F.lit("method")), callee))
    tries = F.array(try_(1, "exact", callee), try_(2, "exact", tail), try_(3, "simple", tail), try_(4, "simple", last_two), try_(5, "simple", F.element_at(parts, -1)), try_(6, "package", packaged), try_(7, "simple", callee))
    asked = calls.select("_n", "language", F.inline(tries)).filter("key IS NOT NULL")
    idx = index(components).hint("merge")  # as large as the components, though the planner takes it for small
    own = asked.join(idx, ["language", "kind", "key"]).select("_n", "rule", "id")
    every = asked.drop("language").join(idx.filter("language IS NULL").drop("language"), ["kind", "key"]).select("_n", (F.col("rule") + 10).alias("rule"), "id")
    best = own.unionByName(every).groupBy("_n").agg(F.min(F.struct("rule", "id")).alias("b")).select("_n", F.col("b.id").alias("resolved"), F.col("b.rule").alias("rule"))
    return calls.join(best.hint("merge"), "_n", "left").drop("_n")


def bound(calls: DataFrame, components: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """caller, callee, resolved, rule and call_line of all calls that stay: resolved ones, and those that the first component of that name takes (rule 20).
    External callees that nothing in the project answers to go; so do unresolved calls of AUTHORITATIVE languages. Of a caller and what it resolves to the first line counts.
    With `bindings` (types of variables, as languages.extract gives them; calls then have their relation) receivers are followed first (rule 0): what they lead to counts, and calls on what is not the project's go."""
    if bindings is None:
        return _by_name(resolved(calls, components), components)
    from corvane.operators.receivers import followed

    typed = followed(calls, components, bindings).filter("NOT external AND NOT (relation = 'chain' AND resolved IS NULL)")
    by_name = resolved(typed.filter("resolved IS NULL").select("caller", "callee", "call_line", "language"), components)
    led = typed.filter("resolved IS NOT NULL").select("caller", "callee", "call_line", "language", "resolved", F.lit(0).alias("rule"))
    return _by_name(by_name.unionByName(led), components)


def _by_name(found: DataFrame, components: DataFrame) -> DataFrame:
    first = components.groupBy("name").agg(F.min("id").alias("_first"))
    tail = F.element_at(F.split(F.element_at(F.split("callee", "::"), -1), r"\."), -1)
    left = found.filter("resolved IS NOT NULL OR language NOT IN ('dart', 'go')").withColumn("_external", F.col("resolved").isNull() & is_external(F.col("callee"), F.col("language"))).filter("NOT _external")
    left = left.withColumn("name", F.when(F.col("resolved").isNull(), tail)).join(first.hint("merge"), "name", "left").withColumn("rule", F.when(F.col("resolved").isNull() & F.col("_first").isNotNull(), 20).otherwise(F.col("rule"))).withColumn("resolved", F.coalesce("resolved", "_first"))
    return first_calls(left.select("caller", "callee", "resolved", "rule", "call_line"))


def first_calls(calls: DataFrame) -> DataFrame:
    """One call for each caller and target, the first by line."""
    return calls.groupBy("caller", F.coalesce("resolved", "callee").alias("_to")).agg(F.min_by(F.struct("callee", "resolved", "rule", "call_line"), F.struct("call_line", "callee")).alias("c")).select("caller", "c.*")


def edges(calls: DataFrame, components: DataFrame) -> DataFrame:
    """src and dst of resolved calls between known components."""
    return bound(calls, components).filter("resolved IS NOT NULL AND resolved <> caller").select(F.col("caller").alias("src"), F.col("resolved").alias("dst")).distinct().join(components.select(F.col("id").alias("src")), "src", "left_semi")


# ---- packages of Go


def promoted(members: DataFrame, embeds: DataFrame, depth: int = 3) -> DataFrame:
    """dir, type, name and id of what a type answers to: its own members (dir, type, name, id), then those of types it embeds (dir, type, embedded), `depth` deep; the nearest wins, and two as near as each other none."""
    out = members.select("dir", "type", "name", "id", F.lit(0).alias("depth"))
    level = embeds.select("dir", "type", F.col("embedded").alias("inner"))
    for d in range(1, depth + 1):
        out = out.unionByName(level.join(members.withColumnRenamed("type", "inner"), ["dir", "inner"]).select("dir", "type", "name", "id", F.lit(d).alias("depth")))
        level = level.join(embeds.select("dir", F.col("type").alias("inner"), "embedded"), ["dir", "inner"]).select("dir", "type", F.col("embedded").alias("inner")).distinct()
    near = out.groupBy("dir", "type", "name", "depth").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    best = near.groupBy("dir", "type", "name").agg(F.min_by(F.struct("n", "id"), "depth").alias("b"))
    return best.filter("b.n = 1").select("dir", "type", "name", F.col("b.id").alias("id"))


def implementers(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """dir, type and interface: types (dir, type, name) whose methods hold all of an interface's (dir, interface, name) of the same package."""
    # those of equal methods are one class; classes are compared, and their members paired in SPREAD parts of each class
    sets = lambda rows, c: rows.select("dir", c, "name").distinct().groupBy("dir", c).agg(F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("n")).select("dir", c, "names", (F.size("names") == F.col("n")).alias("whole"))
    types = stored(sets(methods, "type").filter("size(names) > 0").withColumn("_part", F.pmod(F.xxhash64("type"), F.lit(SPREAD))), "types")
    faces = stored(sets(interfaces, "interface").filter("whole AND size(names) > 0").drop("whole"), "faces")
    has = types.select("dir", F.col("names").alias("has")).distinct()
    asked = faces.select("dir", F.col("names").alias("asked")).distinct()
    by_name = has.withColumn("name", F.explode("has")).join(asked.withColumn("name", F.explode("asked")), ["dir", "name"])
    held = stored(by_name.groupBy("dir", "has", "asked").agg(F.count("*").alias("n")).filter("n = size(asked)").select("dir", "has", "asked"), "held")
    wanted = held.join(faces.withColumnRenamed("names", "asked"), ["dir", "asked"]).select("dir", F.col("has").alias("names"), "interface").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")))
    return types.join(wanted, ["dir", "names", "_part"]).filter("type <> interface").select("dir", "type", "interface")


def containing(sets: DataFrame, most: int = 16) -> DataFrame:
    """typ and iface: sets (o, m) that hold all of another, which has two members or more (none of them null). The two rarest members of the smaller one are looked up among the pairs of members of the others; of sets of more than
    `most` members, whose pairs would be many, among their single members."""
    rows = stored(sets.select("o", "m").filter("o IS NOT NULL").distinct(), "sets")
    met = rows.filter("m IS NOT NULL").groupBy("m").agg(F.count("*").alias("n"))
    held = rows.join(met.hint("merge"), "m", "left").groupBy("o").agg(F.sort_array(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("n", "m")))).alias("ranked"), F.count("*").alias("n"))
    held = stored(held.select("o", F.col("ranked.m").alias("ms"), (F.size("ranked") == F.col("n")).alias("whole")), "held")
    faces = held.filter("whole AND size(ms) >= 2").select(F.col("o").alias("iface"), F.col("ms")[0].alias("_a"), F.col("ms")[1].alias("_b"))
    pairs = F.expr("flatten(transform(sequence(1, size(s) - 1), i -> transform(slice(s, i + 1, size(s)), z -> named_struct('_x', s[i - 1], '_y', z))))")
    small = held.filter((F.size("ms") >= 2) & (F.size("ms") <= most)).select(F.col("o").alias("typ"), F.array_sort("ms").alias("s")).select("typ", F.inline(pairs))
    large = held.filter(F.size("ms") > most).select(F.col("o").alias("typ"), F.explode("ms").alias("_a"))
    found = faces.select("iface", F.least("_a", "_b").alias("_x"), F.greatest("_a", "_b").alias("_y")).join(small.hint("merge"), ["_x", "_y"]).select("typ", "iface").unionByName(faces.join(large, "_a").select("typ", "iface"))
    found = found.filter("typ <> iface").join(held.select(F.col("o").alias("typ"), F.col("ms").alias("_has")), "typ").join(held.select(F.col("o").alias("iface"), F.col("ms").alias("_asked")), "iface")
    return found.filter(F.size(F.array_except("_asked", "_has")) == 0).select("typ", "iface")


# ---- visibility of libraries


def visible(imports: DataFrame, exports: DataFrame, parts: DataFrame) -> DataFrame:
    """file and sees (whole: private names, too): a library sees itself and its parts whole; what it imports, and all that those export in turn, in public. imports (src, dst), exports (src, dst), parts (library, part)."""
    from corvane.operators.graph import closure

    of = parts.select(F.col("part").alias("file"), "library")
    group = of.union(of.select(F.col("library").alias("file"), "library")).distinct()
    whole = group.join(group.withColumnRenamed("file", "sees"), "library").filter("file <> sees").select("file", "sees", F.lit(True).alias("whole"))
    far = closure(exports)
    files = imports.select("src").union(imports.select("dst")).union(parts.select("part")).union(parts.select("library")).distinct()
    direct = imports.union(group.filter("file <> library").join(imports, F.col("library") == F.col("src")).select(F.col("file").alias("src"), "dst"))
    reach = direct.union(direct.alias("a").join(far.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")).distinct()
    with_parts = reach.union(reach.join(parts, F.col("dst") == F.col("library")).select("src", F.col("part").alias("dst")))
    rows = with_parts.select(F.col("src").alias("file"), F.col("dst").alias("sees"), F.lit(False).alias("whole")).union(whole).union(files.select(F.col("src").alias("file"), F.col("src").alias("sees"), F.lit(True).alias("whole")))
    return rows.groupBy("file", "sees").agg(F.max("whole").alias("whole"))


def bound_in_scope(calls: DataFrame, components: DataFrame, scope: DataFrame) -> DataFrame:
    """`calls` (caller, callee) with the one component of that name that the caller's file sees; private names only in its own library. None where several answer."""
    rows = calls.withColumn("file", F.substring_index("caller", "::", 1)).withColumn("name", F.element_at(F.split("callee", r"\."), -1)).join(scope, "file")
    hit = rows.join(components.select("id", "name", F.col("relative_path").alias("sees")), ["name", "sees"]).filter(F.col("whole") | ~F.col("name").startswith("_"))
    one = hit.groupBy("caller", "callee").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").select("caller", "callee", F.col("id").alias("resolved"))
    return calls.join(one, ["caller", "callee"], "left")


# ---- selection


def leaf_types(components: DataFrame) -> DataFrame:
    """n_oop, n_func and with_functions: whether functions count as leaves beside classes, interfaces, structs and artifacts."""
    n = components.agg(F.count(F.when(F.col("component_type").isin("class", "interface", "struct"), 1)).alias("n_oop"), F.count(F.when(F.col("component_type") == "function", 1)).alias("n_func"))
    return n.withColumn("with_functions", (F.col("n_oop") == 0) | ((F.col("n_oop") < 20) & (F.col("n_func") > F.col("n_oop"))) | ((F.col("n_func") > 0) & (F.col("n_oop") / (F.col("n_oop") + F.col("n_func")) < 0.2)))


def leaves(components: DataFrame, depends: DataFrame, prune_at: int = 400) -> DataFrame:
    """id of the components of a valid type; from `prune_at` on only those that nothing but artifacts depends on. Constructors count as their class."""
    gate = F.broadcast(leaf_types(components).select("with_functions"))
    kinds = F.col("component_type").isin("class", "interface", "struct", "artifact") | (F.col("with_functions") & (F.col("component_type") == "function"))
    valid = components.crossJoin(gate).filter(kinds).select(F.regexp_replace("id", r"\.__init__$", "").alias("id")).distinct().join(components.select("id"), "id", "left_semi")
    n = F.broadcast(valid.agg(F.count("*").alias("_n")))
    used = depends.join(components.filter("component_type <> 'artifact'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(True).alias("_used")).distinct()
    return valid.crossJoin(n).join(used, "id", "left").filter((F.col("_n") < prune_at) | F.col("_used").isNull()).select("id")


def known_leaves(ids: DataFrame, components: DataFrame) -> DataFrame:
    """`ids` (id, in order ord) that are components, once each after their paths are normalised, in order."""
    from corvane.functions import text as T

    return ids.withColumn("id", T.normal_id(F.col("id"))).groupBy("id").agg(F.min("ord").alias("ord")).join(components.select("id"), "id", "left_semi")


def call_summary(edges_: DataFrame) -> DataFrame:
    """id, calls and called_by: sorted names on both sides."""
    a = edges_.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("calls"))
    b = edges_.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("called_by"))
    return a.join(b, "id", "full_outer")


def entry_points(components: DataFrame, edges_: DataFrame, most: int = 10) -> DataFrame:
    """The `most` components that look like a start (main, run, cli, app, server, handlers) or are most connected: id, named and degree."""
    named = F.col("name").rlike(r"(?i)^(main|run|start|init|setup|cli|app|server|handler|execute|bootstrap)$|(?i)(main|handler|controller|server)$")
    degree = edges_.select(F.col("src").alias("id"), F.col("dst").alias("o")).union(edges_.select("dst", "src")).groupBy("id").agg(F.countDistinct("o").alias("degree"))
    return components.select("id", named.alias("named")).join(degree, "id", "left").fillna(0, ["degree"]).orderBy(F.col("named").desc(), F.col("degree").desc(), "id").limit(most)


def picture(components: DataFrame, edges_: DataFrame) -> DataFrame:
    """Nodes and edges of the graph as one table for drawing: kind, id, other, label."""
    nodes = components.select(F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("other"), F.concat_ws(" ", "component_type", "name").alias("label"))
    lines = edges_.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("calls").alias("label"))
    return nodes.unionByName(lines)


def inherited(owners: DataFrame, bases: DataFrame, wanted: DataFrame, depth: int = 5) -> DataFrame:
    """`wanted` (class, name) with the id of the method that answers: of the class or of the nearest base. owners (class, name, id), bases (class, base, ord)."""
    level, out = wanted.select("class", "name", F.col("class").alias("at"), F.lit("").alias("way")), None
    for d in range(depth + 1):
        hit = level.join(owners.select(F.col("class").alias("at"), "name", "id"), ["at", "name"]).select("class", "name", "id", F.lit(d).alias("depth"), "way")
        out = hit if out is None else out.unionByName(hit)
        level = level.join(bases.select(F.col("class").alias("at"), "base", "ord"), "at").select("class", "name", F.col("base").alias("at"), F.concat("way", F.lpad(F.col("ord").cast("string"), 4, "0")).alias("way"))
    nth = Window.partitionBy("class", "name").orderBy("depth", "way")
    best = out.withColumn("_n", F.row_number().over(nth)).filter("_n = 1").select("class", "name", "id")
    return wanted.join(best, ["class", "name"], "left")
