"""What the receiver of a call is: types of variables, followed from scope to scope by joins.

A call `a.b.c()` is followed from its head: a parameter or local of the caller, a field of the caller's class or of its bases, a type by its name, or what a function gives back. Each
further name is a field of the type found so far (or of its bases, nearest first), or what its method gives back. At the end the method of that type, or of its nearest base, is what is called.

All steps are joins on unique keys: types by (file, name), by (folder, name) and, where only one has it, by (language, name), nearest first, so a name that thousands
of files share multiplies nothing. Types, members and the chains of each step are stored, so that every step starts from tables. A chain of more than DEPTH names, and bases more than UP levels up, are not followed. Defined cases: a variable that has two types in one scope has the one that comes first by line; a
receiver whose type is known, but is none of the project's, is marked external, so that no rule by name takes it for a project's own; calls without a receiver are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import stored

DEPTH, UP = 4, 5
TYPES = ("class", "interface", "struct", "enum", "record", "type_alias", "impl")


def owner_of(id_: Column) -> Column:
    """What an id lies in."""
    return F.regexp_replace(id_, r"\.[^.:]+$", "")


def file_of(id_: Column) -> Column:
    return F.substring_index(id_, "::", 1)


def folder_of(id_: Column) -> Column:
    return F.regexp_replace(file_of(id_), r"/?[^/]*$", "")


def short(name: Column) -> Column:
    """The last part of a qualified name."""
    return F.regexp_extract(name, r"([^.:\\]+)$", 1)


def _places(id_: Column) -> Column:
    """The keys under which the types around `id_` are found, nearest first."""
    return F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("place")) for k, c in enumerate((file_of(id_), F.concat_ws("|", "language", folder_of(id_)), F.col("language")))])


def type_index(components: DataFrame, kinds: tuple[str, ...] = TYPES) -> DataFrame:
    """kind (0 file, 1 folder, 2 language), place, name and type_id of types (or of components of other `kinds`) that one key names."""
    types = components.filter(F.col("component_type").isin(*kinds)).select("id", "language", short(F.col("name")).alias("name"))
    keys = types.select("id", "name", F.inline(_places(F.col("id"))))
    return keys.groupBy("kind", "place", "name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("type_id")).filter("n = 1").drop("n")


def with_type(rows: DataFrame, index: DataFrame, name: str, at: str) -> DataFrame:
    """`rows` with type_id: the type that the column `name` names where the column `at` (an id) lies; null if it is none of the project's."""
    asked = rows.select(F.col(at).alias("_at"), "language", short(F.col(name)).alias("name")).distinct()
    keys = asked.withColumn("_places", _places(F.col("_at")))
    hit = keys.select("_at", "language", "name", F.inline("_places")).join(index, ["kind", "place", "name"]).groupBy("_at", "language", "name").agg(F.min_by("type_id", "kind").alias("type_id"))
    hit = hit.select(F.col("_at").alias("_h_at"), F.col("language").alias("_h_language"), F.col("name").alias("_h_name"), "type_id")
    on = (F.col(at) == F.col("_h_at")) & F.col("language").eqNullSafe(F.col("_h_language")) & (short(F.col(name)) == F.col("_h_name"))
    return rows.join(hit, on, "left").drop("_h_at", "_h_language", "_h_name")


def ancestors(components: DataFrame, inherits: DataFrame, index: DataFrame) -> DataFrame:
    """type_id, up_id and depth: each type with itself and the types above it, each at its least depth. inherits: id, base, language."""
    own = components.filter(F.col("component_type").isin(*TYPES)).select(F.col("id").alias("type_id")).distinct()
    bases = with_type(inherits.select("id", "base", "language"), index, "base", "id").filter("type_id IS NOT NULL AND type_id <> id").select(F.col("id").alias("up_id"), F.col("type_id").alias("above")).distinct()
    level = own.select("type_id", F.col("type_id").alias("up_id"))
    out = level.withColumn("depth", F.lit(0))
    for d in range(1, UP + 1):
        level = level.join(bases, "up_id").select("type_id", F.col("above").alias("up_id")).distinct()
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out.groupBy("type_id", "up_id").agg(F.min("depth").alias("depth"))


def first_types(bindings: DataFrame) -> DataFrame:
    """scope, name and type: of a variable that is bound more than once, what comes first; what is written before what is set."""
    return bindings.groupBy(F.col("id").alias("scope"), "name").agg(F.min_by(F.struct(F.col("callee").alias("type"), "language"), F.struct(F.col("callee").endswith("()"), "call_line", "callee")).alias("t")).select("scope", "name", "t.type", "t.language")


def resolved_types(bindings: DataFrame, index: DataFrame, functions: DataFrame) -> DataFrame:
    """scope, name, type_id (null: not of the project) of every variable; those set to what a function gives back take that. `functions`: an index like that of types."""
    types = first_types(bindings)
    plain = with_type(types.filter(~F.col("type").endswith("()")), index, "type", "scope").select("scope", "name", "type_id")
    results = plain.filter("name = '()'").select(F.col("scope").alias("function"), "type_id")
    called = types.filter(F.col("type").endswith("()")).withColumn("_f", F.regexp_replace("type", r"\(\)$", ""))
    # a method of the own class, a type's own function, or a function by its name: of the file, the folder, the language
    of_type = with_type(called.withColumn("_t", F.regexp_extract("_f", r"^(.+?)(?:\.|::)[^.:]+$", 1)), index, "_t", "scope")
    of_type = with_type(of_type.withColumnRenamed("type_id", "_type"), functions, "_f", "scope")
    plainly = F.when(F.col("_f") == short(F.col("_f")), F.col("type_id"))
    ways = F.array(F.concat(owner_of(F.col("scope")), F.lit("."), F.col("_f")), F.concat(F.col("_type"), F.lit("."), short(F.col("_f"))), plainly)
    asked = of_type.select("scope", "name", F.posexplode(ways).alias("_way", "function")).filter("function IS NOT NULL")
    found = asked.join(results, "function").groupBy("scope", "name").agg(F.min_by("type_id", "_way").alias("type_id"))
    return plain.unionByName(found)


def followed(calls: DataFrame, components: DataFrame, bindings: DataFrame) -> DataFrame:
    """`calls` (caller, callee, relation, call_line, language) with resolved (the method's id) and external (the receiver's type is known and not of the project)."""
    numbered = calls.withColumn("_n", F.xxhash64("caller", "callee", "relation", "call_line"))
    index = stored(type_index(components), "types")
    inherits = calls.filter("relation IN ('inherits', 'embeds', 'mixin', 'uses')").select(F.col("caller").alias("id"), F.col("callee").alias("base"), "language")
    above = stored(ancestors(components, inherits, index), "above")
    functions = stored(type_index(components, ("function",)), "functions")
    known = stored(resolved_types(bindings, index, functions), "variables")
    # members of types, their bases' included: fields by name, results of methods by name and brackets, nearest first
    results = known.filter("name = '()'").select(owner_of(F.col("scope")).alias("up_id"), F.concat(F.regexp_extract("scope", r"([^.:]+)$", 1), F.lit("()")).alias("name"), F.col("type_id").alias("to_id"))
    fields = known.filter("name <> '()'").select(F.col("scope").alias("up_id"), "name", F.col("type_id").alias("to_id"))
    nearest = Window.partitionBy("type_id", "name").orderBy("depth", "up_id")
    members = stored(above.join(fields.unionByName(results), "up_id").withColumn("_r", F.row_number().over(nearest)).filter("_r = 1").select("type_id", "name", "to_id"), "members")
    methods = components.filter(F.col("component_type").isin("method", "function", "variable")).select(owner_of(F.col("id")).alias("up_id"), F.regexp_extract("id", r"([^.:]+)$", 1).alias("name"), F.col("id").alias("method"))
    answers = stored(above.join(methods, "up_id").withColumn("_r", F.row_number().over(nearest)).filter("_r = 1").select("type_id", "name", "method"), "answers")
    parts = F.split("callee", r"\.|::|\\")
    chains = numbered.filter(F.col("relation").isin("call", "chain") & (F.size(parts) > 1) & (F.size(parts) <= DEPTH + 1)).select("_n", "caller", "language", F.element_at(parts, 1).alias("head"), F.slice(parts, 2, DEPTH).alias("rest")).dropDuplicates(["_n"])
    # the head: a variable of the caller; a member of the caller's class; a type
    local = chains.join(known.select(F.col("scope").alias("caller"), F.col("name").alias("head"), "type_id"), ["caller", "head"]).select("_n", F.lit(0).alias("_way"), "type_id")
    own = chains.withColumn("type_id", owner_of(F.col("caller"))).join(members.withColumnRenamed("name", "head"), ["type_id", "head"]).select("_n", F.lit(1).alias("_way"), F.col("to_id").alias("type_id"))
    named = with_type(chains, index, "head", "caller").filter("type_id IS NOT NULL").select("_n", F.lit(2).alias("_way"), "type_id")
    result = known.filter("name = '()'").select(F.col("scope").alias("_function"), F.col("type_id").alias("_to"))
    given = with_type(chains.filter(F.col("head").endswith("()")).withColumn("_f", F.regexp_replace("head", r"\(\)$", "")), functions, "_f", "caller").join(result, F.col("type_id") == F.col("_function")).select("_n", F.lit(3).alias("_way"), F.col("_to").alias("type_id"))
    heads = local.unionByName(own).unionByName(named).unionByName(given).groupBy("_n").agg(F.min(F.struct("_way", F.col("type_id").isNull().alias("_none"), "type_id")).alias("b")).select("_n", F.col("b.type_id").alias("type_id"))
    state = stored(chains.join(heads, "_n").select("_n", "type_id", "rest"), "chains")
    done = state.filter("type_id IS NULL").select("_n", F.lit(None).cast("string").alias("resolved"), F.lit(True).alias("external"))
    state = state.filter("type_id IS NOT NULL")
    for _ in range(DEPTH):
        last = state.filter("size(rest) = 1").withColumn("name", F.regexp_replace(F.element_at("rest", 1), r"\(\)$", ""))
        done = done.unionByName(last.join(answers, ["type_id", "name"], "left").select("_n", F.col("method").alias("resolved"), F.lit(False).alias("external")))
        if state.filter("size(rest) > 1").isEmpty():
            break
        step = state.filter("size(rest) > 1").withColumn("name", F.element_at("rest", 1)).join(members, ["type_id", "name"]).select("_n", F.col("to_id").alias("type_id"), F.slice("rest", 2, DEPTH).alias("rest"))
        step = stored(step, "chains")
        done = done.unionByName(step.filter("type_id IS NULL").select("_n", F.lit(None).cast("string").alias("resolved"), F.lit(True).alias("external")))
        state = step.filter("type_id IS NOT NULL")
    return numbered.join(done.dropDuplicates(["_n"]), "_n", "left").drop("_n").withColumn("external", F.coalesce("external", F.lit(False)))
