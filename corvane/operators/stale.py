"""What pages still say of components that moved or went, found in their texts.

All changed ids and names are patterns of one automaton, which is broadcast; every page is read once for all of them. Where the patterns have more than PATTERN_CHARS characters, they are dealt
out to several automata by hash, and pages are read once for each, so nothing is left out and nothing larger than that is broadcast. What a hit means is decided by joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import ship_package, stored

#: Characters of the patterns of one automaton (some 50 bytes each on a worker).
PATTERN_CHARS = 2_000_000
#: Links to pages, without their anchors.
LINK = r"\]\(\s*<?([^)\s>#]+\.md)(?:#[^)]*)?>?\s*\)"


def hits(pages: DataFrame, patterns: DataFrame, most: int = PATTERN_CHARS) -> DataFrame:
    """page and pattern of every one of `patterns` (pattern) that stands in the text of one of `pages` (page, text), once each. Empty patterns and null texts have none."""
    spark = pages.sparkSession
    ship_package(spark)
    patterns = stored(patterns.filter("pattern <> ''").select("pattern").distinct(), "patterns")
    groups = -(-(patterns.agg(F.sum(F.length("pattern"))).first()[0] or 0) // most)

    def of(words: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(words)

        def run(batches):
            import ahocorasick
            import pyarrow as pa

            automaton = ahocorasick.Automaton()
            for i, w in enumerate(shared.value):
                automaton.add_word(w, i)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    seen = sorted({i for _, i in automaton.iter(text or "")})
                    at += [k] * len(seen)
                    found += [shared.value[i] for i in seen]
                yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["page", "pattern"])

        return pages.select("page", "text").mapInArrow(run, f"page {pages.schema['page'].dataType.simpleString()}, pattern string")

    parts = [of([r["pattern"] for r in patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g).collect()]) for g in range(groups)]  # `most` characters or so each
    return reduce(DataFrame.unionByName, parts) if parts else pages.select("page", F.lit("").alias("pattern")).limit(0)


def scanned(pages: DataFrame, found: DataFrame, names: DataFrame, removed: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """page, kind, old and new: what pages (page: name without ending; text) say that is no more. `found` has the changes (old_id, change: renamed or deleted, id), `names` (id, name) names that one old component alone bore,
    `removed` (page, replacement) pages that went. Pages `written` (page) this time are not looked at.

    kind renamed or deleted: an id that stands anywhere in the text, or else its name in back ticks; of a renamed one only if the name changed. kind deleted_page: a link to a page that was removed, or that does not exist and
    has no folder. Each item of a page once."""
    look = pages if written is None else pages.join(written.select("page"), "page", "left_anti")
    moved = found.filter("change IN ('renamed', 'deleted')").select("old_id", "change", F.when(F.col("change") == "renamed", F.col("id")).alias("new_id")).join(names.select(F.col("id").alias("old_id"), "name"), "old_id", "left")
    moved = stored(moved.withColumn("new_name", F.substring(F.col("new_id"), F.instr("new_id", "::") + 2, F.length("new_id"))), "moved")
    ticked = moved.filter("name IS NOT NULL AND (new_name IS NULL OR name <> new_name)").withColumn("tick", F.concat(F.lit("`"), "name", F.lit("`")))
    met = stored(hits(look, moved.select(F.col("old_id").alias("pattern")).union(ticked.select("tick"))), "hits")
    by_id = met.join(moved, F.col("pattern") == F.col("old_id")).select("page", F.col("change").alias("kind"), F.col("old_id").alias("old"), F.col("new_id").alias("new"))
    by_name = met.join(ticked, F.col("pattern") == F.col("tick")).join(by_id.select("page", F.col("old").alias("old_id")), ["page", "old_id"], "left_anti").select("page", F.col("change").alias("kind"), F.col("name").alias("old"), F.col("new_name").alias("new"))
    links = look.select("page", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    links = links.withColumn("old", F.regexp_replace(F.element_at(F.split("to", "/"), -1), r"\.md$", "")).withColumn("_plain", ~F.contains("to", F.lit("/")))
    there = pages.select(F.col("page").cast("string").alias("old")).distinct().withColumn("_there", F.lit(True))
    gone = removed.select(F.col("page").alias("old"), F.col("replacement").alias("new"), F.lit(True).alias("_gone"))
    dead = links.join(there, "old", "left").join(gone, "old", "left").filter("_gone OR (_there IS NULL AND _plain)").select("page", F.lit("deleted_page").alias("kind"), "old", "new")
    return by_id.unionByName(by_name).unionByName(dead).dropDuplicates(["page", "kind", "old"])
