"""Reading for a question: hits in lines, what stands next to a unit, what fits a budget, when to stop. Units: id, kind, name, title, file, start_line, end_line, tokens, text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import packing
from corvane.operators.extract import window_of
from corvane.operators.impact import innermost
from corvane.session import ship_package

# fixed values
GREP_FILES, GREP_HITS, GREP_BYTES = 40, 120, 1 << 20
CONFIDENT, GAIN, ROUNDS, BUDGET, MOST_BUDGET = 85, 2.0, 3, 12_000, 60_000


def signature_of(source: str | None) -> str:
    """The first line of code, with up to two that go on with it; comments and decorators are passed over; 240 characters."""
    out: list[str] = []
    for line in (source or "").split("\n"):
        bare = line.strip()
        if not out and (not bare or bare.startswith(("#", "//", "/*", "*", "@", "--"))):
            continue
        out.append(bare)
        joined = " ".join(out)
        if len(out) == 3 or (joined.count("(") <= joined.count(")") and not joined.endswith(("(", ",", "\\"))):
            break
    return " ".join(out)[:240]


def described(units: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """id, kind, title, location, tokens, stale and snippet."""
    ship_package(units.sparkSession)

    def run(series):
        return series.map(signature_of)

    signature = F.pandas_udf(run, "string")
    rows = units.join(stale.select("id", F.lit(True).alias("_s")).distinct(), "id", "left") if stale is not None else units.withColumn("_s", F.lit(None).cast("boolean"))
    where = F.concat(F.col("file"), F.coalesce(F.concat(F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")), F.lit("")))
    return rows.select("id", "kind", "title", where.alias("location"), T.approx_tokens(F.length("text")).alias("tokens"), F.col("_s").isNotNull().alias("stale"), F.when(F.col("kind") == "section", T.first_sentence(F.col("text"))).otherwise(signature(F.col("text"))).alias("snippet"))


def grep(files: DataFrame, components: DataFrame, pattern: str, most_files: int = GREP_FILES, most_hits: int = GREP_HITS) -> DataFrame:
    """id and hits (the first three lines) of the components that lines matching `pattern` lie in. Files (path, text, ord) are searched in order, up to the limits on files and hits; larger ones than a megabyte are passed over (passed_over names them). Hits outside components count towards the limits."""
    lines = files.filter(F.length("text") <= GREP_BYTES).select("path", "ord", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1).filter(F.col("text").rlike(pattern))
    first = lines.select("path", "ord").distinct().orderBy("ord", "path").limit(most_files)
    hits = lines.join(F.broadcast(first.select("path")), "path").orderBy("ord", "path", "line").limit(most_hits)
    found = innermost(hits.select("path", "line", "ord", "text"), components).filter("id IS NOT NULL")
    return found.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", "line", "text"))), lambda x: F.concat(x["line"].cast("string"), F.lit(": "), F.trim(x["text"]))), 1, 3).alias("hits"), F.count("*").alias("n"))


def touched_any(units: DataFrame, touched: DataFrame, hits: DataFrame) -> DataFrame:
    """file, touched and hit of `units` (id, file): whether any unit of the file is among `touched` (id), and any among `hits` (id)."""
    mark = lambda rows, name: rows.select("id").distinct().withColumn(name, F.lit(True))
    rows = units.select("id", "file").join(mark(touched, "_t"), "id", "left").join(mark(hits, "_h"), "id", "left")
    return rows.groupBy("file").agg(F.bool_or(F.col("_t").isNotNull()).alias("touched"), F.bool_or(F.col("_h").isNotNull()).alias("hit"))


def passed_over(files: DataFrame) -> DataFrame:
    """path and n_chars of files (path, text) that grep does not read, as they are larger than GREP_BYTES."""
    return files.filter(F.length("text") > GREP_BYTES).select("path", F.length("text").alias("n_chars"))


def neighbours(edges: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """id and near: what a component uses, what uses it, sections of the first two levels of its pages; and for a section the components of its page. pages (page, component_id), sections (id, page, level)."""
    high = sections.filter("level <= 2").select("id", "page").join(pages, "page")
    every = sections.select("id", "page").join(pages, "page")
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("near")).union(edges.select("dst", "src")).union(high.select("component_id", "id")).union(every.select("id", "component_id")).filter("id <> near").distinct()


def not_contained(chosen: DataFrame, units: DataFrame) -> DataFrame:
    """`chosen` (id, ord) without units that lie strictly inside a larger chosen one of the same file."""
    rows = chosen.join(units.select("id", "file", "start_line", "end_line"), "id")
    outer = rows.select(F.col("file").alias("_f"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"), F.col("id").alias("_i"))
    inner = rows.join(outer, (F.col("file") == F.col("_f")) & (F.col("_a") <= F.col("start_line")) & (F.col("end_line") <= F.col("_b")) & (F.col("id") != F.col("_i")) & ((F.col("_b") - F.col("_a")) > (F.col("end_line") - F.col("start_line"))), "left_semi")
    return chosen.join(inner.select("id"), "id", "left_anti")


def assembled(chosen: DataFrame, units: DataFrame, budget: int) -> DataFrame:
    """id, taken (tokens) and cut of what is read of `chosen` (id, ord) in order: units inside others are left out, what does not fit is skipped, a first that is too large is cut."""
    rows = not_contained(chosen, units).join(units.select("id", "tokens"), "id")
    took = packing.skip_greedy(rows.select(F.lit(0).alias("grp"), "id", "ord", F.col("tokens").cast("long").alias("tokens")), budget)
    return took.join(rows.select("id", "tokens"), "id").select("id", "taken", (F.col("taken") < F.col("tokens")).alias("cut"))


def read(asked: DataFrame, units: DataFrame, near: DataFrame, budget: int, words: list[str] = ()) -> DataFrame:
    """id, state (read, skipped, missing, related), text: the asked ids (id, ord) under a budget, what did not fit, what does not exist, and up to ten ids next to what was read. Code has line numbers; a text that is cut keeps its lines with most of the words."""
    ship_package(units.sparkSession)
    missing = asked.join(units.select("id"), "id", "left_anti").select("id", F.lit("missing").alias("state"), F.lit("").alias("text"))
    got = assembled(asked.join(units.select("id"), "id", "left_semi"), units, budget)
    skipped = asked.join(units.select("id"), "id", "left_semi").join(got.select("id"), "id", "left_anti").select("id", F.lit("skipped").alias("state"), F.lit("").alias("text"))
    shown = got.join(units.select("id", "kind", "text", "start_line"), "id")

    def run(frames):
        for frame in frames:
            out = []
            for text, taken, cut, kind, first in zip(frame["text"], frame["taken"], frame["cut"], frame["kind"], frame["start_line"]):
                out.append(reader(text, kind, int(first or 1), int(taken * 3.6) if cut else None, list(words)))
            yield frame.assign(state="read", text=out)[["id", "state", "text"]]

    done = shown.select("id", "text", "taken", "cut", "kind", F.coalesce("start_line", F.lit(1)).alias("start_line")).mapInPandas(run, f"id {units.schema['id'].dataType.simpleString()}, state string, text string")
    related = near.join(got.select("id"), "id").select(F.col("near").alias("id")).distinct().join(asked.select("id"), "id", "left_anti").orderBy("id").limit(10).select("id", F.lit("related").alias("state"), F.lit("").alias("text"))
    return done.unionByName(skipped).unionByName(missing).unionByName(related)


def reader(text: str, kind: str, first: int, most: int | None, words: list[str]) -> str:
    """A section as it stands, code with its line numbers; cut to `most` characters around the words, the first line kept and gaps marked."""
    lines = (text or "").split("\n")
    lo, hi = 1, len(lines)
    if most is not None and len(text) > most:
        lo, hi, _ = window_of(text, [w.lower() for w in words], max(1, most - len(lines[0]) - 10))
    width = len(str(first + len(lines) - 1))
    show = lambda k: lines[k - 1] if kind == "section" else f"{first + k - 1:>{width}}  {lines[k - 1]}"
    out = ([show(1)] if lo > 1 else []) + ([f"... {lo - 2} lines"] if lo > 2 else []) + [show(k) for k in range(lo, hi + 1)] + ([f"... {len(lines) - hi} lines"] if hi < len(lines) else [])
    return "\n".join(out)


def components_by_id(asked: DataFrame, components: DataFrame) -> DataFrame:
    """`asked` (id, ord) with what is known of each, after its path is normalised; found says whether it exists."""
    rows = asked.withColumn("id", T.normal_id(F.col("id"))).dropDuplicates(["id"])
    return rows.join(components.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def pool(candidates: DataFrame, units: DataFrame, kept: DataFrame, most: int = 40) -> DataFrame:
    """Candidates (id, priority) that exist, the kept ones first, then by priority; `most` of them, with a line each."""
    rows = candidates.join(units.select("id", "kind", "title", "tokens"), "id").join(kept.select("id", F.lit(1).alias("_k")).distinct(), "id", "left")
    return rows.orderBy(F.coalesce("_k", F.lit(0)).desc(), F.desc("priority"), "id").limit(most).select("id", F.col("_k").isNotNull().alias("kept"), F.format_string("%s [%s] %s (%d tokens)", F.col("id").cast("string"), "kind", "title", "tokens").alias("line"))


def budget_for(complexity: Column | int, n_units: Column | int, cap: Column | int = MOST_BUDGET) -> Column:
    """Tokens to read for a question: more for harder ones and larger repositories, 60,000 and the caller's cap at the most."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    factor = F.least(F.lit(2.0), F.greatest(F.lit(0.5), 0.5 + as_col(n_units) / 2000.0))
    return F.least(F.lit(MOST_BUDGET), as_col(cap), F.floor(BUDGET * (0.5 + as_col(complexity) / 100.0) * factor)).cast("int")


def stops(rounds: DataFrame, budget: int, most: int = ROUNDS) -> DataFrame:
    """run, round and reason: where each run of `rounds` (run, round from 0: the first plan, confidence, tokens, kept, leads) ends: confident, budget, low gain (two rounds in a row below 2.0 points for a thousand new tokens), no more leads, or the last round."""
    by = Window.partitionBy("run").orderBy("round")
    more = F.greatest(F.lit(1), F.col("tokens") - F.lag("tokens").over(by))
    gain = (F.col("confidence") - F.lag("confidence").over(by)) / more * 1000.0
    low = F.coalesce(gain < GAIN, F.lit(False))
    rows = rounds.withColumn("_low", low).withColumn("_twice", F.col("_low") & F.coalesce(F.lag("_low").over(by), F.lit(False)))
    reason = F.when((F.col("confidence") >= CONFIDENT) & ((F.col("round") > 0) | (F.col("kept") > 0)), "confident").when(F.col("tokens") >= budget, "budget").when(F.col("_twice"), "low gain").when((F.col("round") > 0) & (F.col("leads") == 0), "no more leads").when(F.col("round") >= most, "rounds")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("run").agg(F.min_by(F.struct("round", "reason"), "round").alias("b")).select("run", "b.round", "b.reason")


def answer_statistics(calls: DataFrame) -> DataFrame:
    """One row over the model calls (input_tokens or prompt_tokens, output_tokens or completion_tokens, cached_tokens, cost) of an answer, and its footer."""
    c = set(calls.columns)
    of = lambda *names: F.sum(F.coalesce(*[F.col(n) for n in names if n in c], F.lit(0)))
    out = calls.agg(F.count("*").alias("calls"), of("input_tokens", "prompt_tokens").alias("input"), of("output_tokens", "completion_tokens").alias("output"), of("cached_tokens").alias("cached"), of("cost").cast("double").alias("cost"))
    return out.withColumn("footer", F.format_string("%d calls, %s in (%s cached), %s out, $%.4f", "calls", T.in_thousands(F.col("input")), T.in_thousands(F.col("cached")), T.in_thousands(F.col("output")), "cost"))


def freshness(changes: DataFrame) -> DataFrame:
    """changed, deleted and a line of a change feed (path, status)."""
    n = changes.agg(F.count(F.when(F.col("status") == "changed", 1)).alias("changed"), F.count(F.when(F.col("status") == "deleted", 1)).alias("deleted"))
    return n.withColumn("line", F.when(F.col("changed") + F.col("deleted") == 0, "up to date").otherwise(F.format_string("%d changed, %d deleted since the pages were written", "changed", "deleted")))


NAME = re.compile(r"(?<![\w.])(?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*(?:::\w+)?(?=\(|\b)")


def names_in(question: str) -> list[str]:
    """Words of a question that look like names of code: with an underscore, dots, capitals inside, or a call."""
    out = []
    for m in NAME.finditer(question):
        w, called = m[0], question[m.end() : m.end() + 1] == "("
        if called or "_" in w.strip("_") or "." in w or re.search(r"[a-z][A-Z]|^[A-Z][a-z]+[A-Z]|^[A-Z]{2,}[a-z]", w):
            out += [w, w.rsplit(".", 1)[-1]]
    return list(dict.fromkeys(out))
