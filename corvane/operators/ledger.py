"""What work cost and how far it is: usage, prices, summaries, progress, schedules, jobs, budgets of messages.

usage: phase, kind, target, model, asked_model, provider, seconds, input_tokens, output_tokens, cache_read, cache_write, cost, cost_source.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import ship_package

#: Names that providers give the same number.
ALIASES = {"input_tokens": ("input_tokens", "prompt_tokens", "promptTokens", "input"), "output_tokens": ("output_tokens", "completion_tokens", "completionTokens", "output"), "cache_read": ("cache_read", "cache_read_input_tokens", "cached_tokens"), "cache_write": ("cache_write", "cache_creation_input_tokens"), "cost": ("cost", "total_cost", "cost_usd")}
#: Shares of a whole run by stage.
STAGES = {"analyse": 0.1, "cluster": 0.1, "write": 0.7, "link": 0.1}


def normalised(calls: DataFrame, json_column: str = "usage") -> DataFrame:
    """`calls` with the numbers of their usage (JSON in any of its spellings, nested or not) as columns; null where none was reported."""
    out = calls
    for name, spellings in ALIASES.items():
        paths = [f"$.{s}" for s in spellings] + [f"$.{outer}.{s}" for outer in ("usage", "prompt_tokens_details", "input_tokens_details") for s in spellings]
        value = F.coalesce(*[F.get_json_object(json_column, p) for p in paths])
        out = out.withColumn(name, value.cast("double") if name == "cost" else value.cast("long"))
    return out.withColumn("reported", F.coalesce(*ALIASES).isNotNull())


def phased(calls: DataFrame) -> DataFrame:
    """`calls` (run, ord, task_phase, run_phase) with phase: the task's, else the last one told in the run, else the run's."""
    so_far = Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("phase", F.coalesce("task_phase", F.last("task_phase", True).over(so_far), "run_phase"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """`usage` with cost and cost_source: what was reported; else by the rates (dollars a million tokens) of the model or else of the one that was asked for. Cached tokens go by their own rates or else by that of input; without rates or tokens, or where more is cached than went in, it is unknown."""
    rates = prices.select("provider", "model", *[F.col(c).cast("decimal(18,6)") for c in ("input", "output")], F.col("cache_read").cast("decimal(18,6)").alias("r_read"), F.col("cache_write").cast("decimal(18,6)").alias("r_write"))
    as_ = lambda p: rates.select("provider", F.col("model").alias("model" if p == "m" else "asked_model"), F.struct("input", "output", F.coalesce("r_read", "input").alias("read"), F.coalesce("r_write", "input").alias("write")).alias(f"_{p}"))
    rows = usage.join(as_("m"), ["provider", "model"], "left").join(as_("a"), ["provider", "asked_model"], "left").withColumn("_r", F.coalesce("_m", "_a"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,0)")
    plain = n("input_tokens") - n("cache_read") - n("cache_write")
    by_rate = ((plain * F.col("_r.input") + n("cache_read") * F.col("_r.read") + n("cache_write") * F.col("_r.write") + n("output_tokens") * F.col("_r.output")).cast("decimal(38,12)") / F.lit(1_000_000)).cast("double")
    known = F.col("_r").isNotNull() & F.coalesce("input_tokens", "output_tokens").isNotNull() & (plain >= 0)
    has = F.col("cost").isNotNull()
    return rows.withColumn("cost_source", F.when(has, F.coalesce("cost_source", F.lit("provider"))).when(known, "configured").otherwise("unknown")).withColumn("cost", F.when(has, F.col("cost")).when(known, by_rate)).drop("_m", "_a", "_r")


def is_priced() -> Column:
    """A call whose cost is known: not zero, or said to be, or of a call without tokens."""
    free = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) == 0
    return F.col("cost").isNotNull() & ((F.col("cost") != 0) | F.coalesce(F.col("cost_source").isin("configured", "provider"), F.lit(False)) | free)


def summary(usage: DataFrame) -> DataFrame:
    """level (all, phase, model), name, calls, tokens, seconds, cost, priced, and status: complete, partial or unknown; one pass over the usage."""
    rows = usage.withColumn("_p", is_priced().cast("int"))
    out = rows.groupingSets([[], [F.col("phase")], [F.col("model")]], "phase", "model").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("seconds"), 6).alias("seconds"), F.round(F.sum("cost"), 9).alias("cost"), F.sum("_p").alias("priced"), F.array_sort(F.collect_set(F.when(F.col("_p") == 0, F.col("model")))).alias("unpriced_models"),
    )
    status = F.when(F.col("priced") == F.col("calls"), "complete").when(F.col("priced") > 0, "partial").otherwise("unknown")
    return out.select(F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "phase").otherwise("model").alias("level"), F.coalesce("phase", "model").alias("name"), "calls", "input_tokens", "output_tokens", "seconds", "cost", "priced", status.alias("status"), "unpriced_models")


def running_totals(usage: DataFrame) -> DataFrame:
    """`usage` (run, ord and numbers) with what a run has used so far."""
    so_far = Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return usage.withColumn("total_input", F.sum(F.coalesce("input_tokens", F.lit(0))).over(so_far)).withColumn("total_output", F.sum(F.coalesce("output_tokens", F.lit(0))).over(so_far))


def left(timings: DataFrame, runs: DataFrame) -> DataFrame:
    """run and eta of `runs` (run, total, done, failed, elapsed, concurrency, paused): what is left at the pace of all, or, with fewer timings (run, seconds) than slots, by their mean; timings under two seconds were cached and say nothing."""
    t = timings.filter("seconds >= 2").groupBy("run").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"))
    rest = F.greatest(F.lit(0), F.col("total") - F.col("done") - F.col("failed"))
    eta = F.when(rest == 0, 0.0).when(F.col("n") >= F.col("concurrency"), rest * F.col("elapsed") / F.col("n")).otherwise(rest * F.col("mean") / F.least(F.col("concurrency"), rest))
    return runs.join(t, "run", "left").select("run", F.when(F.col("n").isNotNull(), F.round(eta + F.coalesce("paused", F.lit(0)), 6)).alias("eta"))


def slowest(timings: DataFrame, k: int = 3) -> DataFrame:
    """target and seconds of the k that took longest."""
    return timings.groupBy("target").agg(F.sum("seconds").alias("seconds")).orderBy(F.desc("seconds"), "target").limit(k)


def overall(stages: DataFrame) -> DataFrame:
    """run and share: how much of a whole run is done; stages (run, stage, done: 0 to 1)."""
    weight = F.element_at(F.create_map(*[x for k, v in STAGES.items() for x in (F.lit(k), F.lit(v))]), F.col("stage"))
    return stages.groupBy("run").agg(F.round(F.sum(F.coalesce(weight, F.lit(0.0)) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("done")))), 6).alias("share"))


def status_line(progress: DataFrame) -> DataFrame:
    """run and line of `progress` (run, total, done, failed, eta: seconds or null)."""
    from corvane.functions.text import duration

    line = F.concat(F.format_string("%d/%d done", "done", "total"), F.when(F.col("failed") > 0, F.format_string(", %d failed", "failed")).otherwise(""), F.when(F.col("eta").isNotNull(), F.concat(F.lit(", about "), duration(F.col("eta")), F.lit(" left"))).otherwise(""))
    return progress.select("run", line.alias("line"))


# ---- schedules


def makespans(jobs: DataFrame, concurrency: list[int]) -> DataFrame:
    """run, slots, makespan, serial and critical of `jobs` (run, id, parent, seconds, ord): each takes the first free slot once its children are done, in order. The critical path is the longest chain of a job and what it waits for. One run is replayed at a time."""
    ship_package(jobs.sparkSession)

    def replay(rows, slots):
        children, parent, ids = {}, {}, {x[0] for x in rows}
        for r in rows:
            parent[r[0]] = r[1] if r[1] in ids else None
            children.setdefault(parent[r[0]], []).append(r[0])
        cost, place = {r[0]: float(r[2]) for r in rows}, {r[0]: i for i, r in enumerate(rows)}
        waits = {j: len(children.get(j, ())) for j in cost}
        ready = [(place[j], j) for j in cost if not waits[j]]
        heapq.heapify(ready)
        running, now, done = [], 0.0, 0
        while ready or running:
            while ready and len(running) < slots:
                _, j = heapq.heappop(ready)
                heapq.heappush(running, (now + cost[j], place[j], j))
            now, _, j = heapq.heappop(running)
            done += 1
            if (p := parent[j]) is not None:
                waits[p] -= 1
                if not waits[p]:
                    heapq.heappush(ready, (place[p], p))
        return now if done == len(cost) else float("nan")

    def chain(rows):
        cost, children, ids = {r[0]: float(r[2]) for r in rows}, {}, {r[0] for r in rows}
        for r in rows:
            children.setdefault(r[1] if r[1] in ids else None, []).append(r[0])
        best, order, todo = {}, [], list(children.get(None, ()))
        while todo:
            order.append(j := todo.pop())
            todo += children.get(j, ())
        for j in reversed(order):
            best[j] = cost[j] + max((best[c] for c in children.get(j, ())), default=0.0)
        return max(best.values(), default=0.0)

    def run(batches):
        import pyarrow as pa

        def told(of, rows):
            return [(of, k, replay(rows, k), float(sum(r[2] for r in rows)), chain(rows)) for k in concurrency]

        of, rows, out, schema = None, [], [], None
        for batch in batches:
            schema = schema or pa.schema([("run", batch.schema.field("run").type), ("slots", pa.int32()), ("makespan", pa.float64()), ("serial", pa.float64()), ("critical", pa.float64())])
            for key, *row in zip(*[batch.column(c).to_pylist() for c in ("run", "id", "parent", "seconds")]):
                if rows and key != of:
                    out += told(of, rows)
                    rows = []
                of = key
                rows.append((row[0], row[1], float("nan") if row[2] is None else row[2]))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)
            out = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*told(of, rows)), schema)], schema=schema)

    # runs lie one after the other in a part, so that many small ones cost no more than their jobs
    kind = jobs.schema["run"].dataType.simpleString()
    ordered = jobs.select("run", "id", "parent", "seconds", "ord").repartition("run").sortWithinPartitions("run", F.asc_nulls_last("ord"), F.asc_nulls_last("id"))
    return ordered.mapInArrow(run, f"run {kind}, slots int, makespan double, serial double, critical double")


def slots_held(events: DataFrame, slots: int) -> DataFrame:
    """`events` (run, ord, kind) with held, the slots in use after each, and over, how many of them are more than there are. A job takes one (hold), gives it back
    (release), or lends it while its children run (lend) and takes it again (resume); other kinds change nothing. A run has at least one slot."""
    step = F.when(F.col("kind").isin("hold", "resume"), 1).when(F.col("kind").isin("release", "lend"), -1).otherwise(0)
    held = F.sum(step).over(Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("held", held).withColumn("over", F.greatest(F.lit(0), F.col("held") - max(1, slots)))


def log_statistics(lines: DataFrame) -> DataFrame:
    """run, errors, retries, turns (mean of those told) and lines of a benchmark's log (run, line)."""
    turn = F.regexp_extract("line", r"(?i)\bturns?[=: ]+(\d+)", 1)
    return lines.groupBy("run").agg(F.count("*").alias("lines"), F.count(F.when(F.col("line").rlike(r"(?i)\b(error|traceback|failed)\b"), 1)).alias("errors"), F.count(F.when(F.col("line").rlike(r"(?i)\bretry"), 1)).alias("retries"), F.avg(F.when(turn != "", turn.cast("double"))).alias("turns"))


# ---- jobs


def intake(asked: DataFrame, jobs: DataFrame, cache: DataFrame, now: Column, minutes: int = 3) -> DataFrame:
    """`asked` (key) with action: what is running is joined, what failed within `minutes` has to wait, what is cached is done, the rest is queued. jobs (key, job_id, status, at), cache (key)."""
    last = jobs.groupBy("key").agg(F.max_by(F.struct("job_id", "status", "at"), F.struct("at", "job_id")).alias("j"))
    rows = asked.select("key").distinct().join(last, "key", "left").join(cache.select("key", F.lit(1).alias("_c")).distinct(), "key", "left")
    status = F.col("j.status")
    action = F.when(status.isin("queued", "processing"), "join").when((status == "failed") & (F.col("j.at") > now - F.expr(f"INTERVAL {minutes} MINUTES")), "wait").when(F.col("_c").isNotNull(), "done").otherwise("queue")
    return rows.select("key", action.alias("action"), F.when(action.isin("join", "wait"), F.col("j.job_id")).alias("job_id"))


def recent(jobs: DataFrame, most: int = 100) -> DataFrame:
    return jobs.orderBy(F.desc("at"), "job_id").limit(most)


def purged(jobs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Jobs without finished ones that are older than `days`."""
    return jobs.filter(~(F.col("status").isin("completed", "failed") & (F.col("at") < now - F.expr(f"INTERVAL {days} DAYS"))))


def queue(jobs: DataFrame, room: int = 100) -> DataFrame:
    """job_id, place and accepted of waiting jobs in the order they came; beyond `room` none is taken."""
    waiting = jobs.filter("status = 'queued'")
    first = waiting.orderBy("at", "job_id").limit(room).select("job_id", F.lit(True).alias("accepted"))
    nth = F.row_number().over(Window.orderBy("_at", "job_id"))  # of `room` rows
    placed = first.join(waiting.select("job_id", F.col("at").alias("_at")), "job_id").withColumn("place", nth).select("job_id", "place", "accepted")
    return placed.unionByName(waiting.join(first, "job_id", "left_anti").select("job_id", F.lit(None).cast("int").alias("place"), F.lit(False).alias("accepted")))


def activity(tools: DataFrame) -> DataFrame:
    """run, tools (name and number, most used first) and the last three rejections of an agent's calls (run, ord, tool, rejected)."""
    n = tools.groupBy("run", "tool").agg(F.count("*").alias("n")).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tool"))), lambda x: F.concat(x["tool"], F.lit(" "), (-x["n"]).cast("string"))).alias("tools"))
    no = tools.filter("rejected IS NOT NULL").groupBy("run").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rejected"))), lambda x: x["rejected"]), -F.least(F.lit(3), F.count("*")).cast("int"), 3).alias("rejections"))
    return n.join(no, "run", "left")


# ---- budgets of messages

LIMIT_PATTERNS = (r"(?i)maximum context length(?: is| of)?:? (\d[\d,]*)", r"(?i)prompt is too long: \d[\d,]* tokens > (\d[\d,]*)", r"(?i)exceeds? (?:the )?(?:limit|maximum)(?: of)? (\d[\d,]*)", r"(?i)context window (?:of|is) (\d[\d,]*)")
USED_PATTERNS = (r"(?i)prompt is too long: (\d[\d,]*) tokens", r"(?i)resulted in (\d[\d,]*) tokens", r"(?i)requested (\d[\d,]*) tokens")


def learned_limits(errors: DataFrame) -> DataFrame:
    """model, limit (the least told) and ratio (the largest of told to estimated tokens) of error texts (model, text, estimated)."""
    number = lambda ps: F.coalesce(*[F.when(F.regexp_extract("text", p, 1) != "", F.replace(F.regexp_extract("text", p, 1), F.lit(","), F.lit("")).cast("long")) for p in ps])
    return errors.withColumn("_l", number(LIMIT_PATTERNS)).withColumn("_u", number(USED_PATTERNS)).groupBy("model").agg(F.min("_l").alias("limit"), F.max(F.col("_u") / F.col("estimated")).alias("ratio"))


def trimmed(messages: DataFrame, budget: int, keep_last: int = 2) -> DataFrame:
    """`messages` (run, ord, role, text) that fit a budget of tokens: the oldest tool results give way to a mark first, then the largest texts are cut in their middle; the last ones stay whole as long as they can."""
    ship_package(messages.sparkSession)

    def run(frame):
        frame = frame.sort_values("ord").reset_index(drop=True)
        texts = [t or "" for t in frame["text"]]
        size = lambda t: int(len(t) / 3.6) + 1 + 8
        mark = "[older result left out]"
        total = sum(map(size, texts))
        for i, role in enumerate(frame["role"][: max(0, len(texts) - keep_last)]):
            if total <= budget:
                break
            if role == "tool" and size(texts[i]) > size(mark):
                total += size(mark) - size(texts[i])
                texts[i] = mark
        while total > budget:
            i = max(range(len(texts)), key=lambda k: len(texts[k]))
            if len(texts[i]) < 80:
                break
            before, half = size(texts[i]), max(20, min(len(texts[i]) // 4, (len(texts[i]) - int((total - budget) * 3.6) - 20) // 2))
            texts[i] = texts[i][:half] + "\n[...]\n" + texts[i][-half:]
            if size(texts[i]) >= before:
                break
            total += size(texts[i]) - before
        return frame.assign(text=texts)[["run", "ord", "role", "text"]]

    s = messages.schema
    return messages.select("run", "ord", "role", "text").groupBy("run").applyInPandas(run, ", ".join(f"{c} {s[c].dataType.simpleString()}" for c in ("run", "ord", "role", "text")))


def condensed(pages: DataFrame, budget: int) -> DataFrame:
    """`pages` (grp, id, text) within a budget of tokens for each group: small ones whole, of the others their outline, cut to their fair share."""
    from corvane.functions.text import approx_tokens
    from corvane.operators.packing import water_fill
    from corvane.operators.pages import outline_of

    ship_package(pages.sparkSession)
    rows = pages.withColumn("tokens", approx_tokens(F.length("text")))
    shares = water_fill(rows.select("grp", "id", "tokens"), budget).select("grp", "id", "share")
    both = rows.join(shares, ["grp", "id"])

    def run(frames):
        for frame in frames:
            out = [t if n <= s else (outline_of(t) or t)[: int(s * 3.6)] for t, n, s in zip(frame["text"], frame["tokens"], frame["share"])]
            yield frame.assign(text=out)[["grp", "id", "text"]]

    s = pages.schema
    return both.select("grp", "id", "text", "tokens", "share").mapInPandas(run, f"grp {s['grp'].dataType.simpleString()}, id {s['id'].dataType.simpleString()}, text string")


def limit_in(text: str) -> int | None:
    """The limit that an error text tells."""
    return next((int(m[1].replace(",", "")) for p in LIMIT_PATTERNS if (m := re.search(p, text))), None)
