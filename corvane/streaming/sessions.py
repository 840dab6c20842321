"""Streams over events: inactivity sessions, latest states, throttled notices, pauses, snapshot refresh by micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import shared_dir, ship_package


def inactivity_sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a user that end after `gap` without an event, as a stream or a batch; events later than `late` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), "n")


def latest_state(events: DataFrame) -> DataFrame:
    """The last state of each key: a running aggregate, in update mode."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


def refresh(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch goes through an incremental pipeline."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet file or folder at `path` as a stream."""
    schema = spark.read.parquet(path).schema
    folder, file = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def into_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives when it has read what is there. Each micro-batch is written where executors share, none is held by the driver: in mode complete the last one counts, in update or append mode all."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/out/batch={i}")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    return rows.drop("batch") if mode != "complete" else rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def run_to_end(spark: SparkSession, path: str) -> DataFrame:
    """All sessions of the events at `path`, by a stream that reads what is there and ends."""
    found = into_table(inactivity_sessions(read_stream(spark, path)))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("began")).cast("long")
    return found.select("user_id", nth.alias("session"), "n")


def throttled(events: DataFrame, every: int = 60) -> DataFrame:
    """`events` (key, id, ts: seconds) that are told: the first of a key, then the first that comes `every` seconds or more after the last
    one told, with `n`, the events of the key so far. Keys stream through a task in order, one row at a time."""
    ship_package(events.sparkSession)
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        key, told, count = None, 0, 0
        for frame in frames:
            keep, counts = [], []
            for k, t in zip(frame["key"], frame["ts"]):
                if k != key:
                    key, told, count = k, None, 0
                count += 1
                counts.append(count)
                keep.append(told is None or t - told >= every)
                told = t if keep[-1] else told
            yield frame.assign(n=counts)[keep]

    kind = events.schema
    return events.select("key", "id", "ts").repartition(n, "key").sortWithinPartitions("key", "ts", "id").mapInPandas(run, f"key {kind['key'].dataType.simpleString()}, id {kind['id'].dataType.simpleString()}, ts {kind['ts'].dataType.simpleString()}, n long")


def throttled_stream(events: DataFrame, every: int = 60, late: str = "1 day") -> DataFrame:
    """The same over a stream of `events` (key, ts: timestamp): state is the time of the last notice and the count; it goes when the watermark, `late` behind, has left a key's last event an hour behind."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    ship_package(events.sparkSession)

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        told, count = state.get if state.exists else (None, 0)
        out = []
        for t in sorted(t for frame in frames for t in frame["ts"]):
            count += 1
            if told is None or t.timestamp() - told >= every:
                told = t.timestamp()
                out.append((key[0], t, count))
        state.update((told, count))
        state.setTimeoutTimestamp(max(int(told + 3600) * 1000, state.getCurrentWatermarkMs() + 3_600_000))
        yield pd.DataFrame(out, columns=["key", "ts", "n"])

    kind = events.schema["key"].dataType.simpleString()
    timed = events.select("key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(run, f"key {kind}, ts timestamp, n long", "told double, n long", "update", GroupStateTimeout.EventTimeTimeout)


def paused_until(events: DataFrame) -> DataFrame:
    """`events` (key, id, ts, until: seconds, null for no pause) with `paused`: the latest end of a pause told so far, and `wait`, what is left of it."""
    so_far = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("paused", F.max("until").over(so_far)).withColumn("wait", F.greatest(F.lit(0), F.coalesce(F.col("paused") - F.col("ts"), F.lit(0))))


def progress(events: DataFrame, cached: float = 2.0) -> DataFrame:
    """`events` (run, target, kind: added, running, done or failed; seconds) as counts of a run: work that took less than `cached` seconds was cached and is in no timing."""
    one = lambda c: F.count(F.when(c, 1))
    done = F.col("kind") == "done"
    return events.groupBy("run").agg(
        one(F.col("kind") == "added").alias("total"), one(F.col("kind") == "running").alias("started"), one(done).alias("done"), one(F.col("kind") == "failed").alias("failed"),
        one(done & (F.col("seconds") < cached)).alias("cached"), one(done & (F.col("seconds") >= cached)).alias("timed"),
        F.round(F.sum(F.when(done & (F.col("seconds") >= cached), F.col("seconds")).otherwise(0.0)), 6).alias("seconds"),
    )


def answer_lines(events: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """`events` (ask, n, type and what they carry) of answers as ask, n and line, a JSON object each. An answer ends before its first event
    of type end. Of `stops` (ask, n: the last event the reader took), the least n of an ask ends its answer after that event."""
    ends = events.filter(F.col("type") == "end").groupBy("ask").agg(F.min("n").alias("_end"))
    lines = events.select("ask", "n", F.to_json(F.struct(*[c for c in events.columns if c not in ("ask", "n")])).alias("line"))
    sent = lines.join(ends, "ask", "left").filter(F.col("_end").isNull() | (F.col("n") < F.col("_end")))
    if stops is not None:
        sent = sent.join(stops.groupBy("ask").agg(F.min("n").alias("_stop")), "ask", "left").filter(F.col("_stop").isNull() | (F.col("n") <= F.col("_stop")))
    return sent.select("ask", "n", "line")
