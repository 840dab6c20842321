"""Budgeted selection and packing, order-dependent and greedy: groups stream through a task in order, one row at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import ship_package


def _ordered(rows: DataFrame) -> DataFrame:
    ship_package(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("tokens", F.coalesce(F.col("tokens").cast("long"), F.lit(0)))
    return rows.repartition(n, "grp").sortWithinPartitions("grp", "ord", "id")


def skip_greedy(rows: DataFrame, budget: int) -> DataFrame:
    """`rows` (grp, id, ord, tokens): what is read under the budget. The first that is too large is cut, later ones are skipped. Null tokens, and fewer than none, are none."""

    def run(frames):
        group, used = None, 0
        for frame in frames:
            out = []
            for g, t in zip(frame["grp"], frame["tokens"]):
                if g != group:
                    group, used = g, 0
                t = max(0, t)
                take = t if used + t <= budget else (budget if not used else 0)
                used += take
                out.append(take)
            yield frame.assign(taken=out)[["grp", "id", "taken"]].query("taken > 0")

    return _ordered(rows).mapInPandas(run, f"grp {rows.schema['grp'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, taken long")


def next_fit(rows: DataFrame, threshold: int) -> DataFrame:
    """`rows` (grp, id, ord, tokens) in bins: a bin closes before it would exceed the threshold."""

    def run(frames):
        group, used, bin_ = None, 0, 0
        for frame in frames:
            out = []
            for g, t in zip(frame["grp"], frame["tokens"]):
                if g != group:
                    group, used, bin_ = g, 0, 0
                elif used + t > threshold:
                    used, bin_ = 0, bin_ + 1
                used += t
                out.append(bin_)
            yield frame.assign(bin=out)[["grp", "id", "bin"]]

    return _ordered(rows).mapInPandas(run, f"grp {rows.schema['grp'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, bin long")


def water_fill(rows: DataFrame, budget: int) -> DataFrame:
    """`rows` (grp, id, tokens) with `share`: small ones whole, the others the same level, so that a group stays in the budget.

    The level follows from prefix sums in ascending order: the first row whose equal share of what is left is below its size.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    up = Window.partitionBy("grp").orderBy("tokens", "id")
    n = F.count("*").over(Window.partitionBy("grp"))
    ranked = rows.withColumn("_before", F.coalesce(F.sum("tokens").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_left", n - F.row_number().over(up) + 1)
    level = F.floor((F.lit(budget) - F.col("_before")) / F.col("_left"))
    # the level of the first row that is cut holds for all after it
    once = F.first(F.when(F.col("tokens") > F.col("_level"), F.col("_level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_level", level).withColumn("share", F.coalesce(once, F.col("tokens")).cast("long")).select("grp", "id", "tokens", "share")
