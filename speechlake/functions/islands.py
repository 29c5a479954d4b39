"""Runs of equal flags in an ordered series, by ranges of the order, so that one long series is many tasks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.ranking import running_sum
from speechlake.sources.shared import written


def _met(rows: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with columns of a table of the same keys, null keys being keys like others."""
    other = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(other[f"_k{i}"])
    return rows.join(other, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def with_previous(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Add `name`: the value of the row before, per keys, in the order, a whole number; null for the first.

    A window runs in each range of `width` places; the first row of a range takes the last value of the range
    before, of which there is one row a range.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(order) / width))
    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by(value, order).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(W.partitionBy(*keys).orderBy("_bucket")))
    inside = W.partitionBy(*keys, "_bucket").orderBy(order)
    met = _met(rows.withColumns({"_own": F.lag(value).over(inside), "_first": F.lag(F.lit(1)).over(inside).isNull()}), ends, [*keys, "_bucket"], ["_carry"])
    return met.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_own"))).drop("_bucket", "_own", "_first", "_carry")


def with_runs(df: DataFrame, keys: Sequence[str], order: str, flag: str, width: int = 4096) -> DataFrame:
    """Add run (its number from 0), run_length, first_run and last_run (whether the run touches an end) per keys.

    The order, a whole number, is cut into ranges of `width` places, and runs are counted within each. What a
    range passes on is one row: its first and last flag and its number of runs. From these follow how far
    the numbers of a range are shifted and which runs go on from one range to the next, and one row a range and
    run adds up the lengths. So no window holds more of a series than a range or a row of each. Null flags change nothing.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(order) / width))
    inside = W.partitionBy(*keys, "_bucket").orderBy(order)
    changed = F.coalesce((F.col(flag) != F.lag(flag).over(inside)).cast("int"), F.lit(0))
    rows = rows.withColumn("_c", changed).withColumn("_r", F.sum("_c").over(inside.rowsBetween(W.unboundedPreceding, 0))).drop("_c")
    rows = written(rows, "runs")
    parts = rows.groupBy(*keys, "_bucket", "_r").agg(F.count(F.lit(1)).alias("_n"), F.max(flag).alias("_flag"))
    ends = parts.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_runs"), F.max_by("_flag", "_r").alias("_last"), F.min_by("_flag", "_r").alias("_head"))
    along = W.partitionBy(*keys).orderBy("_bucket")
    ends = ends.withColumn("_on", F.coalesce(F.lag("_last").over(along) == F.col("_head"), F.lag(F.lit(True)).over(along), F.lit(False)).cast("int"))
    new = F.col("_runs") - F.col("_on")
    before = F.coalesce(F.sum(new).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumns({"_shift": before - F.col("_on"), "_top": F.sum(new).over(W.partitionBy(*keys)) - 1})
    parts = _met(parts, ends, [*keys, "_bucket"], ["_shift", "_top"]).withColumn("run", F.col("_r") + F.col("_shift"))
    parts = parts.withColumn("run_length", F.sum("_n").over(W.partitionBy(*keys, "run")))
    out = _met(rows, parts, [*keys, "_bucket", "_r"], ["run", "run_length", "_top"])
    return out.withColumns({"first_run": F.col("run") == 0, "last_run": F.col("run") == F.col("_top")}).drop("_bucket", "_r", "_top")


def merged_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: Column | float, width: float = 600.0) -> DataFrame:
    """Join intervals of a series that overlap or lie at most `gap` apart: keys, start, end.

    Ranges of `width` of the starts each pass on how far their intervals reach, the largest end so far, and
    how many of them begin anew, so a long series is not one window.
    """
    rows = written(df.withColumn("_bucket", F.floor(F.col(start) / width)), "intervals")
    inside = W.partitionBy(*keys, "_bucket").orderBy(start, end)
    reach = rows.groupBy(*keys, "_bucket").agg(F.max(end).alias("_end"))
    reach = reach.withColumn("_carry", F.max("_end").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
    met = _met(rows.withColumn("_own", F.max(end).over(inside.rowsBetween(W.unboundedPreceding, -1))), reach, [*keys, "_bucket"], ["_carry"])
    new = F.coalesce((F.col(start) - F.greatest("_own", "_carry") > gap).cast("int"), F.lit(1))
    met = written(met.withColumn("_new", new).drop("_own", "_carry"), "intervals")
    # intervals that are equal both stand behind the first of them, which begins anew if any does
    out = running_sum(met, keys, F.col("_bucket"), [F.col(start), F.col(end), F.col("_new").desc()], F.col("_new"), "_before").withColumn("_run", F.col("_before") + F.col("_new"))
    return out.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
