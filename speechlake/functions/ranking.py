"""Ranks and running sums over long orders, without putting an order into one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def range_cuts(df: DataFrame, column: Column, buckets: int) -> list:
    """At most buckets - 1 distinct values, ascending, that cut the column into ranges of about as many rows each."""
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.agg(F.percentile_approx(column, at, max(10_000, 10 * buckets))).first()[0] or []))


def range_bucket(value: Column, cuts: Sequence) -> Column:
    """How many of the ascending cuts are below value, by a search in two steps; so equal values share a bucket."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    groups = [list(cuts[i : i + step]) for i in range(0, len(cuts), step)]
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < value))
    group = below(F.lit([g[-1] for g in groups]))
    inside = F.get(F.array(*[F.lit(g) for g in groups]), group)
    return F.when(group < len(groups), group * step + below(inside)).otherwise(len(cuts))


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of value over the rows before this one, per keys, in the order given.

    bucket must be monotone in the order (equal rows in one bucket) and cut each key's rows into
    pieces that fit a task. A window runs inside (keys, bucket); the sums of the earlier buckets come
    from one pre-aggregated row per bucket, so a key that holds a third of all rows is spread out.
    Null keys form a group of their own.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out.join(starts, same).withColumn(name, F.col("_start") + F.col("_inside")).select(*df.columns, name)
