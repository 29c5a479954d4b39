"""Running sums of a long order by pre-aggregation, range buckets and a window in each bucket."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.ranking import range_bucket, range_cuts
from speechlake.sources.shared import written


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], descending: bool = True, buckets: int | None = None, width: int = 10_000) -> DataFrame:
    """(keys, order, values, cum_<value>...): a row per key and distinct order value, with inclusive running sums.

    Rows of one order value are added up first, so ties never split. The order's range is cut by
    approximate quantiles into buckets of about `width` rows (4096 buckets at most, unless given); a window
    runs in each for all values at once, and the sums of earlier buckets are added, so no task sees the
    whole order even where there is one key. Null order values are dropped.
    """
    sums = df.where(F.col(order).isNotNull()).groupBy(*keys, order).agg(*[F.sum(v).alias(v) for v in values])
    sums = written(sums, "prefix")
    place = F.col(order).cast("double")
    cuts = range_cuts(sums, place, buckets or min(4096, -(-sums.count() // width)))
    rows = sums.withColumn("_bucket", range_bucket(place, cuts))
    by = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    per = rows.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(v) for v in values])
    before = W.partitionBy(*keys).orderBy(by("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    starts = per.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_start{i}") for i, v in enumerate(values)],
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(by(order)).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({f"_inside{i}": F.sum(v).over(inside) for i, v in enumerate(values)})
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    cums = [(F.col(f"_start{i}") + F.col(f"_inside{i}")).alias(f"cum_{v}") for i, v in enumerate(values)]
    return out.join(starts, same).select(*keys, order, *values, *cums)
