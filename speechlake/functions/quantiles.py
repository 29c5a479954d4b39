"""Exact quantiles of any number of rows, without a group in one buffer."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.functions.prefix import prefix_sums
from speechlake.sources.shared import written


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], name: str = "q") -> DataFrame:
    """(keys, name): the quantiles of value per keys as an array, interpolated between the two rows that bracket each rank.

    Rows of one value are counted first and their running counts come from ranges of the values (see
    prefix_sums), so a key that holds all rows is spread as well; then one aggregation picks the rows of all ranks
    of all keys. The quantiles are those of percentile(). Null values count for nothing; a key without
    values gives no row.
    """
    counts = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1).cast("long").alias("_n"))
    sums = written(prefix_sums(counts, keys, "_v", ["_n"], descending=False), "counts")
    totals = sums.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("cum__n").alias("_all"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = sums.join(totals, same)
    place = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    low = [F.min(F.when(F.col("cum__n") > F.floor(place(p)), F.col("_v"))).alias(f"_l{i}") for i, p in enumerate(at)]
    high = [F.min(F.when(F.col("cum__n") > F.ceil(place(p)), F.col("_v"))).alias(f"_h{i}") for i, p in enumerate(at)]
    picked = rows.groupBy(*keys, "_all").agg(*low, *high)
    part = [place(p) - F.floor(place(p)) for p in at]
    between = [F.when(x == 0, F.col(f"_l{i}")).otherwise((1 - x) * F.col(f"_l{i}") + x * F.col(f"_h{i}")) for i, x in enumerate(part)]
    return picked.select(*keys, F.array(*between).alias(name))
