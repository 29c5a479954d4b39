"""Weighted sampling with replacement."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.functions.ranking import running_sum
from speechlake.sources.shared import written


def weighted_draws(rows: DataFrame, key: str, weight: str, draws: int, seed: str = "0") -> DataFrame:
    """(draw, key): `draws` draws with replacement, each row with a chance in proportion to its weight.

    The rows stand in the order of a hash, each over a stretch as long as its weight, and a draw is a seeded
    point on the line. The line is cut into as many cells as there are rows; a row lies in the cells of its
    stretch, a point in one, so they meet in an equi-join and a heavy row is spread over its
    cells. Running sums come from 4096 ranges of the hash. Rows of null, zero or negative weight are never drawn;
    keys tell rows apart; no weight at all, no draws. Depends on seed, keys and weights alone.
    """
    digest = lambda c: F.sha2(F.concat_ws("|", F.lit(seed), c), 256)
    own = rows.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("_w"), digest(F.col(key)).alias("_h"))
    placed = written(running_sum(own, [], F.substring("_h", 1, 3), [F.col("_h")], F.col("_w"), "_low"), "weights")
    total, n = placed.agg(F.sum("_w"), F.count(F.lit(1))).first()
    cell = lambda x: F.floor(x / F.lit((total or 1.0) / max(n, 1)))
    high = F.col("_low") + F.col("_w")
    spread = placed.select(key, F.col("_low").cast("double").alias("_low"), high.alias("_high"), F.explode(F.sequence(cell(F.col("_low")), cell(high))).alias("_cell"))
    uniform = F.conv(F.substring(digest(F.col("draw")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    points = rows.sparkSession.range(draws if total else 0).select(F.col("id").alias("draw")).withColumn("_u", uniform * F.lit(total or 0.0))
    met = points.withColumn("_cell", cell(F.col("_u"))).join(spread, "_cell")
    return met.where("_u >= _low and _u < _high").select("draw", key)
