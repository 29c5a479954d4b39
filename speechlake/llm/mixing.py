"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.ranking import running_sum
from speechlake.functions.text import words
from speechlake.sources.shared import written

#: 2**31 and the odd number nearest to 2**31 divided by the golden ratio.
CIRCLE, GOLDEN = 2147483648, 1327217885
#: The circle is looked up by cells of 2**19 points.
CELL_BITS = 19


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(idx, source, source_size, target) from rows of (source, size), one row per source.

    Sources in code-point order, null last, take the weights in turn. They share `share` times all
    sizes; a target stops at `most` times its source's size and the excess goes to the others by weight,
    which ends where target = min(most * size, level * weight): sorted by size / weight, the sources up
    to some place are full and the level follows from the rest. The windows run over sources only.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("idx", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("idx", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumns({"weight": weight, "cap": most * F.col("source_size")})
    order = W.orderBy(F.col("cap") / F.col("weight"), "idx")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    per = per.withColumn("k", F.row_number().over(order))
    per = per.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("open", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("k", "level"))).over(every))
    target = F.when(F.col("k") >= F.col("open.k"), F.col("open.level") * F.col("weight")).otherwise(F.col("cap"))
    return per.select("idx", "source", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, idx, rank): which source each slot of `block` words goes to, and its number among that source's.

    Slot i stands at the point i * GOLDEN mod 2**31 of a circle on which each source owns an arc as
    long as its target. Any run of slots holds each source within a few slots of its share.
    """
    spark = targets.sparkSession
    total, n = targets.agg(F.sum("target"), F.floor(F.sum("target") / block + F.lit(0.5))).first()
    order = W.orderBy("idx")
    high = F.floor(CIRCLE * (F.sum("target").over(order) / F.sum("target").over(W.partitionBy())))
    arcs = targets.where("target > 0").withColumn("high", F.when(F.lead("idx").over(order).isNull(), F.lit(CIRCLE)).otherwise(high))
    arcs = arcs.withColumn("low", F.lag("high", 1, 0).over(order)).where("low < high")
    arcs = arcs.select("idx", "low", "high", F.explode(F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS))).alias("cell"))
    slots = spark.range(int(n or 0)).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(CIRCLE)) * GOLDEN, F.lit(CIRCLE)).alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", CELL_BITS))
    placed = slots.join(arcs, "cell").where("point >= low and point < high").select("slot", "idx")
    return running_sum(placed, ["idx"], F.shiftright("slot", 16), [F.col("slot")], F.lit(1), "rank")


def shuffled(sized: DataFrame, doc_id: Column) -> DataFrame:
    """Add start: the words of the source's documents before this one, in the order of the ids' MD5."""
    key = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    rows = running_sum(sized.withColumn("_key", key), ["idx"], F.substring("_key", 1, 4), [F.col("_key"), doc_id, F.col("size")], F.col("size"), "start")
    return rows.drop("_key")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 64, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size is the number of words (null text: 0), taken the words that the mix takes of the document,
    repeats counted. A source's shuffled documents stand end to end and are cut into blocks of `block`
    words; its slot of rank r takes block r modulo their number, so a second pass begins when the first
    has ended, and ranks beyond `most` passes take nothing. A source's words come within a few blocks
    of its target, and no document exceeds `most` times its size. Depends on ids and sizes alone.

    Null is a source; rows of no words take nothing; repeated rows each have their own place. The sizes
    are written once. Ranks and places come from pre-aggregated buckets, so a source with a third of
    all rows is spread over all tasks; slots and blocks meet in an equi-join of at most `most` slots a block.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"))
    sized = written(slim, "sizes")
    targets = written(source_targets(sized, weights, share, float(most)), "targets")
    known = targets.select("idx", F.col("source").alias("_source"), F.ceil(F.col("source_size") / block).alias("blocks"))
    rows = sized.join(known, sized["source"].eqNullSafe(known["_source"])).drop("_source", "source")

    slots = schedule(targets.select("idx", "target"), block).join(known.select("idx", "blocks"), "idx").where(F.col("rank") < most * F.col("blocks"))
    times = slots.groupBy("idx", F.pmod("rank", "blocks").alias("block")).agg(F.count(F.lit(1)).alias("times"))

    placed = shuffled(rows.drop("blocks").where("size > 0"), F.col("doc_id"))
    end = F.col("start") + F.col("size")
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    part = F.least(end, (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    met = pieces.withColumn("part", part).join(times, ["idx", "block"], "left")
    taken = met.groupBy("doc_id", "idx", "size", "start").agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = rows.where("size = 0").select("doc_id", "idx", "size", F.lit(0).cast("long").alias("taken"))
    both = taken.select("doc_id", "idx", "size", "taken").unionByName(none)
    return both.join(targets, "idx").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix as rows of docs: each document as often as taken / size says, rounded half up, at most `most` times.

    Documents of which less than half is taken go. Rows with the same id are told apart by nothing but
    their size, so equal ids of equal size share one count. Documents of no words have no place in the mix.
    """
    counts = mix(docs, text=text, doc_id=doc_id, **options).groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size"))
    counts = counts.agg(F.floor(F.avg(F.col("taken") / F.col("size")) + 0.5).alias("_times")).where("_size > 0 and _times > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.size(words(F.col(text))).cast("long").alias("words"))
    met = rows.join(counts, rows["id"].eqNullSafe(counts["_id"]) & (rows["words"] == counts["_size"]))
    return met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select("row.*")
