"""Group-disjoint split assignment."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.functions.components import connected_components
from speechlake.functions.ranking import range_bucket, range_cuts, running_sum
from speechlake.functions.records import known, partition_key
from speechlake.sources.shared import written


def components(records: DataFrame, axes: Sequence[str] = ("channel",)) -> DataFrame:
    """(sample_id, component): records connected by their partition key or by a value of a required axis.

    Values carry their axis, so equal values of two axes do not meet. Nodes are values, records are
    edges between their values; a component is named after its smallest value.
    """
    keys = F.array_compact(F.array(partition_key(F.col("speaker"), F.col("parent_id")), *[F.concat(F.lit(f"{a}:"), known(F.col(a))) for a in axes]))
    rows = records.select("sample_id", keys.alias("k")).withColumn("first", F.col("k")[0])
    edges = rows.select("first", F.explode("k").alias("other")).where("first <> other").distinct()
    found = connected_components(edges, "first", "other")
    return rows.join(found, rows["first"] == found["node"], "left").select("sample_id", F.coalesce("component", "first").alias("component"))


def group_sizes(grouped: DataFrame, holdouts: dict[str, Sequence[str]] | None = None, labels: bool = False) -> DataFrame:
    """(grp, size, pinned[, classes]): one row per group; pinned where any row has a held-out value, which takes the whole group to test.

    classes holds the group's labels, of which there are few, with their numbers of rows.
    """
    pin = F.lit(False)
    for column, values in (holdouts or {}).items():
        pin = pin | F.coalesce(F.col(column).isin(*values), F.lit(False))
    if not labels:
        return grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.bool_or(pin).alias("pinned"))
    per = grouped.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"), F.bool_or(pin).alias("pinned"))
    return per.groupBy("grp").agg(F.sum("n").alias("size"), F.bool_or("pinned").alias("pinned"), F.sort_array(F.collect_list(F.struct("label", "n"))).alias("classes"))


def capacity_fill(groups: DataFrame, order: str, train: float = 0.7, dev: float = 0.15, total: int | None = None) -> DataFrame:
    """(grp, split): groups in an order fill train until it is full, then dev, then test; pinned groups go to test.

    A group goes to train if the groups before it leave room there, and likewise for dev among the rest.
    Capacities are rounded half to even. Both passes are running sums over ranges of the order, a string;
    quantiles of its first bytes cut it into ranges of about 10,000 groups, 4096 ranges at most.
    """
    groups = written(groups, "groups")
    n = total if total is not None else groups.agg(F.sum("size")).first()[0] or 0
    room = groups.sparkSession.range(1).select(F.bround(F.lit(n * train)).alias("t"), F.bround(F.lit(n * dev)).alias("d")).first()
    bucket = _heads(groups, order)
    first = running_sum(groups.where(~F.col("pinned")), [], bucket, [F.col(order), F.col("grp")], F.col("size"), "before")
    rest = running_sum(first.where(F.col("before") >= room["t"]), [], bucket, [F.col(order), F.col("grp")], F.col("size"), "before_dev")
    out = first.where(F.col("before") < room["t"]).select("grp", F.lit("train").alias("split"))
    out = out.unionByName(rest.select("grp", F.when(F.col("before_dev") < room["d"], "dev").otherwise("test").alias("split")))
    return out.unionByName(groups.where("pinned").select("grp", F.lit("test").alias("split")))


def _heads(groups: DataFrame, order: str) -> Column:
    """The range of a group's place in an order, a string: quantiles of its first bytes cut ranges of about 10,000 groups, 4096 at most."""
    head = F.conv(F.rpad(F.hex(F.substring(order, 1, 7)), 14, "0"), 16, 10).cast("long")
    return range_bucket(head, range_cuts(groups, head, min(4096, -(-groups.count() // 10_000))))


def _shares(owed: dict[str, Column], size: Column) -> tuple[Column, Column]:
    """How far train and how far dev reach when `size` rows go, bit by bit, to the split that is owed most.

    That leaves all splits that get any owed the same, the level; the largest of what the first, the first two
    and all three splits would be left with, by what they are owed.
    """
    falling = F.sort_array(F.array(*owed.values()), asc=False)
    upto = lambda k: F.aggregate(F.slice(falling, 1, k), F.lit(0.0), lambda s, x: s + x)
    level = F.greatest(*[(upto(k) - size) / k for k in (1, 2, 3)])
    share = {s: F.greatest(d - level, F.lit(0.0)) for s, d in owed.items()}
    return F.round(share["train"], 6), F.round(share["train"] + share["dev"], 6)


def _dealt(groups: DataFrame, keys: Sequence[str], bounds: DataFrame, order: str) -> DataFrame:
    """Groups in an order with split: those that begin before `train_end` go to train, before `dev_end` to dev, the others to test."""
    rows = running_sum(groups, keys, _heads(groups, order), [F.col(order), F.col("grp")], F.col("size"), "before")
    rows = rows.join(bounds, list(keys)) if keys else rows.join(F.broadcast(bounds))  # then bounds is one row
    return rows.withColumn("split", F.when(F.col("before") < F.col("train_end"), "train").when(F.col("before") < F.col("dev_end"), "dev").otherwise("test"))


def stratified_fill(groups: DataFrame, order: str, train: float = 0.7, dev: float = 0.15) -> DataFrame:
    """(grp, split): whole groups, so that each split gets its share of each label; pinned groups go to test.

    groups: grp, size, pinned, classes (see group_sizes) and an order. Of each label a split is owed its share of
    all rows that are not pinned. Groups of one label go to the splits as these are owed most, one label at
    a time, and then groups of several labels by what all their labels are still owed. Where groups are placed
    one by one, each to the split that is owed most, all splits end owed about the same; so that level is computed, and the
    groups fill the splits' shares in their order by running sums. A split's rows of a label
    differ from those of the one by one placement by no more than a few groups.
    """
    groups = written(groups, "strata")
    free = groups.where("not pinned")
    ratios = {"train": train, "dev": dev, "test": 1 - train - dev}
    totals = free.select(F.explode("classes").alias("c")).groupBy(F.col("c.label").alias("label")).agg(F.sum("c.n").alias("all"))
    single = written(free.where("size(classes) = 1").select("grp", "size", order, F.col("classes")[0]["label"].alias("label")), "single")
    sizes = single.groupBy("label").agg(F.sum("size").alias("size"))
    quota = totals.join(sizes, "label", "left").select("label", "all", F.coalesce("size", F.lit(0)).alias("size"))
    train_end, dev_end = _shares({s: F.col("all") * r for s, r in ratios.items()}, F.col("size"))
    one = written(_dealt(single, ["label"], quota.select("label", train_end.alias("train_end"), dev_end.alias("dev_end")), order), "placed")
    placed = one.groupBy("label").pivot("split", ["train", "dev", "test"]).agg(F.sum("size"))
    owed = totals.join(placed, "label", "left").agg(*[F.coalesce(F.sum(F.greatest(F.col("all") * r - F.coalesce(F.col(s), F.lit(0)), F.lit(0.0))), F.lit(0.0)).alias(s) for s, r in ratios.items()])
    several = written(free.where("size(classes) > 1").select("grp", "size", order), "several")
    rest = owed.join(F.broadcast(several.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))))  # a row each
    train_end, dev_end = _shares({s: F.col(s) for s in ratios}, F.col("size"))
    two = _dealt(several, [], rest.select(train_end.alias("train_end"), dev_end.alias("dev_end")), order)
    return one.select("grp", "split").unionByName(two.select("grp", "split")).unionByName(groups.where("pinned").select("grp", F.lit("test").alias("split")))


def split_problems(assigned: DataFrame, min_train_groups: int = 2) -> DataFrame:
    """(rule, broken) of an assignment (grp, split): two groups at least, no empty split, enough groups in train."""
    counts = assigned.agg(F.countDistinct("grp").alias("g"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "dev", "test")])
    rules = {"two_groups": F.col("g") < 2, "empty_split": (F.col("train") == 0) | (F.col("dev") == 0) | (F.col("test") == 0), "train_groups": F.col("train") < min_train_groups}
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("broken")) for k, v in rules.items()])
    return counts.select(F.explode(pairs).alias("r")).select("r.*")


def temporal_order(records: DataFrame, group: str, recorded_at: str, min_coverage: float = 0.5) -> DataFrame:
    """(grp, size, key): groups by their first date, undated ones last; by hash where too few rows are dated."""
    dated = records.agg((F.count(recorded_at) / F.count(F.lit(1))).alias("coverage"))
    per = records.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("size"), F.min(recorded_at).alias("first_at"))
    stamp = F.coalesce(F.date_format("first_at", "yyyyMMddHHmmss"), F.lit("~"))
    # one row: an aggregate without keys
    return per.join(F.broadcast(dated)).select("grp", "size", F.when(F.col("coverage") >= min_coverage, stamp).otherwise(F.sha2(F.col("grp").cast("string"), 256)).alias("key"))


def evaluation_views(samples: DataFrame, holdouts: dict[str, Sequence[str]]) -> DataFrame:
    """(sample_id, view): test rows with a held-out value; a row may be in several views, unknown is in none."""
    views = F.array_compact(F.array(*[F.when(F.col(c).isin(*values), F.lit(f"cross_{c}")) for c, values in holdouts.items()]))
    return samples.where(F.col("split") == "test").select("sample_id", F.explode(views).alias("view"))
