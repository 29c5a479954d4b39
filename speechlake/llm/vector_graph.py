"""Near-duplicate vectors by NN-descent: a neighbour graph, refined through neighbours of neighbours, audited, cut at a cosine."""

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.components import connected_components
from speechlake.functions.vectors import cosine
from speechlake.sources.shared import written

#: A sketch is 32 signs of random projections for each of TREES orders of the vectors.
TREES, WORDS = 10, 5
BITS = 64 * WORDS
#: An angle by which two vectors must be within the bound to be taken as linked without a look at them.
SURE = 1e-6
FAR = 1 << 14


def _matrix(lists: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None where it is null, zero, or has a component that is null or not finite."""
    out: list[np.ndarray | None] = []
    for x in lists:
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) if x.is_valid and len(x) else None
        good = v is not None and not x.values.null_count and np.isfinite(v).all() and v.any() and np.isfinite(v @ v) and v @ v > 0
        out.append(v + 0.0 if good else None)
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, sketch, v): a digest of the vector and the signs of its projections; nulls where it links with nothing."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, vectors = batch.column(0), _matrix(batch.column(1))
        keys, signs = [], []
        for i, v in zip(ids, vectors, strict=True):
            if v is None or not i.is_valid:
                keys.append(None)
                signs.append(None)
                continue
            if len(v) not in planes:
                planes[len(v)] = np.random.default_rng(len(v)).standard_normal((len(v), BITS))
            keys.append(xxhash.xxh3_128_digest(v.tobytes()))
            signs.append(np.packbits(v / np.sqrt(v @ v) @ planes[len(v)] > 0).tobytes())
        lists = pa.array([None if k is None else v for k, v in zip(keys, vectors, strict=True)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), lists], ["vec_id", "key", "sketch", "v"])


def _bits(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(-1, WORDS)


def _edges(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], ["a", "b", "d"])


def _along(span: int, keep: int):
    """(a, b, d): of the rows up to `span` places away in a tree's order the `keep` whose sketches differ least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n < 2:
                continue
            tree, node, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bits(batch.column(2))
            found = np.full((n, 2 * span), FAR, np.int64)
            at = np.arange(n)[:, None] + np.r_[1 : span + 1, -span:0]
            for s in range(1, min(span, n - 1) + 1):
                d = np.bitwise_count(bits[:-s] ^ bits[s:]).sum(axis=1).astype(np.int64)
                d[tree[:-s] != tree[s:]] = FAR
                found[:-s, s - 1] = d
                found[s:, 2 * span - s] = d
            best = np.argsort(found, axis=1, kind="stable")[:, :keep]
            d = np.take_along_axis(found, best, axis=1)
            x, y = np.nonzero(d < FAR)
            if len(x):
                yield _edges(node[x], node[at[x, best[x, y]]], d[x, y])

    return run


def _local_joins(keep: int):
    """(a, b, d): for each node's list the pairs, one of them new at least, that are nearer than a's list reaches, `keep` an a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = lists.offsets.to_numpy()
            node, reach, fresh, bits = (lists.values.field(i) for i in range(4))
            node, reach, fresh, bits = node.to_numpy(), reach.to_numpy(), fresh.to_numpy(zero_copy_only=False), _bits(bits)
            out = []
            for i, j in zip(ends, ends[1:], strict=False):
                part = bits[i:j]
                d = np.bitwise_count(part[:, None] ^ part[None]).sum(axis=2).astype(np.int64)
                d[(d >= reach[i:j, None]) | ~(fresh[i:j, None] | fresh[None, i:j])] = FAR
                np.fill_diagonal(d, FAR)
                if keep < j - i:
                    best = np.argsort(d, axis=1, kind="stable")[:, :keep]
                    x, y = np.nonzero(np.take_along_axis(d, best, axis=1) < FAR)
                    y = best[x, y]
                else:
                    x, y = np.nonzero(d < FAR)
                out.append((node[i + x], node[i + y], d[x, y]))
            if out:
                a, b, d = (np.concatenate(c) for c in zip(*out, strict=True))
                if len(a):
                    yield _edges(a, b, d)

    return run


def _nearest(edges: DataFrame, neighbours: int, most: int, limit: int) -> DataFrame:
    """The nearest `neighbours` of each node; up to `most` where a list is saturated, that is all within the limit."""
    one = edges.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))  # an edge that was there is not new
    rank = F.row_number().over(W.partitionBy("a").orderBy("d", "b"))
    return one.withColumn("_at", rank).where(F.col("_at") <= most).where((F.col("_at") <= neighbours) | (F.col("d") <= limit)).drop("_at")


def descend(nodes: DataFrame, limit: int, neighbours: int, most: int, rounds: int) -> DataFrame:
    """(a, b, d): for each node its nearest others by sketch; nodes: node, dim, sketch.

    The lists begin with neighbours in TREES orders of the sketches. Each round joins, for each node, its nearest
    neighbours and those whose neighbour it is, and offers each to the others; pairs of which neither was new in
    the last round are left out. It ends with a round that brings no new edge within the limit.
    """
    spots = F.posexplode(F.array(*[F.expr(f"substring(sketch, {4 * t + 1}, 4)") for t in range(TREES)])).alias("tree", "at")
    orders = nodes.select("node", "sketch", "dim", spots).withColumn("tree", F.xxhash64("tree", "dim"))
    orders = orders.repartitionByRange("tree", "at", "node").sortWithinPartitions("tree", "at", "node").select("tree", "node", "sketch")
    first = orders.mapInArrow(_along(8, 5), "a bigint, b bigint, d int").withColumn("fresh", F.lit(True))
    graph = written(_nearest(first, neighbours, most, limit), "graph")
    for _ in range(rounds):
        reach = graph.groupBy("a").agg(F.max("d").alias("_far"), F.count(F.lit(1)).alias("_n"))
        full = F.when(F.col("_n") >= neighbours, F.col("_far")).otherwise(FAR)
        # a list that is saturated takes on anything within the limit
        about = nodes.join(reach, F.col("node") == F.col("a"), "left").select(F.col("node").alias("x"), F.greatest(F.coalesce(full, F.lit(FAR)), F.when(F.col("_n") < most, limit + 1).otherwise(0)).alias("reach"), "sketch")
        both = graph.select(F.col("a").alias("v"), F.col("b").alias("x"), "d", "fresh").unionByName(graph.select(F.col("b").alias("v"), F.col("a").alias("x"), "d", "fresh"))
        order = W.partitionBy("v").orderBy(F.col("fresh").desc(), "d", "x")
        both = both.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= 2 * neighbours).drop("_at", "d")
        lists = both.join(about, "x").groupBy("v").agg(F.collect_list(F.struct("x", "reach", "fresh", "sketch")).alias("s")).select("s")
        offers = lists.mapInArrow(_local_joins(4), "a bigint, b bigint, d int").where("a <> b").withColumn("fresh", F.lit(True))
        graph = written(_nearest(graph.withColumn("fresh", F.lit(False)).unionByName(offers), neighbours, most, limit), "graph")
        if graph.where(F.col("fresh") & (F.col("d") <= limit)).isEmpty():
            break
    return graph.select("a", "b", "d")


def _block_links(bound: float):
    """(node, links): how many vectors each row of a group links with in it, pairs within the core aside; rows come sorted by group."""

    def counted(rows: pa.Table) -> pa.RecordBatch:
        node, m, side, core = (rows.column(c).to_numpy() for c in ("node", "m", "side", "core"))
        v = np.array(rows.column("v").to_pylist())
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
        linked = v @ v.T >= bound
        linked &= ~(core[:, None] & core[None])
        if (side != side[0]).any():  # two blocks: pairs across them only
            linked &= side[:, None] != side[None]
        np.fill_diagonal(linked, False)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(linked @ m)], ["node", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            of = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and of[i] != group:
                    yield counted(pa.Table.from_batches(held))
                    held = []
                group = of[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield counted(pa.Table.from_batches(held))

    return run


def count_links(members: DataFrame, bound: float, block: int = 512) -> DataFrame:
    """(node, links): for each member of a component the vectors linked with it there, itself aside, each exactly.

    members: c, node, m (vectors that are equal to it), v. This is where saturated lists end: the list of a
    member is its whole component, but as a count. Members within half the bound's angle of the component's
    mean are its core; all of them are linked, so they are only added up. The others are dealt into blocks,
    and each pair of blocks, one of them outside the core, is one product of matrices; no pair becomes a row.
    """
    half = math.acos(bound) / 2 - SURE
    size = members.agg(F.max(F.size("v"))).first()[0] or 0
    unit = F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y)))
    mean = members.select("c", unit.alias("u")).groupBy("c").agg(F.array(*[F.avg(F.get("u", F.lit(i))) for i in range(size)]).alias("mean"))
    core = F.coalesce(cosine(F.col("v"), F.slice("mean", 1, F.size("v"))) >= math.cos(half), F.lit(False)) if half > 0 else F.lit(False)
    rows = members.join(mean, "c").select("c", "node", "m", "v", core.alias("core"))
    kinds = rows.groupBy("c", "core").agg(F.count(F.lit(1)).alias("_n"), F.sum("m").alias("_m"))
    kinds = written(kinds, "kinds")
    rows = rows.join(kinds, ["c", "core"]).withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / block)))
    rows = written(rows, "members")
    blocks = kinds.select("c", "core", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / block) - 1)).alias("block"))
    one = blocks.select("c", F.col("core").alias("core1"), F.col("block").alias("block1"))
    two = blocks.select("c", F.col("core").alias("core2"), F.col("block").alias("block2"))
    pairs = one.join(two, "c").where("not core1 and (core2 or block1 <= block2)")
    ends = F.array(F.struct(F.col("core1").alias("core"), F.col("block1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("core2").alias("core"), F.col("block2").alias("block"), F.lit(1).alias("side")))
    ends = F.when((F.col("core1") == F.col("core2")) & (F.col("block1") == F.col("block2")), F.slice(ends, 1, 1)).otherwise(ends)
    pairs = pairs.select("c", F.xxhash64("c", "core1", "block1", "core2", "block2").alias("group"), F.explode(ends).alias("e")).select("c", "group", "e.*")
    held = rows.join(pairs, ["c", "core", "block"]).select("group", "node", "m", "side", "core", "v")
    held = held.repartition("group").sortWithinPartitions("group")
    counts = held.mapInArrow(_block_links(bound), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    inside = F.when(F.col("core"), F.col("_m") - F.col("m")).otherwise(0)
    return rows.join(counts, "node", "left").select("c", "node", (inside + F.coalesce("links", F.lit(0))).alias("links"))


def _brute_force(queries: list, bound: float):
    """(node, other, found): held against all rows, how many links each query has in its component, and each link out of it."""
    of: dict[int, list] = {}
    for q in queries:
        of.setdefault(len(q.v), []).append(q)
    known = {n: (np.array([q.node for q in qs]), np.array([q.c for q in qs]), np.array([q.v for q in qs])) for n, qs in of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, c, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            starts = np.r_[0, np.cumsum(lengths)]
            for n, (q, qc, qv) in known.items():
                rows = np.flatnonzero(lengths == n)
                if not len(rows):
                    continue
                v = flat[starts[rows][:, None] + np.arange(n)]
                linked = (qv @ v.T) / (np.sqrt((qv * qv).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))) >= bound
                linked &= q[:, None] != node[rows]
                same = qc[:, None] == c[rows]
                x, y = np.nonzero(linked & ~same)
                found = (linked & same).sum(axis=1)
                nodes, others = np.r_[q[x], q], np.r_[node[rows][y], np.full(len(q), -1)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(others), pa.array(np.r_[np.zeros(len(x), np.int64), found]), pa.array(np.r_[np.ones(len(x), bool), np.zeros(len(q), bool)])], ["node", "other", "found", "missed"])

    return run


def audit(placed: DataFrame, bound: float, queries: int) -> tuple[float, DataFrame]:
    """The share of the true links of `queries` nodes, least hash first, that lie within their components, and the links that do not.

    placed: node, c, v. The queries, a bounded number, go with the task and meet all rows in blocks.
    """
    asked = placed.select("node", "c", "v").orderBy(F.xxhash64("node", F.lit(3)), "node").limit(queries).collect()
    seen = placed.select("node", "c", "v").mapInArrow(_brute_force(asked, bound), "node bigint, other bigint, found bigint, missed boolean")
    seen = written(seen, "audit")
    found, missed = seen.agg(F.sum("found"), F.count_if("missed")).first()
    total = (found or 0) + (missed or 0)
    return ((found or 0) / total if total else 1.0), seen.where("missed").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def near_vectors(vectors: DataFrame, bound: float = 0.9, neighbours: int = 12, most: int = 48, rounds: int = 8, queries: int = 512, recall: float = 0.98, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id linked), kept (is that one).

    Vectors are linked where their cosine, in double precision, is at least `bound` (above 0). Equal vectors are one node. NN-descent
    (see descend) finds each node's nearest others by 320-bit sketches; lists in which all are near grow from
    `neighbours` to `most`. Edges whose sketches may be of the bound are confirmed on the vectors. A node's links
    are then counted exactly within its component (see count_links), which is how saturated lists end.

    What can be missed is a component that no edge of the graph joins to another. So the recall of `queries` nodes
    is held against all vectors; while it is below `recall` the descent is run again with twice the lists, three times at
    most, and a warning says so if that is not enough. Links that the audit finds are kept.

    Vectors that are null, zero or empty, or hold null or non-finite components, link with nothing, nor do vectors of
    another length; rows with a null id neither: their component is null and they are kept. Rows that repeat a
    vector are vectors of their own, linked with each other. An empty table gives an empty one.
    """
    if not 0 < bound <= 1:
        raise ValueError("bound must be above 0, 1 at most")
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    signed = written(slim.mapInArrow(_sketches, "vec_id bigint, key binary, sketch binary, v array<double>"), "signed")
    groups = signed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("sketch").alias("sketch"), F.first("v").alias("v"))
    seed = 0
    while True:  # until each group has a number of its own
        nodes = written(groups.select(F.xxhash64("key", F.lit(seed)).alias("node"), "key", "rep", "m", "sketch", F.size("v").alias("dim"), "v"), "nodes")
        if nodes.groupBy("node").count().where("count > 1").isEmpty():
            break
        seed += 1

    p = math.acos(bound) / math.pi
    limit = math.floor(BITS * p + 5 * math.sqrt(BITS * p * (1 - p)))
    vectors_of = lambda end, name: nodes.select(F.col("node").alias(end), F.col("v").alias(name))
    links = None
    for attempt in range(4):
        size = neighbours << attempt
        graph = descend(nodes.select("node", "dim", "sketch"), limit, size, most << attempt, rounds)
        near = graph.where(F.col("d") <= limit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = near.join(vectors_of("a", "va"), "a").join(vectors_of("b", "vb"), "b")
        found = near.where((F.size("va") == F.size("vb")) & (cosine(F.col("va"), F.col("vb")) >= bound)).select("a", "b")
        found = written(found, "links")
        links = found if links is None else links.unionByName(found)
        groups_of = connected_components(links, "a", "b").select("node", F.col("component").alias("c"))
        placed = written(nodes.join(groups_of, "node", "left").select("node", F.coalesce("c", "node").alias("c"), "key", "rep", "m", "v"), "placed")
        share, missed = audit(placed, bound, queries)
        links = links.unionByName(missed)
        if share >= recall:
            break
    else:
        warnings.warn(f"near_vectors: a recall of {share:.3f} is below {recall}", stacklevel=2)
    if share < 1:
        groups_of = connected_components(links, "a", "b").select("node", F.col("component").alias("c"))
        placed = written(nodes.join(groups_of, "node", "left").select("node", F.coalesce("c", "node").alias("c"), "key", "rep", "m", "v"), "placed")

    several = placed.groupBy("c").agg(F.count(F.lit(1)).alias("_k"), F.min("rep").alias("component"))
    counts = count_links(placed.join(several.where("_k > 1").select("c"), "c", "left_semi").select("c", "node", "m", "v"), bound)
    known = placed.join(several, "c").join(counts.select("node", "links"), "node", "left")
    known = known.select("key", "component", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = signed.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
