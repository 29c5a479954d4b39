"""Near-duplicate groups by an LSH forest of MinHash signatures, confirmed on the full shingle sets."""

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.functions.components import connected_components
from speechlake.sources.shared import written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's n-word shingles, A-Z lower-cased.

    Words are cut at ASCII white space. Fewer than n words give one shingle, none give an empty array.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _hashes(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**32, k, np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each hash over the set, taken in pieces so that memory does not grow with the text."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, (low[i : i + 2048] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def _sign(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashes(k)
        for batch in batches:
            ids, sizes, sets, sigs = batch.column(0), [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), n)
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s, a, b).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_hash", "sig"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), n).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "s"])

    return run


def _by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole regions, and where each region starts in them; the rows come sorted by region, the first column."""
    rest = None
    for batch in _ended(batches):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
        if rest is None or not rest.num_rows:
            continue
        region = rest.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        if batch is None:
            yield rest, np.r_[starts, len(region)]
        elif len(starts) > 1:
            yield rest.slice(0, starts[-1]), starts
            rest = rest.slice(starts[-1])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _neighbours(k: int, least: int, span: int):
    """(a, b): the rows of a region beside each other in its tree's order, up to `span` places apart, whose sketch agrees in `least` of k places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, ids, sketch = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, k), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, k)
            old = len(ids)  # the last rows of the batch before
            region, ids, sketch = np.r_[region, batch.column(0).to_numpy()], np.r_[ids, batch.column(1).to_numpy()], np.r_[sketch, new]
            pairs = []
            for s in range(1, span + 1):
                x = np.arange(max(0, old - s), len(ids) - s)
                x = x[region[x] == region[x + s]]
                x = x[(sketch[x] == sketch[x + s]).sum(axis=1) >= least]
                pairs.append(np.sort(np.c_[ids[x], ids[x + s]], axis=1))
            found = np.unique(np.concatenate(pairs), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
            region, ids, sketch = region[-span:], ids[-span:], sketch[-span:]

    return run


def _connected(linked: np.ndarray) -> list[np.ndarray]:
    """The connected groups, of two at least, of a symmetric matrix of links."""
    groups, left = [], linked.any(axis=0)
    while left.any():
        group = front = np.arange(len(linked)) == left.argmax()
        while front.any():
            front = linked[front].any(axis=0) & ~group
            group = group | front
        left &= ~group
        if group.sum() > 1:
            groups.append(np.flatnonzero(group))
    return groups


def _untested(k: int, least: int, values: int):
    """(part, rep, c): the rows of a region whose sketch agrees, in `least` of k places at least, with one of another component c.

    Rows that such pairs connect are one part. Where their sets together have more than `values` values
    they are cut into blocks of half as many, and each pair of blocks with such a pair of rows is a part;
    so a part stays within `values`, but for single sets that are larger. Its number is made of its rows,
    so that trees that bring the same rows together give the same part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in _by_region(batches):
            ids, c, n = (part.column(x).to_numpy() for x in (1, 2, 4))
            sketch = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(ids), k)
            out = []
            for i, j in zip(starts, starts[1:], strict=False):
                alike = np.array([(c[i:j] != c[x]) & ((sketch[i:j] == sketch[x]).sum(axis=1) >= least) for x in range(i, j)])
                for group in _connected(alike):
                    group = group[np.argsort(ids[i + group])]
                    block = np.cumsum(n[i + group]) // max(1, values // 2) if n[i + group].sum() > values else np.zeros(len(group), np.int64)
                    for rows in _parts(i + group, block, alike[np.ix_(group, group)]):
                        out.append((np.full(len(rows), xxhash.xxh3_64_intdigest(ids[rows].tobytes()), np.uint64).view(np.int64), ids[rows], c[rows]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["part", "rep", "c"])

    return run


def _parts(rows: np.ndarray, block: np.ndarray, alike: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each pair of blocks that an alike pair of rows connects."""
    of = {b: block == b for b in np.unique(block)}
    for x, y in combinations_with_replacement(of, 2):
        if alike[np.ix_(of[x], of[y])].any():
            yield rows[of[x] | of[y]]


def linked_groups(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """The connected groups, of two at least, of sets whose similarity is percent / 100 or more."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.flatnonzero(np.bincount(place, minlength=len(values)) > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    column = column[place]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(shared), 4096):
        here = (column >= low) & (column < low + 4096)
        member = np.zeros((len(sets), min(4096, len(shared) - low)), np.float32)
        member[owner[here], column[here] - low] = 1
        common += member @ member.T
    return [g.tolist() for g in _connected(100 * common >= percent * (n[:, None] + n - common))]


def _confirm(percent: int):
    """(a, b): for each region the rows that its links connect, each beside the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in _by_region(batches):
            ids, lists, out = part.column(1).to_numpy(), part.column(2).combine_chunks(), []
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, j in zip(starts, starts[1:], strict=False):
                for group in linked_groups([values[ends[x] : ends[x + 1]] for x in range(i, j)], percent):
                    out += [(ids[i + group[0]], ids[i + x]) for x in group[1:]]
            if out:
                yield _edges(out)

    return run


def _regions(reps: DataFrame, trees: int, depth: int, least_depth: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(region, rep, t, n): the places of a forest where 2 to `most` representatives share a prefix; all at least_depth; (region, rep) of the larger ones.

    A tree sorts the signatures by `depth` values; a region is a prefix of least_depth values. One with
    more than `most` rows is cut by one value more, and so on; those still larger at full depth, whose
    rows agree in the whole tree, are dealt into blocks. What such cuts part is left to _blocks.
    """
    width = 4 * depth
    trees_of = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t")
    todo, found, shallow, crowds = reps.select("rep", "sig", trees_of), None, None, None
    for d in range(least_depth, depth + 1):
        region = F.xxhash64(F.lit(d), "t", F.expr(f"substring(sig, t * {width} + 1, {4 * d})"))
        rows = todo.select("rep", F.col("t").cast("byte").alias("t"), region.alias("region"))  # the signatures stay behind
        counts = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = written(rows.join(counts, "region"), "regions")
        shallow = shallow or rows
        small = rows.where(F.col("n") <= most).select("region", "rep", "t", "n")
        found = small if found is None else found.unionByName(small)
        rows = rows.where(F.col("n") > most)
        if rows.isEmpty():
            return found, shallow, crowds
        crowds = crowds or rows.select("region", "rep")
        if d == depth:
            block = F.pmod(F.xxhash64("rep", "t"), F.ceil(F.col("n") / most))
            return found.unionByName(rows.select(F.xxhash64("region", block).alias("region"), "rep", "t", "n")), shallow, crowds
        todo = rows.select("rep", "t").join(reps.select("rep", "sig"), "rep")
    raise AssertionError("least_depth is over depth")


def _blocks(placed: DataFrame, size: int) -> DataFrame:
    """(region, rep, c) of crowds, once for each pair of blocks that the row is in, under the pair as its region.

    A component of more than `size` rows has blocks of its own, the others share some, of about `size`
    rows each. So each two rows of different components are together in one pair; pairs of blocks of
    one and the same component are left out.
    """
    per = placed.groupBy("region", "c").agg(F.count(F.lit(1)).alias("m"))
    rest = per.groupBy("region").agg(F.coalesce(F.sum(F.when(F.col("m") <= size, F.col("m"))), F.lit(1)).alias("few"))
    per = written(per.join(rest, "region").withColumn("own", F.when(F.col("m") > size, F.col("c"))), "crowds")
    deal = F.when(F.col("own").isNotNull(), F.xxhash64("own", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / size)))).otherwise(F.pmod(F.xxhash64("c"), F.ceil(F.col("few") / size)))
    rows = written(placed.join(per, ["region", "c"]).select("region", "rep", "c", "own", deal.alias("block")), "blocks")
    one = rows.groupBy("region", "block").agg(F.max("own").alias("own"))
    two = one.select("region", F.col("block").alias("block2"), F.col("own").alias("own2"))
    pairs = one.join(two, "region").where("block <= block2 and (own is null or own2 is null or own <> own2)")
    ends = F.explode(F.array_distinct(F.array("block", "block2"))).alias("block")
    pairs = pairs.select("region", F.xxhash64("region", "block", "block2").alias("pair"), ends)
    return rows.join(pairs, ["region", "block"]).select(F.col("pair").alias("region"), "rep", "c")


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = 80, trees: int = 20, depth: int = 6, least_depth: int = 3, most: int = 2048, values: int = 4_000_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id linked), kept (is that one).

    Documents are linked where their sets of ngram-word shingles have a Jaccard similarity of at least
    percent / 100. Equal sets are one representative from the start. Each of the forest's trees orders the
    representatives by its part of their signatures; where they share a prefix of least_depth values, or a
    longer one where that is crowded, each is held against its two neighbours on either side, with which
    it shares the longest prefixes, and those links count that the full sets confirm. In a crowd of more than `most` rows, which is cut, each row is also held against the one that
    has most links so far. In every region of every tree whose rows are then of several components, all
    pairs of two components are held against each other by signature, and the rows of those that may be
    linked by full sets, at most `most` rows and about `values` shingles at a time, of which come what is
    connected and no pairs. So a group of m near copies gives rows in proportion to m. Crowds are held so too, uncut and at
    least_depth, by pairs of blocks (see _blocks): a crowd of n rows that stays in many components costs
    n * n / `most` rows, spread over as many tasks.

    What can be missed: a link of similarity exactly at the bound is in no region of any tree with a
    chance of (1 - s**least_depth)**trees (6e-7 for the values given) and its signature is refused with a
    chance of 3e-6. It must be found only if nothing else connects its ends. In crowds it is the same.

    Null or blank text has no shingles and is linked with nothing; a null doc_id too: its component is
    null and it is kept. Repeated rows give repeated rows; rows of one id are taken for one document.
    An empty table gives an empty one.
    """
    k = trees * depth
    s = percent / 100
    least = math.floor(k * s - 4.5 * math.sqrt(k * s * (1 - s)))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(slim.mapInArrow(_sign(ngram, k), "doc_id bigint, n_shingles bigint, set_hash binary, sig binary"), "signatures")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    reps = linkable.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    reps = written(reps, "reps")

    regions, shallow, crowds = _regions(reps, trees, depth, least_depth, most)
    ids = shallow.select(F.col("rep").alias("doc_id")).distinct()
    # merge: the same plan at every size
    sets = slim.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(ngram), "doc_id bigint, s array<bigint>").dropDuplicates(["doc_id"])
    sets = written(sets, "sets")

    sketch = F.unhex(F.regexp_replace(F.hex("sig"), "......(..)", "$1"))  # the lowest byte of each place
    order = F.expr(f"substring(sig, t * {4 * depth} + {1 + 4 * least_depth}, {4 * (depth - least_depth)})")  # within a region
    asked = regions.join(reps.select("rep", "sig", sketch.alias("sketch")), "rep").select("region", "rep", "sketch", order.alias("order"))
    asked = asked.repartition("region").sortWithinPartitions("region", "order", "rep").select("region", "rep", "sketch")
    pairs = asked.mapInArrow(_neighbours(k, least, 2), "a bigint, b bigint").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        checked = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("n"))
        return checked.where(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("a", "b")

    links = confirmed(pairs)
    if crowds is not None:  # the row with most links stands for its crowd
        links = written(links, "links")
        ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("d"))
        centres = crowds.join(ends, "rep").groupBy("region").agg(F.max(F.struct("d", -F.col("rep"), F.col("rep").alias("r")))["r"].alias("r"))
        spokes = crowds.join(centres, "region").where("rep <> r").select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b")).distinct()
        links = links.unionByName(confirmed(spokes))

    labels = reps.select("rep", "set_hash", "size", sketch.alias("sketch")).join(connected_components(links, "a", "b"), F.col("rep") == F.col("node"), "left")
    labels = written(labels.select("rep", "set_hash", "size", "sketch", F.coalesce("component", "rep").alias("c")), "labels")
    # of regions of three, the proposals have held every pair
    placed = written(shallow.where("n > 3").select("region", "rep", "n").join(labels.select("rep", "c"), "rep"), "placed")
    mixed = placed.groupBy("region").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("region")
    placed = placed.join(mixed, "region")
    held = placed.where(F.col("n") <= most).select("region", "rep", "c")
    if crowds is not None:
        held = held.unionByName(_blocks(placed.where(F.col("n") > most), max(most // 2, 1)))
    open_rows = held.join(labels.select("rep", "sketch", "size"), "rep").select("region", "rep", "c", "sketch", "size")
    open_rows = open_rows.repartition("region").sortWithinPartitions("region")
    parts = open_rows.mapInArrow(_untested(k, least, values), "part bigint, rep bigint, c bigint").distinct()
    parts = parts.join(sets, parts["rep"] == sets["doc_id"]).select("part", "c", "s").repartition("part").sortWithinPartitions("part")
    bridges = parts.mapInArrow(_confirm(percent), "a bigint, b bigint")  # between components

    merged = labels.join(connected_components(bridges, "a", "b"), F.col("c") == F.col("node"), "left")
    merged = merged.select("set_hash", F.coalesce("component", "c").alias("_c"))
    out = signed.join(merged, "set_hash", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("_c"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
