"""SimHash fingerprints of texts and the search for near ones, in DataFrame functions only."""

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.ranking import range_bucket, range_cuts
from speechlake.functions.text import hexadecimal, words
from speechlake.sources.shared import written

#: 16 votes of 16 bits fit a long four at a time; a group of CHUNK terms cannot overflow them.
LANES, CHUNK = 0x0001000100010001, 32_768
HALVES = 0x0000FFFF0000FFFF
#: Texts whose sets of five-word shingles have a similarity of 0.8 differ in about one word of 45, which turns some 7 of 128
#: bits; nine tenths of them are within 10.
RADIUS = 10
#: A word counts as often as it comes, this often at most, so that no text is all its commonest word.
MOST_WEIGHT = 6


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, hi, lo): 128 bits for each row of texts, which keys must tell apart.

    Terms are the words in lower case, each with the weight of its count, MOST_WEIGHT at most. Each term's
    128-bit hash votes on each bit as often as it weighs; a bit is set where more than half of the votes are for it. No words, no bits. Votes are added 4 to a long, which keeps the
    aggregation at 32 sums; it needs no shuffle where texts is partitioned by some of the keys.
    """
    rows = texts.select(*keys, words(F.lower(F.col(text))).alias("_w"))
    rows = rows.select(*keys, F.sort_array(F.transform("_w", lambda x: F.xxhash64(x))).alias("_h"))
    first = F.filter("_h", lambda x, i: (i < MOST_WEIGHT) | (F.get(F.col("_h"), i - MOST_WEIGHT) != x))  # equal ones are neighbours
    terms = rows.select(*keys, F.posexplode_outer(first).alias("_at", "_a"))
    terms = terms.withColumn("_b", F.when(F.col("_a").isNotNull(), F.xxhash64("_a", F.lit(1))))
    votes = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))).alias(f"{h}{k}") for h in ("_a", "_b") for k in range(16)]
    chunks = terms.groupBy(*keys, F.floor(F.col("_at") / CHUNK).alias("_chunk")).agg(F.count("_a").alias("_n"), *votes)
    wide = []
    for h in ("_a", "_b"):
        for k in range(16):
            wide += [F.sum(F.shiftrightunsigned(f"{h}{k}", s).bitwiseAND(F.lit(HALVES))).alias(f"{h}{k}_{s}") for s in (0, 16)]
    sums = chunks.groupBy(*keys).agg(F.sum("_n").alias("_n"), *wide)

    def bits(h: str) -> Column:
        out = F.lit(0).cast("long")
        for j in range(64):
            k, lane = j % 16, j // 16
            count = F.shiftrightunsigned(f"{h}{k}_{16 * (lane % 2)}", 32 * (lane // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
            bit = F.lit(1 << j if j < 63 else -(1 << 63)).cast("long")
            out = out.bitwiseOR(F.when(2 * count > F.col("_n"), bit).otherwise(F.lit(0).cast("long")))
        return out

    return sums.select(*keys, bits("_a").alias("hi"), bits("_b").alias("lo"))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1 - (F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))) / 128


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, block: int = 256) -> DataFrame:
    """(hi, lo, n_near): each distinct fingerprint and how many others differ in at most `radius` bits.

    Of radius + 2 blocks of bits, as many changes leave two alone at least. So a table for each pair of
    blocks, keyed by their bits, brings together all that can be near; each pair is then compared whole,
    and counted in the table of the first two blocks that it has in common. Fingerprints that share a key
    lie in arrays of at most `block`; each two arrays of a key meet in one row, under a key of their own, which counts
    inside and gives a count per fingerprint, so pairs are never rows. Equal fingerprints are one.
    """
    if not 0 <= radius <= 62:
        raise ValueError("radius must be 0 to 62")
    k, blocks = radius + 2, []
    for half, n in (("hi", k // 2), ("lo", k - k // 2)):
        cuts = [64 * i // n for i in range(n + 1)]
        blocks += [(half, low, high - low) for low, high in zip(cuts, cuts[1:], strict=False)]
    bits = lambda x, low, width: F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    distinct = prints.select("hi", "lo").distinct()
    tables = list(combinations(range(k), 2))
    keys = F.array(*[F.xxhash64(F.lit(n), bits(F.col(blocks[i][0]), *blocks[i][1:]), bits(F.col(blocks[j][0]), *blocks[j][1:])) for n, (i, j) in enumerate(tables)])
    keyed = distinct.select("hi", "lo", F.posexplode(keys).alias("_t", "_key"))
    place = F.row_number().over(W.partitionBy("_t", "_key").orderBy("hi", "lo")) - 1
    many = F.count(F.lit(1)).over(W.partitionBy("_t", "_key"))
    dealt = keyed.withColumns({"_block": F.floor(place / block), "_many": F.ceil(many / block)})
    dealt = dealt.groupBy("_t", "_key", "_block", "_many").agg(F.collect_list(F.struct("hi", "lo")).alias("prints"))
    dealt = written(dealt.where("_block > 0 or size(prints) > 1"), "blocks")  # a first block of one is alone
    others = dealt.select("_t", "_key", F.col("_block").alias("_other"), F.col("prints").alias("others"))
    tops = {h: [min(low + width - 1, 62) for half, low, width in blocks if half == h] for h in ("hi", "lo")}
    top = [(h, t) for h in ("hi", "lo") for t in tops[h]]  # the highest bit of each block
    upto = {h: [sum(1 << t for g, t in top[: j + 1] if g == h) for _, j in tables] for h in ("hi", "lo")}
    own = {h: [sum(1 << t for g, t in (top[i], top[j]) if g == h) for i, j in tables] for h in ("hi", "lo")}

    def equal_blocks(other: Column, h: str) -> Column:
        """The highest bit of each block in which two fingerprints, whose exclusive or this is, are equal."""
        high = sum(1 << t for t in tops[h])
        rest = 2**63 - 1 - high
        folded = other.bitwiseAND(2**63 - 1).bitwiseOR(F.shiftrightunsigned(other, 1).bitwiseAND(1 << 62))  # sums stay below 2**63
        return F.bitwise_not((folded.bitwiseAND(rest) + rest).bitwiseOR(folded)).bitwiseAND(high)

    def near(x: Column, y: Column) -> Column:
        other = {h: x[h].bitwiseXOR(y[h]) for h in ("hi", "lo")}
        out = F.bit_count(other["hi"]) + F.bit_count(other["lo"]) <= radius
        for h in ("hi", "lo"):
            out = out & (equal_blocks(other[h], h).bitwiseAND(F.col(f"_upto_{h}")) == F.col(f"_own_{h}"))
        return out & ((x["hi"] != y["hi"]) | (x["lo"] != y["lo"]))

    # each two blocks of a key by a key of their own, so that the blocks of a crowd spread over tasks
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1))).join(others, ["_t", "_key", "_other"])
    met = met.withColumns({f"_{n}_{h}": F.get(F.lit(of[h]).cast("array<bigint>"), F.col("_t")) for n, of in (("upto", upto), ("own", own)) for h in ("hi", "lo")})
    counted = F.transform("prints", lambda x: F.struct(x["hi"].alias("hi"), x["lo"].alias("lo"), F.size(F.filter("others", lambda y: near(x, y))).alias("n")))
    found = met.select(F.explode(F.filter(counted, lambda c: c["n"] > 0)).alias("c")).select("c.*")
    counts = found.groupBy("hi", "lo").agg(F.sum("n").alias("n_near"))
    return distinct.join(counts, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def _ranges(ids: DataFrame, rank: Column, ranges: int, most: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds bucket, the range of about as many rows that a row's rank is in, in ascending order.

    Quantiles cut the ranks into `most` ranges at most; where more are needed each of these is cut by quantiles
    of its own, which lie in a table of one row a range.
    """
    outer = min(most, ranges)
    cuts = range_cuts(ids, rank, outer)
    inner = min(most, -(-ranges // outer)) if outer else 1
    first = range_bucket(rank, cuts).cast("long")
    if inner < 2:
        return lambda rows: rows.withColumn("bucket", first)
    at = [i / inner for i in range(1, inner)]
    own = ids.select(first.alias("_outer"), rank.alias("_r")).groupBy("_outer").agg(F.array_sort(F.array_distinct(F.percentile_approx("_r", at, 10 * inner))).alias("_cuts"))
    own = written(own, "ranges")
    below = F.size(F.filter("_cuts", lambda c: c < rank)).cast("long")
    return lambda rows: rows.withColumn("_outer", first).join(own, "_outer").withColumn("bucket", F.col("_outer") * inner + below).drop("_outer", "_cuts")


def with_next(docs: DataFrame, width: int = 1024, most: int = 4096) -> DataFrame:
    """(bucket, row, doc_id, text, next_id, next_text, last) of (doc_id, text): each row beside the next by ascending id.

    Null ids come last, equal ids by text, and the last row's next is the first; a single row is its own.
    Quantiles of the ids, in two levels of `most` at most, cut them into ranges of about `width` rows, so sparse
    ids spread as dense ones do and the texts move once. Only a range's last row takes its next from another
    range, whose first row meets it by a join on ranges. The first ids, one a range, are stored before they
    fetch their texts, so that Spark knows their size; the window that orders the ranges sees one number of each.
    """
    rank = F.coalesce("doc_id", F.lit(2**63 - 1))
    ids = docs.select("doc_id")
    placed = _ranges(ids, rank, -(-ids.count() // width), most)
    rows = placed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("_rank", rank)
    firsts = written(rows.groupBy("bucket").agg(F.min("_rank").alias("_rank")), "firsts")
    each = W.partitionBy(F.lit(0)).orderBy("bucket")
    after = firsts.select(F.col("bucket").alias("_for"), F.coalesce(F.lead("bucket").over(each), F.first("bucket").over(each)).alias("bucket"))
    heads = rows.join(firsts, ["bucket", "_rank"]).groupBy("bucket").agg(F.min("doc_id").alias("_id"), F.min("text").alias("_text"))
    heads = heads.join(after, "bucket").select(F.col("_for").alias("bucket"), "_id", "_text")
    order = W.partitionBy("bucket").orderBy("_rank", "text")
    rows = rows.withColumns(
        {
            "row": F.row_number().over(order), "next_text": F.lead("text").over(order), "next_id": F.lead("doc_id").over(order),
            "last": F.lead(F.lit(1)).over(order).isNull(),
        }
    )
    met = rows.join(heads, "bucket", "left")
    last = F.col("last")
    return met.select(
        "bucket", "row", "doc_id", "text", "last",
        F.when(last, F.col("_id")).otherwise(F.col("next_id")).alias("next_id"),
        F.when(last, F.col("_text")).otherwise(F.col("next_text")).alias("next_text"),
    )


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how near these and the next document's are.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's text (see with_next). Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and n_near, the number of other fingerprints of documents
    within radius bits. Null texts count as empty and have a fingerprint of zeros; repeated rows are
    documents of their own; an empty table gives an empty one.
    """
    rows = with_next(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    n = F.length("text").cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumns({"n_chars": n, "edited": edited})
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    texts = F.when(F.col("last"), F.array("text", "edited", "next_text")).otherwise(F.array("text", "edited"))
    keys = ["bucket", "row", "doc_id", "n_chars", "edited_sha256"]
    each = rows.select(*keys, F.posexplode(texts).alias("kind", "_text"))
    prints = fingerprints(each, [*keys, "kind"], "_text")
    of = [F.max(F.when(F.col("kind") == k, F.struct("hi", "lo"))).alias(name) for k, name in enumerate(("own", "edited", "over"))]
    one = prints.groupBy(*keys).agg(*of)
    following = F.coalesce("over", F.lead("own").over(W.partitionBy("bucket").orderBy("row")))
    one = one.withColumn("following", following)
    out = one.select(
        "doc_id", "n_chars", "edited_sha256", F.col("own.hi").alias("hi"), F.col("own.lo").alias("lo"),
        F.concat(hexadecimal(F.col("own.hi")), hexadecimal(F.col("own.lo"))).alias("fingerprint"),
        F.concat(hexadecimal(F.col("edited.hi")), hexadecimal(F.col("edited.lo"))).alias("edited_fingerprint"),
        likeness(F.col("own.hi"), F.col("own.lo"), F.col("edited.hi"), F.col("edited.lo")).alias("near_edited"),
        likeness(F.col("own.hi"), F.col("own.lo"), F.col("following.hi"), F.col("following.lo")).alias("near_next"),
    )
    out = written(out, "prints")
    return out.join(near_fingerprints(out, radius), ["hi", "lo"]).drop("hi", "lo")
