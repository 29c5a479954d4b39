"""Phrases that stick together, mined from a weighted de Bruijn graph whose edges are four-word grams."""

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.components import connected_components
from speechlake.sources.shared import written

#: A-Z to a-z and every end of a piece to a newline, byte by byte.
_TABLE = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of a gram; grams that a task adds up before it hands them on; pairs of words with a larger share than 1 / HOT are spread.
LONGEST, FLUSH, HOT = 4, 1 << 19, 500
#: Buckets that grams are dealt into at a time, and the bytes of text that a last bucket may stand for.
FAN, BUCKET = 512, 4_000_000
_NAMES = ["lang", "bucket", "k", "grams", "counts"]
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
_BLOCKS = "lang string, bucket bigint, k int, grams binary, counts array<bigint>"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece, in lower case."""
    for piece in text.translate(_TABLE).split(b"\n"):
        words = piece.split()
        if words:
            yield words


def add_longest_grams(words: list[bytes], grams: list[list[bytes]]) -> None:
    """Add for each word of a piece the longest gram that begins with it to grams[its number of words]: four, fewer at the piece's end."""
    if len(words) >= LONGEST:
        grams[LONGEST] += map(b" ".join, zip(words, words[1:], words[2:], words[3:]))  # noqa: B905
    for k in range(1, min(LONGEST - 1, len(words)) + 1):
        grams[k].append(b" ".join(words[-k:]))


def _bucket(gram: bytes, hot: frozenset[bytes]) -> int:
    """A checksum of the first two words, which keeps what a count of two or three words adds up in one bucket; of hot pairs of the whole gram."""
    at = gram.find(b" ", gram.find(b" ") + 1)
    pair = gram if at < 0 else gram[:at]
    return zlib.crc32(gram if pair in hot else pair)


def _blocks(found: dict[str, list], buckets: int, hot: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    """Counted grams of each language and length, a row per bucket, packed."""
    for lang, by_length in found.items():
        for k, grams in enumerate(by_length):
            dealt: dict[int, tuple[list, list]] = {}
            for gram, n in (grams if isinstance(grams, dict) else Counter(grams)).items():
                held, counts = dealt.setdefault(_bucket(gram, hot) % buckets, ([], []))
                held.append(gram)
                counts.append(n)
            if dealt:
                packed = [zstandard.compress(b"\n".join(g), 1) for g, _ in dealt.values()]
                columns = [[lang] * len(dealt), [*dealt], [k] * len(dealt), packed, [c for _, c in dealt.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int, list[bytes], list[int]]]:
    for batch in batches:
        for of, lang, k, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "k", "grams", "counts")), strict=True):
            yield of, lang, k, zstandard.decompress(grams).split(b"\n"), counts


def _gram_blocks(hot: frozenset[bytes], flush: int):
    """The grams of a task's texts, added up over some half a million words at a time, in FAN buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[list[bytes]]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = found.setdefault(lang, [[] for _ in range(LONGEST + 1)])
                for words in pieces(text):
                    add_longest_grams(words, grams)
                    held += len(words)
                if held >= flush:
                    yield from _blocks(found, FAN, hot)
                    found, held = {}, 0
        yield from _blocks(found, FAN, hot)

    return run


def _dealt_again(buckets: int, hot: frozenset[bytes], flush: int):
    """The same grams in more buckets, each of which lies within one that it was in; they come by bucket, so that copies meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, _Flows] = {}
        for _, lang, k, grams, counts in _unpacked(batches):
            found.setdefault(lang, _Flows()).add(k, grams, counts)
            if sum(f.size() for f in found.values()) >= flush:
                yield from _blocks({x: f.by_length for x, f in found.items()}, buckets, hot)
                found = {}
        yield from _blocks({x: f.by_length for x, f in found.items()}, buckets, hot)

    return run


class _Flows:
    """The counts of one bucket and language: edges, and what flows from them into shorter grams."""

    def __init__(self):
        self.by_length: list[dict[bytes, int]] = [{} for _ in range(LONGEST + 1)]

    def add(self, k: int, grams: list[bytes], counts: list[int]) -> None:
        known = self.by_length[k]
        for gram, n in zip(grams, counts, strict=True):
            known[gram] = known.get(gram, 0) + n

    def size(self) -> int:
        return sum(map(len, self.by_length))

    def counted(self, least: int, hot: frozenset[bytes]) -> tuple[dict[bytes, int], dict[bytes, int], dict[bytes, int], dict[bytes, int]]:
        """The counts of grams of one word, all of them, and of two, three and four that have `least` or begin with a hot pair."""
        _, ones, twos, threes, fours = self.by_length
        # a node's flow is that of its edges, to which the ends of pieces come
        for gram, n in fours.items():
            node = gram[: gram.rfind(b" ")]
            threes[node] = threes.get(node, 0) + n
        nodes = {}
        for gram, n in threes.items():
            pair = gram[: gram.rfind(b" ")]
            twos[pair] = twos.get(pair, 0) + n
            if n >= least or pair in hot:
                nodes[gram] = n
        pairs = {}
        for gram, n in twos.items():
            word = gram[: gram.find(b" ")]
            ones[word] = ones.get(word, 0) + n
            if n >= least or gram in hot:
                pairs[gram] = n
        return ones, pairs, nodes, {g: n for g, n in fours.items() if n >= least}


def _bucket_counts(least: int, hot: frozenset[bytes], room: int):
    """(lang, k, phrase, n) from the blocks of grams, which come by bucket.

    A bucket is added up whole where its distinct grams are `room` at most. One that has more is handed on
    in parts, of which nothing is left out, and Spark adds them up. Words are added up over the buckets of a task.
    """

    def rows(lang: str, k: int, counts: dict[bytes, int]) -> pa.RecordBatch:
        n = len(counts)
        columns = [pa.array([lang] * n, pa.string()), pa.array([k] * n, pa.int32()), pa.array([*counts], pa.binary()).cast(pa.string()), pa.array([*counts.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "k", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, dict[bytes, int]] = {}
        bucket, flows, parted = None, {}, False

        def closed() -> Iterator[pa.RecordBatch]:
            for lang, flow in flows.items():
                ones, *longer = flow.counted(1 if parted else least, hot)
                yield from (rows(lang, k, counts) for k, counts in enumerate(longer, 2) if counts)
                known = words.setdefault(lang, {})
                for word, n in ones.items():
                    known[word] = known.get(word, 0) + n
                if len(known) > room:
                    yield from worded(lang)

        def worded(lang: str) -> Iterator[pa.RecordBatch]:
            known = words.pop(lang)
            yield rows(lang, 1, known)
            yield rows(lang, 0, {b"": sum(known.values())})

        for of, lang, k, grams, counts in _unpacked(batches):
            if of != bucket:
                yield from closed()
                bucket, flows, parted = of, {}, False
            flows.setdefault(lang, _Flows()).add(k, grams, counts)
            if sum(f.size() for f in flows.values()) > room:
                parted = True
                yield from closed()
                flows = {}
        yield from closed()
        for lang in [*words]:
            yield from worded(lang)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            for words in pieces(text):
                counts.update(map(b" ".join, zip(words, words[1:])))  # noqa: B905
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())], ["pair", "n"])


def frequent_phrases(docs: DataFrame, least: int = 30, flush: int = FLUSH, sample: float = 1 / 64, bucket: int = BUCKET) -> DataFrame:
    """(lang, k, phrase, n): the phrases of k = 1 to 4 words that occur `least` times or more, and k = 0 for all words of a language.

    docs: lang, text (binary). Each word begins one longest gram: an edge of the graph (four words, between
    the nodes of its first three and last three) or, at a piece's end, a shorter one. A node's count is the
    flow of its edges and the ends of three words; a pair's is that of its nodes and the ends of two; so
    only longest grams are shuffled, added up by task and packed a bucket to a row. A bucket holds all
    grams that begin with the same two words, so its counts of two words and more are whole and the
    rare ones are dropped there. Grams are dealt into FAN buckets at a time, and again where a bucket would stand for more than
    `bucket` bytes of text; so rows grow with the grams, at any size: 2 GB of text take
    one shuffle, 1 TB two, 500 TB three. A pair of words with more than 1 / HOT of a sample of the rows has its
    grams spread over all buckets, and its flows are added up behind them; the sample serves the balance only. So does
    a bucket with more than twice `flush` distinct grams, whose counts Spark adds up; no task holds more.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    pairs = docs.sample(sample, seed=7).select("text").mapInArrow(_pairs, "pair binary, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = written(pairs, "pairs")
    share = (pairs.agg(F.sum("n")).first()[0] or 0) // HOT + 1
    hot = frozenset(bytes(r.pair) for r in pairs.where(F.col("n") > share).collect())  # fewer than HOT
    blocks, buckets = docs.mapInArrow(_gram_blocks(hot, flush), _BLOCKS), FAN
    while buckets * bucket < size:
        buckets *= FAN
        blocks = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_dealt_again(buckets, hot, flush), _BLOCKS)
    counts = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_counts(least, hot, 2 * flush), "lang string, k int, phrase string, n bigint")
    out = counts.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return written(out.where((F.col("n") >= least) | (F.col("k") == 0)), "phrases")


def compact_paths(nodes: DataFrame, edges: DataFrame, width: int = 256) -> tuple[DataFrame, DataFrame]:
    """The graph with its unary paths compacted: (path, part, lang, words, nodes, edges), and the edges between paths.

    nodes and edges: lang, phrase, n. An edge that is the only one out of its node and the only one into the
    next joins the two into one path. A path's nodes find their place by pointer jumping, in as many rounds as the
    logarithm of the longest path; a cycle is cut at its smallest node. A path lies in rows of `width` nodes at
    most: words (three, and one for each edge), the counts of its nodes, and those of the edges behind each, null behind the path's last.
    """
    key = lambda phrase: F.concat_ws("\n", phrase, "lang")
    edges = written(edges.select("lang", "phrase", "n", key(F.substring_index("phrase", " ", 3)).alias("src"), key(F.substring_index("phrase", " ", -3)).alias("dst")), "edges")
    single = lambda end: edges.groupBy(end).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(end)
    links = written(edges.where("src <> dst").join(single("src"), "src").join(single("dst"), "dst").select("src", "dst", "n", F.substring_index("phrase", " ", -1).alias("word")), "links")
    groups = connected_components(links, "src", "dst")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    counted = links.join(groups, F.col("dst") == F.col("node")).groupBy("component").agg(F.count(F.lit(1)).alias("links"))
    cycles = sizes.join(counted, "component").where("nodes = links").select(F.col("component").alias("dst"))
    links = written(links.join(cycles, "dst", "left_anti"), "links")
    places = written(links.select(F.col("dst").alias("node"), F.col("src").alias("head"), F.lit(1).cast("long").alias("at")), "places")
    left = places.count()
    while left:
        far = places.select(F.col("node").alias("head"), F.col("head").alias("_head"), F.col("at").alias("_at"))
        places = written(places.join(far, "head", "left").select("node", F.coalesce("_head", "head").alias("head"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"), F.col("_at").isNotNull().alias("moved")), "places")
        left = places.where("moved").count()
        places = places.drop("moved")
    named = nodes.select("lang", "phrase", F.col("n").alias("count"), key(F.col("phrase")).alias("node"))
    out = links.select(F.col("src").alias("node"), F.col("n").alias("edge"), "word")
    rows = named.join(places, "node", "left").join(out, "node", "left")
    rows = rows.select("lang", F.coalesce("head", "node").alias("path"), F.coalesce("at", F.lit(0)).alias("at"), "phrase", "count", "edge", "word")
    part = rows.groupBy("path", F.floor(F.col("at") / width).alias("part")).agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "phrase", "count", "edge", "word"))).alias("s"))
    words = F.concat(F.split(F.col("s")[0]["phrase"], " "), F.array_compact(F.col("s.word")))
    paths = part.select("path", "part", "lang", words.alias("words"), F.col("s.count").alias("nodes"), F.col("s.edge").alias("edges"))
    return paths, edges.join(links.select("src", "dst"), ["src", "dst"], "left_anti").select("lang", "phrase", "n")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, percent: int = 80, text: str = "text", lang: str = "lang", flush: int = FLUSH, sample: float = 1 / 64) -> DataFrame:
    """The first `most` phrases of each language by how much their parts stick together.

    Texts, A-Z lower-cased, are split into pieces at .,;:!? and line ends, and those at spaces and tabs into
    words. f counts the occurrences of a phrase within pieces, by language (null: und). Candidates have 2 to 4
    words and a = f >= `least`. Cut after k words, l and r are f of the two parts and the score is
    floor(2000000 a / (l + r)), exact; the lowest-scoring cut counts, the smallest k of equal ones. Candidates
    that lie in a longer candidate of percent / 100 of their count go. Returns lang, rank (from 1), phrase, a, l, r, n
    (all words of the language) and score, by score, a and phrase.

    Candidates of three and four words are read off the compacted graph of frequent nodes and edges, those of two off
    the nodes' flows (see frequent_phrases and compact_paths). Null text counts as empty; repeated rows count
    again; no text, no rows; other columns are left behind.
    """
    slim = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    known = frequent_phrases(slim, least, flush, sample)
    paths, junctions = compact_paths(known.where("k = 3").drop("k"), known.where("k = 4").drop("k"))
    each = paths.select("lang", "words", F.posexplode(F.arrays_zip("nodes", "edges")).alias("at", "x"))
    part = lambda n: F.array_join(F.slice("words", F.col("at") + 1, F.lit(n)), " ")
    nodes = each.select("lang", F.lit(3).alias("size"), part(3).alias("phrase"), F.col("x.nodes").alias("a"))
    along = each.where("x.edges is not null").select("lang", F.lit(4).alias("size"), part(4).alias("phrase"), F.col("x.edges").alias("a"))
    between = junctions.select("lang", F.lit(4).alias("size"), "phrase", F.col("n").alias("a"))
    pairs = known.where("k = 2").select("lang", F.lit(2).alias("size"), "phrase", F.col("n").alias("a"))
    candidates = written(nodes.unionByName(along).unionByName(between).unionByName(pairs), "candidates")

    cuts = candidates.select("lang", "size", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    count = lambda c, name: known.where("k > 0").select("lang", F.col("phrase").alias(c), F.col("n").alias(name))
    cuts = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    whole = "cast({} as decimal(20, 0))"
    score = F.expr(f"(cast(2000000 as decimal(7, 0)) * {whole.format('a')}) div ({whole.format('l')} + {whole.format('r')})")
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(least_cut)

    inner = candidates.where("size > 2").select("lang", "a", "size", F.split("phrase", " ").alias("w"))
    starts = F.explode(F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))"))
    longest = inner.select("lang", "a", starts.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = scored.join(longest, ["lang", "phrase"], "left").where(f"longer is null or 100 * {whole.format('longer')} < {percent} * {whole.format('a')}")

    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)  # so that few rows meet in the last window
    first = open_.withColumn("_at", F.row_number().over(part)).where(F.col("_at") <= most)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    n = known.where("k = 0").select("lang", "n")
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
