"""Phrases against plain counts of every gram, the compacted graph against its edges, and odd texts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from speechlake.llm.phrase_graph import collocations, compact_paths, frequent_phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_texts(seed=3):
    rng = random.Random(seed)
    words = ["a", "B", "c", "é", "É", "dd", "e-e", "'f", "g h", "ı"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randint(0, 40)))) for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(700))  # a path over several rows
    rows += [("en", passage), ("en", passage.upper()), ("fr", passage), ("en", passage)]
    rows += [("en", "x y " * 30), ("de", "round and round and " * 9), ("en", None), (None, ""), ("en", " \t.,;:!?\r\x0b "), ("en", "z " * 3000)]
    return rows + rows[:5]


def grams():
    count = defaultdict(Counter)
    for lang, text in odd_texts():
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            ws = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                count[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return count


def plain(least, most, percent):
    out = set()
    for lang, f in grams().items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        candidates = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        longer = Counter()
        for g, c in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i : i + k]] = max(longer[g[i : i + k]], c)
        for g, a in candidates.items():
            if 100 * longer[g] >= percent * a:
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:most], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(odd_texts(), "lang string, text string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("k", "n", "phrase", "bucket", "a", "score")})


@pytest.mark.parametrize("sample, flush", [(0.0, 1 << 19), (1.0, 50)])
def test_collocations(docs, sample, flush):
    """Without hot pairs and with most pairs hot, added up in one piece and in many."""
    got = collocations(docs, least=3, most=40, sample=sample, flush=flush).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == plain(3, 40, 80)


def test_counts_and_paths(spark, docs):
    slim = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    known = frequent_phrases(slim, 3, 100, 1.0, bucket=10)  # dealt twice
    want = {(lang, len(g), " ".join(g), c) for lang, f in grams().items() for g, c in f.items() if c >= 3}
    assert {tuple(r) for r in known.where("k > 0").collect()} == want
    nodes, edges = known.where("k = 3").drop("k"), known.where("k = 4").drop("k")
    paths, between = compact_paths(nodes, edges, width=256)
    found_nodes, found_edges, longest = Counter(), Counter(map(tuple, between.select("lang", "phrase", "n").collect())), 0
    for r in paths.collect():
        for i, (n, e) in enumerate(zip(r.nodes, r.edges, strict=True)):
            found_nodes[r.lang, " ".join(r.words[i : i + 3]), n] += 1
            if e is not None:
                found_edges[r.lang, " ".join(r.words[i : i + 4]), e] += 1
        longest = max(longest, len(r.nodes))
    assert found_nodes == Counter((r.lang, r.phrase, r.n) for r in nodes.collect())
    assert found_edges == Counter((r.lang, r.phrase, r.n) for r in edges.collect())
    assert longest == 256  # the passage is one path of 698 nodes in three rows
    assert paths.where("path like 'p0 p1 p2%'").count() == 3


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
