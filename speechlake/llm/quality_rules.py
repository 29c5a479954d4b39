"""Quality rules with host-level verdicts, in DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.functions.text import BLANK_CLASS, words
from speechlake.sources.shared import written

SYMBOLS = "#*$%&|<>"


def _dup_windows(docs: DataFrame) -> DataFrame:
    """Add n_repeat_words from the array _w of words: the words that lie in a 3-word window found twice.

    All in one row: hash the windows, and only where a hash comes twice sort (hash, position), keep the
    positions whose neighbour has the same hash and add up how many words they cover.
    """
    n = F.size("_w")
    hashes = F.when(n >= 3, F.transform(F.slice("_w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = docs.withColumn("_h", hashes)
    found = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = "array<struct<h:bigint,p:int>>"
    out = out.withColumn("_s", F.when(found, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).otherwise(F.array().cast(pairs)))
    s = F.col("_s")

    def twice(x: Column, i: Column) -> Column:
        return (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])

    out = out.withColumn("_p", F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["p"])))
    gaps = F.transform("_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), i + 1) - x, F.lit(3))))
    return out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long"))


def document_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, text: str = "text", n_lines: str | None = None) -> DataFrame:
    """Add the counts of each text, base_failed and, under the name n_lines if given, the number of lines with a word.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an
    earlier line), n_repeat_words and base_failed (too few words, or too many of them repeated).
    Null text counts as empty; repeated rows each get their own counts. Columns of docs that are named like
    a count give way.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_w": words(F.col(text)), "_lines": lines})
    out = _dup_windows(out)
    counted = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, BLANK_CLASS + "+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = [F.size("_lines").cast("long").alias(n_lines)] if n_lines else []
    return counted.select(*[c for c in docs.columns if c not in (*names, "base_failed")], *names, *more).withColumn("base_failed", failed)


#: The rules whose failures are counted by host: the base rules, and two that count against a document only at a flagged host.
RULES = ("base_failed", "symbols_failed", "lines_failed")


def host_rates(rated: DataFrame, host: str = "source", rules: tuple[str, ...] = ("base_failed",), spread: float = 1.0) -> DataFrame:
    """One row per host: n_docs and, for each rule (a boolean column), n_failed, host_rate and host_bound.

    host_rate is the host's failure rate shrunk towards all hosts, host_bound the prior's mean plus
    `spread` of its standard deviations. The prior is a beta distribution fitted by moments to the hosts'
    raw rates, each with the weight of its documents: mean m, variance v, strength m(1-m)/v - 1, held to
    1..1000 (1000 where the rates do not differ). Null is a host. With several rules the columns of all but the first end in _<rule>.
    """
    ends = ["" if i == 0 else f"_{r}" for i, r in enumerate(rules)]
    failures = [F.sum(F.col(r).cast("long")).alias(f"n_failed{e}") for r, e in zip(rules, ends, strict=True)]
    hosts = rated.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n_docs"), *failures)
    moments = []
    for e in ends:
        failed = F.col(f"n_failed{e}")
        moments += [(F.sum(failed) / F.sum("n_docs")).alias(f"_m{e}"), (F.sum(failed * failed / F.col("n_docs")) / F.sum("n_docs")).alias(f"_q{e}")]
    out = hosts.join(F.broadcast(hosts.agg(*moments)))  # one row: an aggregate without keys
    for e in ends:
        m, v = F.col(f"_m{e}"), F.col(f"_q{e}") - F.col(f"_m{e}") * F.col(f"_m{e}")
        strength = F.when(v * 1000 <= m * (1 - m), F.lit(1000.0)).otherwise(F.greatest(F.lit(1.0), m * (1 - m) / v - 1))
        out = out.withColumn(f"_k{e}", strength)
        out = out.withColumn(f"host_rate{e}", (F.col(f"n_failed{e}") + m * F.col(f"_k{e}")) / (F.col("n_docs") + F.col(f"_k{e}")))
        out = out.withColumn(f"host_bound{e}", m + spread * F.sqrt(m * (1 - m) / (F.col(f"_k{e}") + 1)))
    return out.drop(*[f"_{c}{e}" for c in "mqk" for e in ends])


def quality_rules(
    docs: DataFrame, host: str = "source", max_host_rate: float = 0.5, spread: float = 1.0, min_words: int = 50, max_repeat_percent: int = 50,
    max_symbol_percent: int = 10, max_dup_line_percent: int = 30, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Judge each document by its own rules and by its host's shrunk failure rates.

    Failures are counted by host for three rules: the base rules, symbols (more than max_symbol_percent
    of the characters in words) and repeated lines (more than max_dup_line_percent of the lines with a
    word). The base rules reject a document anywhere. A host is rejected whole where its shrunk rate of
    the first rule is above max_host_rate. The two others are signs, not faults: they reject a document
    only at a host that is flagged for that rule, which it is where its shrunk rate is above the
    prior's mean by `spread` standard deviations. So a small host with a few failures is spared, and a
    host that differs from the others is held to more rules.

    Returns one row per input row: the columns in keep, the counts of document_rules, base_failed,
    symbols_failed, lines_failed, host_rate, host_rejected (the host's verdict on this document) and kept
    (neither failed nor rejected). An empty table gives an empty one. The counts are written once to the
    shared folder, so the texts are read once. Hosts are pre-aggregated before the shuffle and their
    verdicts stored, so that Spark knows their size: a small table is broadcast to the rows, a large one
    meets them in a join whose large partitions Spark can split.
    """
    slim = docs.select(*[F.col(c) for c in keep], F.col(host).alias("_source"), F.col(text).alias("_text"))
    rated = document_rules(slim, min_words, max_repeat_percent, "_text", n_lines="_n_lines").drop("_text")
    rated = rated.withColumns(
        {
            "symbols_failed": 100 * F.col("n_symbols") > max_symbol_percent * F.col("word_chars"),
            "lines_failed": 100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("_n_lines"),
        }
    )
    rated = written(rated.drop("_n_lines"), "quality")
    hosts = host_rates(rated, "_source", RULES, spread)
    flags = [(F.col(f"host_rate_{r}") > F.col(f"host_bound_{r}")).alias(f"_flag_{r}") for r in RULES[1:]]
    verdicts = written(hosts.select("_host", "host_rate", (F.col("host_rate") > max_host_rate).alias("_whole"), *flags), "hosts")
    joined = rated.join(verdicts, rated["_source"].eqNullSafe(verdicts["_host"]), "left").drop("_source", "_host")
    rejected = F.col("_whole")
    for r in RULES[1:]:
        rejected = rejected | (F.col(f"_flag_{r}") & F.col(r))
    out = joined.withColumn("host_rejected", rejected).drop("_whole", *[f"_flag_{r}" for r in RULES[1:]])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
