"""Runs, neighbours and intervals by ranges against plain loops, on one long series and on many."""

import random
from itertools import groupby

import pytest

from speechlake.functions.islands import merged_intervals, with_previous, with_runs
from speechlake.operators import signal as G


def series(seed, one):
    rng = random.Random(seed)
    out = {}
    for s in ["only"] if one else ["a", "b", None, "short"]:
        n, flags = 1 if s == "short" else rng.randint(150, 400), []
        while len(flags) < n:  # runs of one and runs over many ranges
            flags += [not flags[-1] if flags else True] * rng.choice([1, 1, 2, 5, 40])
        out[s] = flags[:n]
    return out


@pytest.mark.parametrize("one", [True, False])
@pytest.mark.parametrize("width", [1, 7, 4096])
def test_runs_in_ranges(spark, one, width):
    data = series(width, one)
    df = spark.createDataFrame([(s, i, f) for s, flags in data.items() for i, f in enumerate(flags)], "s string, i long, f boolean").repartition(3)
    got = {(r.s, r.i): r for r in with_runs(df, ["s"], "i", "f", width=width).collect()}
    before = {(r.s, r.i): r.p for r in with_previous(df, ["s"], "i", "f", "p", width=width).collect()}
    assert len(got) == len(before) == sum(map(len, data.values()))
    for s, flags in data.items():
        runs, i = [(f, len([*g])) for f, g in groupby(flags)], 0
        for k, (f, n) in enumerate(runs):
            for _ in range(n):
                r = got[s, i]
                assert (r.f, r.run, r.run_length, r.first_run, r.last_run) == (f, k, n, k == 0, k == len(runs) - 1)
                assert before[s, i] == (flags[i - 1] if i else None)
                i += 1


@pytest.mark.parametrize("width", [0.5, 10.0, 1e6])
def test_intervals_in_ranges(spark, width):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), round(a, 2), round(a + rng.choice([0.1, 0.5, 30]), 2)) for a in (rng.uniform(-5, 400) for _ in range(300))]
    rows += rows[:20]
    want = []
    for s in ("a", None):
        spans = sorted((a, b) for k, a, b in rows if k == s)
        low, high = spans[0]
        for a, b in spans[1:]:
            if a - high > 0.3:
                want.append((s, low, high))
                low, high = a, b
            high = max(high, b)
        want.append((s, low, high))
    got = merged_intervals(spark.createDataFrame(rows, "s string, a double, b double").repartition(4), ["s"], "a", "b", 0.3, width=width)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_segments_of_one_long_signal(spark):
    flags = series(9, True)["only"]
    df = spark.createDataFrame([("only", i, f) for i, f in enumerate(flags)], "s string, i long, f boolean")
    n, window, hop = len(flags), 20, 6
    starts = sorted({*range(0, n - window + 1, hop), n - window})
    want = [(s, s + window, sum(flags[s : s + window])) for s in starts if sum(flags[s : s + window]) / window >= 0.25]
    got = G.segments(df, "s", "i", "f", window, hop).orderBy("segment").collect()
    assert [(r.start, r.stop, r.speech) for r in got] == want and [r.segment for r in got] == [*range(len(want))]
    short = df.where("i < 5")
    assert [(r.start, r.stop) for r in G.segments(short, "s", "i", "f", window, hop, least_coverage=0.0).collect()] == [(0, 5)]
    assert G.segments(short, "s", "i", "f", window, hop, pad_short=False).count() == 0 and G.segments(df.limit(0), "s", "i", "f", window, hop).count() == 0


def test_sign_changes_over_ranges(spark):
    rng = random.Random(1)
    values = [rng.choice([-1.0, 1.0, 0.0]) for _ in range(9000)]
    df = spark.createDataFrame([("only", i, v) for i, v in enumerate(values)], "s string, i long, v double").repartition(4)
    sign = lambda x: (x > 0) - (x < 0)
    for r in G.frames(df, "s", "i", "v", 100, 50).where("frame % 7 = 3 or frame between 80 and 84").collect():
        part = values[50 * r.frame : 50 * r.frame + 100]
        assert r.n == 100 and r.zcr == sum(sign(a) != sign(b) for a, b in zip(part, part[1:], strict=False)) / 99
