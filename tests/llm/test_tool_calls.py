"""Topological places of tool calls against a plain search, on chains, cycles, unknown ids and ties."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from speechlake.llm import tool_calls
from speechlake.llm.tool_calls import call_places, link_tool_calls

SCHEMA = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, depends array<string>"


def odd_calls(seed=8):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        n = rng.randint(1, 7)
        for i in range(n):
            depends = [f"c{rng.randint(0, n + 1)}" for _ in range(rng.choice([0, 0, 1, 1, 2]))]
            rows.append((conv, rng.choice([i, i, 2 * n - i]), "assistant", "t", f"c{i}", "f", "{}", depends or rng.choice([None, []])))
            rows.append((conv, rng.randint(0, 9), "tool", f"r{i}", f"c{i}", None, None, None))
        rows.append((conv, rng.randint(0, 9), "user", "hi", None, None, None, None))
    rows += [(100, 50 - i, "assistant", "t", f"c{i}", "f", "{}", [f"c{i - 1}"]) for i in range(12)]  # each waits for a later turn's
    return rows


def plain(rows):
    """(conv, call) to (key, depth, stuck), by the largest (turn, 0) or (key, depth + 1) of what a call waits for."""
    calls = {(c, i): (t, d or []) for c, t, _, _, i, tool, _, d in rows if tool}
    deps = {k: {(k[0], d) for d in ds if (k[0], d) in calls} for k, (_, ds) in calls.items()}

    def reaches(start):
        seen, todo = set(), [*deps[start]]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += deps[k]
        return seen

    closure = {k: reaches(k) for k in calls}
    cyclic = {k for k in calls if k in closure[k]}
    stuck = {k for k in calls if k in cyclic or closure[k] & cyclic}
    found = {}

    def value(k):
        if k not in found:
            found[k] = max([(calls[k][0], 0), *((key, depth + 1) for key, depth in map(value, deps[k]))])
        return found[k]

    return {k: (calls[k][0], 0, True) if k in stuck else (*value(k), False) for k in calls}, deps, calls


def test_call_places(spark):
    rows = odd_calls()
    calls = spark.createDataFrame(rows, SCHEMA).where("tool is not null")
    want, _, turns = plain(rows)
    got = {(r.conv_id, r.call_id): (r.key, r.depth, r.stuck) for r in call_places(calls).collect()}
    assert got == {k: v if not v[2] else (turns[k][0], 0, True) for k, v in want.items()}
    assert sum(v[2] for v in got.values()) >= 20 and max(v[1] for v in got.values()) == 11


def test_calls_stand_behind_the_results_that_they_need(spark):
    rows = odd_calls()
    want, deps, _ = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "depth", "stuck", "_turn", "moved")})
    at, results = {}, defaultdict(int)
    got = link_tool_calls(df, {"f": {}}).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.status in ("call", "stuck"):
            at[r.conv_id, r.call_id] = r.position
            assert (r.status == "stuck") == want[r.conv_id, r.call_id][2]
        elif r.status == "result":
            results[r.conv_id, r.call_id] = r.position
    for k, ds in deps.items():
        assert k not in results or results[k] > at[k]
        if not want[k][2]:
            assert all(at[d] < at[k] and results.get(d, -1) < at[k] for d in ds)


def long_calls():
    """A chain told backwards and one in a shuffled order, a circle with calls in order behind it, and a ladder in order, of 100 calls each."""
    order = random.Random(1).sample(range(100), 100)
    rows = [(1, 100 - i, f"c{i}", [f"c{i - 1}"]) for i in range(100)]
    rows += [(2, order[i], f"c{i}", [f"c{i - 1}"]) for i in range(100)]
    rows += [(3, i, f"c{i}", [f"c{(i + 1) % 50}"] if i < 50 else [f"c{i - 1}", f"c{i - 2}"] if i < 53 else [f"c{i - 1}"]) for i in range(100)]
    rows += [(4, i, f"c{i}", ["c1"] if i == 0 else [f"c{j}" for j in range(i)][-5:] if i > 1 else []) for i in range(100)]
    return [(conv, turn, "assistant", "t", call, "f", "{}", depends) for conv, turn, call, depends in rows]


def test_chains_need_few_rounds(spark, monkeypatch):
    rows, tables = long_calls(), []
    monkeypatch.setattr(tool_calls, "written", lambda df, name, w=tool_calls.written: tables.append(name) or w(df, name))
    want = plain(rows)[0]
    got = {(r.conv_id, r.call_id): (r.key, r.depth, r.stuck) for r in call_places(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    assert sum(v[2] for v in got.values()) == 100 and got[1, "c99"][1] == 99
    assert tables.count("places") <= 12


def test_no_calls(spark):
    assert call_places(spark.createDataFrame([], SCHEMA)).count() == 0
    one = link_tool_calls(spark.createDataFrame([(1, 1, "user", "x", None, None, None, None)], SCHEMA), {}).first()
    assert (one.status, one.position) == ("message", 0)
