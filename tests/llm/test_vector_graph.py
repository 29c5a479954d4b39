"""Near vectors against all pairs, and on nulls, copies and empty tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.llm.vector_graph import audit, count_links, near_vectors

SCHEMA = "vec_id long, embedding array<float>"


def odd_vectors(seed=4):
    """Random vectors with pairs, chains, a dense cluster, a loose one, exact copies and rows that link with nothing."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    base = [unit(rng.standard_normal(32)) for _ in range(300)]
    beside = lambda x, cos: cos * x + np.sqrt(1 - cos * cos) * unit((r := rng.standard_normal(32)) - (r @ x) * x)
    vectors = [*base, *(beside(b, c) for b, c in zip(base[:60], np.linspace(0.88, 0.99, 60), strict=True))]
    at = base[70]
    for _ in range(8):  # a chain whose ends are far apart
        at = beside(at, 0.93)
        vectors.append(at)
    vectors += [beside(base[80], 0.995) for _ in range(150)] + [beside(base[81], 0.94) for _ in range(80)]
    rows = [(3 * i + 1, (v * rng.uniform(0.5, 3)).astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    rows += [(5000 + i, rows[80][1]) for i in range(40)] + [(9, rows[0][1]), rows[5], rows[5], (2, [0.0, -0.0, *rows[7][1][2:]]), (8, [-0.0, 0.0, *rows[7][1][2:]])]
    nan = float("nan")
    rows += [(6000, None), (6001, []), (6002, [0.0] * 32), (6003, [nan, *rows[0][1][1:]]), (6004, [None, *rows[0][1][1:]]), (6005, [float("inf"), *rows[0][1][1:]])]
    return rows + [(6006, [1.0, 2.0]), (6007, [1.0, 2.1]), (6008, [-1.0, 2.0]), (None, rows[0][1]), (None, None)]


def plain(rows, bound):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    good = [i for i, v in rows if False] or [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {k: set() for k in range(len(rows))}
    for size in {len(rows[k][1]) for k in good}:
        ks = [k for k in good if len(rows[k][1]) == size]
        x = np.array([np.float32(rows[k][1]) for k in ks], np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= bound - 1e-13), strict=True):
            if a != b:
                links[ks[a]].add(ks[b])
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo = [b for a in todo for b in links[a] if b not in seen and not seen.add(b)]
        least = None if i is None else min(rows[j][0] for j in seen)
        out.append((i, len(links[k]), least, i is None or i == least))
    return Counter(out)


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.createDataFrame(odd_vectors(), SCHEMA).repartition(4)
    return df.withColumns({c: F.lit(1) for c in ("v", "key", "node", "rep", "m", "c", "component", "n_links")})


@pytest.mark.parametrize("bound", [0.9, 0.97])
def test_near_vectors(vectors, bound):
    got = Counter(map(tuple, near_vectors(vectors, bound=bound, neighbours=6, most=12).collect()))
    assert got == plain(odd_vectors(), bound)


def test_count_links_in_blocks(spark):
    """Blocks of few rows, a core and rows outside it, copies that weigh more than one."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal(16) + np.array([rng.standard_normal(16) * s for s in (*[0.05] * 40, *[0.5] * 60)])
    m = rng.integers(1, 4, 100)
    members = spark.createDataFrame([(i % 2, i, int(m[i]), x[i].tolist()) for i in range(100)], "c long, node long, m long, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    same = (np.arange(100)[:, None] - np.arange(100)) % 2 == 0
    want = {i: int((linked & same)[i] @ m) for i in range(100)}
    assert {r.node: r.links for r in count_links(members, 0.9, block=7).collect()} == want


def test_audit_finds_links_that_are_missing(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 3, [1.0, -0.1]), (4, 4, [0.0, 1.0])]
    share, missed = audit(spark.createDataFrame(rows, "node long, c long, v array<double>"), 0.9, 10)
    assert share == 2 / 6  # of the six ends of links
    assert {tuple(r) for r in missed.collect()} == {(1, 3), (2, 3)}


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], SCHEMA)).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1, True), (2, 0, 2, True)]
