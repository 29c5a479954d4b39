"""Stratified placement against a greedy loop, weighted draws, exact quantiles and capped trials."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.functions.quantiles import exact_quantiles
from speechlake.operators import speaker as S
from speechlake.operators.sampling import weighted_draws
from speechlake.operators.splitting import group_sizes, stratified_fill
from speechlake.plans import QUERIES, SQL
from speechlake.plans.speaker_queries import EVERY_SCORE
from tests.test_queries import SF
from tests.test_queries import rows as plain_rows


def greedy(groups, ratios):
    """Split of each group, placed one by one where most is owed: groups of one label first, label by label."""
    totals = Counter()
    for _, classes in groups:
        totals.update(classes)
    owed = {s: {k: n * r for k, n in totals.items()} for s, r in ratios.items()}
    out = {}
    for g, classes in sorted(groups, key=lambda g: (len(g[1]) > 1, sorted(g[1]))):
        split = max(ratios, key=lambda s: round(sum(max(owed[s][k], 0) for k in classes), 9))
        out[g] = split
        for k, n in classes.items():
            owed[split][k] -= n
    return out


@pytest.mark.parametrize("seed, mixed", [(0, 0.0), (1, 0.3), (2, 0.9)])
def test_stratified_fill_agrees_with_a_greedy_loop(spark, seed, mixed):
    rng = random.Random(seed)
    rows, groups = [], []
    for g in range(300):
        classes = {k: rng.randint(1, 5) for k in (["a", "b"] if rng.random() < mixed else [rng.choice("aaab")])}
        groups.append((g, classes))
        rows += [(f"g{g}", k, g % 50 == 49) for k, n in classes.items() for _ in range(n)]
    ratios = {"train": 0.7, "dev": 0.15, "test": 0.15}
    df = spark.createDataFrame(rows, "grp string, label string, held boolean")
    sizes = group_sizes(df, {"held": [True]}, labels=True).withColumn("key", F.sha2("grp", 256))
    got = {r.grp: r.split for r in stratified_fill(sizes, "key").collect()}
    assert len(got) == 300 and all(got[f"g{g}"] == "test" for g in range(49, 300, 50))
    free = [x for x in groups if x[0] % 50 != 49]
    want, plain, mine = greedy([(g, c) for g, c in free] and [(f"g{g}", c) for g, c in free], ratios), Counter(), Counter()
    for g, classes in free:
        for k, n in classes.items():
            plain[want[f"g{g}"], k] += n
            mine[got[f"g{g}"], k] += n
    assert all(abs(plain[s, k] - mine[s, k]) <= (10 if not mixed else 24) for s in ratios for k in "ab"), (plain, mine)
    assert all(abs(sum(plain[s, k] for k in "ab") - sum(mine[s, k] for k in "ab")) <= 20 for s in ratios)


def test_stratified_fill_of_few_groups(spark):
    one = spark.createDataFrame([("g", "a")], "grp string, label string")
    assert [r.split for r in stratified_fill(group_sizes(one, labels=True).withColumn("key", F.col("grp")), "key").collect()] == ["train"]
    assert stratified_fill(group_sizes(one.limit(0), labels=True).withColumn("key", F.col("grp")), "key").count() == 0


def test_weighted_draws(spark):
    rows = [(i, w) for i, w in enumerate([1.0] * 50 + [30.0, 0.0, None, -2.0, 20.0])]
    df = spark.createDataFrame(rows, "i int, w double")
    got = weighted_draws(df, "i", "w", 20_000, seed="s")
    drawn = [(r.draw, r.i) for r in got.collect()]
    assert sorted(d for d, _ in drawn) == [*range(20_000)]
    count = Counter(i for _, i in drawn)
    for i, w in rows:
        p = (w or 0) / 100 if (w or 0) > 0 else 0
        assert abs(count[i] - 20_000 * p) <= 4 * (20_000 * p * (1 - p)) ** 0.5
    assert sorted(drawn) == sorted((r.draw, r.i) for r in weighted_draws(df.repartition(7), "i", "w", 20_000, seed="s").collect())
    assert weighted_draws(df.where("w <= 0"), "i", "w", 10).count() == 0 and weighted_draws(df.limit(0), "i", "w", 10).count() == 0


def test_exact_quantiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, rng.random(), float(rng.randint(0, 3))])) for _ in range(700)] + [("one", 1, 5.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double")
    values = defaultdict(list)
    for k, j, v in rows:
        if v is not None:
            values[k, j].append(v)
    at = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.k, r.j): r.q for r in exact_quantiles(df, ["k", "j"], "v", at).collect()}
    assert set(got) == set(values)
    for key, q in got.items():
        assert np.allclose(q, np.percentile(values[key], [100 * p for p in at]))
    assert exact_quantiles(df.limit(0), [], "v", at).count() == 0
    assert np.allclose(exact_quantiles(df, [], "v", [0.5]).first().q, np.median([v for *_, v in rows if v is not None]))


def test_capped_trials_have_no_join_of_all_pairs(spark):
    rows = [(i, f"s{i % 60}", i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "recording_id int, speaker_id string, session int")
    out = S.build_trials(df, cap=100)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert Counter(r.label for r in out.collect()) == {0: 50, 1: 50}


@pytest.fixture(scope="module")
def many_speakers(spark, tmp_path_factory):
    """A folder with embeddings of 200 and 120 speakers, two recordings each."""
    path, rng = str(tmp_path_factory.mktemp("speakers")), random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], i // 40 % 8) for i in range(640)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["trial_scores", "verification_metrics", "stratified_trials"])
def test_scores_are_of_every_trial(spark, many_speakers, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{many_speakers}/embeddings.parquet/*.parquet'")
    got, want = QUERIES[name](spark, many_speakers), con.sql(SQL[name])
    found = got.collect()
    assert plain_rows(got.columns, found) == plain_rows(want.columns, want.fetchall())
    every = 200 * 199 // 2 + 120 * 119 // 2 + 320
    if name == "trial_scores":
        assert len(found) == every
    if name == "stratified_trials":
        assert sum(r.n for r in found if r.axis == "split") == every


def test_speaker_evaluation_is_of_every_trial(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    found = con.sql(f"WITH {EVERY_SCORE} SELECT split, cross_session, label, score FROM ts").fetchall()
    of = lambda split, cross: [np.array([s for x, c, y, s in found if x == split and c in cross and y == label]) for label in (1, 0)]
    p, n = of("dev", (True, False))
    gap = lambda t: (round(abs((n >= t).mean() - (p < t).mean()), 12), -t)
    threshold = min({*p, *n}, key=gap)
    got = {r.cross_session: r for r in QUERIES["speaker_evaluation"](spark, SF).collect()}
    assert set(got) == {c for x, c, *_ in found if x == "test"}
    for cross, r in got.items():
        p, n = of("test", (cross,))
        assert (r.tp, r.fp, r.fn, r.tn) == ((p >= threshold).sum(), (n >= threshold).sum(), (p < threshold).sum(), (n < threshold).sum())
        assert r.brier == pytest.approx(np.concatenate([(p - 1) ** 2, n**2]).mean())
        if len(p) and len(n):
            assert r.auc == pytest.approx((np.sign(p[:, None] - n).mean() + 1) / 2)
    assert sum(r.tp + r.fp + r.fn + r.tn for r in got.values()) == sum(x == "test" for x, *_ in found) > 4000


def test_scoring_reads_the_embeddings_of_its_trials_once(spark, monkeypatch):
    rows = [(i, f"s{i // 20}", i % 3, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(2000)]
    df = spark.createDataFrame(rows, "recording_id long, speaker_id string, session long, embedding array<float>")
    trials, tables = S.build_trials(df.drop("embedding"), cap=50), {}

    def kept(table, name, w=S.written):
        tables[name] = w(table, name)
        return tables[name]

    monkeypatch.setattr(S, "written", kept)
    seen = spark.sparkContext.accumulator(0)
    vector = F.udf(lambda v: seen.add(1) or v, "array<float>").asNondeterministic()
    got = S.score_trials(trials, df.withColumn("embedding", vector("embedding")), "recording_id", "embedding").collect()
    vectors = {r[0]: np.array(r[3]) for r in rows}
    for r in got:
        a, b = vectors[r.enrol], vectors[r.test]
        assert abs(r.score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-9
    assert len(got) == 50 and seen.value <= len(rows)
    assert tables["vectors"].count() == len({x for r in got for x in (r.enrol, r.test)}) <= 100
