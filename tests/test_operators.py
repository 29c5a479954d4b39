"""Hand-checked cases, properties, and empty or odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.functions import records as R
from speechlake.functions.components import connected_components
from speechlake.functions.prefix import prefix_sums
from speechlake.functions.ranking import range_bucket
from speechlake.operators import baselines as B
from speechlake.operators import corpus as C
from speechlake.operators import metrics as M
from speechlake.operators import privacy
from speechlake.operators import speaker as S
from speechlake.operators import splitting as P
from speechlake.operators import training as T
from speechlake.sources import files

SCORES = "label int, score double"


def points(spark, rows):
    return M.operating_points(spark.createDataFrame(rows, SCORES))


def test_perfect_scores(spark):
    p = points(spark, [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)])
    assert M.auc(p).first().auc == 1.0
    assert M.eer(p).first().eer == 0.0
    assert M.gap_eer(p).first()[:2] == (0.0, 0.8)
    assert M.select_threshold(p, "max_recall", max_far=0.0).first().threshold == 0.8


def test_ties_and_one_class(spark):
    assert M.auc(points(spark, [(1, 0.5), (0, 0.5)])).first().auc == 0.5
    one = M.detect(spark.createDataFrame([(1, 0.5), (1, 0.6)], SCORES), 0.55).first()
    assert one.auc is None and one.reason == "one class only" and one.tp == 1
    assert M.input_problem(spark.createDataFrame([(1, float("nan"))], SCORES)).first().reason == "scores that are not finite"
    assert M.input_problem(spark.createDataFrame([], SCORES)).first().reason == "no rows"


def test_threshold_without_a_fit_is_null(spark):
    assert M.select_threshold(points(spark, [(1, 0.1), (0, 0.9)]), "eer", max_far=-1.0).first().threshold is None


def test_probit(spark):
    got = spark.createDataFrame([(0.5,), (0.975,), (0.001,)], "p double").select(M.probit(F.col("p"))).collect()
    assert [round(r[0], 5) for r in got] == [0.0, 1.95996, -3.09023]


def test_prefix_sums_match_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 40) / 7, rng.randint(0, 5)) for _ in range(400)] + [("a", None, 9)]
    got = prefix_sums(spark.createDataFrame(rows, "k string, o double, v int"), ["k"], "o", ["v"], buckets=5).collect()
    for r in got:
        assert r.cum_v == sum(v for k, o, v in rows if k == r.k and o is not None and o >= r.o)


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_best_described_copy_is_kept(spark):
    rows = [("d", "a", "h", None, None), ("d", "b", "h", "s1", "c"), ("c", "z", "h", "s1", None), ("d", "n", None, None, None)]
    df = spark.createDataFrame(rows, "dataset_id string, sample_id string, file_hash string, speaker string, channel string")
    for c in ("generator", "language", "device", "session"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = {r.sample_id: (r.is_kept, r.group_size) for r in C.mark_duplicates(df).collect()}
    assert got == {"a": (False, 3), "b": (True, 3), "z": (False, 3), "n": (True, 1)}


def test_rejected_copy_does_not_take_the_place(spark):
    rows = [("a", "h", "x", "too_short", None), ("b", "h", "x", None, None), ("c", "h", "x", None, None)]
    df = spark.createDataFrame(rows, "sample_id string, file_hash string, content_hash string, code string, reason string")
    assert {r.sample_id: r.code for r in C.dedup_accepted(df).collect()} == {"a": "too_short", "b": None, "c": "duplicate"}


def test_null_tokens_and_families(spark):
    df = spark.createDataFrame([(" N/A ", "A07"), ("x", "Hi_Fi_GAN"), (None, None), ("-", "hifigan")], "v string, a string")
    got = df.select(R.known_or_unknown(F.col("v")), R.attack_family(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("unknown", "neural_waveform"), ("x", "vocoder"), ("unknown", None), ("unknown", "unclassified")]


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_splits_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        g = spark.createDataFrame([(f"g{i}", i % 5 + 1, i == 7) for i in range(60)], "grp string, size long, pinned boolean")
        got = {r.grp: r.split for r in P.capacity_fill(g.withColumn("key", F.sha2("grp", 256)), "key").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = {s: sum(i % 5 + 1 for i in range(60) if got[f"g{i}"] == s) for s in ("train", "dev", "test")}
    assert len(got) == 60 and got["g7"] == "test" and abs(sizes["train"] - 126) <= 5 and abs(sizes["dev"] - 27) <= 5


def test_baseline_by_hand(spark):
    rows = [("s", f"r{i}", f, v + off, True) for i, off in enumerate((0.0, 1.0, -1.0)) for f, v in (("pitch", 120.0), ("energy", 1.0), ("ratio", 2.0))]
    df = spark.createDataFrame(rows, "speaker string, sample string, feature string, value double, valid boolean")
    b = {r.feature: r for r in B.enroll(df, "speaker", "sample").collect()}
    assert (b["pitch"].n, b["pitch"].median, b["pitch"].mad) == (3, 120.0, 1.0)
    assert B.enroll(df.where("sample <> 'r2'"), "speaker", "sample").count() == 0


def test_enrolment_refuses_near_copies(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (1, 3, [1.0, 1e-6]), (1, 4, [0.0, 1.0]), (1, 5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "p int, s int, v array<double>")
    got = {r.s: r.outcome for r in S.accepted_samples(df, "p", "s", "v").collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "near_duplicate", 4: "accepted", 5: "invalid"}


def test_calibration_and_fallbacks(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < s), s**3) for s in (rng.random() for _ in range(400))]
    df = spark.createDataFrame(rows, SCORES)
    base = M.brier(df).first().brier
    for kind in ("platt", "isotonic"):
        c = T.fit_calibrator(df, kind)
        assert c.kind == kind and M.brier(c.calibrated(df)).first().brier < base
    assert T.fit_calibrator(df.limit(3)).kind == "identity"
    assert T.fit_calibrator(df.limit(60), "isotonic").kind == "platt"


def test_isotonic_scores_between_boundaries(spark):
    rng = random.Random(5)
    xs = sorted({round(rng.random(), 6) for _ in range(500)} | {0.3, 0.300001})
    ys = sorted(rng.uniform(-0.1, 1.1) for _ in xs)
    scores = [rng.uniform(-0.2, 1.2) for _ in range(400)] + xs[:50] + [xs[-1], None]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(scores)], "i int, score double, _cell int")
    got = {r.i: r.y for r in T.calibrator("isotonic", (xs, ys)).calibrated(df, name="y").collect()}
    assert len(got) == len(scores) and got[len(scores) - 1] is None
    for i, x in enumerate(scores[:-1]):
        assert abs(got[i] - min(1.0, max(0.0, np.interp(x, xs, ys)))) < 1e-9
    one = T.calibrator("isotonic", ([0.5], [0.7])).calibrated(df, name="y").where("score is not null")
    assert {r.y for r in one.collect()} == {0.7}
    sizes = [len(T.calibrator("isotonic", ([i / n for i in range(n)], [i / n for i in range(n)])).calibrated(df)._jdf.queryExecution().toString()) for n in (10, 100_000)]
    assert sizes[1] < 1.2 * sizes[0]


def test_logistic_learns_a_separable_table(spark):
    rng = random.Random(5)
    rows = [([(y := i % 2) * 2 + rng.gauss(0, 0.4), rng.gauss(0, 1)], y, ("train", "dev", "test")[i % 3]) for i in range(300)]
    got = {r.stage: r for r in T.run_baseline(spark.createDataFrame(rows, "v array<double>, label int, split string"), "v").collect()}
    assert got["test"].auc > 0.95
    bad = spark.createDataFrame(rows[:1], "v array<double>, label int, split string")
    assert T.run_baseline(bad, "v").first().outcome == "not_run"


def test_scorer_failures_are_unscored(spark):
    df = spark.range(3).withColumn("x", F.when(F.col("id") == 1, 7.0).otherwise(0.5))
    assert {r.id: r.score for r in T.score_with(df, lambda b: b["x"], "v", "id").collect()} == {0: 0.5, 1: None, 2: 0.5}
    assert all(r.score is None for r in T.score_with(df, lambda b: 1 / 0, "v", "id").collect())


def test_manifest_refuses_what_does_not_add_up(spark):
    rows = spark.createDataFrame([("a", "train"), ("b", "test")], "sample_id string, split string")
    path = files.new_path(spark, "m")
    with pytest.raises(ValueError, match="header"):
        spark.createDataFrame([], "schema_version int, build_id string, rows bigint").write.json(f"{path}0/header")
        files.read_manifest(spark, f"{path}0", rows.schema)
    files.write_manifest(rows, path, "b")
    assert files.read_manifest(spark, path, rows.schema).count() == 2
    rows.limit(1).write.mode("append").partitionBy("split").json(f"{path}/rows")
    with pytest.raises(ValueError, match="rows"):
        files.read_manifest(spark, path, rows.schema)


def test_scan_and_sidecar_aliases(spark, tmp_path):
    (tmp_path / "a" / ".hidden").mkdir(parents=True)
    for name in ("a/x.flac", "a/y.txt", "a/.hidden/z.wav", "a/w.WAV"):
        (tmp_path / name).write_bytes(name.encode())
    got = files.inventory(files.scan_files(spark, f"file://{tmp_path}"), 7)
    assert {r.path.rsplit("/", 1)[1]: r.quarantined for r in got.collect()} == {"x.flac": True, "w.WAV": False}
    (tmp_path / "one.csv").write_text("File , speakerid\nx.flac, s1\ny.flac\n")
    (tmp_path / "two.csv").write_text("filename,speaker\nx.flac,s2\n")
    out = files.read_sidecar(spark, [f"file://{tmp_path}/one.csv", f"file://{tmp_path}/two.csv"], {"filename": ["filename", "file"], "speaker": ["speakerid", "speaker"]})
    assert {r.filename: r.speaker for r in out.collect()} == {"x.flac": "s2", "y.flac": None}


def test_leakage_examples_are_limited_before_they_are_collected(spark):
    rows = [(str(v), s) for v in range(100) for s in ("train", "test")] + [("x", "dev"), (None, "dev")]
    got = C.check_leakage(spark.createDataFrame(rows, "speaker string, split string"), ["speaker"], examples=3)
    assert [tuple(r) for r in got.collect()] == [("speaker", 101, 100, True, "0,1,10")]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_near_equal_samples_match_a_plain_fold(spark):
    rng = random.Random(3)
    rows, hub = [], None
    for i in range(160):
        if i % 20 == 0:
            hub = [rng.gauss(0, 1) for _ in range(8)]
        size = sum(x * x for x in hub) ** 0.5
        hub = [x + rng.gauss(0, 0.001) * size for x in hub]  # a drift: near the last, not the first
        rows.append((i % 2, i, hub))
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    taken, want = {0: [], 1: []}, {}
    for p, i, v in rows:
        near = any(sum(x * y for x, y in zip(unit(v), u, strict=True)) >= 0.99999 for u in taken[p])
        want[i] = "near_duplicate" if near else "accepted"
        if not near:
            taken[p].append(unit(v))
    out = S.accepted_samples(spark.createDataFrame(rows, "p int, s int, v array<double>"), "p", "s", "v")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert {r.s: r.outcome for r in out.collect()} == want and len(set(want.values())) == 2


def test_screening_sees_every_level(spark):
    rows = {
        '{"a":{"email":"x"}}': "forbidden_key", '{"a":[{"phone":"n"}]}': "forbidden_key", '{"a":[[{"pcm":1}]]}': "forbidden_key", '{"Customer_Name":1}': "forbidden_key",
        '{"sample_rate_hz":16000,"name":"mel","address":"here"}': None, '{"telephone":"x","iban_":"y"}': "forbidden_key", '{"a":{"b":["a@b.org"]}}': "identifier_value", '{"a":"write to a@b.org"}': None,
        '{"a":" 123-45-6789 "}': "identifier_value", '{"a":"(555) 123-4567"}': "identifier_value", '{"a":"DE89370400440532013000"}': "identifier_value",
        '{"a":"say \\"email\\": x"}': None, '{"a":[' + ",".join(["1.5"] * 33) + "]}": "long_sequence", '{"a":[' + ",".join(["1"] * 32) + "]}": None,
        '{"a":{"b":[[' + ",".join(["-1e-3"] * 5000) + "]]}}": "long_sequence", '{"a":"[1,2]"}': None, "{}": None, "no json": "not_json", None: None,
    }
    got = {r.j: r.problem for r in privacy.screen(spark.createDataFrame([(j,) for j in rows], "j string"), "j").collect()}
    assert got == rows


def test_scrubbing_sees_every_level(spark):
    rows = {
        '{"a": {"email": {"x": 1}}, "audio_seconds": 3}': '{"a":{"email":"[redacted]"},"audio_seconds":3}', '{"a": [{"t": "a@b.org"}, "/home/me/x y"]}': '{"a":[{"t":"[redacted]"},"[redacted] y"]}',
        '{"a": ' + str(list(range(33))) + "}": '{"a":"[list len=33 redacted]"}', "[[[[[[[[1]]]]]]]]": "[[[[[[[[1]]]]]]]]", "no json": '"[redacted]"', None: None, '{"é": null}': '{"é":null}',
        '{"phone": {"x": [1, {"y": "a, b"}]}, "k": [[], {}, -1.5e3, true]}': '{"phone":"[redacted]","k":[[],{},-1.5e3,true]}', '{"em\\u0061il": 1, "k": "a\\u0040b.org"}': '{"email":"[redacted]","k":"[redacted]"}',
        "[" + ",".join(["[1]"] * 33) + "]": '"[list len=33 redacted]"', "[" + ",".join(["0"] * 32) + "]": "[" + ",".join(["0"] * 32) + "]", '{"a":1,"a":2}': '"[redacted]"', '"say \\"x\\" [,{"': '"say \\"x\\" [,{"',
        '{"a":' * 400 + "1" + "}" * 400: '{"a":' * 400 + "1" + "}" * 400, '{"a":' * 5000 + "1" + "}" * 5000: '"[redacted]"', "[" * 5000 + "]" * 5000: '"[redacted]"',
    }
    got = {r.j: r.s for r in spark.createDataFrame([(j,) for j in rows], "j string").select("j", privacy.scrub(F.col("j")).alias("s")).collect()}
    assert got == rows


def test_running_sums_of_several_values_and_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), float(rng.randint(-50, 50)), rng.randint(1, 5), 1) for _ in range(900)] + [("a", None, 7, 7)]
    df = spark.createDataFrame(rows, "k string, o double, v int, w int")
    for down in (True, False):
        got = prefix_sums(df, ["k"], "o", ["v", "w"], descending=down, width=7).collect()
        known = [r for r in rows if r[1] is not None]
        assert len(got) == len({r[:2] for r in known})
        for r in got:
            part = [x for x in known if x[0] == r.k and (x[1] >= r.o if down else x[1] <= r.o)]
            assert (r.cum_v, r.cum_w) == (sum(x[2] for x in part), len(part))


def test_fill_in_the_order_of_dates(spark):
    rows = [(f"g{i}", 1, False, f"2024{i % 12 + 1:02d}01000000") for i in range(240)]
    got = {r.grp: r.split for r in P.capacity_fill(spark.createDataFrame(rows, "grp string, size long, pinned boolean, key string"), "key").collect()}
    ordered = [got[g] for g, _, _, _ in sorted(rows, key=lambda r: (r[3], r[0]))]
    assert ordered == ["train"] * 168 + ["dev"] * 36 + ["test"] * 36


def test_range_buckets(spark):
    cuts = [3, 7, 8, 20, 21, 40, 41]
    got = [r.b for r in spark.range(50).select(range_bucket(F.col("id"), cuts).alias("b")).collect()]
    assert got == [sum(c < i for c in cuts) for i in range(50)] and spark.range(1).select(range_bucket(F.col("id"), []).alias("b")).first().b == 0


def test_artifacts_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([([float(i % 7), float(i % 3)], int(i % 7 > 3), i) for i in range(120)], "v array<double>, label int, i long")
    ready = T.with_features(rows, "v")
    model = T.fit_logistic(ready)
    on = T.scores(model, ready)
    for kind in ("platt", "isotonic"):
        made = T.Artifact(model, T.fit_calibrator(on, kind), 0.5, {"size": 2})
        T.save_artifact(spark, made, f"file://{tmp_path}/{kind}")
        back = T.load_artifact(spark, f"file://{tmp_path}/{kind}", {"size": 2})
        want, got = ({r.i: (r.score, r.flagged) for r in T.rescore(x, rows, "v").collect()} for x in (made, back))
        assert want == got and back.calibrator.kind == kind
        with pytest.raises(ValueError):
            T.load_artifact(spark, f"file://{tmp_path}/{kind}", {"size": 3})


def test_fields_of_odd_paths(spark):
    paths = ["", "a.wav", "gen/x.wav", "test/Fake/HIFIGAN/en/LJ001-2.wav", "orig/gen/melgan/7/x.flac", "EN-us/real/.wav", "generated/ /x", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string").withColumn("p", R.path_parts(F.col("path")))
    p = F.col("p")
    got = df.orderBy("i").select(
        R.folder_label(p).alias("l"), R.folder_generator(p).alias("g"), R.folder_split(p).alias("s"), R.folder_language(p, locale=True).alias("n"), R.stem_speaker(p).alias("k"), R.reading(p)["speaker"].alias("r")
    )
    u = "unknown"
    assert [tuple(r) for r in got.collect()] == [
        (u, u, u, u, u, u), (u, u, u, u, u, u), ("spoof", u, u, u, u, u), ("spoof", "hi_fi_gan", "test", "en", "LJ001", u),
        ("bona_fide", u, u, u, u, "7"), ("bona_fide", u, u, "en-us", u, u), ("spoof", u, u, u, u, u), (u, u, u, u, u, u),
    ]


def test_gate_passes_warns_and_refuses(spark):
    columns = "parent_id string, speaker string, device string, split string"
    good = spark.createDataFrame([("p", "s", "d", "train"), ("q", "t", "d", "test")], columns)
    report = C.gate_report(good, ["speaker"], ["speaker", "device"])
    assert {tuple(r) for r in report.collect()} == {("warning", "device", "1 values in more than one split"), ("gate", "passed", "0 failures")}
    C.assert_gates(report)
    bad = spark.createDataFrame([("p", None, "d", "train"), ("p", None, "d", "test"), ("q", None, None, None)], columns)
    report = C.gate_report(bad, ["speaker"], ["device"], fail_on_unavailable=True, least_test_sources=2)
    assert {r.subject for r in report.collect() if r.kind == "failure"} == {"speaker", "train->test", "test_sources", "split"}
    with pytest.raises(ValueError, match="speaker: no known values"):
        C.assert_gates(report)
    assert [r.subject for r in C.gate_report(good.limit(0), [], ["device"]).collect() if r.kind == "gate"] == ["failed"]


def test_a_sample_without_assignment_is_refused(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    splits = spark.createDataFrame([("a", "train")], "sample_id string, split string")
    assert C.assigned(rows.where("sample_id = 'a'"), splits).collect()[0].split == "train"
    with pytest.raises(Exception, match="no split is assigned to b"):
        C.assigned(rows, splits).collect()


@pytest.mark.parametrize("speakers", [0, 1, 2, 5, 6])
def test_ring_pairs_are_all_pairs_once_or_enough(spark, speakers):
    rows = spark.createDataFrame([(i, f"s{i}", 0) for i in range(speakers)], "recording_id int, speaker_id string, session int")
    pairs = lambda cap: [(r.speaker_a, r.speaker_b) for r in S.build_trials(rows, cap=cap).collect()]
    every = {(f"s{i}", f"s{j}") for i in range(speakers) for j in range(i + 1, speakers)}
    whole = pairs(1000)
    assert len(whole) == len(set(whole)) and set(whole) == every
    few = pairs(8)
    assert len(few) == len(set(few)) == min(4, len(every)) and set(few) <= every
