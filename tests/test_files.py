"""Inventories of files and the headers of manifests."""

import hashlib

import pytest

from speechlake.sources import files
from speechlake.sources.shared import new_path


def test_file_inventory(spark, tmp_path, monkeypatch):
    for name, body in (("a.wav", b"x" * 10), ("sub/b.WAV", b"x" * 10), ("c.flac", b"y" * 500), ("d.txt", b"no"), (".hidden/e.wav", b"z"), ("f.wav", b""), ("gone.wav", b"q")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    scan = files.scan_files
    # a file that the listing has and the scan of contents fails on
    monkeypatch.setattr(files, "scan_files", lambda *a: scan(*a).where("path not like '%gone.wav'") if len(a) > 3 else scan(*a))
    found = files.file_inventory(spark, str(tmp_path), max_bytes=100)
    got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.file_hash, r.problem) for r in found.collect()}
    digest = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    assert got == {
        "a.wav": (10, digest(b"x" * 10), None), "b.WAV": (10, digest(b"x" * 10), None), "c.flac": (500, None, "file_too_large"), "gone.wav": (1, None, "unreadable"),
    }
    twice = files.duplicate_files(found).collect()
    assert [(r.copies, [p.rsplit("/", 1)[1] for p in r.paths]) for r in twice] == [(2, ["a.wav", "b.WAV"])]


def test_long_files_are_not_opened(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"x")
    plan = files.scan_files(spark, str(tmp_path), max_bytes=100)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan


def test_a_manifest_without_its_header_is_refused(spark, monkeypatch):
    path, rows = new_path(spark, "manifest"), spark.createDataFrame([("a", "train"), ("b", "dev")], "sample_id string, split string")
    files.write_manifest(rows, path, "b1")
    assert files.read_manifest(spark, path, rows.schema).count() == 2
    monkeypatch.setattr(files, "SCHEMA_VERSION", lambda: None)  # the writer dies between the rows and the new header
    with pytest.raises(Exception):
        files.write_manifest(rows, path, "b2")
    monkeypatch.undo()
    with pytest.raises(Exception):
        files.read_manifest(spark, path, rows.schema)


def test_a_refused_build_leaves_its_reports_and_nothing_published(spark):
    from speechlake.operators.jobs import inspect_job, publish_job
    from speechlake.sources.versions import current

    rows = [(f"s{i}", f"d{i % 2}", f"spk{i % 12}", f"p{i}", f"h{i}", "en", "bona_fide", float(i % 50), 100, None) for i in range(60)]
    names = "sample_id string, dataset_id string, speaker string, parent_id string, file_hash string, language string, label string, duration_s double, file_bytes int, split string"
    records = spark.createDataFrame(rows, names).selectExpr("*", "duration_s as speech_s", "true as usable", "file_hash as content_hash", "cast(null as string) as session", "'c' as channel", "cast(null as string) as generator", "'x' as device")
    path = new_path(spark, "build")
    with pytest.raises(ValueError, match="device"):  # one device for all: it leaks
        publish_job(records, f"{path}/m", f"{path}/r", "b1", required=("speaker", "device"))
    assert current(spark, f"{path}/m") is None
    for report in ("validation", "scopes", "rejected", "splits", "leakage", "gates"):
        assert spark.read.json(f"{path}/r/{report}").count() > 0
    publish_job(records, f"{path}/m", f"{path}/r", "b2")
    assert {r.build_id for r in spark.read.json(f"{path}/r/rejected").select("build_id").distinct().collect()} == {"b1", "b2"}
    found, tallies = inspect_job(spark, f"{path}/m", "all", ["s30", "s31", "s0"])
    assert sorted(r.sample_id for r in found.collect()) == ["s30", "s31"]  # s0 is too short
    assert {r.value: r.rows for r in tallies.where("axis = 'language'").collect()} == {"en": inspect_job(spark, f"{path}/m")[1].where("axis = 'label'").first().rows}


def test_many_folders_are_listed_by_tasks(spark, tmp_path):
    path, n = f"file://{tmp_path}/many", 40_500
    rows = spark.range(n).selectExpr("concat('f', id, '.txt') as name", "cast(if(id = 7, null, concat('x', id % 40000)) as binary) as content")
    assert files.write_files(rows, path) == n
    assert len(list((tmp_path / "many").iterdir())) == 40
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    files.scan_files(spark, path, ("txt",))
    assert len(tracker.getJobIdsForGroup("listing")) == 1
    found = files.file_inventory(spark, path, ("txt",))
    assert found.where("problem is null").count() == n - 1  # Spark does not list the one of no bytes
    twice = files.duplicate_files(found).selectExpr("count(*)", "max(copies)").first()
    assert tuple(twice) == (499, 2)
    body = lambda name: next((tmp_path / "many").glob(f"*/{name}")).read_bytes()
    assert body("f40001.txt") == b"x1" and body("f7.txt") == b""


def test_an_empty_folder_and_loose_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert files.scan_files(spark, str(tmp_path / "none")).count() == 0
    for name in ("a.wav", "_b=1/c.wav", "_d/e.wav"):
        (tmp_path / "some" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "some" / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.scan_files(spark, str(tmp_path / "some")).collect()) == ["a.wav", "c.wav"]


def test_a_task_takes_many_small_files(spark, tmp_path):
    (tmp_path / "small" / "sub").mkdir(parents=True)
    (tmp_path / "none").mkdir()
    for i in range(300):
        (tmp_path / "small" / "sub" / f"{i}.wav").write_bytes(b"x%d" % (i % 200))
    tracker, size = spark.sparkContext.statusTracker(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # what Spark adds to each file: a part of its own for each
    spark.sparkContext.setJobGroup("inventory", "")
    try:
        found = files.file_inventory(spark, str(tmp_path / "small"))
        assert sorted(r.copies for r in files.duplicate_files(found).collect()) == [2] * 100
        assert found.where("problem is null").count() == 300
        stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup("inventory") for s in tracker.getJobInfo(job).stageIds]
        assert max(s.numTasks for s in stages if s) <= 8 * spark.sparkContext.defaultParallelism < 300
        assert files.file_inventory(spark, str(tmp_path / "none")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.sparkContext.setJobGroup("", "")


def test_contents_are_shuffled_only_where_they_lie_unevenly(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 400, 1, 4).selectExpr("concat('f', id, '.txt') as name", "cast(concat('x', id) as binary) as content")
    calls, repartition = [], type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: calls.append(a) or repartition(self, *a))
    assert files.write_files(rows, f"file://{tmp_path}/even") == 400 and calls == []
    assert files.write_files(rows.coalesce(1), f"file://{tmp_path}/uneven") == 400 and len(calls) == 1
    found = [{str(f.relative_to(tmp_path / name)): f.read_bytes() for f in (tmp_path / name).rglob("f*.txt")} for name in ("even", "uneven")]
    assert found[0] == found[1] and len(found[0]) == 400
    assert files.write_files(rows.limit(0), f"file://{tmp_path}/none") == 0
