"""Manifest sets, versioned tables and profiles: what a crash, a lost race or a wrong change leaves behind."""

import datetime

import pytest
from pyspark.sql import functions as F

from speechlake.operators.profiles import SCHEMA, ProfileError, Profiles
from speechlake.sources import versions
from speechlake.sources.manifests import manifest_names, read_manifest_set, write_manifest_set
from speechlake.sources.shared import new_path
from speechlake.sources.versions import LostRace, VersionedTable, commit, current, purge

ROWS = [("a1", "train", "h1", "en", None), ("a2", "train", "h1", "en", "licence"), ("b1", "dev", "h2", "en", None), ("c1", "test", "h3", "de", None), ("c2", "test", "h4", None, None)]
COLUMNS = "sample_id string, split string, file_hash string, language string, removed_reason string"


def test_manifest_set(spark):
    path = new_path(spark, "manifests")
    rows = spark.createDataFrame(ROWS, COLUMNS)
    write_manifest_set(rows, path, "b1", {"language": ["de"], "split": ["nowhere"]})
    assert manifest_names(spark, path) == {
        "all": {"rows": 5, "active": 4}, "train": {"rows": 2, "active": 1}, "dev": {"rows": 1, "active": 1}, "test": {"rows": 2, "active": 2}, "test_cross_language": {"rows": 1, "active": 1},
    }
    assert sorted(tuple(r)[:5] for r in read_manifest_set(spark, path).collect()) == sorted(ROWS, key=lambda r: r[0])
    assert [r.sample_id for r in read_manifest_set(spark, path, "test_cross_language").collect()] == ["c1"]
    assert current(spark, path).facts["within_split_duplicates"] == 1
    for name in ("all", "train", "dev", "test", "test_cross_language"):
        assert {r.build_id for r in read_manifest_set(spark, path, name).collect()} == {"b1"}
    with pytest.raises(ValueError, match="no manifest test_cross_split"):
        read_manifest_set(spark, path, "test_cross_split")
    with pytest.raises(ValueError, match="holds no manifests"):
        read_manifest_set(spark, new_path(spark, "nothing"))


def test_another_build_needs_overwrite(spark):
    path = new_path(spark, "manifests")
    rows = spark.createDataFrame(ROWS, COLUMNS)
    write_manifest_set(rows, path, "b1")
    with pytest.raises(ValueError, match="overwrite"):
        write_manifest_set(rows, path, "b2")
    assert current(spark, path).facts["build_id"] == "b1"
    write_manifest_set(rows.where("split <> 'dev'"), path, "b1")  # a build may replace itself
    assert read_manifest_set(spark, path).count() == 4
    write_manifest_set(rows, path, "b2", overwrite=True)
    assert read_manifest_set(spark, path, "train").first().build_id == "b2"


@pytest.mark.parametrize(
    "change, rule",
    [
        ("removed_reason = 'all'", "all_retired"), ("sample_id = 'a1'", "duplicate_ids"), ("split = case when sample_id = 'a1' then 'hold' else split end", "stray_split"),
        ("split = case when sample_id = 'a1' then null else split end", "stray_split"), ("file_hash = 'h'", "cross_split_content"), ("build_id = sample_id", "mixed_builds"),
    ],
)
def test_bad_rows_are_not_published(spark, change, rule):
    path = new_path(spark, "manifests")
    write_manifest_set(spark.createDataFrame(ROWS, COLUMNS), path, "b1")
    column, value = change.split(" = ", 1)
    with pytest.raises(ValueError, match=rule):
        write_manifest_set(spark.createDataFrame(ROWS, COLUMNS).withColumn(column, F.expr(value)), path, "b1")
    with pytest.raises(ValueError, match="empty"):
        write_manifest_set(spark.createDataFrame([], COLUMNS), path, "b1")
    assert read_manifest_set(spark, path).count() == 5  # what was there is still there


def test_a_killed_writer_leaves_the_old_set(spark, monkeypatch):
    path = new_path(spark, "manifests")
    rows = spark.createDataFrame(ROWS, COLUMNS)
    write_manifest_set(rows, path, "b1")
    monkeypatch.setattr(versions, "bytearray", lambda *a: 1 / 0, raising=False)  # dies behind the rows, while the pointer is written
    with pytest.raises(ZeroDivisionError):
        write_manifest_set(rows.where("split = 'train'"), path, "b1")
    monkeypatch.undo()
    assert read_manifest_set(spark, path).count() == 5
    write_manifest_set(rows.where("split = 'train'"), path, "b1")
    assert read_manifest_set(spark, path).count() == 2 and purge(spark, path) == 2


def test_lost_race(spark):
    path = new_path(spark, "table")
    a, b = (VersionedTable(spark, path, "i long") for _ in range(2))
    assert a.read().count() == 0 and b.read().count() == 0
    a.append(spark.range(3).toDF("i"))
    with pytest.raises(LostRace):
        b.append(spark.range(5).toDF("i"))
    with pytest.raises(LostRace):  # both past the check: the rename decides
        commit(spark, path, lambda folder: {"parts": []}, 0)
    assert b.read().count() == 3
    b.append(spark.range(5).toDF("i"))
    assert a.read().count() == 8
    a.rewrite(a.read().where("i < 2"))
    assert sorted(r.i for r in b.read().collect()) == [0, 0, 1, 1] and purge(spark, path) == 2 and b.read().count() == 4


IDS = [f"00000000-0000-4000-a000-00000000000{i}" for i in range(4)]
WHEN = datetime.datetime(2024, 1, 1)


def profile(i, **changes):
    row = {"profile_id": IDS[i], "version": 1, "encoder": "e", "dimension": 2, "centroid": [0.6, 0.8], "samples": 1, "consent": "c", "created_at": WHEN, "expires_at": None, "active": True}
    return tuple((row | changes).values())


@pytest.fixture
def store(spark):
    store = Profiles(spark, new_path(spark, "profiles"))
    store.create(spark.createDataFrame([profile(0), profile(1, expires_at=WHEN)], SCHEMA))
    return store


def test_profiles_change_by_version(spark, store):
    rows = lambda *p: spark.createDataFrame([*p], SCHEMA)
    now = F.lit(WHEN + datetime.timedelta(days=1))
    assert [r.profile_id for r in store.active(now).collect()] == [IDS[0]]
    with pytest.raises(ProfileError, match="already"):
        store.create(rows(profile(1), profile(2)))
    with pytest.raises(ProfileError, match="twice"):
        store.create(rows(profile(2), profile(2)))
    with pytest.raises(ProfileError, match="missing"):
        store.get(rows(profile(2)))
    for version in (1, 3):
        with pytest.raises(ProfileError, match="follow"):
            store.update(rows(profile(0, version=version)))
    store.update(rows(profile(0, version=2, samples=9)))
    store.deactivate(rows(profile(0)))
    found = store.get(rows(profile(0))).first()
    assert (found.version, found.samples, found.active) == (3, 9, False)
    with pytest.raises(ProfileError, match="inactive"):
        store.deactivate(rows(profile(0)))
    assert store.delete(rows(profile(0), profile(3))) == 1 and store.delete(rows(profile(0))) == 0
    assert [r.profile_id for r in store.all().collect()] == [IDS[1]]


@pytest.mark.parametrize(
    "changes, problem",
    [
        ({"profile_id": "anna"}, "not_a_uuid"), ({"version": 0}, "no_version"), ({"dimension": 3}, "dimension"), ({"centroid": None}, "dimension"), ({"consent": " "}, "no_consent"), ({"consent": None}, "no_consent"),
        ({"samples": 0}, "no_samples"), ({"active": False}, "inactive_at_first"), ({"centroid": [float("nan"), 1.0]}, "not_finite"), ({"centroid": [1.0, 1.0]}, "not_of_unit_length"), ({"created_at": None}, "no_date"),
    ],
)
def test_broken_profiles_are_refused(spark, store, changes, problem):
    with pytest.raises(ProfileError, match=problem):
        store.create(spark.createDataFrame([profile(2, **changes)], SCHEMA))
    assert store.all().count() == 2
