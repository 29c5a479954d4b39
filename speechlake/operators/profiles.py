"""The life of speaker profiles: created once, updated by version, deactivated, deleted, in bulk over a versioned table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions.vectors import norm
from speechlake.sources.shared import written
from speechlake.sources.versions import VersionedTable

SCHEMA = "profile_id string, version int, encoder string, dimension int, centroid array<double>, samples bigint, consent string, created_at timestamp, expires_at timestamp, active boolean"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


class ProfileError(ValueError):
    """A change that the profiles, or what is there of them, do not allow."""


def profile_problem() -> Column:
    """The first rule that a profile breaks, null if it breaks none."""
    v = F.col("centroid")
    rules = (
        ("not_a_uuid", ~F.col("profile_id").rlike(UUID)), ("no_version", F.col("version") < 1), ("dimension", (F.col("dimension") < 1) | (F.col("dimension") != F.size(v))),
        ("no_consent", F.trim("consent") == ""), ("no_samples", F.col("samples") < 1), ("inactive_at_first", ~F.col("active") & (F.col("version") < 2)),
        ("not_finite", F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), ("not_of_unit_length", F.abs(norm(v) - 1) > 1e-3), ("no_date", F.col("created_at").isNull()),
    )
    # a rule that cannot be told for a null is broken
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules])


class Profiles:
    """Profiles under a path of the shared folder, one row each at its last version.

    Every change takes a table of profiles or ids, so that it is a join and not a loop, and is committed whole
    or not at all; of two writers the slower one gets LostRace. Deleted profiles are gone from the table at once,
    and from storage when the folders of earlier versions are purged.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, SCHEMA)

    def all(self) -> DataFrame:
        return self.table.read()

    def get(self, ids: DataFrame) -> DataFrame:
        """The profiles of a table of profile_id; ProfileError where one is missing."""
        return self._found(ids)[0]

    def active(self, now: Column) -> DataFrame:
        """Profiles that are active and have not expired."""
        return self.all().where(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))

    def create(self, profiles: DataFrame) -> int:
        """Add profiles; ProfileError where an id is there already or comes twice, or a profile breaks a rule."""
        new = self._sound(profiles)
        self._refuse(new.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "ids come twice")
        self._refuse(new.join(self.all().select("profile_id"), "profile_id", "left_semi"), "profiles are there already")
        return self.table.append(new)

    def update(self, profiles: DataFrame) -> int:
        """Replace profiles by their next version; ProfileError where one is missing or its version is not one more."""
        new = self._sound(profiles)
        before, _ = self._found(new.select("profile_id"))
        self._refuse(new.join(before.select("profile_id", F.col("version").alias("_v")), "profile_id").where("version <> _v + 1"), "versions do not follow")
        return self._replace(new)

    def deactivate(self, ids: DataFrame) -> int:
        """Switch profiles off, at their next version; ProfileError where one is missing or off already."""
        before, _ = self._found(ids)
        self._refuse(before.where("not active"), "profiles are inactive already")
        return self._replace(written(before.withColumns({"active": F.lit(False), "version": F.col("version") + 1}), "profiles"))

    def delete(self, ids: DataFrame) -> int:
        """Remove the profiles of a table of profile_id and say how many were there; ids without one count for nothing."""
        there = self.all()
        gone = there.join(ids.select("profile_id").distinct(), "profile_id", "left_semi").count()
        if gone:
            self.table.rewrite(there.join(ids.select("profile_id").distinct(), "profile_id", "left_anti"))
        return gone

    def _found(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        asked, there = ids.select("profile_id").distinct(), self.all()
        self._refuse(asked.join(there.select("profile_id"), "profile_id", "left_anti"), "profiles are missing")
        return there.join(asked, "profile_id", "left_semi"), there

    def _replace(self, new: DataFrame) -> int:
        rest = self.all().join(new.select("profile_id"), "profile_id", "left_anti")
        return self.table.rewrite(rest.unionByName(new))

    def _sound(self, profiles: DataFrame) -> DataFrame:
        new = written(profiles.select(*self.table.schema.names), "profiles")
        self._refuse(new.withColumn("_problem", profile_problem()).where("_problem is not null"), "profiles break a rule", "_problem")
        return new

    def _refuse(self, rows: DataFrame, what: str, *more: str) -> None:
        """ProfileError with the first of the rows, if there are any."""
        first = rows.select("profile_id", *more).orderBy("profile_id").limit(5).collect()
        if first:
            raise ProfileError(f"{what}: " + ", ".join(" ".join(map(str, r)) for r in first))
