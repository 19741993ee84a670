"""Models by key as a stored table: saved in versions, loaded as of any of them, rolled back and thinned out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.generations import Generations


class ModelStore:
    """Models (key, ...) in a folder. Each save is a version; a key keeps the model of the last version that has it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.own = spark, Generations(spark, path, "key")

    def save(self, models: DataFrame) -> int:
        """A new version of these keys' models; other keys keep theirs. Its number."""
        gen = self.own.next()
        self.own.write(gen, "models", models)
        self.own.publish(gen, {"models": models.count()})
        return gen

    def versions(self) -> list[int]:
        return sorted(self.own.facts())

    def load(self, version: int | None = None) -> DataFrame:
        """Each key's model as of a version, the latest without one."""
        rows = self.own.read("models")
        if rows is None:
            raise ValueError("no models are stored")
        rows = rows if version is None else rows.where(F.col("gen") <= version)
        last = rows.groupBy("key").agg(F.max("gen").alias("gen"))
        return rows.join(last, ["key", "gen"]).drop("gen")

    def rollback(self, version: int) -> int:
        """Make the models as of a version the latest ones, as a new version; keys that came later keep theirs."""
        return self.save(self.load(version))

    def thin(self, keep: int = 10) -> list[int]:
        """Drop versions but the newest so many, save those that some key still needs; which were dropped."""
        old = self.versions()[:-keep]
        needed = {r[0] for r in self.own.read("models").groupBy("key").agg(F.max("gen").alias("gen")).select("gen").distinct().collect()}  # versions at most
        gone = [g for g in old if g not in needed]
        self.own.retire(gone)
        return gone
