"""Ordered operators: drift, decay, gaps, carried-forward values, as-of lookups and version histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_drift(rows: DataFrame, key: str, order: list[str], error: Column, window: int = 50, threshold: float = 0.3) -> DataFrame:
    """rows with the error rate of the last so many rows of their key and whether it passes the threshold."""
    last = Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0)
    return rows.withColumn("error_rate", F.avg(error.cast("double")).over(last)).withColumn("drift", F.col("error_rate") > threshold)


def fifo(rows: DataFrame, key: str, order: list[Column], most: int = 100) -> DataFrame:
    """The last rows of each key, as a bounded window keeps them."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def batches(rows: DataFrame, key: str, order: list[str], size: int = 10) -> DataFrame:
    """rows with the number of the batch that a trigger at every size rows puts them in."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))


def decayed_scores(rows: DataFrame, keys: list[str], time: str, now: Column, half_life_days: float = 90.0, least: float = 0.01) -> DataFrame:
    """(keys, score): one for each row, halved every half_life_days until now; scores below the least are dropped. A plain sum, so combined before the shuffle."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(time).cast("timestamp"))) / 86_400e6
    return rows.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -age / half_life_days)).alias("score")).where(F.col("score") >= least)


def gaps(scenes: DataFrame, key: str, date: str, most_days: int) -> DataFrame:
    """(key, start, end, days) of consecutive dates further apart than allowed."""
    after = F.lead(date).over(Window.partitionBy(key).orderBy(date))
    out = scenes.select(key, F.col(date).alias("start"), after.alias("end")).withColumn("days", F.datediff("end", "start"))
    return out.where(F.col("days") > most_days)


def scene_pairs(scenes: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """(key, start, end, value, next_value, day): every day strictly between two consecutive scenes."""
    order = Window.partitionBy(key).orderBy(date)
    pairs = scenes.select(key, F.col(date).alias("start"), F.lead(date).over(order).alias("end"), F.col(value).alias("value"), F.lead(value).over(order).alias("next_value"))
    pairs = pairs.where(F.datediff("end", "start") > 1)
    return pairs.withColumn("day", F.explode(F.sequence(F.date_add("start", 1), F.date_sub("end", 1))))


def fill_linear(pairs: DataFrame) -> DataFrame:
    """pairs with filled: the value on the line between both scenes."""
    share = F.datediff("day", "start") / F.datediff("end", "start")
    return pairs.withColumn("filled", F.col("value") + (F.col("next_value") - F.col("value")) * share)


def fill_weighted(pairs: DataFrame) -> DataFrame:
    """pairs with filled: both values weighted by the inverse of their distance in days."""
    a, b = 1 / F.datediff("day", "start"), 1 / F.datediff("end", "day")
    return pairs.withColumn("filled", (F.col("value") * a + F.col("next_value") * b) / (a + b))


def carry_forward(rows: DataFrame, key: str, order: list[str], value: str, valid: str) -> DataFrame:
    """rows with used (the value, or the last valid one before) and source: NEW, REUSED or NONE."""
    last = F.last(F.when(F.col(valid), F.col(value)), ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    source = F.when(F.col(valid) & F.col(value).isNotNull(), "NEW").when(last.isNotNull(), "REUSED").otherwise("NONE")
    return rows.withColumn("used", last).withColumn("source", source)


def as_of_linear(points: DataFrame, samples: DataFrame, key: str, time: str, value: str, block: str = "day") -> DataFrame:
    """points (key, time) with the value on the line between the samples before and after; at an end the nearest sample's.

    Both tables are laid into one sequence and looked at by windows: no range join. A window holds one block of time of a
    key; what lies before and after a block comes from the blocks' own first and last samples, a row for each block.
    """
    no = F.lit(None).cast("double")
    both = points.select(key, F.col(time).alias("t"), no.alias("v"), F.lit(1).alias("asked")).unionByName(samples.select(key, F.col(time).alias("t"), F.col(value).cast("double").alias("v"), F.lit(0).alias("asked")))
    both = both.withColumn("block", F.date_trunc(block, "t"))
    known = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    edges = both.groupBy(key, "block").agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
    on, back = Window.partitionBy(key).orderBy("block"), Window.partitionBy(key).orderBy(F.desc("block"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(key, "block", F.last("hi", ignorenulls=True).over(earlier(on)).alias("prior"), F.last("lo", ignorenulls=True).over(earlier(back)).alias("next"))
    # Running last values in both directions: a frame that ends with the block would be gone through again for each row.
    own = Window.partitionBy(key, "block")
    before = F.last(known, ignorenulls=True).over(own.orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(known, ignorenulls=True).over(own.orderBy(F.desc("t"), "asked").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("b", before).withColumn("a", after).where("asked = 1").join(edges, [key, "block"])
    both = both.select(key, "t", F.coalesce("b", "prior").alias("b"), F.coalesce("a", "next").alias("a"))
    sec = lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
    share = F.try_divide(sec(F.col("t")) - sec(F.col("b.t")), sec(F.col("a.t")) - sec(F.col("b.t")))
    line = F.col("b.v") + (F.col("a.v") - F.col("b.v")) * F.coalesce(share, F.lit(0.0))
    return both.select(key, F.col("t").alias(time), F.coalesce(line, F.col("b.v"), F.col("a.v")).alias(value))


def nearest_sample(samples: DataFrame, key: list[str], time: str, target: Column, tie: str) -> DataFrame:
    """Of the samples of each key the one nearest to a target time; ties go to the smaller tie column."""
    names = [c for c in samples.columns if c not in key]
    off = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(target))
    return samples.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(off, tie)).alias("_r")).select(*key, "_r.*")


def old_versions(versions: DataFrame, keys: list[str], order: list[Column], keep: int = 10) -> DataFrame:
    """Versions beyond the newest so many of each key, which may be removed."""
    return versions.withColumn("age_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("age_rank") > keep)


def active_versions(saves: DataFrame, rollbacks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, version, rolled_back): the version in use for each key. Both tables have the keys, version and at; the last save or rollback counts, a rollback to a version not saved by then does not."""
    saved = saves.groupBy(*keys, "version").agg(F.min("at").alias("saved_at"))
    valid = rollbacks.join(saved, [*keys, "version"]).where("saved_at <= at").select(*keys, "version", "at", F.lit(True).alias("rolled_back"))
    steps = saves.select(*keys, "version", "at", F.lit(False).alias("rolled_back")).unionByName(valid)
    return steps.groupBy(*keys).agg(F.max(F.struct("at", "rolled_back", "version")).alias("s")).select(*keys, "s.version", "s.rolled_back")
