"""Exact quantiles of large groups, without a task or a buffer that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import checkpoint


def quantiles(rows: DataFrame, keys: list[str], ranks: dict[str, list[float]]) -> DataFrame:
    """(keys, an array for each band): interpolated quantiles, at the given ranks, of the values of each band that aren't null; null without any.

    Distinct values with their counts are dealt out by ranges of (keys, band, value), so a large group is spread over many
    tasks. A row for each group and task tells where each wanted place lies; only there are values counted through.
    """
    long = rows.unpivot(keys, [*ranks], "band", "v").where("v is not null")
    counts = long.groupBy(*keys, "band", "v").agg(F.count("*").alias("c"))
    # Stored with its task's number, which a repeated shuffle might give to other ranges.
    ranged = checkpoint(counts.repartitionByRange(*keys, "band", "v").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "band").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy(*keys, "band", "part").agg(F.sum("c").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(own)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "band")))
    wanted = F.create_map(*[x for band, own_ranks in ranks.items() for x in (F.lit(band), F.array(*map(F.lit, own_ranks)))])
    places = sums.select(*keys, "band", "part", "n", "upto", "total", F.posexplode(F.element_at(wanted, F.col("band"))).alias("i", "rank"))
    at = F.col("rank") * (F.col("total") - 1)
    places = places.select(*keys, "band", "part", "n", "upto", "i", (at - F.floor(at)).alias("share"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("place"))
    places = places.where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))).select(*keys, "band", "part", "i", "share", "place", (F.col("upto") - F.col("n")).alias("before"))
    through = Window.partitionBy(*keys, "band", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumn("cum", F.sum("c").over(through)).join(places, [*keys, "band", "part"])
    found = found.where((F.col("place") < F.col("before") + F.col("cum")) & (F.col("place") >= F.col("before") + F.col("cum") - F.col("c")))
    each = found.groupBy(*keys, "band", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("share").alias("share"))
    each = each.groupBy(*keys, "band").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share")).alias("q")))).alias("q"))
    wide = each.groupBy(*keys).pivot("band", [*ranks]).agg(F.first("q"))
    return wide.select(*keys, *[F.transform(band, lambda x: x["q"]).alias(band) for band in ranks])
