"""Entities and relations: traversal, expansion to segments, pending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import checkpoint


def traverse(relations: DataFrame, start: DataFrame, depth: int = 1, most: int = 50) -> DataFrame:
    """(start, relation_id, near, far, hop) reached from (start): hops 0 to depth (3 at most), each relation once, at its first hop, the first by hop and id up to most.

    Breadth first and undirected: each round is one equi-join of the frontier with relations (id, source_id, target_id).
    """
    both = relations.select(F.col("id").alias("relation_id"), F.col("source_id").alias("near"), F.col("target_id").alias("far"))
    both = both.union(relations.select(F.col("id"), F.col("target_id"), F.col("source_id")))
    frontier, found = start.select("start", F.col("start").alias("near")), None
    first = Window.partitionBy("start").orderBy("relation_id")
    for hop in range(min(depth, 3) + 1):
        step = frontier.join(both, "near").groupBy("start", "relation_id").agg(F.min(F.struct("near", "far")).alias("e")).select("start", "relation_id", "e.near", "e.far", F.lit(hop).alias("hop"))
        if found is not None:
            step = step.join(found.select("start", "relation_id"), ["start", "relation_id"], "left_anti")
        # More than most of one hop can't be among the first; where so many are found, no hop beyond is, either.
        # Stored: each hop is read by the next one, by the search for what was met before, and by the result.
        step = checkpoint(step.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n"))
        found = step if found is None else found.unionByName(step)
        full = found.groupBy("start").agg(F.count("*").alias("_k")).where(F.col("_k") >= most).select("start")
        frontier = step.select("start", F.col("far").alias("near")).distinct().join(full, "start", "left_anti")
    order = Window.partitionBy("start").orderBy("hop", "relation_id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def expand_hits(hits: DataFrame, entities: DataFrame, relations: DataFrame, most: int = 50) -> DataFrame:
    """(query_id, segment_id) of segments that are evidence of entities related to those of the hits, and aren't hits themselves.

    entities: (id, evidence_id). The related entity leads to its evidence, not to a segment of its own id.
    """
    own = hits.join(entities.select(F.col("id").alias("near"), F.col("evidence_id").alias("id")), "id").select("query_id", "near")
    both = relations.select(F.col("source_id").alias("near"), F.col("target_id").alias("far")).union(relations.select("target_id", "source_id"))
    far = own.join(both, "near").join(entities.select(F.col("id").alias("far"), F.col("evidence_id").alias("segment_id")), "far").select("query_id", "segment_id").distinct()
    new = far.join(hits.select("query_id", F.col("id").alias("segment_id")), ["query_id", "segment_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("segment_id")
    return new.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def pending(candidates: DataFrame, trained: DataFrame, states: tuple[str, ...] = ("verified", "supported")) -> DataFrame:
    """Candidates (id, state) of such states that aren't among trained (id)."""
    return candidates.where(F.col("state").isin(*states)).join(trained.select("id").distinct(), "id", "left_anti")


def latest(observations: DataFrame, subject: str, time: str, tie: str) -> DataFrame:
    """The last observation of each subject; an aggregation, so a subject of many rows is combined before the shuffle."""
    names = [c for c in observations.columns if c != subject]
    return observations.groupBy(subject).agg(F.max_by(F.struct(*names), F.struct(time, tie)).alias("_r")).select(subject, "_r.*")
