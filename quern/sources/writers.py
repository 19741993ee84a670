"""Writers: export of datasets, vectors by space, pixels and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.feedback import TASKS, export_rows


def dataset(examples: DataFrame, task: str, path: str) -> None:
    """JSON lines of a task's examples under path/task, and a card with their number beside them; an error if there are none."""
    rows = export_rows(examples, task)
    if rows.isEmpty():
        raise ValueError(f"no examples for {task}")
    rows.write.mode("overwrite").text(f"{path}/{task}")
    card = rows.agg(F.count("*").alias("count")).select(F.lit(task).alias("task_type"), "count", F.array(*map(F.lit, TASKS[task])).alias("columns"), F.current_timestamp().cast("string").alias("created_at"))
    card.coalesce(1).write.mode("overwrite").json(f"{path}/{task}_card")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of equal keys replaced by those of new, and new ones added; of several new rows of a key the last by all columns."""
    names = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*names)).alias("_r")).select(*keys, "_r.*")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def vectors(rows: DataFrame, path: str) -> None:
    """Vectors (space_id, id, embedding), one folder a space."""
    rows.write.mode("overwrite").partitionBy("space_id").parquet(path)


def manifest(rows: DataFrame, model: str) -> DataFrame:
    """(space_id, model, dimension, count) of vectors; the dimension is the commonest one."""
    return rows.groupBy("space_id").agg(F.lit(model).alias("model"), F.mode(F.size("embedding")).alias("dimension"), F.count("*").alias("count"))


def products(px: DataFrame, path: str, keys: list[str]) -> None:
    """Pixel products, sorted by place within each scene's folder so that scans of a region skip row groups."""
    px.repartition("scene_id").sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("scene_id").parquet(path)


def table(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header or as JSON lines."""
    if kind not in ("csv", "json"):
        raise ValueError(f"no writer for {kind}")
    (rows.write.mode("overwrite").option("header", "true").csv if kind == "csv" else rows.write.mode("overwrite").json)(path)
