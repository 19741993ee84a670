"""Feedback: confidence scores and states, transitions, dataset dedup and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a memory and those that may follow each.
TRANSITIONS = {"proposed": ("supported", "rejected"), "supported": ("verified", "rejected"), "verified": ("rejected",), "rejected": ()}
# Fields of the export rows of each task.
TASKS = {
    "rag_eval": {"question": ("question", "query"), "expected_documents": (), "gold_ids": ()},
    "qa_eval": {"question": ("question", "query"), "reference_answer": ("reference_answer", "answer"), "expected_documents": ()},
    "sft": {"instruction": ("question", "instruction"), "context": (), "completion": ("answer", "reference_answer")},
    "preference": {"prompt": ("question", "prompt"), "chosen": ("chosen", "answer"), "rejected": ("rejected",)},
}


def confidence(confirming: Column, usage: Column, actors_agree: Column, rejections: Column, contradictions: Column, base: float = 5.0) -> Column:
    """Base 5; 3 for each confirmation (6 at most), 2 for each use (4 at most), 3 if actors agree; less 5 for each rejection and 3 for each contradiction; 0 to 20."""
    s = F.lit(base) + F.least(confirming * 3, F.lit(6)) + F.least(usage * 2, F.lit(4)) + F.when(actors_agree, 3).otherwise(0) - rejections * 5 - contradictions * 3
    return F.greatest(F.lit(0.0), F.least(F.lit(20.0), s)).cast("double")


def state_of(score: Column) -> Column:
    return F.when(score >= 14, "verified").when(score >= 8, "supported").otherwise("proposed")


def weight_of(state: Column) -> Column:
    return F.when(state == "verified", 0.8).when(state == "supported", 0.4).otherwise(0.1)


def allowed(before: Column, after: Column) -> Column:
    """Whether a state may follow another: itself, one of the table, or rejected after any but rejected."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    return (before == after) | F.coalesce(F.array_contains(F.try_element_at(table, before), after), F.lit(False))


def transitions(events: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """events with the state before each within its key (proposed at first) and whether the change is allowed."""
    before = F.lag(state, 1, "proposed").over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).withColumn("valid", allowed(F.col("before"), F.col(state)))


def dedup_examples(examples: DataFrame, task: str, signature: str, order: list[Column]) -> DataFrame:
    """Of examples with equal task and signature the first by order. Aggregated, so copies without number are combined before the shuffle."""
    names = [c for c in examples.columns if c not in (task, signature)]
    return examples.groupBy(task, signature).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r")).select(task, signature, "_r.*")


def duplicate_counts(examples: DataFrame, task: str, signature: str) -> DataFrame:
    """(task, duplicates): examples beyond the first of each signature."""
    groups = examples.groupBy(task, signature).agg(F.count("*").alias("n")).where("n > 1")
    return groups.groupBy(task).agg(F.sum(F.col("n") - 1).alias("duplicates"))


def export_rows(examples: DataFrame, task: str, payload: str = "payload") -> DataFrame:
    """(line): a JSON object for each example of a task, from a payload map of strings; the first of the fields that isn't empty, else empty."""
    if task not in TASKS:
        raise ValueError(f"no such task: {task}")
    fields = []
    for name, sources in TASKS[task].items():
        own = [F.when(F.try_element_at(F.col(payload), F.lit(s)) != "", F.try_element_at(F.col(payload), F.lit(s))) for s in sources]
        value = F.coalesce(*own, F.lit("")) if own else F.coalesce(F.from_json(F.try_element_at(F.col(payload), F.lit(name)), "array<string>"), F.array().cast("array<string>"))
        fields.append(value.alias(name))
    return examples.select(F.to_json(F.struct(*fields)).alias("line"))


def promote(events: DataFrame) -> DataFrame:
    """(target_id, events): the event ids behind each target, sorted."""
    return events.groupBy("target_id").agg(F.array_sort(F.collect_set("event_id")).alias("events"))


def relation_of(text: Column) -> Column:
    """struct(source, predicate, target) of a proposal written source -> predicate -> target, or source -> target; null for anything else."""
    parts = F.transform(F.split(text, "->"), lambda p: F.trim(p))
    n = F.size(parts)
    three = F.struct(F.get(parts, F.lit(0)).alias("source"), F.get(parts, F.lit(1)).alias("predicate"), F.get(parts, F.lit(2)).alias("target"))
    two = F.struct(F.get(parts, F.lit(0)).alias("source"), F.lit("related_to").alias("predicate"), F.get(parts, F.lit(1)).alias("target"))
    return F.when(F.exists(parts, lambda p: p == ""), None).when(n == 3, three).when(n == 2, two)
