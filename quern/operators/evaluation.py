"""Retrieval and answer quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query_id, k, recall, precision, mrr, ndcg) of ranked hits (query_id, id, rank from 0) against gold (query_id, id).

    Every query with gold has a row for each k; those without hits have zeros.
    """
    size = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    marked = hits.join(gold.distinct().withColumn("good", F.lit(1)), ["query_id", "id"], "left")
    cut = F.explode(F.array(*map(F.lit, ks))).alias("k")
    per = marked.select("*", cut).where("rank < k").groupBy("query_id", "k").agg(
        F.count("*").alias("n"),
        F.count("good").alias("n_good"),
        F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("good") == 1, 1 / F.log2(F.col("rank") + 2)).otherwise(0.0)).alias("dcg"),
    )
    rows = size.select("*", cut).join(per, ["query_id", "k"], "left")
    best = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", "n").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "query_id", "k", zero(F.col("n_good") / F.col("n_gold")).alias("recall"), zero(F.try_divide("n_good", "n")).alias("precision"),
        zero(F.lit(1.0) / (F.col("first") + 1)).alias("mrr"), zero(F.when(F.col("n") > 0, F.col("dcg") / best)).alias("ndcg"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """(metric, k, value): the mean of each metric over all queries."""
    long = metrics.unpivot(["query_id", "k"], ["recall", "precision", "mrr", "ndcg"], "metric", "value")
    return long.groupBy("metric", "k").agg(F.avg("value").alias("value"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """One row over (predicted_abstain, expected_abstain, cited, gold): accuracy of abstention, rate of it, share of citations that are gold, and mean share by answer."""
    share = F.try_divide(F.size(F.array_intersect("cited", "gold")), F.size("cited"))
    return answers.agg(
        F.avg((F.col("predicted_abstain") == F.col("expected_abstain")).cast("double")).alias("abstention_accuracy"),
        F.avg(F.col("predicted_abstain").cast("double")).alias("abstain_rate"),
        F.try_divide(F.sum(F.size(F.array_intersect("cited", "gold"))), F.sum(F.size("cited"))).alias("citation_correctness"),
        F.avg(F.coalesce(share, F.lit(0.0))).alias("faithfulness"),
    )
