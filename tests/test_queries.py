"""Every registered query runs; those with SQL give the same rows."""

import pytest

from quern import registry

from .compare import DATA, same

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        same(spark, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_clusters_hold_all_vectors(spark):
    """Which clusters there are is the library's choice; that they hold each vector once is not."""
    rows = QUERIES["embedding_clusters"](spark, DATA).collect()
    labels = spark.read.parquet(f"{DATA}/embeddings.parquet").select("label").distinct().count()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert len({r.cluster for r in rows}) == len(rows) <= 10 and all(1 <= r.labels <= min(r.n, labels) for r in rows)


def test_models_by_key_have_all_rows(spark):
    rows = {r.key: r for r in QUERIES["train_per_key"](spark, DATA).collect()}
    counts = {r["k"]: r["count"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("vec_id % 4 AS k").groupBy("k").count().collect()}
    assert {k: r.n for k, r in rows.items()} == counts
    assert all(0 <= r.accuracy <= 1 and len(r.weights) == 65 for r in rows.values())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_names_are_taken_once():
    with pytest.raises(ValueError):
        registry.query("hybrid_search")(lambda spark, sf_dir: None)
