"""Tables dealt into buckets by a key when they are written, so that joins on that key move neither side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quern.session import new_folder


def bucketed(rows: DataFrame, key: str, buckets: int, name: str = "table") -> DataFrame:
    """rows as a table of so many buckets, sorted by key in each, in the shared folder; tables that are joined need equal numbers."""
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, key)  # so that each bucket is one file
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", new_folder(rows.sparkSession, name)).saveAsTable(table)
    return rows.sparkSession.table(table)
