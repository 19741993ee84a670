"""An index of vectors by inverted lists, as a stored table with upserts, deletes, compaction and exact or approximate search.

Centroids come from k-means on a bounded sample. Vectors are stored at length 1, in a folder for each centroid's list; each
generation notes the largest distance of a list's members from its centroid. On unit vectors cosine and distance say the
same, so by the triangle inequality a list whose centroid is farther from a query than the k-th best hit so far and its own
radius together can't hold a better one: an exact search reads the other lists only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.expr import dot, norm
from quern.operators import products
from quern.operators.ranking import top
from quern.session import checkpoint
from quern.sources.generations import Generations

#: Vectors that centroids are fitted to, at most, those of the smallest hashes; rows of a list that one task writes, about.
SAMPLE, ROWS_A_TASK = 100_000, 1_000_000
#: Lists of a query that are read before its bound is known; rounding of distances.
FIRST, HAIR = 2, 1e-6


def _unit(v: Column) -> Column:
    """v at length 1; null if it is null, zero, or holds null or non-finite components."""
    n = norm(v)
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))) & (n > 0) & (n < float("inf"))
    return F.when(ok, F.transform(v, lambda x: x.cast("double") / n))


def _gap(cos: Column) -> Column:
    """The distance of two unit vectors from their cosine."""
    return F.sqrt(F.greatest(F.lit(2.0) - 2 * cos, F.lit(0.0)))


def _one(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a task as one value."""
    if held := [p for p in parts if p.num_rows]:
        yield products.pack(pa.Table.from_batches(held)).rename_columns(["asked"])


def _dealt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of unit vectors (id, v) with the list of their nearest centroid, of equally near ones the first, and the distance from it."""
    centre, lists, own = None, None, None
    for part in parts:
        for i in range(part.num_rows):
            if centre is None:
                t = products.unpacked(part.column("asked")[i].as_buffer())
                centre, lists = products.vectors(t.column("centroid")), t.column("list").to_numpy()
                own = (centre * centre).sum(1)
            t = products.unpacked(part.column("pack")[i].as_buffer())
            v = products.vectors(t.column("v"))
            n = max(v.shape[1], centre.shape[1])
            # What a shorter vector lacks counts as no number, as in Spark: such a vector is nearest to the first list.
            d = own - 2 * (np.pad(v, ((0, 0), (0, n - v.shape[1])), constant_values=np.nan) @ np.pad(centre, ((0, 0), (0, n - centre.shape[1])), constant_values=np.nan).T)
            at = np.argmin(np.where(np.isnan(d), np.inf, d), axis=1)
            gap = np.sqrt(np.maximum(d[np.arange(len(at)), at] + 1, 0.0))
            yield from t.append_column("list", pa.array(lists[at].astype(np.int32))).append_column("gap", pa.array(gap)).to_batches()


def _probed(t: pa.Table, u: pa.Table) -> np.ndarray:
    """Cosines of unit vectors with queries that read their list."""
    a, b = products.vectors(t.column("v")), products.vectors(u.column("v"))
    n = max(a.shape[1], b.shape[1])
    out = np.pad(a, ((0, 0), (0, n - a.shape[1])), constant_values=np.nan) @ np.pad(b, ((0, 0), (0, n - b.shape[1])), constant_values=np.nan).T
    lists = u.column("lists").combine_chunks()
    row, read = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
    mine = t.column("list").to_numpy()
    met = np.zeros((max(mine.max(initial=0), read.max(initial=0)) + 1, len(lists)), bool)
    met[read, row] = True
    return np.where(met[mine] & ~np.isnan(out), out, products.LAST)


class VectorIndex:
    """Vectors (id, embedding) of one space in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.own = spark, path, Generations(spark, path)

    # --- writing ---

    def create(self, rows: DataFrame, lists: int | None = None, model: str = "unknown", seed: int = 1) -> int:
        """Fit centroids to a sample of rows (id, embedding) and store all of them. lists: about the root of their number if it isn't given."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if self.own.facts():
            raise ValueError("the index is there already; rebuild() makes it anew")
        unit = rows.select("id", _unit(F.col("embedding")).alias("v")).where("v is not null")
        n = unit.count()
        k = min(lists or max(1, round(n**0.5)), max(1, n))
        sample = checkpoint(unit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("v").alias("features")))
        if n:
            model_of = KMeans(k=k, seed=seed, maxIter=10).fit(sample)
            found = [(i, [float(x) for x in c]) for i, c in enumerate(model_of.clusterCenters())]
        else:
            found = [(0, [])]
        centroids = self.spark.createDataFrame(found, "list int, centroid array<double>")
        self.own.write(0, "centroids", centroids.coalesce(1))
        return self._add(0, rows, {"model": model, "dimension": len(found[0][1]), "lists": len(found)})

    def centroids(self) -> DataFrame:
        """(list, centroid) of the latest fit; as many as there are lists."""
        rows = self.own.read("centroids")
        return rows.join(F.broadcast(rows.agg(F.max("gen").alias("gen"))), "gen").drop("gen")  # one row

    def _add(self, gen: int, rows: DataFrame, facts: dict[str, object]) -> int:
        one = rows.where("id is not null").groupBy("id").agg(F.max("embedding").alias("embedding"))
        unit = one.select("id", _unit(F.col("embedding")).alias("v"))
        first = checkpoint(unit)
        centres = self.spark.read.parquet(f"{self.path}/centroids/gen={gen}") if gen == 0 or "lists" in facts else self.centroids()
        # All centroids are one value: packs of vectors meet it where they are.
        table = F.broadcast(centres.orderBy("list").coalesce(1).mapInArrow(_one, "asked binary"))
        dealt = first.where("v is not null").mapInArrow(products._packs, "pack binary").crossJoin(table).mapInArrow(_dealt, first.withColumns({"list": F.lit(0), "gap": F.lit(0.0)}).schema)
        dealt = checkpoint(dealt)
        parts = max(1, -(-dealt.count() // ROWS_A_TASK))
        written = dealt.repartition("list", F.pmod(F.xxhash64("id"), F.lit(parts)))
        self.own.write(gen, "vectors", written.select("id", "v", "list"), ["list"])
        self.own.write(gen, "lists", dealt.groupBy("list").agg(F.max("gap").alias("radius"), F.count("*").alias("n")))
        # Vectors without a direction are known, but never found.
        self.own.write(gen, "ids", first.select("id", F.col("v").isNotNull().alias("found")))
        if gen:
            self.own.mark(gen, first.select("id"))
        self.own.publish(gen, facts)
        return gen

    def upsert(self, rows: DataFrame) -> int:
        """Add vectors (id, embedding), or put them in place of those of the same ids; of rows of one id one is taken."""
        return self._add(self.own.next(), rows, {})

    def delete(self, ids: DataFrame) -> int:
        gen = self.own.next()
        self.own.mark(gen, ids.select("id").where("id is not null"))
        self.own.publish(gen, {})
        return gen

    def rebuild(self, lists: int | None = None, seed: int = 1) -> int:
        """New centroids for all vectors that are there, and one generation of them; the old ones go."""
        old = self.own.facts()
        gen = self.own.next()
        rows = checkpoint(self.vectors().select("id", F.col("v").alias("embedding")))
        dead = checkpoint(self.own.live(self.own.read("ids")).where("not found").select("id", F.lit(None).cast("array<double>").alias("embedding")))
        side = VectorIndex(self.spark, f"{self.path}/_rebuild-{gen}")
        side.create(rows, lists, seed=seed)
        centres = checkpoint(side.centroids())
        self.own.write(gen, "centroids", centres.coalesce(1))
        first = old[min(old)]
        self._add(gen, rows.unionByName(dead), {"model": first.get("model", "unknown"), "dimension": first.get("dimension", "0"), "lists": centres.count()})
        self.own.retire([*old])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(side.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gen

    # --- reading ---

    def vectors(self, lists: list[int] | None = None) -> DataFrame:
        """(id, v, list) of all vectors that can be found, or of some lists."""
        rows = self.own.read("vectors", None if lists is None else F.col("list").isin(lists))
        return self.own.live(rows).select("id", "v", "list")

    def count(self) -> int:
        return self.own.live(self.own.read("ids")).count()

    def manifest(self) -> DataFrame:
        """(model, dimension, lists, generations, count): one row."""
        facts = self.own.facts()
        said = [f for _, f in sorted(facts.items()) if "dimension" in f][-1]
        return self.spark.createDataFrame([(said["model"], int(said["dimension"]), int(said["lists"]), len(facts), self.count())], "model string, dimension int, lists int, generations int, count bigint")

    def _radii(self) -> DataFrame:
        return self.own.read("lists").groupBy("list").agg(F.max("radius").alias("radius"))

    def _hits(self, probes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """The k best of each query among the lists that it probes (query_id, list)."""
        lists = [r[0] for r in probes.select("list").distinct().collect()]  # lists at most
        lists = [r[0] for r in probes.select("list").distinct().collect()]  # lists at most
        both = asked.join(probes.groupBy("query_id").agg(F.collect_list("list").alias("lists")), "query_id")
        both = both.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("q").alias("v"), "lists")
        return top(products.best_vectors(self.vectors(lists).select(F.col("id").cast("bigint").alias("id"), "v", "list"), both, k, _probed, products.LAST), k)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k vectors of the largest cosine with each query (query_id, query), those of 0 or less left out.

        probes: so many nearest lists are read and no others, which may miss hits; without it the result is exact. A query
        that is zero or not finite has no hits.
        """
        asked = checkpoint(queries.select("query_id", _unit(F.col("query")).alias("q")).where("q is not null"))
        lists = self.centroids().join(self._radii(), "list")
        # A stated set of queries against all centroids.
        far = asked.crossJoin(F.broadcast(lists)).select("query_id", "list", "radius", F.sqrt(F.greatest(dot(F.col("centroid"), F.col("centroid")) - 2 * dot(F.col("centroid"), F.col("q")) + 1, F.lit(0.0))).alias("gap"))
        far = checkpoint(far)
        first = top(far.select("query_id", F.col("list").alias("id"), F.col("gap").alias("score")), probes or FIRST, ascending=True)
        first = checkpoint(first.select("query_id", F.col("id").alias("list")))
        begin = self._hits(first, asked, k)
        if probes is None:
            begin = checkpoint(begin)
            reached = begin.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", _gap(F.col("least")).alias("limit"))
            rest = far.join(first, ["query_id", "list"], "left_anti").join(reached, "query_id", "left")
            rest = checkpoint(rest.where(F.col("limit").isNull() | (F.col("gap") - F.col("radius") <= F.col("limit") + HAIR)).select("query_id", "list"))
            begin = top(begin.drop("rank").unionByName(self._hits(rest, asked, k).drop("rank")), k)
        return begin.where(F.round("score", 9) > 0)
