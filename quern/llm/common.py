"""Small helpers shared by the operators: words, row keys, intermediate tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of letters and digits of ASCII and of anything beyond ASCII; A-Z count as a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Letters of scripts that put no blanks between words, and what stands between those.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: What leads such a letter in UTF-8; dashes and quotation marks of other scripts don't begin so.
_LEADS = re.compile(rb"[\xe0\xe1\xe3-\xf4]")
_BETWEEN = re.compile("[\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased; none for null. A letter of a script without blanks is a word."""
    if not text:
        return []
    raw = text.encode()
    if _LEADS.search(raw) and UNSPACED.search(text):
        raw = UNSPACED.sub(r" \g<0> ", _BETWEEN.sub(" ", text)).encode()
    return raw.translate(_FOLD).split()


def rows_of(parts: Iterator[pa.RecordBatch], n: int = 256) -> Iterator[list[dict]]:
    """Rows of Arrow batches as Python objects, a few at a time: a batch of long texts is never unpacked whole."""
    for part in parts:
        for lo in range(0, part.num_rows, n):
            yield part.slice(lo, n).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, kept for the next text; emptied when it has grown too large."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k values (one run of all, if there are fewer)."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * _ODD + h[i : i + n])
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, spark.checkpoint.dir; where that is unset, a temporary folder if all executors are on this machine, else an error."""
    if not (to := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        to = getattr(spark, "_quern_scratch", None) or tempfile.mkdtemp(prefix="quern-")
        spark._quern_scratch = to
    return to.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which release() deletes."""
    to = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(to)
    return to


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: what follows neither repeats the work nor loses it with an executor."""
    to = scratch(df.sparkSession, name)
    df.write.parquet(to)
    out = df.sparkSession.read.schema(df.schema).parquet(to)
    out._quern_path = to
    return out


def discard(df: DataFrame) -> None:
    """Delete an intermediate table that store() has given, once all that was made of it is stored itself."""
    spark, to = df.sparkSession, df._quern_path
    _STORED[spark.sparkContext.applicationId].remove(to)
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_STORED: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has stored, once their results are written; how many there were."""
    done = _STORED.pop(spark.sparkContext.applicationId, [])
    for to in done:
        path = spark._jvm.org.apache.hadoop.fs.Path(to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(done)


#: Rows of a batch that goes to Python: whole texts, which may be long, so many fewer than Spark's 10 000.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends at most BATCH_ROWS rows to Python at once (fewer, if it was set to fewer).

    The operators leave their caller's session as it is; whoever applies them to tables of long texts calls this first.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def batches(texts: Iterator[str | None], chars: int = 500_000) -> Iterator[list[str]]:
    """Lists of texts of so many characters in all, or one longer text; null becomes empty."""
    out, n = [], 0
    for t in texts:
        t = t or ""
        if out and n + len(t) > chars:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t)
    if out:
        yield out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another one; component is the smallest node reachable.

    Alternating large-star and small-star steps: each is one aggregation with map-side combine and one join, and the
    number of steps grows with the logarithm of the longest path. A node of very many edges is split by the skew join.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = store(pairs, "edges")
    state = pairs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    while state["n"]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are stored before they are joined: a small table is broadcast then, and beside a large one a hot node's edges
        # come straight from a shuffle, which the skew join can split.
        low = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        # large star: every neighbour v > u of u goes to u's smallest neighbour
        large = pairs.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u <> v").distinct(), "large")
        # small star: u and its smaller neighbours go to the smallest of them
        low = store(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs = store(small.where("u <> v").distinct(), "edges")
        now = pairs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
