"""Readers: files and tables to rows. Paths go to Spark's own sources, so any store that Spark reads will do."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.corpus import mime_of

WEATHER = "time timestamp, temperature_2m double, relative_humidity_2m double, wind_speed_10m double, surface_pressure double, shortwave_radiation double, et0_fao_evapotranspiration double"
BENCHMARK = "query string, gold_ids array<string>, reference_answer string, expected_abstain boolean, metadata map<string,string>"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, mime, digest, text): whole files as UTF-8, what isn't being replaced; markup stays."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (read.option("pathGlobFilter", glob) if glob else read).load(path)
    return raw.select("path", mime_of(F.regexp_extract("path", "[^/]*$", 0)).alias("mime"), F.sha2("content", 256).alias("digest"), F.decode(F.col("content"), "UTF-8").alias("text"))


_CELLS = "struct<cells:array<struct<cell_type:string,source:string>>,metadata:struct<language_info:struct<name:string>>>"


def notebooks(rows: DataFrame) -> DataFrame:
    """rows (path, text) with cell_count, language and the cells' text, each under a line with its number and kind; a cell's source is a string or a list of them."""
    own = rows.withColumn("nb", F.from_json("text", _CELLS))
    source = lambda c: F.coalesce(F.array_join(F.from_json(c["source"], "array<string>"), ""), c["source"])
    cells = F.transform("nb.cells", lambda c, i: F.concat(F.lit("<!-- cell "), i.cast("string"), F.lit(" ["), F.coalesce(c["cell_type"], F.lit("code")), F.lit("] -->\n"), F.coalesce(source(c), F.lit(""))))
    return own.select("path", F.array_join(cells, "\n\n").alias("text"), F.size("nb.cells").alias("cell_count"), F.coalesce("nb.metadata.language_info.name", F.lit("python")).alias("language"))


_UNITS = "path string, kind string, name string, signature string, docstring string, first int, last int"


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = node.args
    star = [f"*{a.vararg.arg}"] if a.vararg else ["*"] if a.kwonlyargs else []
    names = [x.arg for x in [*a.posonlyargs, *a.args]] + star + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
    return f"{node.name}({', '.join(names)})"


def python_units(rows: DataFrame) -> DataFrame:
    """(path, kind, name, signature, docstring, first, last) of every function and class; a text that isn't Python has none."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, ast.ClassDef):
                        out.append((path, "class", n.name, "", ast.get_docstring(n) or "", n.lineno, n.end_lineno))
                    elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                        out.append((path, "function", n.name, _signature(n), ast.get_docstring(n) or "", n.lineno, n.end_lineno))
            yield pd.DataFrame(out, columns=["path", "kind", "name", "signature", "docstring", "first", "last"])

    return rows.select("path", "text").mapInPandas(of, _UNITS)


def without_comments(rows: DataFrame) -> DataFrame:
    """rows (path, text) with the comments of Python texts blanked, strings and places kept; a text that can't be read so stays."""

    def strip(text: str) -> str:
        lines = text.splitlines(keepends=True)
        try:
            for t in tokenize.generate_tokens(io.StringIO(text).readline):
                if t.type == tokenize.COMMENT:
                    (row, a), (_, b) = t.start, t.end
                    lines[row - 1] = lines[row - 1][:a] + " " * (b - a) + lines[row - 1][b:]
        except (tokenize.TokenError, SyntaxError):
            return text
        return "".join(lines)

    @F.pandas_udf("string")
    def of(part: pd.Series) -> pd.Series:
        return part.map(lambda t: None if t is None else strip(t))

    return rows.select("path", of("text").alias("text"))


def js_units(rows: DataFrame) -> DataFrame:
    """(path, name, line) of declarations: lines that begin with function, var, const or let and hold an equals sign."""
    lines = rows.select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("i", "line"))
    pattern = r"^\s*(?:async function|function|var|const|let)\s+([A-Za-z_$][\w$]*)"
    return lines.where(F.col("line").contains("=") & F.col("line").rlike(pattern)).select("path", F.regexp_extract("line", pattern, 1).alias("name"), (F.col("i") + 1).alias("line"))


def indentation(rows: DataFrame) -> DataFrame:
    """(path, width): the commonest number of spaces that lines begin with, the smallest of equally common ones; 0 for none."""
    lines = rows.select("path", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("^ +[^ ]"))
    counts = lines.groupBy("path", F.length(F.regexp_extract("line", "^( +)", 1)).alias("w")).agg(F.count("*").alias("n"))
    best = counts.groupBy("path").agg(F.max_by("w", F.struct("n", -F.col("w"))).alias("width"))
    return rows.select("path").join(best, "path", "left").select("path", F.coalesce("width", F.lit(0)).alias("width"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, rings, properties) of the features of GeoJSON collections; rings are the exterior rings of polygons as arrays of struct<px, py>."""
    schema = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("px"), p[1].alias("py")))
    rings = F.when(F.col("f.geometry.type") == "Polygon", F.array(points(one[0]))).when(F.col("f.geometry.type") == "MultiPolygon", F.transform(many, lambda poly: points(poly[0])))
    return f.select(F.coalesce("f.id", F.col("f.properties")["id"]).alias("id"), F.col("f.geometry.type").alias("kind"), rings.alias("rings"), F.col("f.properties").alias("properties"))


def weather(spark: SparkSession, path: str) -> DataFrame:
    """Weather samples from CSV with a header; an error if a required column is missing or a row is malformed."""
    return spark.read.schema(WEATHER).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark items from JSON lines; blank lines are skipped, bad JSON is an error."""
    return spark.read.schema(BENCHMARK).option("mode", "FAILFAST").json(path)


def bands(spark: SparkSession, path: str, metadata: str) -> DataFrame:
    """Pixels of Parquet bands with the scalars of their scene from JSON metadata."""
    return spark.read.parquet(path).join(spark.read.option("multiLine", "true").json(metadata), "scene_id")
