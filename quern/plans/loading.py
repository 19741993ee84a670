"""Readers of code and notebooks on texts made from the given tables; versions and scenes as they are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import series, spatial
from quern.registry import query
from quern.session import new_folder
from quern.sources import readers

from .tables import table


@query(
    "notebook_cells",
    """SELECT CAST(doc_id AS VARCHAR) AS path, concat('<!-- cell 0 [markdown] -->', chr(10), coalesce(text, ''), chr(10), chr(10), '<!-- cell 1 [code] -->', chr(10), coalesce(source, '')) AS text, 2 AS cell_count, 'python' AS language FROM documents""",
)
def notebook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notebooks of two cells, read back."""
    cell = lambda kind, c: F.struct(F.lit(kind).alias("cell_type"), F.col(c).alias("source"))
    text = F.to_json(F.struct(F.array(cell("markdown", "text"), cell("code", "source")).alias("cells")))
    return readers.notebooks(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), text.alias("text")))


#: Turns of conversations as pieces of code: what is said, without signs, stands in comments, strings and docstrings; which kind of code it is goes by the numbers.
_TURNS = "t AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS path, 'f' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS name, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 #]', ' ', 'g') AS said, (conv_id + turn) % 5 AS p, (conv_id + turn) % 4 AS j FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    k, n = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 #]", " ")
    return c.select(F.concat(k, F.lit(":"), n).alias("path"), F.concat(F.lit("f"), k, F.lit("_"), n).alias("name"), said.alias("said"), ((F.col("conv_id") + F.col("turn")) % 5).alias("p"), ((F.col("conv_id") + F.col("turn")) % 4).alias("j"))


def _filled(turns: DataFrame, kinds: list[str], by: str) -> DataFrame:
    """(path, text): the kind of code that by says; @ stands for the name, ~ for what is said."""
    text = F.element_at(F.array(*map(F.lit, kinds)), F.col(by).cast("int") + 1)
    return turns.select("path", F.replace(F.replace(text, F.lit("@"), F.col("name")), F.lit("~"), F.col("said")).alias("text"))


#: A function with comment and docstring; a class by tabs, with a sign of comments in a string; what isn't Python; CRLF, blank lines and an async function; no definitions.
_PYTHON = ['def @(a, b=1):  # ~\n    """~"""\n    return a\n', 'class @:\n\tdef m(self, *args, **kw):\n\t\t"""~"""\n\t\tx = "#~"  # ~\n\t\treturn x\n', "def @(:\n    pass  # ~\n", 'async def @(x, *, y=1):\r\n\r\n  return "~ # no"\r\n', "# ~\nx = '~'\n\n\n# end"]
#: A variable, a function without an equals sign and an indented constant; a default value, CRLF and a comment; a name that only begins like a keyword; blank lines and wide spaces.
_JS = ["var @ = '~';\nfunction g() {}\n  const c = 1;\n", "async function @(a = 1) {\r\n  let $x_y = a;\r\n}\r\n// const z = 1; ~", 'const @="~"\n  letter = 2\n', "\n\nlet  @  =  5; // ~"]


def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(_turns(spark, sf_dir), _PYTHON, "p")


@query(
    "code_units",
    f"""WITH {_TURNS} SELECT path, 'function' AS kind, name, name || '(a, b)' AS signature, ltrim(said) AS docstring, 1 AS first, 3 AS last FROM t WHERE p = 0
    UNION ALL SELECT path, 'class', name, '', '', 1, 5 FROM t WHERE p = 1 UNION ALL SELECT path, 'function', 'm', 'm(self, *args, **kw)', ltrim(said), 2, 5 FROM t WHERE p = 1
    UNION ALL SELECT path, 'function', name, name || '(x, *, y)', '', 1, 3 FROM t WHERE p = 3""",
)
def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.python_units(_python(spark, sf_dir))


def _text_of(kinds: list[str], blank: bool) -> str:
    """SQL of a turn's code; blank: its comments as blanks."""
    gone = "' ' || ' ' || repeat(' ', length(said))"
    out = []
    for k, kind in enumerate(kinds):
        parts = []
        for i, piece in enumerate(kind.replace("# end", "     " if blank else "# end").split("~")):
            if blank and k not in (2, 3) and piece.endswith("# "):
                parts.append("'" + piece[:-2].replace("'", "''") + "'")
                parts.append(gone)
            else:
                parts.append("'" + piece.replace("'", "''") + "'")
                parts.append("said")
        sql = " || ".join(parts[:-1]).replace("@", "' || name || '")
        for sign, number in (("\n", 10), ("\r", 13), ("\t", 9)):
            sql = sql.replace(sign, f"' || chr({number}) || '")
        out.append(f"WHEN {k} THEN {sql}")
    return f"CASE p {' '.join(out)} END"


@query("code_without_comments", f"WITH {_TURNS} SELECT path, {_text_of(_PYTHON, True)} AS text FROM t")
def code_without_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.without_comments(_python(spark, sf_dir))


@query(
    "code_indentation",
    f"""WITH {_TURNS}, l AS (SELECT path, unnest(string_split({_text_of(_PYTHON, False)}, chr(10))) AS line FROM t), w AS (SELECT path, length(regexp_extract(line, '^( +)[^ ]', 1)) AS w FROM l WHERE regexp_matches(line, '^ +[^ ]')),
    n AS (SELECT path, w, count(*) AS n FROM w GROUP BY path, w) SELECT t.path, CAST(coalesce(arg_max(w, (n, -w)), 0) AS INTEGER) AS width FROM t LEFT JOIN n ON n.path = t.path GROUP BY t.path""",
)
def code_indentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.indentation(_python(spark, sf_dir))


@query(
    "js_declarations",
    f"""WITH {_TURNS} SELECT path, name, 1 AS line FROM t WHERE j < 3 UNION ALL SELECT path, 'c', 3 FROM t WHERE j = 0 UNION ALL SELECT path, '$x_y', 2 FROM t WHERE j = 1 UNION ALL SELECT path, name, 3 FROM t WHERE j = 3""",
)
def js_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function without an equals sign in its line is no declaration."""
    return readers.js_units(_filled(_turns(spark, sf_dir), _JS, "j"))


@query("version_rollback", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN min(event_id) ELSE first(event_id ORDER BY ts DESC, event_id DESC) END AS version, user_id % 3 = 0 AS rolled_back FROM events GROUP BY user_id")
def version_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saved versions; a third of the users go back to their first one, another third to one that was never saved."""
    e = table(spark, sf_dir, "events")
    saves = e.select("user_id", F.col("event_id").alias("version"), F.col("ts").alias("at"))
    back = e.groupBy("user_id").agg(F.when(F.col("user_id") % 3 == 0, F.min("event_id")).otherwise(F.lit(-1)).alias("version"), F.max("ts").alias("at")).where("user_id % 3 < 2")
    return series.active_versions(saves, back, ["user_id"])


@query("scene_registration", "SELECT c_custkey AS scene_id, CAST(c_nationkey AS DOUBLE) AS min_lon, CAST(c_nationkey * 2 AS DOUBLE) AS min_lat, CAST(c_nationkey + 1 AS DOUBLE) AS max_lon, CAST(c_nationkey * 2 + 1 AS DOUBLE) AS max_lat FROM customer WHERE c_custkey % 3 = 0")
def scene_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes whose bounding box is whole; a third have one of three values, a third none."""
    n = F.col("c_nationkey").cast("double")
    box = F.when(F.col("c_custkey") % 3 == 0, F.array(n, n * 2, n + 1, n * 2 + 1)).when(F.col("c_custkey") % 3 == 1, F.array(n, n, n))
    return spatial.registered(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scene_id"), box.alias("bbox")))


@query(
    "benchmark_items",
    "SELECT text AS query, CAST(item_id AS VARCHAR) AS gold, CASE WHEN item_id % 2 = 0 THEN text END AS reference_answer, item_id % 3 = 0 AS expected_abstain, CAST(length(text) AS VARCHAR) AS size FROM benchmark",
)
def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items written as JSON lines, with a blank one behind each, and read back."""
    k = F.col("item_id")
    item = F.struct(F.col("text").alias("query"), F.array(k.cast("string")).alias("gold_ids"), F.when(k % 2 == 0, F.col("text")).alias("reference_answer"), (k % 3 == 0).alias("expected_abstain"), F.create_map(F.lit("size"), F.length("text").cast("string")).alias("metadata"))
    to = new_folder(spark, "benchmark")
    table(spark, sf_dir, "benchmark").select(F.concat(F.to_json(item), F.lit("\n")).alias("value")).write.text(to)
    return readers.benchmark(spark, to).select("query", F.array_join("gold_ids", ",").alias("gold"), "reference_answer", "expected_abstain", F.col("metadata")["size"].alias("size"))


@query(
    "weather_samples",
    "SELECT CAST(user_id AS DOUBLE) AS relative_humidity_2m, date_trunc('second', ts) AS time, value AS temperature_2m, value * 2 AS wind_speed_10m, CASE WHEN event_id % 5 > 0 THEN CAST(event_id AS DOUBLE) END AS surface_pressure FROM events",
)
def weather_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a weather table in CSV, some values missing, and read back."""
    e = F.col("event_id").cast("double")
    rows = table(spark, sf_dir, "events").select(
        F.date_trunc("second", "ts").cast("timestamp").alias("time"), F.col("value").alias("temperature_2m"), F.col("user_id").cast("double").alias("relative_humidity_2m"), (F.col("value") * 2).alias("wind_speed_10m"),
        F.when(F.col("event_id") % 5 > 0, e).alias("surface_pressure"), e.alias("shortwave_radiation"), e.alias("et0_fao_evapotranspiration"),
    )
    to = new_folder(spark, "weather")
    rows.write.option("header", "true").csv(to)
    return readers.weather(spark, to).select("relative_humidity_2m", F.col("time").cast("timestamp_ntz").alias("time"), "temperature_2m", "wind_speed_10m", "surface_pressure")
