"""Folders of scenes as a data source of Spark: a folder holds metadata (MTL.json) and a file for each band.

Metadata is read once for each scene, when partitions are planned. A partition is one band's file; filters on scene and band
leave files out before anything of them is read. Band files are arrays in numpy's own format, read a few rows at a time.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT = "quern_scene"
# Bands of a scene, those that may be missing, and instruments by the begin of a product's name.
BANDS = ("blue", "green", "red", "nir08", "swir16", "swir22", "lwir11", "qa", "qa_pixel")
OPTIONAL = ("qa", "qa_pixel")
INSTRUMENTS = {"LC08": "oli", "LO08": "oli", "LC09": "oli_tirs", "LE07": "etm", "LC07": "etm", "LT05": "tm", "LC05": "tm"}
#: Pixels that are read at once.
BLOCK = 1 << 18

SCHEMA = "scene_id string, band string, y bigint, x int, value double, platform string, sensor string, cloud_cover double, sun_elevation double, sun_azimuth double, path int, row int"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])


def described(raw: dict) -> dict:
    """platform, sensor, cloud_cover, sun_elevation, sun_azimuth, path and row of a scene's metadata; what is missing is null, cloud cover 0."""
    number = lambda k, to: None if raw.get(k) is None else to(raw[k])
    told = raw.get("instruments") or []
    sensor = "_".join(told).lower() if isinstance(told, list) else str(told).lower()
    return {
        "platform": raw.get("platform", "unknown"),
        "sensor": sensor or INSTRUMENTS.get(str(raw.get("LANDSAT_PRODUCT_ID", ""))[:4], "unknown"),
        "cloud_cover": float(raw.get("cloud_cover") or 0.0),
        **{k: number(k, float) for k in ("sun_elevation", "sun_azimuth")},
        **{k: number(k, int) for k in ("path", "row")},
    }


@dataclass
class Band(InputPartition):
    scene_id: str
    band: str
    file: str
    facts: dict = field(default_factory=dict)


class SceneReader(DataSourceReader):
    """Scenes are the folders below the path that hold MTL.json, or the path itself."""

    def __init__(self, path: str, bands: list[str]):
        self.path, self.bands = path, bands
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and (name := f.attribute[0]) in ("band", "scene_id"):
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Band]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        kinds = {posixpath.basename(x.path): x.type for x in fs.get_file_info(pyarrow.fs.FileSelector(root))}
        folders = [root] if "MTL.json" in kinds else sorted(posixpath.join(root, n) for n, t in kinds.items() if t == pyarrow.fs.FileType.Directory)
        out = []
        for folder in folders:
            scene = posixpath.basename(folder.rstrip("/"))
            if scene not in self.only.get("scene_id", {scene}):
                continue
            names = {posixpath.basename(x.path) for x in fs.get_file_info(pyarrow.fs.FileSelector(folder))}
            if "MTL.json" not in names:
                raise ValueError(f"no MTL.json in {folder}")
            with fs.open_input_stream(posixpath.join(folder, "MTL.json")) as f:
                facts = described(json.loads(f.read()))
            for band in self.bands:
                if f"{band}.npy" in names:
                    if band in self.only.get("band", {band}):
                        out.append(Band(scene, band, posixpath.join(folder, f"{band}.npy"), facts))
                elif band not in OPTIONAL:
                    raise ValueError(f"no band {band} in {folder}")
        return out

    def read(self, partition: Band | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # all is left out
            return
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(partition.file, compression=None) as f:
            version = np.lib.format.read_magic(f)
            shape, columnwise, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
            if len(shape) != 2 or columnwise:
                raise ValueError(f"{partition.file} is no array of rows")
            height, width = shape
            rows = max(1, BLOCK // max(1, width))
            for lo in range(0, height, rows):
                n = min(rows, height - lo)
                raw = f.read(n * width * dtype.itemsize)
                if len(raw) < n * width * dtype.itemsize:
                    raise ValueError(f"{partition.file} ends within a row")
                v = np.frombuffer(raw, dtype).astype(float)
                own = {"scene_id": partition.scene_id, "band": partition.band, **partition.facts}
                columns = {"y": np.repeat(np.arange(lo, lo + n), width), "x": np.tile(np.arange(width, dtype=np.int32), n), "value": pa.array(v, mask=~np.isfinite(v))}
                full = [columns[c] if c in columns else pa.array([own[c]] * len(v), _ARROW.field(c).type) for c in _COLUMNS]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in full], schema=_ARROW)


class Scenes(DataSource):
    """Options: path, and bands (names with commas between them; all by default)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SceneReader:
        return SceneReader(self.options["path"], [b.strip() for b in self.options.get("bands", ",".join(BANDS)).split(",")])


def scenes(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    """A row for each pixel and band of the scenes in a folder, values as they are stored (no rescaling), with the scalars of their scene; no data and what isn't finite is null.

    A scene without metadata, or without a band that isn't one of quality, is an error. Filters on scene_id and band leave files
    out.
    """
    spark.dataSource.register(Scenes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format(FORMAT).option("path", path)
    return (read.option("bands", ",".join(bands)) if bands else read).load()


def side_by_side(rows: DataFrame, bands: list[str]) -> DataFrame:
    """(scene_id, y, x, a column for each band and the scene's scalars): pixels, from a row for each band; only the asked bands' files are read."""
    facts = _COLUMNS[5:]
    own = rows.where(F.col("band").isin(bands))
    values = [F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands]
    return own.groupBy("scene_id", "y", "x").agg(*values, *[F.max(c).alias(c) for c in facts])
