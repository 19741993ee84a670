"""Folders of scenes, made here and read back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import scene_source as S


def folder(root, name, bands, meta=True, shape=(40, 7)):
    rng = np.random.default_rng(len(name))
    path = root / name
    path.mkdir(parents=True)
    if meta is not None:
        (path / "MTL.json").write_text(json.dumps(meta if isinstance(meta, dict) else {"platform": "landsat-8", "instruments": ["OLI", "TIRS"], "cloud_cover": 12.5, "sun_elevation": 61, "path": "165", "row": 38}))
    out = {}
    for b in bands:
        out[b] = (rng.random(shape) * 100).astype("f4" if b != "qa_pixel" else "u2")
        np.save(path / f"{b}.npy", out[b])
    return out


ALL = [b for b in S.BANDS if b not in S.OPTIONAL]


def test_scenes_are_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    a = folder(tmp_path, "a", [*ALL, "qa_pixel"])
    a["red"][3, 4] = np.nan
    np.save(tmp_path / "a" / "red.npy", a["red"])
    b = folder(tmp_path, "b", ALL, {"LANDSAT_PRODUCT_ID": "LC09_L2SP"}, (3, 2))
    got = {(r.scene_id, r.band, r.y, r.x): r for r in S.scenes(spark, str(tmp_path)).collect()}
    assert len(got) == 8 * 280 + 7 * 6
    for name, bands in (("a", a), ("b", b)):
        for band, v in bands.items():
            for (y, x), value in np.ndenumerate(v):
                assert got[name, band, y, x].value == (None if np.isnan(value) else float(value))
    one, two = got["a", "red", 0, 0], got["b", "red", 0, 0]
    assert (one.platform, one.sensor, one.cloud_cover, one.sun_elevation, one.sun_azimuth, one.path, one.row) == ("landsat-8", "oli_tirs", 12.5, 61.0, None, 165, 38)
    assert (two.platform, two.sensor, two.cloud_cover, two.path) == ("unknown", "oli_tirs", 0.0, None)
    assert S.scenes(spark, str(tmp_path / "b")).count() == 42  # a scene's own folder


def test_files_of_other_bands_and_scenes_are_not_read(spark, tmp_path):
    for name in ("a", "b", "c"):
        folder(tmp_path, name, ALL)
        (tmp_path / name / "swir22.npy").write_bytes(b"not an array")
    rows = S.scenes(spark, str(tmp_path))
    few = rows.where(F.col("band").isin("red", "nir08") & (F.col("scene_id") == "b") & (F.col("y") < 2))
    assert few.count() == 2 * 14 and few.rdd.getNumPartitions() == 2
    assert rows.where("band = 'none'").count() == 0
    with pytest.raises(Exception, match="swir22|magic"):
        rows.where("band = 'swir22'").count()
    px = S.side_by_side(rows, ["red", "nir08"])
    assert px.count() == 3 * 280 and set(px.columns) >= {"scene_id", "y", "x", "red", "nir08", "cloud_cover"}
    assert S.scenes(spark, str(tmp_path), ["red"]).rdd.getNumPartitions() == 3


def test_what_is_missing_is_an_error(spark, tmp_path):
    folder(tmp_path / "no-meta", "a", ALL, None)
    folder(tmp_path / "no-band", "a", ALL[1:])
    for name, what in (("no-meta", "MTL.json"), ("no-band", "blue")):
        with pytest.raises(Exception, match=what):
            S.scenes(spark, str(tmp_path / name)).count()
    folder(tmp_path / "short", "a", ALL)
    raw = (tmp_path / "short" / "a" / "red.npy").read_bytes()
    (tmp_path / "short" / "a" / "red.npy").write_bytes(raw[:-5])
    with pytest.raises(Exception, match="ends within"):
        S.scenes(spark, str(tmp_path / "short")).count()
