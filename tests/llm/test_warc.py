import gzip
import hashlib
import json
import os
import random

import pytest

from quern.llm import warc as W

PAGES = "page_id bigint, url string, html string, target bigint, mark string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "m") for r in rows], PAGES)


def want(rows):
    """(page_id, bytes, digest, type, refers_to) by the rules."""
    out, groups = [], {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    for payload, pages in groups.items():
        top = max(pages, key=lambda x: (x is not None, x or 0))
        met = False
        for page in pages:
            first = page == top and not met
            met = met or first
            out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), *(("response", None) if first or len(payload) < W.REVISIT_BYTES else ("revisit", top))))
    return sorted(out, key=str)


def rows_of(n=400, seed=1):
    rng = random.Random(seed)
    texts = ["", "short", "x" * 999, "y" * 1000, "é" * 500, "<p>" + "long text " * 500, "z" * 5000]
    rows = [(i, f"http://h/{i}", rng.choice(texts) if rng.random() < 0.5 else f"<p>{i}</p>" * rng.randrange(1, 400)) for i in range(n)]
    rows += [(5, "http://h/5", "y" * 1000), (5, "http://h/5", "y" * 1000), (n + 1, "http://h/again", "k" * 2000), (n + 1, "http://h/again", "k" * 2000), (None, "http://h/none", "y" * 1000)]
    return [*rows, (None, None, None), (None, None, "q" * 3000), (None, None, "q" * 3000), (-(2**63), "u", "a"), (2**63 - 1, "u", "b" * 1000), (-3, "u\r\nWARC-Type: x ", "c")]


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("range_bytes", [1 << 30, 40_000])
def test_round_trip(spark, tmp_path, range_bytes):
    rows = rows_of()
    W.write_archives(table(spark, rows), str(tmp_path / "a"), roll=20_000, range_bytes=range_bytes)
    got = W.read_archives(spark, str(tmp_path / "a"))
    assert result(got) == want(rows)
    kept = got.where("record_type = 'response'").collect()
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in kept)
    assert got.where("record_type = 'revisit' AND payload IS NOT NULL").count() == 0
    assert len({r.record_id for r in got.collect()}) == len(rows)
    files = json.loads((tmp_path / "a" / W.MANIFEST).read_text())["files"]
    assert sorted([W.MANIFEST, *(f["name"] for f in files)]) == sorted(os.listdir(tmp_path / "a"))  # nothing temporary is left
    assert len(files) > 2 and all(f["bytes"] < 20_000 + 10_000 for f in files)
    for f in files:
        raw = (tmp_path / "a" / f["name"]).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == f["sha256"] and len(raw) == f["bytes"]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    ids = [r.page_id for r in got.collect() if r.page_id is not None]
    assert {r.url for r in got.where("page_id = -3").collect()} == {"u%0D%0AWARC-Type: x%20"}
    assert len(ids) == len([r for r in rows if r[0] is not None])


def test_same_rows_give_the_same_bytes(spark, tmp_path):
    rows = rows_of(300, 2)
    for name, order, parts in (("a", rows, 3), ("b", rows[::-1], 7)):
        W.write_archives(table(spark, order).repartition(parts), str(tmp_path / name), range_bytes=60_000)
    a, b = ({f: (tmp_path / d / f).read_bytes() for f in os.listdir(tmp_path / d)} for d in "ab")
    assert a == b and len(a) > 3


def test_ranges_are_sorted_and_even(spark, tmp_path):
    rows = [(i, None, f"{i}" * 200) for i in range(2000)] + [(7, None, f"{i}-" * 100) for i in range(1000)]  # one id with a third of all rows
    W.write_archives(table(spark, rows), str(tmp_path / "a"), range_bytes=100_000)
    files = json.loads((tmp_path / "a" / W.MANIFEST).read_text())["files"]
    sizes = [f["records"] for f in files]
    assert len(sizes) > 8 and max(sizes) < 3 * sum(sizes) / len(sizes)
    last = None
    for f in files:
        with open(tmp_path / "a" / f["name"], "rb") as s:
            for raw in W.members(s):
                if row := W.row_of(raw, False):
                    assert last is None or last <= row[0]
                    last = row[0]


def test_an_empty_table(spark, tmp_path):
    W.write_archives(table(spark, []), str(tmp_path / "a"))
    assert W.read_archives(spark, str(tmp_path / "a")).count() == 0


def test_failed_and_repeated_attempts_leave_nothing(tmp_path):
    import pyarrow as pa

    class Task:
        def partitionId(self):
            return 0

    writer = W.ArchiveWriter(str(tmp_path / "a"), 1 << 20, 1000, "d")
    W.TaskContext.get, kept = classmethod(lambda cls: Task()), W.TaskContext.get
    try:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("target", pa.int64()), ("mark", pa.int32())])
        part = pa.RecordBatch.from_pylist([{"page_id": 1, "url": "u", "payload": b"x", "target": None, "mark": 1}], schema)
        lost, done = writer.write(iter([part])), writer.write(iter([part]))
    finally:
        W.TaskContext.get = kept
    assert lost.files[0]["name"] == done.files[0]["name"] and len(os.listdir(tmp_path / "a" / W.TEMPORARY)) == 2
    writer.commit([done, None])
    assert sorted(os.listdir(tmp_path / "a")) == [W.MANIFEST, done.files[0]["name"]]
    writer.abort([None])


def test_damage_is_seen(spark, tmp_path):
    W.write_archives(table(spark, [(1, "u", "text " * 300)]), str(tmp_path / "a"))
    name = next(f for f in os.listdir(tmp_path / "a") if f != W.MANIFEST)
    raw = gzip.decompress((tmp_path / "a" / name).read_bytes())
    (tmp_path / "a" / name).write_bytes(gzip.compress(raw.replace(b"text text", b"text tent", 1)))
    with pytest.raises(Exception, match="is not what its headers say|member|record"):
        W.read_archives(spark, str(tmp_path / "a")).collect()


def test_ids_survive_in_records():
    for page in (None, 0, 1, -1, 2**63 - 1, -(2**63), 2**62, 123456789):
        assert W.page_of(W.record_id(page, b"abcdef", 3)) == page
        assert W.record_id(page, b"abcdef", 3).split("-")[2][0] == "8"
