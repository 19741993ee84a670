"""WARC archives: a deterministic sharded writer and a reader, as a data source of Spark.

Records are dealt out by ranges of their id, whose bounds depend on the rows alone, and sorted in each range. A task writes
its range to files that roll by compressed size, under temporary names; every record is a gzip member of its own with
regenerated headers and digests, and a payload that another page has already becomes a revisit of that page's record. When all
tasks are done the driver gives the files their names and writes a manifest last; the reader knows files by the manifest only.
So the same rows give the same bytes, and neither lost executors nor a failed job leave half an archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import store

#: Bytes of payload of a range, about; keys that are sampled for each range; compressed bytes after which a file is closed.
RANGE_BYTES, KEYS_PER_RANGE, ROLL_BYTES = 32 << 20, 100, 1 << 30
#: Bytes from which an equal payload is stored once.
REVISIT_BYTES = 1000
FORMAT, MANIFEST, TEMPORARY = "quern_warc", "manifest.json", "_temporary"
# Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

INPUT = "page_id bigint, url string, payload binary, target bigint, mark int"
OUTPUT = "page_id bigint, url string, record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
_OUTPUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


# --- records -------------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, payload: bytes, copy: int) -> str:
    """A UUID (version 8) that holds a page's id; the begin of the payload's digest and a number tell records of one page apart."""
    n = 0 if page_id is None else page_id & (2**64 - 1)
    bits = int.from_bytes(payload[:3]) << 104 | copy % 2**24 << 80 | 8 << 76 | (page_id is None) << 66 | n >> 62 << 64 | 2 << 62 | n & (2**62 - 1)
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def page_of(record: str) -> int | None:
    """The page's id that a record's id holds."""
    bits = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    n = (bits >> 64 & 3) << 62 | bits & (2**62 - 1)
    return None if bits >> 66 & 1 else n - (n >> 63 << 64)


def labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def bare(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def _uri(url: str) -> str:
    """A URL that fits in a header: control characters and what surrounds it are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" or c == " " and i in (0, len(url) - 1) else c for i, c in enumerate(url))


def record(kind: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    """One record as a gzip member, the same bytes for the same content."""
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Date: {date}", f"WARC-Block-Digest: {labelled(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + _END) + press.compress(block) + press.compress(_END) + press.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, copy: int, target: tuple[int | None] | None, date: str) -> bytes:
    """A response, or, with a target (the id of the page that holds the payload), a revisit with the HTTP header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = hashlib.sha1(payload).digest()
    headers = [("WARC-Record-ID", record_id(page_id, digest, copy)), *([("WARC-Target-URI", _uri(url))] if url is not None else []), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", labelled(digest))]
    if target:
        return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(target[0], digest, 0))], head, date)
    return record("response", headers, head + payload, date)


def members(stream) -> Iterator[bytes]:
    """What the gzip members of a stream hold, one after the other."""
    held = b""
    while held or (held := stream.read(1 << 16)):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            out.append(one.decompress(held))
            held = one.unused_data
            if not one.eof and not (held := stream.read(1 << 16)):
                raise ValueError("an archive ends within a record")
        yield b"".join(out)


def parsed(raw: bytes) -> tuple[dict[str, str], memoryview]:
    """Headers (names in lower case) and block of a record, held against its block digest."""
    split = raw.index(_END)
    version, *lines = raw[:split].decode().split("\r\n")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = memoryview(raw)[split + 4 : split + 4 + int(headers["content-length"])]
    if not version.startswith("WARC/") or labelled(hashlib.sha1(block).digest()) != headers["warc-block-digest"]:
        raise ValueError(f"record {headers.get('warc-record-id')} is not what its headers say")
    return headers, block


def row_of(raw: bytes, payloads: bool) -> tuple | None:
    """The row of OUTPUT that a record gives; none for a warcinfo."""
    headers, block = parsed(raw)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    split = bytes(block[:4096]).index(_END) + 4
    http = dict(x.split(": ", 1) for x in bytes(block[: split - 4]).decode().split("\r\n")[1:])
    payload, digest = block[split:], bare(headers["warc-payload-digest"])
    if kind == "response" and (len(payload) != int(http["Content-Length"]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} is not what its headers say")
    refers = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
    return page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-record-id"], kind, int(http["Content-Length"]), digest, refers, bytes(payload) if payloads and kind == "response" else None


# --- data source ---------------------------------------------------------------------------------------------------------


@dataclass
class Files(WriterCommitMessage):
    """Files of one task: temporary name, name, records, bytes and SHA-256 each."""

    files: list[dict]


class ArchiveWriter(DataSourceArrowWriter):
    """Rows of INPUT, each task's in order -> files of one folder.

    A row with mark 0 says that pages of this id and payload digest (in payload) revisit target; it stands before them.
    """

    def __init__(self, path: str, roll: int, revisit: int, date: str):
        self.path, self.roll, self.revisit, self.date = path, roll, revisit, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(posixpath.join(root, TEMPORARY))
        task = TaskContext.get()
        shard, attempt = task.partitionId(), uuid.uuid4().hex
        files: list[dict] = []
        out, digest = None, hashlib.sha256()

        def put(raw: bytes) -> None:
            out.write(raw)
            digest.update(raw)
            files[-1]["bytes"] += len(raw)

        def close() -> None:
            out.close()
            files[-1]["sha256"] = digest.hexdigest()

        said, last, copy = None, None, 0  # the last role, and the last payload of a page with how often it was met before
        for part in iterator:
            ids, urls, payloads, targets, marks = (part.column(c) for c in ("page_id", "url", "payload", "target", "mark"))
            for i in range(part.num_rows):
                page, payload = ids[i].as_py(), payloads[i].as_py()
                if marks[i].as_py() == 0:
                    said = (page, payload), (targets[i].as_py(),)
                    continue
                key = page, hashlib.sha1(payload).digest()
                copy = copy + 1 if last == key else 0
                target = said[1] if said and said[0] == key else (page,) if last == key and len(payload) >= self.revisit else None
                last = key
                if out is not None and files[-1]["bytes"] >= self.roll:
                    close()
                    out = None
                if out is None:
                    name = f"pages-{shard:06d}-{len(files):04d}.warc.gz"
                    files.append({"name": name, "temporary": f"{TEMPORARY}/{name}-{attempt}", "records": 0, "bytes": 0})
                    out, digest = fs.open_output_stream(posixpath.join(root, files[-1]["temporary"]), compression=None), hashlib.sha256()
                    about = b"software: quern\r\nformat: WARC File Format 1.1\r\n"
                    put(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], about, self.date))
                put(page_record(page, urls[i].as_py(), payload, copy, target, self.date))
                files[-1]["records"] += 1
        if out is not None:
            close()
        return Files(files)

    def commit(self, messages: list[Files | None]) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        for f in files:
            fs.move(posixpath.join(root, f.pop("temporary")), posixpath.join(root, f["name"]))
        with fs.open_output_stream(posixpath.join(root, f"{MANIFEST}.new")) as out:
            out.write(json.dumps({"files": files}, indent=1).encode())
        fs.move(posixpath.join(root, f"{MANIFEST}.new"), posixpath.join(root, MANIFEST))
        self.abort(messages)  # what attempts that were not committed have left

    def abort(self, messages: list[Files | None]) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        if fs.get_file_info(posixpath.join(root, TEMPORARY)).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(posixpath.join(root, TEMPORARY))


@dataclass
class ArchiveFile(InputPartition):
    name: str
    records: int


class ArchiveReader(DataSourceReader):
    """A partition for each file of the manifest."""

    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads = path, payloads

    def partitions(self) -> list[ArchiveFile]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(posixpath.join(root, MANIFEST)) as f:
            return [ArchiveFile(x["name"], x["records"]) for x in json.loads(f.read())["files"]]

    def read(self, partition: ArchiveFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        rows, held, met = [], 0, 0
        with fs.open_input_stream(posixpath.join(root, partition.name), compression=None) as f:
            for raw in members(f):
                if row := row_of(raw, self.payloads):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    met += 1
                if len(rows) >= 1024 or held >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUTPUT.types, strict=True)], schema=_OUTPUT)
                    rows, held = [], 0
        if met != partition.records:
            raise ValueError(f"{partition.name} has {met} records, the manifest says {partition.records}")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUTPUT.types, strict=True)], schema=_OUTPUT)


class Archives(DataSource):
    """Options: path; payloads (true; false leaves the column null); when writing roll (compressed bytes of a file), revisit (least bytes) and date."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return OUTPUT

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("payloads", "true") == "true")

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        o = self.options
        return ArchiveWriter(o["path"], int(o.get("roll", ROLL_BYTES)), int(o.get("revisit", REVISIT_BYTES)), o.get("date", "1970-01-01T00:00:00Z"))


# --- whole tables --------------------------------------------------------------------------------------------------------


def _key(page_id: Column, digest: Column) -> Column:
    """What rows are sorted by: the id (null first), then a part of the digest, so that rows of one id can be dealt out."""
    return F.struct(F.coalesce(page_id, F.lit(-(2**63))).alias("k"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("d"))


def bounds(narrow: DataFrame, ranges: int) -> list:
    """Keys that divide the rows in about equal ranges: quantiles of the KEYS_PER_RANGE * ranges distinct keys of the smallest hashes."""
    keys = narrow.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(KEYS_PER_RANGE * ranges).collect()
    keys = sorted((r["key"]["k"], r["key"]["d"]) for r in keys)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)})


def range_of(key: Column, at: list) -> Column:
    """How many bounds are not above the key, by halving."""
    if not at:
        return F.lit(0)
    table = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(d).cast("bigint").alias("d")) for k, d in at])
    lo, hi = F.lit(0), F.lit(len(at))
    whole = F.struct(lo.alias("lo"), hi.alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        left = (s["lo"] < s["hi"]) & (F.get(table, mid) <= key)
        return F.struct(F.when(left, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(left | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(at).bit_length())), whole, half, lambda s: s["lo"])


def write_archives(pages: DataFrame, to: str, roll: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages (page_id, url, html) to a new folder; the payload is the html as UTF-8.

    Of rows with equal payloads of at least REVISIT_BYTES that of the largest page_id (null is the least) is a response; all
    others, rows that repeat it included, revisit it. A null html is an empty payload, a null url gives no target; control
    characters of a URL are percent-encoded. An empty table gives an archive without files. Other columns are left out.
    """
    spark = pages.sparkSession
    spark.dataSource.register(Archives)
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("bigint"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    own = own.withColumn("key", _key(F.col("page_id"), F.col("digest")))
    narrow = store(own.select("page_id", "digest", "key", F.octet_length("html").alias("bytes")), "payloads")
    ranges = max(1, -(-(narrow.agg(F.sum("bytes")).first()[0] or 0) // range_bytes))
    at = bounds(narrow, ranges)
    large = narrow.where(f"bytes >= {REVISIT_BYTES}")
    # Counted before they are joined: a row for each payload that is met more than once.
    groups = store(large.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    roles = large.join(groups, "digest").where("NOT page_id <=> target").select("page_id", "digest", "target", "key").distinct()
    roles = roles.select("page_id", F.lit(None).cast("string").alias("url"), F.unhex("digest").alias("payload"), "target", F.lit(0).alias("mark"), "key")
    rows = own.select("page_id", "url", F.col("html").cast("binary").alias("payload"), F.lit(None).cast("bigint").alias("target"), F.lit(1).alias("mark"), "key")
    # The texts are moved once: roles go with them to their range, instead of a join.
    dealt = rows.unionByName(roles).withColumn("range", range_of(F.col("key"), at))
    dealt = dealt.repartitionById(len(at) + 1, F.col("range").cast("int")).sortWithinPartitions("key", "mark", "url")
    dealt.select("page_id", "url", "payload", "target", "mark").write.format(FORMAT).mode("append").option("path", to).option("roll", str(roll)).option("revisit", str(REVISIT_BYTES)).option("date", date).save()


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record_id, record_type, payload_bytes and payload_digest (of the full payload), refers_to (for revisits the page that holds it) and payload (of responses) of every record.

    Blocks and payloads are held against their digests, files against the manifest.
    """
    spark.dataSource.register(Archives)
    return spark.read.format(FORMAT).option("path", path).option("payloads", str(payloads).lower()).load()


def round_trip(pages: DataFrame, to: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row of pages, from archives written to a folder and read back."""
    write_archives(pages, to)
    return read_archives(pages.sparkSession, to, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN CAST(top AS BIGINT) END AS refers_to
FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
