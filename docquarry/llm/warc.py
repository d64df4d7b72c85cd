"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by identifier, digest and address, and a shard is a stretch of about SHARD_BYTES of that order, found
from a running sum over the records' sizes. So the same table gives the same archives however the job is scheduled and
however its identifiers lie. Payloads travel once, to the task of their shard; what each needs to know of its group of
equal payloads stands before it in the sorted rows. A task writes its shards one after another, compresses what is no
revisit, rolls a file when its compressed size
is reached, regenerates all headers and digests, and renames each finished file from a temporary name of its own.
The manifest, committed by Spark when all tasks are through, names the files that count; readers open no others, and
a task that runs again replaces its files by equal ones.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, named, scratch_path, small_batches

#: Compressed bytes at which a file is rolled, bytes of payload in a shard, and bytes from which equal payloads are revisits.
ROLL_BYTES, SHARD_BYTES, REVISIT_BYTES = 64 << 20, 16 << 20, 1000
#: Bytes that a record counts besides its payload, and the most shards, whose first keys are broadcast; beyond 1.6 TB shards grow.
RECORD_BYTES, MAX_SHARDS = 400, 100_000
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "file string, shard long, records long, compressed_bytes long, sha256 string"


def _gzip(record: bytes) -> bytes:
    """One gzip member with no time in it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: object, url: str | None, sha1: str, length: int, payload: bytes | None, refers_to: object = None, date: str = DATE) -> bytes:
    """The gzip member of one page: a response, or where payload is None a revisit with headers only that names its response."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (payload or b"")
    target = "".join(f"%{ord(c):02X}" if c in "\r\n\t <>" else c for c in url or f"urn:page:{page}")
    fields = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date), ("WARC-Target-URI", target)]
    if payload is None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("WARC-Payload-Digest", sha1), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if page is not None:
        fields.append(("X-Page", str(page)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return _gzip(head.encode() + block + b"\r\n\r\n")


def _info(name: str, date: str) -> bytes:
    block = b"software: docquarry\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return _gzip(head.encode() + block + b"\r\n\r\n")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class _Roll:
    """The open file of a task."""

    def __init__(self, folder: str, roll_bytes: int, date: str) -> None:
        self.fs, self.folder = _file_system(folder)
        self.roll, self.date, self.out = roll_bytes, date, None
        self.done: list[tuple] = []

    def add(self, shard: int, member: bytes) -> None:
        if self.out and (shard != self.shard or self.size >= self.roll):
            self.close()
        if not self.out:
            self.part = self.part + 1 if self.done and shard == self.shard else 0
            self.shard, self.records = shard, 0
            self.name = f"pages-{shard:08d}-{self.part:04d}.warc.gz"
            self.temp = f"{self.folder}/_temporary/{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.out, self.hash, self.size = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0
            self.write(_info(self.name, self.date))
        self.write(member)
        self.records += 1

    def write(self, member: bytes) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.fs.move(self.temp, f"{self.folder}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, self.hash.hexdigest()))
            self.out = None


_KEY = ["page", "digest", "place"]
_ROW = "shard long, page long, digest binary, place long, kind int, url string, first long, times long, payload binary"


def _order() -> list:
    return [F.col("page").asc_nulls_first(), F.col("digest"), F.col("place")]


def _key(page: int | None, digest: bytes, place: int) -> tuple:
    return (page is not None, page or 0, digest, place)


def _sharded(meta: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """meta (page, digest, place, n, length, first) with shard and last_shard, and the number of shards.

    The running sum is exact: a sum within each range partition, and before it those of the partitions in front.
    """
    spark = meta.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = F.col("length") + RECORD_BYTES
    ranged = materialize(meta.repartitionByRange(n, *_order()).withColumn("part", F.spark_partition_id()), "warc-keys")
    sums = sorted(map(tuple, ranged.groupBy("part").agg(F.sum(F.col("n") * each)).collect()))  # a row a partition
    before = list(itertools.accumulate((size for _, size in sums), initial=0))
    size = max(shard_bytes, before[-1] // MAX_SHARDS + 1)
    starts = spark.createDataFrame([(part, at) for (part, _), at in zip(sums, before, strict=False)], "part int, before long")
    running = F.sum(F.col("n") * each).over(Window.partitionBy("part").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("run", F.coalesce(running, F.lit(0))).join(F.broadcast(starts), "part").withColumn("at", F.col("before") + F.col("run"))
    shard = lambda at: F.floor(at / F.lit(size)).cast("long")
    placed = placed.select(*_KEY, "n", "first", each.alias("each"), "at", shard(F.col("at")).alias("shard"), shard(F.col("at") + (F.col("n") - 1) * each).alias("last_shard"), F.lit(size).cast("long").alias("size"))
    return materialize(placed, "warc-shards"), -(-before[-1] // size)


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> DataFrame:
    """Write one record per row of df below folder and return the manifest: file, shard, records, compressed_bytes, sha256.

    Null payloads count as empty. Of the rows whose payloads are equal and at least revisit_bytes long, that with the
    largest identifier is the response. Repeated rows become a record each; two rows with that largest identifier are both
    responses. Rows without an identifier come first; if all rows of a group lack one, all are responses. Rows that are alike in everything travel
    as one with a count where they fill more than a shard, and are dealt over as many shards as they fill. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    small_batches(df.sparkSession)
    payload = F.coalesce(named(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(named(id_col).cast("long").alias("page"), named(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page", F.unhex(F.sha2("payload", 256)).alias("digest"), F.xxhash64("url").alias("place"), "url", "payload")
    meta = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.first(F.octet_length("payload")).cast("long").alias("length"))
    meta = materialize(meta, "warc-records")
    groups = meta.where(F.col("length") >= revisit_bytes).groupBy("digest").agg(F.max("page").alias("first"), F.sum("n").alias("all")).where("all > 1 and first is not null")
    meta = meta.join(groups.select("digest", "first"), "digest", "left").withColumn("first", F.expr("CASE WHEN page IS NULL OR page <> first THEN first END"))
    meta, shards = _sharded(meta, shard_bytes)
    spread = meta.where("last_shard > shard")
    starts = sorted((_key(r["k"]["page"], bytes(r["k"]["digest"]), r["k"]["place"]), r["shard"]) for r in meta.groupBy("shard").agg(F.min_by(F.struct(*_KEY), F.struct(F.col("page").isNotNull(), *_KEY)).alias("k")).collect())  # a row a shard
    wide = {_key(r["page"], bytes(r["digest"]), r["place"]) for r in spread.select(*_KEY).collect()}  # each fills a shard, so no more than these
    sent = spark.sparkContext.broadcast(([k for k, _ in starts], [s for _, s in starts], wide))

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, wide = sent.value
        for b in batches:
            mine = [_key(*k) for k in zip(*(b[c].to_pylist() for c in _KEY), strict=True)]
            shard = pa.array([None if k in wide else numbers[bisect.bisect_right(keys, k) - 1] for k in mine], pa.int64())
            none = pa.nulls(len(b), pa.int64())
            made = {"shard": shard, "kind": pa.array([1] * len(b), pa.int32()), "first": none, "times": none} | {c: b[c] for c in (*_KEY, "url", "payload")}
            names = [c.split()[0] for c in _ROW.split(", ")]
            out = pa.RecordBatch.from_arrays([made[c] for c in names], names)
            yield out.filter(shard.is_valid()) if wide else out

    every = rows.mapInArrow(to_shards, _ROW)
    nothing = {c: F.lit(None).cast(t) for c, t in (f.split() for f in _ROW.split(", "))}
    full = lambda part, kind: part.select(*(F.lit(kind).alias("kind") if c == "kind" else F.col(c) if c in part.columns else v.alias(c) for c, v in nothing.items()))
    every = every.unionByName(full(meta.where("first is not null and last_shard = shard").select("shard", *_KEY, "first"), 0))
    if wide:
        one = rows.join(F.broadcast(spread.select(*(F.col(c).alias(f"_{c}") for c in _KEY))), F.expr(" AND ".join(f"{c} <=> _{c}" for c in _KEY)), "left_semi")
        one = one.groupBy(*_KEY).agg(F.first("url").alias("url"), F.first("payload").alias("payload"))
        upto = "least(n, greatest(0, ceil(({} * size - at) / each)))"
        parts = spread.withColumn("shard", F.explode(F.sequence("shard", "last_shard"))).withColumn("times", F.expr(f"{upto.format('(shard + 1)')} - {upto.format('shard')}").cast("long")).where("times > 0")
        every = every.unionByName(full(parts.select("shard", *_KEY, "first", "times"), 0))
        both = parts.select("shard", *(F.col(c).alias(f"_{c}") for c in _KEY)).join(one, F.expr(" AND ".join(f"{c} <=> _{c}" for c in _KEY)))
        every = every.unionByName(full(both.select("shard", *_KEY, "url", "payload"), 1))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    # shards in turn over the tasks: for each task a key that Spark's hash deals to it, so that no two shards meet by chance
    lots = spark.range(16 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("task")).agg(F.min("id").alias("lot"))
    dealt = every.join(F.broadcast(lots), F.pmod("shard", F.lit(n)) == F.col("task"), "left")  # MAX_SHARDS rows, or as many as there are partitions
    sorted_rows = dealt.repartition(n, "lot").sortWithinPartitions("shard", *_order(), "kind")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, known, first, times = _Roll(folder, roll_bytes, date), None, None, None
        for b in batches:
            for shard, page, digest, place, kind, url, given, count, body in zip(*(b[c.split()[0]].to_pylist() for c in _ROW.split(", ")), strict=True):
                key = (shard, page, digest, place)
                if kind == 0:
                    known, first, times = key, given, count
                    continue
                if key != known:
                    known, first, times = key, None, None
                made = record(page, url, _sha1(body), len(body), body if first is None else None, first, date)
                for _ in range(times or 1):
                    roll.add(shard, made)
        roll.close()
        if roll.done:
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*roll.done, strict=True), types, strict=True)], [c.split()[0] for c in _MANIFEST.split(", ")])

    return materialize(sorted_rows.mapInArrow(write, _MANIFEST), "warc-manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    rest, out, unpacker = b"", [], None
    while data := (rest or stream.read(chunk)):
        unpacker = unpacker or zlib.decompressobj(31)
        out.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(out)
            out, unpacker = [], None
    if unpacker is not None:
        raise ValueError("a WARC file ends within a record")


def parse(member: bytes) -> dict[str, object]:
    """Header fields of a record, with its block under "block"."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields: dict[str, object] = dict(line.split(": ", 1) for line in lines[1:])
    fields["block"] = rest[: int(str(fields["Content-Length"]))]
    return fields


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page, type, payload_bytes, payload_digest (hex), refers_to, target, payload of each record in the manifest's files.

    A response whose payload or block does not have the digest in its header stops the job, as does a file that does
    not have the manifest's length.
    """
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("file", "compressed_bytes").repartition(n, "file")
    schema = "page long, type string, payload_bytes long, payload_digest string, refers_to long, target string, payload binary"
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def rows(name: str, size: int) -> Iterator[tuple]:
        fs, root = _file_system(folder)
        path = f"{root}/{name}"
        if fs.get_file_info(path).size != size:
            raise ValueError(f"{name} is not the file of the manifest")
        with fs.open_input_stream(path, compression=None) as stream:
            for member in members(stream):
                f = parse(member)
                if f["WARC-Type"] not in ("response", "revisit"):
                    continue
                http, _, payload = f["block"].partition(b"\r\n\r\n")
                length = int(http.lower().rpartition(b"content-length: ")[2].split(b"\r\n")[0])
                if _sha1(f["block"]) != f["WARC-Block-Digest"] or f["WARC-Type"] == "response" and (len(payload) != length or _sha1(payload) != f["WARC-Payload-Digest"]):
                    raise ValueError(f"a record of {name} is damaged")
                digest = base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
                page, refers = f.get("X-Page"), f.get("X-Refers-To-Page")
                yield (page and int(page), f["WARC-Type"], length, digest, refers and int(refers), f["WARC-Target-URI"], payload if f["WARC-Type"] == "response" else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size in zip(b["file"].to_pylist(), b["compressed_bytes"].to_pylist(), strict=True):
                for part in itertools.batched(rows(name, size), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*part, strict=True), types, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return files.mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    found = read_archives(write_archives(pages, folder), folder)
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
     k AS (SELECT page_id, n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM k
"""
