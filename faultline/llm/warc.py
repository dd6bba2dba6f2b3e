"""WARC archives: a deterministic sharded writer, and a reader.

The writer range-sorts records by id over boundaries that follow from the data alone: of
the rows with the smallest hashes, the quantiles. Each shard is written by one task as
gzip members, one per record, into files that are rolled by compressed size. A file is
written under a temporary name that no other attempt uses, then renamed; a lost task's
next attempt writes the same bytes under the same name. What counts is the manifest of
files, a table that Spark commits once all shards are done; readers go by it, so files of
attempts that never came to it do not matter. Dates, record ids and headers derive from
the record, so that equal input gives equal files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.frames import pieces
from faultline.session import scratch_path

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs
MANIFEST = "shard long, seq int, file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean, payload binary"


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Rows to write: id, url, payload, its SHA-1 and its size."""
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))


def references(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(id, sha1, refers_to) of rows that repeat the payload of a smaller id.

    Least ids are pre-aggregated per digest, and no payload takes part in the join.
    """
    light = rows.filter(F.col("size") >= min_bytes).select("id", "sha1")
    first = light.groupBy("sha1").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).filter("last > refers_to").select("sha1", "refers_to")
    return light.join(first, "sha1").filter("id > refers_to").select("id", "sha1", "refers_to").distinct()


def boundaries(rows: DataFrame, shards: int, sample: int = 20_000) -> list[int]:
    """Ids at which shards begin: quantiles of the ids with the ``sample`` smallest hashes. A function of the ids alone."""
    ids = sorted(r.id for r in rows.filter("id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample).collect())
    return sorted({ids[len(ids) * k // shards] for k in range(1, shards)}) if ids else []


def shard_of(id_: Column, starts: list[int]) -> Column:
    """How many boundaries are at or below the id; a null id goes first."""
    if not starts:
        return F.lit(0)
    marks = F.array(*[F.lit(int(s)) for s in starts])
    return F.coalesce(F.size(F.filter(marks, lambda s: s <= id_)), F.lit(0))


def _header(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(id_: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One record, compressed. Headers and digests are made anew from the row."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    name = lambda i: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{i}:{digest}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(id_)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if id_ is not None:
        lines.append(f"X-Page-ID: {id_}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    lines.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip without a time
    return deflate.compress(raw) + deflate.flush()


class _Roller:
    """Files of one shard, one after the other."""

    def __init__(self, folder: str, shard: int, most: int) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.most, self.seq = shard, most, 0
        self.out = None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is not None and self.size + len(data) > self.most:
            yield self.close()
        if self.out is None:
            self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}.warc.gz"
            self.out, self.size, self.records, self.hash = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.hash.update(data)
        self.size, self.records = self.size + len(data), self.records + 1

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        name = f"pages-{self.shard:06d}-{self.seq:05d}.warc.gz"
        self.store.move(self.temporary, f"{self.root}/{name}")
        self.seq += 1
        return self.shard, self.seq - 1, name, self.records, self.size, self.hash.hexdigest()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
          shard_bytes: int = 256 << 20, file_bytes: int = 128 << 20, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row below ``folder`` (a URI every executor reaches) and return the manifest, a row per file.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the least id
    is a response and the others revisit it; shorter ones are all responses. Files hold
    at most ``file_bytes`` compressed bytes, unless a single record is larger.

    A null payload is empty. A null url has no target header. A row with a null id is a
    response without an id; it comes first. Repeated rows and ids are all written, and all
    rows of the least id are responses. Other columns are not read. An empty table gives
    an empty manifest.
    """
    spark = pages.sparkSession
    rows = plan_records(pages, id_col, url_col, payload_col)
    total = rows.agg(F.sum("size").alias("b")).first().b or 0
    shards = max(int(total // shard_bytes) + 1, min(64, int(total // (2 << 20)) + 1))
    starts = boundaries(rows, shards)
    # A reference travels as a row of its own and comes just before the rows it is for: payloads are shuffled once.
    both = rows.select("id", "url", "payload", "sha1", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("full")).unionByName(
        references(rows, min_bytes).withColumn("full", F.lit(0)), allowMissingColumns=True)
    placed = both.withColumn("shard", shard_of(F.col("id"), starts)).repartitionByRange(max(1, len(starts) + 1), "shard").sortWithinPartitions("shard", "id", "sha1", "full", "url")
    target, _ = fs.FileSystem.from_uri(folder)
    target.create_dir(f"{fs.FileSystem.from_uri(folder)[1]}/_temporary", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        roller = refers = None
        for batch in batches:
            for lo, hi in pieces(batch.column("payload"), 2 << 20):
                for r in batch.slice(lo, hi - lo).to_pylist():
                    if not r["full"]:
                        refers = r
                        continue
                    known = refers is not None and (refers["id"], refers["sha1"]) == (r["id"], r["sha1"])
                    if roller is None or roller.shard != r["shard"]:
                        if roller is not None:
                            done.append(roller.close())
                        roller = _Roller(folder, r["shard"], file_bytes)
                    done += roller.add(record_bytes(r["id"], r["url"], r["payload"], r["sha1"], refers["refers_to"] if known else None, date))
        if roller is not None:
            done.append(roller.close())
        if done:
            columns = list(zip(*done))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "seq", "file", "records", "bytes", "sha256"])

    files = placed.select("shard", "id", "url", "payload", "sha1", "refers_to", "full").mapInArrow(run, MANIFEST)
    files.write.mode("errorifexists").parquet(f"{folder}/_manifest")
    return spark.read.schema(files.schema).parquet(f"{folder}/_manifest")


class _Hashed:
    """A stream that keeps the size and hash of what was read from it."""

    def __init__(self, stream: object) -> None:
        self.stream, self.bytes, self.sha256 = stream, 0, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.bytes += len(data)
        self.sha256.update(data)
        return data


def _members(stream: object) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, read a piece at a time."""
    inflate, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            if out:
                raise ValueError("the archive ends inside a record")
            return
        out.append(inflate.decompress(data))
        rest = b""
        if inflate.eof:
            rest = inflate.unused_data
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []


def parse(record: bytes) -> tuple:
    """Columns of RECORD from one decompressed record; digests are computed from its bytes and compared."""
    head, _, body = record.partition(b"\r\n\r\n")
    named = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = body[: int(named[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[16:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    kind, digest = named[b"WARC-Type"].decode(), named[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    of = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    ok = named[b"WARC-Block-Digest"] == b"sha1:" + of(block).encode() and (kind == "revisit" or (of(payload) == digest and len(payload) == size))
    number = lambda key: int(named[key]) if key in named else None
    url = named[b"WARC-Target-URI"].decode("utf-8", "replace") if b"WARC-Target-URI" in named else None
    return number(b"X-Page-ID"), url, kind, size, digest, number(b"X-Refers-To-Page-ID"), ok, payload if kind == "response" else None


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all files of the manifest, one row each (see RECORD), with ``digest_ok``; a task per few files.

    A revisit's payload is null; its size and digest are those of the full payload. A file
    whose bytes or records are not the manifest's fails the job once it has been read.
    """
    files = spark.read.parquet(f"{folder}/_manifest").select("file", "records", "bytes", "sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])
        for batch in batches:
            for name, *said in zip(*(batch.column(c).to_pylist() for c in ("file", "records", "bytes", "sha256"))):
                rows, held, records = [], 0, 0
                with disk.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    hashed = _Hashed(stream)
                    for record in _members(hashed):
                        records += 1
                        rows.append(parse(record))
                        if not payloads:
                            rows[-1] = (*rows[-1][:-1], None)
                        held += len(record) if payloads else 200
                        if held > 4 << 20:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                if [records, hashed.bytes, hashed.sha256.hexdigest()] != said:
                    raise ValueError(f"{name} is not the file of the manifest: {records} records, {hashed.bytes} bytes")

    spread = files.repartition(max(1, min(files.count(), 4096)), "file")
    return spread.mapInArrow(run, RECORD)


def archive(pages: DataFrame, **options: object) -> DataFrame:
    """Write ``pages`` to a fresh folder in the shared place and read the records back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    write(pages, folder, **options)
    return read(spark, folder, payloads=False)
