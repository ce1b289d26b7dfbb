"""WARC archives: a deterministic sharded writer, and a reader.

Writing:

1. Ids, addresses and payload hashes are written once as a narrow table. A bounded sample of its distinct rows, those
   with the least hashes, gives the bounds of ranges of about ``range_bytes``; it depends on the data only, not on partitions.
2. Of records with equal payloads, the one with the largest (id, address) is the response, the others revisit it. Owners
   are found per (hash, slice of ids) first, then per hash, and go back the same way, so a payload that a third of
   all records share is never one key's work.
3. Verdicts and payloads meet in one shuffle by range, sorted by (address, id, hash); the verdict comes first.
4. A task writes its range's records to archives that are rolled by compressed size: every record is a gzip member of its
   own, with new headers, lengths, record ids and digests, all functions of the record. An archive is written under a
   temporary name, one per attempt, and renamed when complete, so attempts cannot mix and a repeated one writes the same bytes.
5. The tasks' manifest rows (name, records, size, SHA-256) are written by Spark and renamed into place at the end.
   Before that nothing can be read; after it the reader opens only listed archives and checks their digests.

Equality is by SHA-256; the SHA-1 in base32 that the format wants is a label.

Defined cases: a null payload is empty; null ids and addresses are kept and come first (smallest); rows that agree in all
three columns are written each, the first as the response if it owns the payload; control characters in addresses are
escaped in the header and kept in a field of their own; an empty table gives an empty manifest. Other columns are not written.
"""
from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rebuff.llm.common import materialize, spread

RANGE_BYTES = 16 << 20
ROLL_BYTES = 2 << 20
SAMPLE_PER_RANGE = 128
#: Bound of the sample on the driver. More ranges than a sample of this size serves well only get less even.
MAX_SAMPLE = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, range int, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, record_id string, refers_to_id string, refers_to long, date string, payload_bytes long, payload_digest string, name string, position long"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0<>]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str, page_id: int | None, url: str | None, copy: int) -> str:
    seed = hashlib.sha256(json.dumps([key, page_id, url, copy]).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=5)}>"


def member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member without name or time."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", len(block))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, key: str, payload: bytes, copy: int, owner: tuple | None, date: str) -> bytes:
    """The response, or with ``owner`` (id, address) a revisit, for one page."""
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]|\\^`{}\"-._") if url and _UNSAFE.search(url) else url or "about:blank"
    fields = [("WARC-Type", "revisit" if owner else "response"), ("WARC-Record-ID", record_id(key, page_id, url, copy)), ("WARC-Date", date), ("WARC-Target-URI", target),
              ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if target != url:
        fields.append(("X-Address", json.dumps(url)))
    if page_id is not None:
        fields.append(("X-Page", page_id))
    if owner:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(key, *owner, 0))]
        if owner[0] is not None:
            fields.append(("X-Refers-To-Page", owner[0]))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(fields, http if owner else http + payload)


class Roller:
    """Archives of one task: written under a name of this attempt, renamed when complete."""

    def __init__(self, path: str, roll_bytes: int, date: str) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(path)
        self.attempt, self.roll_bytes, self.date = uuid.uuid4().hex, roll_bytes, date
        self.range = self.part = -1
        self.out, self.done = None, []

    def add(self, range_: int, data: bytes) -> None:
        if range_ != self.range or self.size + len(data) > self.roll_bytes and self.records:
            self.close()
            self.part = self.part + 1 if range_ == self.range else 0
            self.range, self.name = range_, f"part-{range_:06d}-{self.part:05d}.warc.gz"
            self.fs.create_dir(f"{self.root}/_temporary/{self.attempt}", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.root}/_temporary/{self.attempt}/{self.name}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name, None, None, 0)), ("WARC-Date", self.date), ("WARC-Filename", self.name),
                              ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n"))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.fs.create_dir(f"{self.root}/archives", recursive=True)
            self.fs.move(f"{self.root}/_temporary/{self.attempt}/{self.name}", f"{self.root}/archives/{self.name}")
            self.done.append((self.name, self.range, self.records, self.size, self.sha.hexdigest()))


def _order(url: str | None, page_id: int | None, key: str) -> tuple:
    return url is not None, url or "", page_id is not None, page_id or 0, key


def range_bounds(narrow: DataFrame, range_bytes: int) -> list[tuple]:
    """Upper-exclusive bounds between ranges of near equal bytes, from at most ``SAMPLE_PER_RANGE`` rows per range and ``MAX_SAMPLE`` in all."""
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = -(-total // range_bytes)
    if ranges < 2:
        return []
    want = min(SAMPLE_PER_RANGE * ranges, MAX_SAMPLE)
    hashed = narrow.withColumn("h", F.expr("pmod(xxhash64(url, page_id, key), 4294967296L)"))
    if 4 * want < n:                           # few enough to be shuffled, and enough whatever the luck
        hashed = hashed.where(F.col("h") < int(4 * want / n * 2**32))
    drawn = hashed.groupBy("h", "url", "page_id", "key").agg(F.sum("size").alias("size")).orderBy("h", "url", "page_id", "key").limit(want).collect()
    rows = sorted((_order(r.url, r.page_id, r.key), r.size) for r in drawn)
    step, seen, bounds = sum(s for _, s in rows) / ranges, 0, []
    for at, s in rows:
        if seen >= step * (len(bounds) + 1):
            bounds.append(at)
        seen += s
    return bounds


def verdicts(narrow: DataFrame, min_bytes: int) -> DataFrame:
    """(url, page_id, key, owner_id, owner_url) of every record that revisits a record with another id or address."""
    sliced = narrow.where(F.col("size") >= min_bytes).withColumn("slice", F.expr(f"pmod(xxhash64(page_id, url), {spread(narrow.sparkSession)})"))
    tops = sliced.groupBy("key", "slice").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"))
    owners = tops.groupBy("key").agg(F.max("top").alias("owner"), F.sum("n").alias("n")).where("n > 1").drop("n")
    marks = tops.select("key", "slice").join(owners, "key")
    same = F.col("page_id").eqNullSafe(F.col("owner.page_id")) & F.col("url").eqNullSafe(F.col("owner.url"))
    return sliced.join(marks, ["key", "slice"]).where(~same).select("url", "page_id", "key", F.col("owner.page_id").alias("owner_id"), F.col("owner.url").alias("owner_url"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
                   range_bytes: int = RANGE_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Writes the archives below ``path``, a fresh folder that all executors reach, and returns the committed manifest."""
    root_fs, root = fs.FileSystem.from_uri(path)
    if root_fs.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(url).cast("string").alias("url"), F.col(page_id).cast("long").alias("page_id"), F.sha2(body, 256).alias("key"), body.alias("payload"))
    narrow = materialize(rows.select("url", "page_id", "key", F.octet_length("payload").cast("long").alias("size")), "warc_keys")
    bounds = range_bounds(narrow, range_bytes)

    def ranges(urls: pa.Array, ids: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(bounds, _order(*x)) for x in zip(urls.to_pylist(), ids.to_pylist(), keys.to_pylist())], pa.int32())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Roller(path, roll_bytes, date)
        last, copy, owner = None, 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                range_, url_, id_, key, kind, data, owner_id, owner_url = r
                if (url_, id_, key) != last:
                    last, copy, owner = (url_, id_, key), 0, None
                if kind == 0:
                    owner = (owner_id, owner_url)
                    continue
                own = owner or ((id_, url_) if copy and len(data) >= min_bytes else None)
                out.add(range_, page_record(id_, url_, key, data, copy, own, date))
                copy += 1
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.done), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], [c.split()[0] for c in MANIFEST.split(", ")])
    judged = verdicts(narrow, min_bytes).select("url", "page_id", "key", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("payload"), "owner_id", "owner_url")
    both = judged.unionByName(rows.withColumns({"kind": F.lit(1), "owner_id": F.lit(None).cast("long"), "owner_url": F.lit(None).cast("string")}))
    both = both.withColumn("range", F.arrow_udf(ranges, "int")("url", "page_id", "key") if bounds else F.lit(0))
    order: list[Column] = [F.col(c) for c in ("range", "url", "page_id", "key", "kind")]
    both = both.select("range", "url", "page_id", "key", "kind", "payload", "owner_id", "owner_url").repartitionById(len(bounds) + 1, "range").sortWithinPartitions(*order)
    both.mapInArrow(write, MANIFEST).write.parquet(f"{path}/_manifest")
    root_fs.move(f"{root}/_manifest", f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def members(stream, sha) -> Iterator[tuple[int, bytes]]:
    """(position, content) of every gzip member of a stream; ``sha`` sees all bytes."""
    z, parts, start, at, rest = zlib.decompressobj(31), [], 0, 0, b""
    while True:
        chunk = rest
        if not chunk:
            chunk = stream.read(1 << 20)
            sha.update(chunk)
            at += len(chunk)
        if not chunk:
            break
        parts.append(z.decompress(chunk))
        rest = z.unused_data
        if z.eof:
            yield start, b"".join(parts)
            z, parts, start = zlib.decompressobj(31), [], at - len(rest)
    if start != at:
        raise ValueError("an archive ends inside a record")


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record whose length and block digest hold."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"a damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


def page_row(fields: dict[str, str], block: bytes) -> tuple[tuple, bytes | None]:
    """The columns of ``RECORD`` up to payload_digest, and the payload (None for a revisit)."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"a damaged payload {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    url = json.loads(fields["X-Address"]) if "X-Address" in fields else fields["WARC-Target-URI"]
    return (number("X-Page"), url, kind, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), number("X-Refers-To-Page"), fields["WARC-Date"], size, digest), payload if kind == "response" else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives that the manifest lists, without the archives' own; with ``payloads`` a binary ``payload``, null for revisits."""
    schema = RECORD + ", payload binary" * payloads
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for b in batches:
            for name, digest in zip(*(c.to_pylist() for c in b.columns)):
                rows, held, sha = [], 0, hashlib.sha256()
                with files.open_input_stream(f"{root}/archives/{name}", compression=None) as stream:
                    for position, content in members(stream, sha):
                        fields, block = parse(content)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        row, payload = page_row(fields, block)
                        rows.append((*row, name, position, *[payload] * payloads))
                        held += len(payload or b"") * payloads
                        if len(rows) == 4096 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if sha.hexdigest() != digest:
                        raise ValueError(f"{name} is not the archive of the manifest")
                if rows:
                    yield batch(rows)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return manifest.select("name", "sha256").repartition(spread(spark), "name").mapInArrow(read, schema)
