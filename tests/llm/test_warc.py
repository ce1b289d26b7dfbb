"""Archives: exact round trips, the same bytes whatever the partitions, revisits, rolling, damage."""
from __future__ import annotations

import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from rebuff.llm import warc
from rebuff.session import scratch_path
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3", "same"), (4, None, None), (5, "", ""), (None, "http://n", "same"), (None, None, "alone"),
        (7, "http://a/7", "twice"), (7, "http://a/7", "twice"), (8, "http://x y/\r\nWARC-Type: z", "é漢😀\r\n\r\nWARC/1.1"), (9, "http://a/9", "x" * 300_000), (2, "http://b/2", "same")]
SCHEMA = "page_id long, url string, html string"


def files(path):
    root = path.removeprefix("file://") + "/archives"
    return {n: hashlib.sha256(open(f"{root}/{n}", "rb").read()).hexdigest() for n in sorted(os.listdir(root))}


def rows_back(spark, path):
    r = warc.read_archives(spark, path)
    own = r.select(F.col("record_id").alias("owner"), F.col("payload").alias("own"))
    r = r.join(own, F.coalesce("refers_to_id", "record_id") == F.col("owner"))
    return sorted(r.select("page_id", "url", F.col("own").cast("string").alias("html")).collect(), key=str)


def test_round_trip_and_roles(spark):
    pages = spark.createDataFrame([(*r, "k", 0) for r in ROWS], SCHEMA + ", key string, range int")
    path = scratch_path(spark, "warc-test")
    m = warc.write_archives(pages, path, range_bytes=64, roll_bytes=200)
    assert m.count() == len(files(path)) > 3 and m.agg(F.sum("records")).first()[0] == len(ROWS)
    assert {r.name: r.sha256 for r in m.collect()} == files(path)
    assert not [n for _, _, names in os.walk(path.removeprefix("file://") + "/_temporary") for n in names]
    assert [tuple(r) for r in rows_back(spark, path)] == sorted(((i, u, t or "") for i, u, t in ROWS), key=str)
    got = {(r.page_id, r.url, r.record_type, r.refers_to): r for r in warc.read_archives(spark, path, payloads=False).collect()}
    assert {k[:3] + k[3:] for k in got} == {
        (1, "http://a/1", "revisit", 3), (2, "http://a/2", "revisit", 3), (2, "http://b/2", "revisit", 3), (None, "http://n", "revisit", 3), (3, "http://a/3", "response", None),
        (4, None, "revisit", 5), (5, "", "response", None), (None, None, "response", None), (7, "http://a/7", "response", None), (7, "http://a/7", "revisit", 7),
        (8, ROWS[9][1], "response", None), (9, "http://a/9", "response", None)}
    for (page, url, *_), r in got.items():
        text = next(t for i, u, t in ROWS if (i, u) == (page, url)) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), warc.base32_sha1(text.encode()))
    with pytest.raises(FileExistsError):
        warc.write_archives(pages, path)


def test_same_bytes_from_other_partitions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").union(spark.createDataFrame(ROWS, SCHEMA))
    seen = []
    for n in (1, 5):
        path = scratch_path(spark, "warc-test")
        warc.write_archives(pages.orderBy(F.rand(n)).repartition(n), path, range_bytes=100_000, roll_bytes=10_000)
        seen.append(files(path))
    assert seen[0] == seen[1] and len({n[:11] for n in seen[0]}) > 3 and any(n.endswith("00001.warc.gz") for n in seen[0])
    sizes = [os.path.getsize(f"{path.removeprefix('file://')}/archives/{n}") for n in seen[0]]
    assert sum(s > 10_000 for s in sizes) <= 2          # only a record that is larger on its own


def test_minimum_size(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (2, "b", "xx"), (3, "c", "xxxxx"), (4, "d", "xxxxx")], SCHEMA), path, min_bytes=3)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
    assert got == [(1, "response", None), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_empty_table(spark):
    path = scratch_path(spark, "warc-test")
    assert warc.write_archives(spark.createDataFrame([], SCHEMA), path).count() == 0
    assert warc.read_archives(spark, path).count() == 0


def test_members_in_small_chunks():
    data = [b"one" * 1000, b"", b"three"]
    packed = b"".join(gzip.compress(d, mtime=0) for d in data)

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)
    sha = hashlib.sha256()
    got = list(warc.members(Slow(packed), sha))
    assert [d for _, d in got] == data and got[0][0] == 0 and sha.hexdigest() == hashlib.sha256(packed).hexdigest()
    assert gzip.decompress(packed[got[2][0]:]) == b"three"
    with pytest.raises(ValueError):
        list(warc.members(Slow(packed[:-9]), hashlib.sha256()))


def test_damage_is_noticed(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(ROWS[:3], SCHEMA), path)
    name = next(iter(files(path)))
    at = f"{path.removeprefix('file://')}/archives/{name}"
    data = open(at, "rb").read()
    open(at, "wb").write(data + gzip.compress(gzip.decompress(data[warc_start(data):])))
    with pytest.raises(Exception, match="not the archive"):
        warc.read_archives(spark, path).count()


def warc_start(data):
    return [p for p, _ in warc.members(io.BytesIO(data), hashlib.sha256())][-1]


def test_query(spark):
    status, info = compare(spark, connect(SF), "op11_warc", SF)
    assert status == "OK", info
