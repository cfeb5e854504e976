"""WARC packages: ZIP archives against the standard library, round trips, and the cases the docstring defines."""

import gzip
import io
import uuid
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termlens.llm import warc_packages as wp
from termlens.session import scratch_path

FILES = [("archive/data.warc.gz", b"x" * 1000), ("indexes/index.cdxj", b""), ("datapackage.json", "é".encode())]


def ranged(data: bytes) -> wp.Ranged:
    return wp.Ranged("", data)


@pytest.fixture
def folder(spark):
    return scratch_path(spark, f"llm/test-warc-{uuid.uuid4().hex}")


def put(folder: str, name: str, data: bytes) -> str:
    import os
    import re

    path = re.sub(r"^file:/+", "/", folder)
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "wb") as f:
        f.write(data)
    return folder


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_archives(zip64):
    data = wp.package(FILES, zip64=zip64) + b"\n"  # the writer's line feed is the comment
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.comment == b"\n"
        assert [(i.filename, z.read(i)) for i in z.infolist()] == FILES
    found = wp.directory(ranged(data))
    assert [(n, m, data[at:at + stored], crc) for n, m, at, stored, _, crc in found] == [(n, 0, d, zlib.crc32(d)) for n, d in FILES]
    ahead = b"#!/bin/sh\n" * 7 + data  # a self-extracting archive: offsets count from where the archive starts
    assert [ahead[m[2]:m[2] + m[3]] for m in wp.directory(ranged(ahead))] == [d for _, d in FILES]


def test_directory_of_more_members_than_16_bits_count():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"f{i}"), b"%d" % i)
        z.comment = b"a comment that holds PK\x05\x06, the mark of an end record"
    data = raw.getvalue()
    found = wp.directory(ranged(data))
    assert len(found) == 66_000 and all(data[m[2]:m[2] + m[3]] == m[0][1:].encode() for m in found[::997])
    with pytest.raises(ValueError):
        wp.directory(ranged(b"PK no archive" * 9))


def archive(records, packed=True):
    out, lines = b"", []
    for i, r in enumerate(records):
        piece = gzip.compress(r) if packed else r
        lines.append(b'com,x)/%d 2020 {"offset": "%d", "length": "%d", "filename": "a.warc%s"}' % (i, len(out), len(piece), b".gz" if packed else b""))
        out += piece
    return out, b"\n".join(lines)


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("index", ["none", "stored", "deflated", "gzip", "twice"])
def test_foreign_packages(spark, folder, packed, index):
    texts = [b"", b"one", b"two " * 400_000, "drei ü".encode()]
    data, lines = archive([wp.page_record(i, f"http://x/{i}", wp.digest_of(t), len(t), t) for i, t in enumerate(texts)], packed)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc" + ".gz" * packed, data)
        if index in ("stored", "twice"):
            z.writestr("indexes/index.cdxj", lines)
        if index == "deflated":
            z.writestr("indexes/index.cdx", lines, zipfile.ZIP_DEFLATED)
        if index in ("gzip", "twice"):
            z.writestr("indexes/index.cdx.gz", gzip.compress(lines[:50]) + gzip.compress(lines[50:]))
    put(folder, "a.wacz", raw.getvalue())
    for by_ranges in (True, False):
        got = wp.records(spark, folder, by_ranges=by_ranges, chunk_bytes=1000).orderBy("id").collect()
        assert [(r.id, bytes(r.payload), r.payload_bytes, r.url) for r in got] == [(str(i), t, len(t), f"http://x/{i}") for i, t in enumerate(texts)]
    assert {r.member for r in wp.members(spark, folder).collect()} == {m for m in zipfile.ZipFile(raw).namelist()}


def test_faults_are_named(spark, folder):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", b"1" * 100)
    with pytest.raises(Exception, match="a.wacz.*not stored"):
        wp.records(spark, put(folder + "a", "a.wacz", raw.getvalue())).collect()
    data, lines = archive([wp.page_record(1, None, wp.digest_of(b"other"), 4, b"text")])
    package = wp.package([("archive/a.warc.gz", data), ("indexes/index.cdxj", lines)])
    with pytest.raises(Exception, match="b.wacz, offset .*digest"):
        wp.records(spark, put(folder + "b", "b.wacz", package + b"\n")).collect()


ROWS = [(5, "http://a/ b\n", "same"), (3, "http://a/3", "same"), (3, "http://a/3", "same"), (9, None, "same"), (None, "http://n/", "same"),
        (7, "u7", None), (8, "u8", ""), (None, None, "own"), (11, "u", "ü" * 5000), (12, "v", "one"), (12, "v", "two")]


@pytest.mark.parametrize("min_revisit", [0, 4, 100])
def test_round_trip_and_cases(spark, folder, min_revisit):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("sha", F.lit("clash")).repartition(3)
    wp.write(df, folder, "page_id", "url", "html", min_revisit=min_revisit, package_bytes=500)
    assert wp.members(spark, folder).where("method <> 0").count() == 0
    found = wp.records(spark, folder)
    back = wp.with_payloads(found).collect()
    assert Counter((r.id, bytes(r.payload).decode()) for r in back) == Counter((None if i is None else str(i), t or "") for i, _, t in ROWS)
    rows = found.collect()
    assert all(r.payload_digest == wp.digest_of((t or "").encode()) for r in rows for i, _, t in ROWS if r.payload_bytes == len((t or "").encode()) > 4)
    kinds = Counter((r.id, r.record_type, r.refers_to) for r in rows if r.payload_digest == wp.digest_of(b"same"))
    if min_revisit <= 4:
        assert kinds == Counter([("3", "response", None), ("3", "revisit", "3"), ("5", "revisit", "3"), ("9", "revisit", "3"), (None, "revisit", "3")])
    else:
        assert all(k[1] == "response" for k in kinds) and sum(kinds.values()) == 5
    empty = {r.id: (r.record_type, r.refers_to) for r in rows if r.payload_bytes == 0}
    assert empty == ({"7": ("response", None), "8": ("revisit", "7")} if min_revisit == 0 else {"7": ("response", None), "8": ("response", None)})
    urls = {r.id: r.url for r in rows if r.id in ("5", "9")}
    assert urls == {"5": "http://a/%20b%0A", "9": None}
    bare = wp.records(spark, folder, payloads=False, by_ranges=False)
    same = lambda rs: sorted(map(str, ((r.id, r.record_type, r.payload_bytes, r.payload_digest) for r in rs)))
    assert same(bare.collect()) == same(rows) and bare.where("payload is not null").count() == 0


def test_empty_table(spark, folder):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    wp.write(df, folder, "page_id", "url", "html")
    assert wp.records(spark, folder).count() == 0


def test_hot_copies_are_dealt_out(spark, folder):
    df = spark.range(2500).select(F.lit(1).cast("long").alias("id"), F.lit("u").alias("url"), F.lit("copy").alias("html"))
    wp.write(df, folder, "id", "url", "html")
    assert {(r.record_type, r["count"]) for r in wp.records(spark, folder).groupBy("record_type").count().collect()} == {("response", 1), ("revisit", 2499)}
