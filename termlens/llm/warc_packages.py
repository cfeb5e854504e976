"""Operator 11: WARC records in ZIP packages, written by Spark and read back by ranges, without extraction.

A package is a ZIP archive whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip member a record),
``indexes/index.cdxj`` (a line a record: key, time, JSON with offset and length) and ``datapackage.json``.

Writing. Records with equal payloads of at least ``min_revisit`` bytes are told apart by a grouped minimum over digests:
the one with the smallest id is the response, the others become revisits, which carry no payload. Only digests and ids
meet there; payloads are shuffled once, by (id, url, digest), after the copies of a row are merged on the map side, and
only responses keep theirs. Every task packs its records into packages of about ``package_bytes``. Spark's own text
writer commits them, one row a file, so a lost executor or a second attempt leaves no half packages and any file system
that Spark writes will do. The line feed that the writer adds is the ZIP archive's comment.

Reading. ``members`` reads a package's tail, the ZIP64 locator and end record where there are any, and the central
directory. ``chunks`` reads the indexes (stored or deflated, plain or gzip) and cuts each archive into ranges of about
``chunk_bytes`` of whole records; an archive that no index names is walked once to find its records. ``records`` deals
the ranges out to tasks, and each reads its range and nothing else. Ranges are read through Arrow's file systems
(local and shared folders, S3, GCS, HDFS); packages in a store that only Spark reads come whole through Spark's binary
file source, which bounds them at 2 GB (``by_ranges=False``; the default looks at the scheme).

Defined cases: a null text is an empty payload; null ids are written and read as null and are the largest; a null url
leaves the header out; rows that repeat in id, url and payload get a record each (one response, the others revisit
it); blanks and control letters in urls are percent-encoded; a record longer than a package or range has one of its
own; an empty table gives an empty folder and no records; other columns are not carried. Archives that are deflated
inside their package, damaged records and digests that do not match raise an error that names package and offset.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zlib
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import written

# ---- fixed values: ZIP and WARC formats ----
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
STORED, DEFLATED = 0, 8
BIG = 0xFFFFFFFF
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables hold no time of capture
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# ---------------------------------------------
RANGED = ("", "file", "s3", "s3a", "gs", "gcs", "hdfs", "abfs", "abfss")


# ---- records ----------------------------------------------------------------------------------------

def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(key) -> str:
    return "<urn:null:>" if key is None else f"<urn:id:{quote(str(key), safe='')}>"


def _key(uri: str | None) -> str | None:
    return unquote(uri[8:-1]) if uri and uri.startswith("<urn:id:") else None


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_record(key, url: str | None, digest: str, size: int, payload: bytes | None, first=None) -> bytes:
    """A response with its payload, or, without one, a revisit of the record of ``first``."""
    kind = "revisit" if payload is None else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", _uri(key)), ("WARC-Target-URI", url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
               ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if payload is None:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _uri(first))]
    return _record(kind, headers, http + (payload or b""))


def parse_record(data: bytes) -> dict:
    """Headers in lower case, the block's HTTP headers under ``http`` and the payload behind them."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(out["content-length"])
    block = rest[:size]
    if len(block) < size:
        raise ValueError("record cut short")
    out["http"] = {}
    out["payload"] = block
    if out.get("content-type", "").startswith("application/http"):
        top, _, out["payload"] = block.partition(b"\r\n\r\n")
        out["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("latin-1").split("\r\n")[1:])}
    return out


# ---- packages -----------------------------------------------------------------------------------------

def package(files: list[tuple[str, bytes]], comment: bytes = b"\n", zip64: bool = False) -> bytes:
    """A ZIP archive of stored members. Without its comment it is what a writer that adds the comment has to be given."""
    out, entries = io.BytesIO(), []
    for name, data in files:
        at, raw, crc = out.tell(), name.encode(), zlib.crc32(data)
        big = zip64 or len(data) >= BIG or at >= BIG
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        sizes = (BIG, BIG) if big else (len(data), len(data))
        out.write(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, STORED, 0, 33, crc, *sizes, len(raw), len(extra)) + raw + extra)
        out.write(data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        entries.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, STORED, 0, 33, crc, *sizes, len(raw), len(extra),
                                             0, 0, 0, 0, BIG if big else at) + raw + extra)
    start, directory, n = out.tell(), b"".join(entries), len(entries)
    out.write(directory)
    big = zip64 or start >= BIG or n >= 0xFFFF
    if big:
        end = out.tell()
        out.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), start))
        out.write(LOCATOR + struct.pack("<IQI", 0, end, 1))
    count = 0xFFFF if big else n
    out.write(END + struct.pack("<HHHHIIH", 0, 0, count, count, BIG if big else len(directory), BIG if big else start, len(comment)))
    return out.getvalue()


class _Packer:
    """Collects records and gives packages of about ``limit`` bytes."""

    def __init__(self, limit: int, level: int):
        self.limit, self.level = limit, level
        self.data, self.lines = io.BytesIO(), []

    def _put(self, record: bytes) -> tuple[int, int]:
        squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        at = self.data.tell()
        self.data.write(squeeze.compress(record) + squeeze.flush())
        return at, self.data.tell() - at

    def add(self, key, url, digest, size, payload, first) -> None:
        if not self.lines:
            self._put(_record("warcinfo", [("Content-Type", "application/warc-fields")], b"software: termlens\r\nformat: WARC File Format 1.1\r\n"))
        at, length = self._put(page_record(key, url, digest, size, payload, first))
        line = {"url": url, "digest": f"sha1:{digest}", "mime": "warc/revisit" if payload is None else "text/html",
                "filename": ARCHIVE.split("/")[1], "offset": at, "length": length, "status": "200"}
        parts = urlsplit(url or "")
        surt = ",".join(reversed((parts.hostname or "").split("."))) + ")" + quote(parts.path or "/")
        self.lines.append(f"{surt} {re.sub('[^0-9]', '', DATE)} {json.dumps(line)}\n")

    def full(self) -> bool:
        return self.data.tell() >= self.limit

    def take(self) -> bytes:
        files = [(ARCHIVE, self.data.getvalue()), (INDEX, "".join(sorted(self.lines)).encode())]
        about = {"profile": "data-package", "wacz_version": "1.1.1",
                 "resources": [{"name": n.split("/")[1], "path": n, "bytes": len(d), "hash": "sha256:" + hashlib.sha256(d).hexdigest()} for n, d in files]}
        self.data, self.lines = io.BytesIO(), []
        return package([*files, ("datapackage.json", json.dumps(about).encode())])


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def write(df: DataFrame, path: str, id_col: str, url_col: str, text_col: str, min_revisit: int = 0, package_bytes: int = 16 << 20, level: int = 6) -> str:
    """Writes a record for every row of ``df`` into packages under ``path``, which is returned."""
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    # the pair of id and url as one text that is never null, so that grouping and join deal payloads out by the same keys, once
    ident = F.col("id").cast("string")
    place = F.concat(F.coalesce(F.concat(F.octet_length(ident).cast("string"), F.lit(":"), ident), F.lit("-")), F.coalesce(F.concat(F.lit("u"), "url"), F.lit("-")))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long")).withColumn("place", place)
    each = [F.any_value("id").alias("id"), F.any_value("url").alias("url"), F.any_value("n").alias("n"), F.count("*").alias("copies")]
    slim = written(rows.select("id", "url", "sha", "n", "place").groupBy("sha", "place").agg(*each), "warc-keys")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url", "place")
    first = slim.where(F.col("n") >= min_revisit).groupBy("sha").agg(F.min(rank).alias("f"), F.sum("copies").alias("total"))
    again = (slim.join(first.where("total > 1"), "sha").withColumn("more", F.col("copies") - F.when(F.col("place") == F.col("f.place"), 1).otherwise(0))
             .where("more > 0"))
    revisits = again.select("id", "url", "sha", "n", F.lit(None).cast("binary").alias("payload"), F.col("f.id").alias("first"), "more")
    whole = rows.groupBy("sha", "place").agg(*each, F.any_value("payload").alias("payload"))
    mine = first.select("sha", F.col("f.place").alias("place"), F.lit(True).alias("is_first"))
    # a row below min_revisit has no first and is a response as often as it occurs
    more = F.when(F.col("n") < min_revisit, F.col("copies")).otherwise(F.when(F.col("is_first"), 1).otherwise(0))
    responses = whole.join(mine, ["sha", "place"], "left").withColumn("more", more).where("more > 0").select(
        "id", "url", "sha", "n", "payload", F.lit(None).cast(df.schema[id_col].dataType).alias("first"), "more")

    def work(batches):
        packer = _Packer(package_bytes, level)
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "sha", "n", "payload", "first", "more")]
            for row in zip(*columns):
                key, url, sha, n, body, head, more = (x.as_py() for x in row)
                for _ in range(more):
                    packer.add(key, url, _base32(sha), n, body, head)
                    if packer.full():
                        yield pa.RecordBatch.from_arrays([pa.array([packer.take()], pa.binary())], names=["package"])
        if packer.lines:
            yield pa.RecordBatch.from_arrays([pa.array([packer.take()], pa.binary())], names=["package"])

    # the repeats of a hot row are dealt out in thousands, so that no task writes all of them
    dealt = (responses.unionByName(revisits).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("more") - 1) / 1000))))
             .withColumn("more", F.least(F.lit(1000).cast("long"), F.col("more") - F.col("slot") * 1000)).drop("slot"))
    packed = dealt.mapInArrow(work, "package binary")
    packed.select(F.col("package").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


# ---- reading ------------------------------------------------------------------------------------------

class Ranged:
    """Reads ranges of a package, through an Arrow file system or from bytes at hand."""

    def __init__(self, path: str, content: bytes | None = None):
        if content is not None:
            self.file, self.size = pa.BufferReader(content), len(content)
            return
        import pyarrow.fs as pf

        path = re.sub(r"^file:/+", "/", path).replace("s3a://", "s3://", 1)
        system, inner = (pf.LocalFileSystem(), path) if path.startswith("/") else pf.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) < n:
            raise ValueError(f"{n} bytes wanted at {at}, {len(data)} there")
        return data


def directory(f) -> list[tuple[str, int, int, int, int, int]]:
    """(name, method, start of its data, stored bytes, bytes, crc) of every member, from the central directory."""
    tail_at = max(f.size - 22 - 0xFFFF, 0)
    tail = f.read(tail_at, f.size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP end record")
    n, size, start = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    if end >= 20:
        locator = f.read(end - 20, 20)
        if locator[:4] == LOCATOR:
            where = struct.unpack_from("<Q", locator, 8)[0]
            record = f.read(where, 56)
            if record[:4] != END64:  # something was put ahead of the archive: the record lies right before its locator
                where = end - 20 - 56
                record = f.read(where, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record")
            n, size, start = struct.unpack_from("<QQQ", record, 32)
            end = where
    shift = end - size - start  # bytes put ahead of the archive
    data, at, out = f.read(start + shift, size), 0, []
    for _ in range(n):
        if data[at:at + 4] != CENTRAL:
            raise ValueError("central directory is damaged")
        method, = struct.unpack_from("<H", data, at + 10)
        crc, stored, plain, names, extras, comments = struct.unpack_from("<IIIHHH", data, at + 16)
        header, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46:at + 46 + names].decode("utf-8", "replace")
        extra, k = data[at + 46 + names:at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # holds, in this order, only those fields that are too large above
                big = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                plain = next(big) if plain == BIG else plain
                stored = next(big) if stored == BIG else stored
                header = next(big) if header == BIG else header
            k += 4 + length
        local = f.read(header + shift, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        out.append((name, method, header + shift + 30 + sum(struct.unpack_from("<HH", local, 26)), stored, plain, crc))
        at += 46 + names + extras + comments
    return out


def _pieces(f, member, size: int = 1 << 20):
    """A member's bytes piece by piece: inflated if deflated, and unpacked if it is a gzip file."""
    name, method, at, stored, *_ = member
    if method not in (STORED, DEFLATED):
        raise ValueError(f"{name} is packed by method {method}")

    def raw():
        for lo in range(at, at + stored, size):
            yield f.read(lo, min(size, at + stored - lo))

    def unpacked(pieces, bits):
        d = zlib.decompressobj(bits)
        for piece in pieces:
            while piece:
                yield d.decompress(piece)
                piece = d.unused_data
                if d.eof:
                    d = zlib.decompressobj(bits)
        yield d.flush()

    pieces = unpacked(raw(), -15) if method == DEFLATED else raw()
    return unpacked(pieces, 31) if name.endswith(".gz") else pieces


def _index_lines(f, member):
    left = b""
    for piece in _pieces(f, member):
        *lines, left = (left + piece).split(b"\n")
        yield from lines
    yield left


def _walk(f, member):
    """(offset, length) of the records of an archive that no index names."""
    name, _, start, stored, *_ = member
    if not name.endswith(".gz"):
        at = 0
        while at < stored:
            head = f.read(start + at, min(1 << 16, stored - at))
            end = head.find(b"\r\n\r\n")
            size = re.search(rb"(?im)^content-length:\s*(\d+)", head[:end])
            if end < 0 or not size:
                raise ValueError(f"no WARC record at {at} of {name}")
            length = end + 4 + int(size[1]) + 4
            yield at, length
            at += length
        return
    at, d, fed = 0, zlib.decompressobj(31), 0
    for lo in range(0, stored, 1 << 20):
        piece = f.read(start + lo, min(1 << 20, stored - lo))
        while piece:
            d.decompress(piece)
            fed += len(piece) - len(d.unused_data)
            piece = d.unused_data
            if d.eof:
                yield at, fed - at
                at, d = fed, zlib.decompressobj(31)


def _ranges(f, chunk_bytes: int):
    """(archive, start, offsets, lengths) of ranges of whole records, offsets counted from the range's start."""
    files = directory(f)
    archives = {m[0]: m for m in files if re.search(r"(^|/)archive/.+\.warc(\.gz)?$", m[0])}
    for name, m in archives.items():
        if m[1] != STORED:
            raise ValueError(f"{name} is not stored, so its records have no ranges")
    found: dict[str, list] = {name: [] for name in archives}
    for m in files:
        if re.search(r"(^|/)indexes/.+\.cdxj?(\.gz)?$", m[0]):
            for line in _index_lines(f, m):
                at = line.find(b"{")
                if at >= 0:
                    entry = json.loads(line[at:])
                    for name in (entry["filename"], f"archive/{entry['filename']}"):
                        if name in found:
                            found[name].append((int(entry["offset"]), int(entry["length"])))
    for name, m in archives.items():
        at = np.array(found[name] or list(_walk(f, m)), dtype=np.int64).reshape(-1, 2)
        at = np.unique(at, axis=0)  # by offset; two indexes may name the same record
        lo = 0
        while lo < len(at):
            hi = max(int(np.searchsorted(at[:, 0], at[lo, 0] + chunk_bytes)), lo + 1)
            yield name, int(m[2] + at[lo, 0]), (at[lo:hi, 0] - at[lo, 0]).tolist(), at[lo:hi, 1].tolist()
            lo = hi


def _named(path: str, fn, *args):
    """Errors name the package they come from."""
    try:
        yield from fn(*args)
    except (ValueError, KeyError, struct.error, zlib.error) as exc:
        raise ValueError(f"{path}: {exc}") from exc


def _parsed(path: str, archive: str, data: bytes, start: int, offsets, lengths):
    for at, n in zip(offsets, lengths):
        piece = data[at:at + n]
        try:
            r = parse_record(zlib.decompress(piece, 31) if archive.endswith(".gz") else piece)
        except (ValueError, KeyError, zlib.error) as exc:
            raise ValueError(f"{path}, offset {start + at}: {exc}") from exc
        kind, payload = r["warc-type"], r["payload"]
        if kind not in ("response", "revisit"):
            continue
        digest = r.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response" and digest and digest_of(payload) != digest:
            raise ValueError(f"{path}, offset {start + at}: payload does not match its digest")
        size = len(payload) if kind == "response" else int(r["http"].get("content-length", -1))
        yield (path, start + at, kind, _key(r.get("warc-record-id")), _key(r.get("warc-refers-to")), r.get("warc-target-uri"),
               None if size < 0 else size, digest_of(payload) if kind == "response" else digest, payload if kind == "response" else None)


RECORD = pa.schema([("package", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("id", pa.string()), ("refers_to", pa.string()),
                    ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
RECORD_DDL = ("package string, offset long, record_type string, id string, refers_to string, url string, payload_bytes long, "
              "payload_digest string, payload binary")
CHUNK = pa.schema([("package", pa.string()), ("archive", pa.string()), ("start", pa.int64()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
MEMBER = pa.schema([("package", pa.string()), ("member", pa.string()), ("method", pa.int64()), ("start", pa.int64()), ("stored", pa.int64()),
                    ("size", pa.int64()), ("crc", pa.int64())])


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _batches(rows, schema, limit: int = 4 << 20):
    """Rows as batches of at most 1,000 rows and about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, list)))
        if len(held) == 1000 or size >= limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", *columns)


def members(spark: SparkSession, path: str) -> DataFrame:
    """(package, member, method, start, stored, size, crc) of all packages under ``path``, from their directories."""
    def work(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield from _batches(((p, *m) for m in _named(p, lambda p: directory(Ranged(p)), p)), MEMBER)

    return _scan(spark, path).mapInArrow(work, "package string, member string, method long, start long, stored long, size long, crc long")


def chunks(spark: SparkSession, path: str, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(package, archive, start, offsets, lengths): every package's records in ranges of about ``chunk_bytes``."""
    def work(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield from _batches(((p, *r) for r in _named(p, lambda p: _ranges(Ranged(p), chunk_bytes), p)), CHUNK)

    return _scan(spark, path).mapInArrow(work, "package string, archive string, start long, offsets array<long>, lengths array<long>")


def records(spark: SparkSession, path: str, payloads: bool = True, by_ranges: bool | None = None, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(package, offset, record_type, id, refers_to, url, payload_bytes, payload_digest, payload) of all responses and
    revisits of all packages under ``path``. Size and digest are of the full payload; without ``payloads`` the payload
    is read and its digest taken, but it stays in its task (null here, as it is for revisits)."""
    if by_ranges is None:
        by_ranges = (urlsplit(path).scheme if "://" in path or path.startswith("file:") else "") in RANGED
    bare = lambda rows: (r if payloads else (*r[:-1], None) for r in rows)
    if not by_ranges:
        def whole(batches):
            for batch in batches:
                for p, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    f = Ranged(p, content.as_py())
                    for archive, start, offsets, lengths in _named(p, _ranges, f, chunk_bytes):
                        data = f.read(start, offsets[-1] + lengths[-1])
                        yield from _batches(bare(_parsed(p, archive, data, start, offsets, lengths)), RECORD)

        return _scan(spark, path, "content").mapInArrow(whole, RECORD_DDL)

    def work(batches):
        for batch in batches:
            for p, archive, start, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                data = Ranged(p).read(start, offsets[-1] + lengths[-1])
                yield from _batches(bare(_parsed(p, archive, data, start, offsets, lengths)), RECORD)

    # the rows that name ranges are tiny beside the ranges, so their number and not their bytes says how many tasks read
    todo = written(chunks(spark, path, chunk_bytes), "warc-ranges")
    n = todo.count()
    parts = max(-(-n // 8), min(n, spark.sparkContext.defaultParallelism), 1)
    return todo.repartition(parts, "package", "start").mapInArrow(work, RECORD_DDL)


def with_payloads(found: DataFrame) -> DataFrame:
    """``records`` with revisits given the payload of the response of their digest. A response shares its digest with
    any number of revisits, so the join is left to split hot digests at run time."""
    own = found.where(F.col("record_type") == "response").select(F.col("payload_digest").alias("d"), F.col("payload").alias("p")).groupBy("d").agg(
        F.any_value("p").alias("p"))
    return found.join(own, found["payload_digest"] == own["d"], "left").withColumn("payload", F.coalesce("payload", "p")).drop("d", "p")
