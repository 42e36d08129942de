"""WARC in ZIP packages: written as stored members, read back by byte ranges without extraction.

A package holds `archive/data.warc.gz` (every record a gzip member of its own) and `indexes/index.cdxj` (a line a record with its offset
and length), both stored, not deflated, so a record is a byte range of the package.

Reading. The end of a package gives its end-of-central-directory record, the ZIP64 one where numbers overflow, and with them the central
directory, which is parsed entry by entry (`Package`). Stored archive members are found by their names, their data by their local headers,
and the records in them by an index member. The ranges are rows: Spark deals them out in runs of neighbours, and tasks read each run with
one request. An archive without an index is walked record by record. No member is unpacked to disk or held whole.

Writing. Pages stay where the scan puts them, and every task streams its records to packages of about `package` bytes. A first pass over
the pages makes light rows (digest, length, page_id, url). Of records with equal payloads of at least `least` bytes, that with the largest
page_id (then the largest url) is a response, the others revisit it; a revisit record needs no payload, so it is written from the light
rows. A Bloom filter of their ids (32 MB at most) lets the pages that surely are responses pass in place; only pages it doubts are joined.
Files are named at random and count only if the manifest, a table, names them: what a failed or repeated task leaves behind is not read.

Files are opened by pyarrow.fs below spark.checkpoint.dir (local and shared folders, hdfs, s3, gs, abfs), as tasks have no other ranged access.

Defined cases: null html is an empty payload; a null url is not written, control characters in one are percent-encoded; a null page_id
counts as the smallest; of rows equal in page_id, url and html one is the response; an empty table gives no package and no row; other
columns are ignored. Members that are deflated can't be read by range and raise an error, as does a payload that differs from its digest.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from hashlib import sha1
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, release, shared_dir, small_batches, spread_join
from .ngram_join import _bloom, _in_filter

# Signatures and marks of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:uuid:"


def digest_of(payload: bytes) -> str:
    """Bare base32 of SHA-1."""
    return base64.b32encode(sha1(payload).digest()).decode()


def record_id(*parts) -> str:
    """A name that follows from what a record is, the same in every run."""
    return _URN + str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts)))


# ------------------------------------------------------------------ packages


class Package:
    """The members of a ZIP file that is read by ranges only. `file` has size() and read_at(length, offset)."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.members = {m["name"]: m for m in self._directory()}

    def _at(self, offset: int, length: int) -> bytes:
        got = self.file.read_at(length, offset) if length else b""
        if len(got) != length:
            raise ValueError(f"package ends at {self.size}, {length} bytes from {offset} asked for")
        return got

    def _end(self) -> tuple[int, int, int]:
        """(entries, length, offset) of the central directory, and the bytes that stand before the package."""
        tail = min(self.size, 22 + FULL16)
        data = self._at(self.size - tail, tail)
        at = data.rfind(struct.pack("<I", END))
        while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
            at = data.rfind(struct.pack("<I", END), 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        count, length, offset = struct.unpack_from("<HII", data, at + 10)
        end = self.size - tail + at
        if FULL16 in (count,) or FULL32 in (length, offset):
            sign, _, where, _ = struct.unpack("<IIQI", self._at(end - 20, 20))
            if sign != LOCATOR:
                raise ValueError("no ZIP64 locator")
            if struct.unpack("<I", self._at(where, 4))[0] != END64:
                raise ValueError("no ZIP64 end of a central directory")
            count, length, offset = struct.unpack("<QQQ", self._at(where + 32, 24))
        return count, length, offset

    def _directory(self) -> Iterator[dict]:
        count, length, offset = self._end()
        data = self._at(offset, length)
        at = 0
        for _ in range(count):
            sign, method, packed, size, n_name, n_extra, n_note, local = *struct.unpack_from("<I6xH", data, at), *struct.unpack_from("<IIHHH8xI", data, at + 20)
            if sign != CENTRAL:
                raise ValueError("a central directory entry has another signature")
            name = data[at + 46 : at + 46 + n_name]
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            yield {"name": name.decode("utf-8", "replace"), "method": method} | self._wide(extra, size, packed, local)
            at += 46 + n_name + n_extra + n_note

    @staticmethod
    def _wide(extra: bytes, size: int, packed: int, local: int) -> dict:
        """Sizes and offset, from the ZIP64 field where 32 bits don't hold them: it has those that overflow, in this order."""
        out = {"size": size, "packed": packed, "local": local}
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = [k for k in out if out[k] == FULL32]
                out |= zip(wide, struct.unpack_from(f"<{len(wide)}Q", extra, at + 4), strict=True)
            at += 4 + n
        return out

    def data(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes within the package."""
        m = self.members[name]
        if m["method"]:
            raise ValueError(f"{name} is deflated, not stored: it has no byte ranges")
        sign, n_name, n_extra = struct.unpack("<I22xHH", self._at(m["local"], 30))
        if sign != LOCAL:
            raise ValueError(f"{name} has no local header")
        return m["local"] + 30 + n_name + n_extra, m["size"]

    def lines(self, name: str, piece: int = 1 << 20) -> Iterator[str]:
        """The lines of a stored member, read piece by piece."""
        at, length = self.data(name)
        rest = b""
        for k in range(0, length, piece):
            *whole, rest = (rest + self._at(at + k, min(piece, length - k))).split(b"\n")
            yield from (x.decode() for x in whole)
        if rest:
            yield rest.decode()

    def ranges(self) -> Iterator[tuple[int, int]]:
        """(offset, length) within the package of every record of its archives."""
        archives = {n.rsplit("/", 1)[-1]: n for n in self.members if re.search(r"\.warc(\.gz)?$", n)}
        begins: dict[str, int] = {}
        for index in (n for n in self.members if n.endswith((".cdxj", ".cdx"))):
            for line in self.lines(index):
                if "{" in line:
                    entry = json.loads(line[line.index("{") :])
                    name = archives[entry["filename"].rsplit("/", 1)[-1]]
                    if name not in begins:
                        begins[name] = self.data(name)[0]
                    yield begins[name] + int(entry["offset"]), int(entry["length"])
        for name in archives.values():
            if name not in begins:
                yield from self._walk(name)

    def _walk(self, name: str, piece: int = 1 << 16) -> Iterator[tuple[int, int]]:
        """Records of an archive that no index names."""
        at, length = self.data(name)
        stop = at + length
        while at < stop:
            if name.endswith(".gz"):
                inflate, k = zlib.decompressobj(31), at
                while not inflate.eof:
                    if k >= stop:
                        raise ValueError(f"{name} ends within a record")
                    got = self._at(k, min(piece, stop - k))
                    k += len(got)
                    inflate.decompress(got)
                size = k - len(inflate.unused_data) - at
            else:
                head, k = b"", at
                while b"\r\n\r\n" not in head:
                    if k >= stop:
                        raise ValueError(f"{name} ends within a record")
                    got = self._at(k, min(piece, stop - k))
                    k += len(got)
                    head += got
                head = head[: head.index(b"\r\n\r\n") + 4]
                size = len(head) + int(re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", head)[1]) + 4
            yield at, size
            at += size


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip(" \t") for k, v in (x.split(":", 1) for x in lines)}
    return fields, rest[: int(fields["content-length"])]


# ------------------------------------------------------------------ records


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, name: str, refers: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit of the response `refers`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if payload is not None else "revisit"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", REVISIT if payload is None else None), ("WARC-Refers-To", refers and f"<{refers}>"),
        ("Page-Id", None if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(fields, http + (payload or b""))


class _Sink:
    """What a ZIP writer needs of a stream that can't seek."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data):
        self.stream.write(data)
        return len(data)

    def flush(self):
        pass


def write_package(stream, records: Iterator[tuple[dict, bytes]], limit: int, level: int = 1) -> int:
    """Write records, with what the index says of each, until about `limit` bytes are written; returns how many."""
    n = at = 0
    index: list[str] = []
    with zipfile.ZipFile(_Sink(stream), "w", zipfile.ZIP_STORED) as z:
        with z.open("archive/data.warc.gz", "w", force_zip64=True) as member:
            for entry, whole in records:
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = gz.compress(whole) + gz.flush()
                member.write(packed)
                said = {"url": entry["url"] or "", "mime": "warc/revisit" if entry["type"] == "revisit" else "text/html", "filename": "data.warc.gz", "offset": str(at), "length": str(len(packed)), "digest": f"sha1:{entry['digest']}"}
                index.append(f"{entry['url'] or '-'} {entry['date']} {json.dumps(said)}\n")
                at += len(packed)
                n += 1
                if at >= limit:
                    break
        with z.open("indexes/index.cdxj", "w", force_zip64=True) as member:
            for line in index:
                member.write(line.encode())
    return n


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner


def _digests(batches):
    """(digest, bytes, page_id, url) of every page."""
    for batch in batches:
        raw = [(x or "").encode() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([digest_of(x) for x in raw]), pa.array([len(x) for x in raw], pa.int64()), batch.column(0), batch.column(1)], names=["digest", "bytes", "page_id", "url"]
        )


class ZipWarc:
    """least: bytes of the smallest payload that is revisited; package: bytes of an archive; level: of gzip; run: bytes that one request reads at most
    beyond its first record."""

    def __init__(self, least: int = 0, package: int = 64 << 20, level: int = 1, date: str = "2000-01-01T00:00:00Z", run: int = 4 << 20):
        self.least, self.package, self.level, self.date, self.run = least, package, level, date, run

    # -------------------------------------------------------------- writing

    def decisions(self, pages: DataFrame) -> DataFrame:
        """digest, bytes, page_id, url, responses, revisits (how many of the equal rows become which), and page and url of the response."""
        light = pages.select("page_id", "url", "html").mapInArrow(_digests, "digest string, bytes long, page_id long, url string")
        each = durable(light.groupBy("digest", "bytes", "page_id", "url").agg(F.count("*").alias("m")), "warc-light")
        best = each.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("n"))
        rows = spread_join(each, best, ["digest", "bytes"], "n").withColumn("first", F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url")))
        small = F.col("bytes") < self.least
        responses = F.when(small, F.col("m")).when(F.col("first"), 1).otherwise(0).cast("long")
        rows = rows.select("digest", "bytes", "page_id", "url", responses.alias("responses"), (F.col("m") - responses).alias("revisits"), F.col("best.page_id").alias("to_page"), F.col("best.url").alias("to_url"))
        return durable(rows.where("revisits > 0"), "warc-revisits")

    def write(self, pages: DataFrame) -> DataFrame:
        """The manifest: path and number of records of every package."""
        spark = pages.sparkSession
        small_batches(spark, 256)
        revisits = self.decisions(pages)
        bitmap = _bloom(revisits.where("page_id is not null").select(F.col("page_id").alias("doc_id")))
        shared = spark.sparkContext.broadcast(bitmap.tobytes())
        rows = pages.select("page_id", "url", "html")

        def part(batches, sure: bool):
            bits = np.frombuffer(shared.value, np.uint64)
            for batch in batches:
                ids = batch.column(0)
                hit = _in_filter(np.nan_to_num(ids.to_numpy(zero_copy_only=False)).astype(np.int64), bits) | ~np.asarray(ids.is_valid())
                batch = batch.filter(pa.array(~hit if sure else hit))
                digests = [digest_of((x or "").encode()) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["page_id", "url", "html", "digest"])

        shape = "page_id long, url string, html string, digest string"
        blank = [F.lit(None).cast(kind).alias(c) for c, kind in (("to_page", "long"), ("to_url", "string"), ("bytes", "long"), ("copy", "long"))]
        columns = ["page_id", "url", "html", "digest", "to_page", "to_url", "bytes", "copy"]
        clear = rows.mapInArrow(lambda it: part(it, True), shape).select("*", *blank).select(*columns)
        doubt = rows.mapInArrow(lambda it: part(it, False), shape)
        known = revisits.select(F.col("page_id").alias("__p"), F.col("url").alias("__u"), F.col("digest").alias("__d"), "responses")
        same = F.col("page_id").eqNullSafe(F.col("__p")) & F.col("url").eqNullSafe(F.col("__u")) & (F.col("digest") == F.col("__d"))
        doubt = doubt.join(known, same, "left")
        single = doubt.where("responses is null").select(*shape_names(shape))
        kept = doubt.where("responses > 0").groupBy("page_id", "url", "digest").agg(F.first("html").alias("html")).select(*shape_names(shape))
        doubted = single.unionByName(kept).select("*", *blank).select(*columns)
        # Equal rows are a number until here: they are dealt out in blocks, and made rows where they are written.
        blocks = revisits.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("revisits") - 1) / 4096)))).repartition("digest", "page_id", "url", "blk")
        copy = F.explode(F.sequence(F.col("blk") * 4096 + 1, F.least("revisits", (F.col("blk") + 1) * 4096))).alias("copy")
        again = blocks.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "to_page", "to_url", "bytes", copy)
        folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        every = clear.unionByName(doubted).unionByName(again.select(*columns))
        return durable(every.mapInArrow(lambda it: self._packages(it, folder), "path string, records long"), "warc-manifest")

    def _records(self, batches):
        for batch in batches:
            for x in batch.to_pylist():
                page, url, digest = x["page_id"], x["url"], x["digest"]
                if x["copy"] is None:
                    payload = (x["html"] or "").encode()
                    # Nothing refers to a payload below `least`, and equal rows of it are all responses: their names are random.
                    name = record_id("response", digest, page, url) if len(payload) >= self.least else _URN + str(uuid.uuid4())
                    whole = page_record(page, url, digest, len(payload), payload, name, None, self.date)
                else:
                    refers = record_id("response", digest, x["to_page"], x["to_url"])
                    whole = page_record(page, url, digest, x["bytes"], None, record_id("revisit", digest, page, url, x["copy"]), refers, self.date)
                yield {"url": None if url is None else _clean(url), "date": re.sub(r"\D", "", self.date), "type": "response" if x["copy"] is None else "revisit", "digest": digest}, whole

    def _packages(self, batches, folder: str):
        records = self._records(batches)
        fs, inner = _open(folder)
        while (first := next(records, None)) is not None:
            fs.create_dir(inner, recursive=True)
            name = f"{uuid.uuid4().hex}.wacz"

            with fs.open_output_stream(f"{inner}/{name}") as stream:
                n = write_package(stream, chain((first,), records), self.package, self.level)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    # -------------------------------------------------------------- reading

    def locate(self, packages: DataFrame) -> DataFrame:
        """path, begin, length of runs of neighbouring records and the lengths of their records, from directories and indexes alone."""

        def found(batches):
            shape = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("lengths", pa.list_(pa.int64()))])
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    fs, inner = _open(path)
                    with fs.open_input_file(inner) as file:
                        runs, total = [], 0
                        for at, n in Package(file).ranges():
                            if runs and at == runs[-1][0] + sum(runs[-1][1]) and total + n <= self.run and len(runs[-1][1]) < 4096:
                                runs[-1][1].append(n)
                                total += n
                            else:
                                runs.append((at, [n]))
                                total = n
                            if len(runs) > 256:
                                done, runs = runs[:-1], runs[-1:]
                                yield pa.RecordBatch.from_arrays([pa.array([path] * len(done)), pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.list_(pa.int64()))], schema=shape)
                        if runs:
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(runs)), pa.array([x for x, _ in runs], pa.int64()), pa.array([x for _, x in runs], pa.list_(pa.int64()))], schema=shape)

        return packages.select("path").repartition(self._tasks(packages), "path").mapInArrow(found, "path string, begin long, lengths array<long>")

    def records(self, packages: DataFrame, payloads: bool = True) -> DataFrame:
        """path, record_id, type, page_id, url, digest, refers, http_bytes (the payload's length as the HTTP header says) and payload of every record.

        Payloads of responses are held against their digests. Without `payloads` they are read and checked, but not returned.
        """
        shape = "path string, record_id string, type string, page_id long, url string, digest string, refers string, http_bytes long, payload_bytes long, payload binary"
        names = shape_names(shape)
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("page_id", "http_bytes", "payload_bytes") else pa.string()) for n in names])

        def read(batches):
            for batch in batches:
                for x in batch.to_pylist():
                    fs, inner = _open(x["path"])
                    with fs.open_input_file(inner) as file:
                        data = file.read_at(sum(x["lengths"]), x["begin"])
                    at, out = 0, []
                    for n in x["lengths"]:
                        fields, block = parse_record(data[at : at + n])
                        at += n
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", http)
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        whole = payload if fields["warc-type"] == "response" else None
                        if whole is not None and digest is not None and digest_of(whole) != digest:
                            raise ValueError(f"{x['path']}: a payload differs from its digest {digest}")
                        page = fields.get("page-id")
                        out.append(
                            (
                                x["path"], fields["warc-record-id"].strip("<>"), fields["warc-type"], None if page is None else int(page), fields.get("warc-target-uri"), digest,
                                fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, int(said[1]) if said else None,
                                None if whole is None else len(whole), whole if payloads else None,
                            )
                        )
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        return self.locate(packages).repartition(self._tasks(packages), "path", "begin").mapInArrow(read, shape)

    @staticmethod
    def _tasks(packages: DataFrame) -> int:
        """Rows are few bytes but much work, so their number of tasks is given: it grows with the packages."""
        return max(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")), packages.count())

    def resolved(self, packages: DataFrame) -> DataFrame:
        """page_id, url, payload_bytes, payload_digest, record_type, refers_to: revisits have length and digest of the response they refer to."""
        rows = durable(self.records(packages, payloads=False).where("type in ('response', 'revisit')"), "warc-read")
        revisits = rows.where("type = 'revisit'")
        asked = revisits.groupBy("refers").agg(F.count("*").alias("n"))
        target = rows.where("type = 'response'").select(F.col("record_id").alias("refers"), F.col("payload_bytes").alias("b"), F.col("digest").alias("d"), F.col("page_id").alias("to"))
        said = spread_join(revisits, target.join(asked, "refers"), ["refers"], "n")
        columns = lambda b, d, to: [F.col("page_id"), F.col("url"), F.col(b).alias("payload_bytes"), F.col(d).alias("payload_digest"), F.col("type").alias("record_type"), to.alias("refers_to")]
        plain = rows.where("type = 'response'").select(*columns("payload_bytes", "digest", F.lit(None).cast("long")))
        return plain.unionByName(said.select(*columns("b", "d", F.col("to"))))


def shape_names(shape: str) -> list[str]:
    return [x.split()[0] for x in shape.split(",")]


def discard(spark: SparkSession, manifest: DataFrame) -> None:
    """Delete the packages of a manifest, and the manifest."""
    for x in manifest.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct().toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(x["folder"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(manifest)
