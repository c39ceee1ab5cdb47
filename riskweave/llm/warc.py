"""WARC records in ZIP packages, and a reader that takes records out by range.

A package is a ZIP of stored (uncompressed) members: ``archive/data.warc.gz``, whose records are
gzip members of their own, and ``indexes/index.cdxj``, whose lines give each record's place. The
reader finds the central directory from the end of the file (with ZIP64 records where sizes need
them), locates the two members and reads single records by offset; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path

#: ZIP signatures and the WARC profile of a revisit.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed beyond so many bytes, and a reading task takes about so many at once.
PACKAGE_BYTES, READ_BYTES = 1 << 30, 4 << 20
#: Digests that are broadcast, counted first (some 60 bytes each); with more, payloads are joined by digest.
BROADCAST_DIGESTS = 200_000


def _line(value) -> str:
    return str(value).replace("\r", "").replace("\n", "")


def record(page_id, url, payload: bytes, digest_hex: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record, gzip-compressed. A revisit keeps the HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=3, mtime=0)


def parse_record(raw: bytes) -> dict:
    """Headers and payload facts of one gzip-compressed record."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "revisit":
        said = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:]))
        size, digest = int(said["content-length"]), base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to")), "payload": payload}


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number else None


def members(size: int, read) -> dict[str, tuple[int, int]]:
    """Member name -> (offset of its bytes, length) of a ZIP; ``read(offset, length)`` gives ranges.

    Only stored members count: others cannot be read by range.
    """
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, count, length, start, _ = struct.unpack("<4H2LH", tail[at + 4 : at + 22])
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        where = struct.unpack("<Q", tail[at - 12 : at - 4])[0]
        record64 = read(where, 56)
        if record64[:4] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<3Q", record64[32:56])
    directory, out, p = read(start, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[p + 10 : p + 12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<2L3H", directory[p + 20 : p + 34])
        local, = struct.unpack("<L", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack("<2H", extra[q : q + 4])
            if tag == 1:  # ZIP64: 8 bytes for each field that is all ones, in this order
                values = [v[0] for v in struct.iter_unpack("<Q", extra[q + 4 : q + 4 + n // 8 * 8])]
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            q += 4 + n
        if method == 0:
            head = read(local, 30)
            if head[:4] != LOCAL:
                raise ValueError("broken local header")
            out[name] = (local + 30 + sum(struct.unpack("<2H", head[26:30])), packed)
        p += 46 + n_name + n_extra + n_comment
    return out


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


class _Package:
    """A package under way: written beside its place and moved there when it is whole."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.fs, path = _open(folder)
        self.fs.create_dir(path, recursive=True)
        self.name, self.final, self.part = name, f"{path}/{name}", f"{path}/.{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data, self.at, self.index = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0, []

    def add(self, raw: bytes, facts: dict) -> None:
        self.data.write(raw)
        self.index.append(json.dumps(facts | {"offset": self.at, "length": len(raw)}))
        self.at += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in self.index))
        self.zip.close()
        self.out.close()
        self.fs.move(self.part, self.final)
        return self.name, len(self.index), self.at


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page and return the manifest ``package, n_records, bytes``.

    Pages with equal payloads of at least ``min_revisit_bytes`` share one response, that of the
    largest id (all rows of that id, if repeated; if no id is known, all are responses); the
    others revisit it. Null html is an empty payload, a null url is left out, a null id is kept
    as null. Digests are counted first; few shared ones are broadcast and payloads stay where they
    are, many are joined by digest, where Spark splits a hot one. Payloads of any length are one
    record. An empty table writes no package and has no row in the manifest; further columns are
    ignored.
    """
    facts = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    facts = facts.withColumn("digest", F.sha1("payload"))
    shared = facts.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    shared = materialise(shared, "warc-shared")
    rows = facts.join(F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared, "digest", "left").select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        package, done = None, []
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if package is None:
                    package = _Package(folder, f"part-{task.partitionId():06d}-{len(done):04d}.wacz", task.taskAttemptId())
                package.add(record(page_id, url, payload, digest, refers_to, date), {"url": url, "mime": "text/html", "digest": f"sha1:{digest}", "page_id": page_id})
                if package.at >= PACKAGE_BYTES:
                    done, package = [*done, package.close()], None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["package", "n_records", "bytes"])

    return materialise(rows.mapInArrow(write, "package string, n_records long, bytes long"), "warc-manifest")


def read_packages(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` (and ``payload``).

    Each package's directory and index are read first and give runs of neighbouring records of
    about READ_BYTES; the runs are dealt out over as many tasks as the manifest's bytes fill, so
    one large package is read by many.
    """

    def runs(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = _open(folder)
                with fs.open_input_file(f"{path}/{name}") as f:
                    found = members(f.size(), lambda at, n: f.read_at(n, at))
                    index = f.read_at(found[INDEX][1], found[INDEX][0]).decode().splitlines()
                start, sizes, out = found[DATA][0], [], []
                for line in index:
                    x = json.loads(line)
                    if sizes and sum(sizes) + x["length"] > READ_BYTES:
                        out.append((name, start, sizes))
                        start, sizes = start + sum(sizes), []
                    sizes.append(x["length"])
                out.append((name, start, sizes))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))], ["package", "at", "sizes"])

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches):
        for b in batches:
            for name, at, sizes in zip(*[c.to_pylist() for c in b.columns], strict=True):
                fs, path = _open(folder)
                with fs.open_input_file(f"{path}/{name}") as f:
                    raw = f.read_at(sum(sizes), at)
                got, p = [], 0
                for n in sizes:
                    got.append(parse_record(raw[p : p + n]))
                    p += n
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in zip(names, kinds)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    packages, size = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, -(-(size or 0) // READ_BYTES), min(packages, manifest.sparkSession.sparkContext.defaultParallelism))
    found = manifest.select("package").repartition(max(1, packages), "package").mapInArrow(runs, "package string, at long, sizes array<long>")
    return found.repartition(tasks, "package", "at").mapInArrow(read, schema)


def package_folder(spark: SparkSession) -> str:
    """A new folder for packages in the shared folder, as a URI."""
    path = new_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
