"""WARC records in ZIP archives, read by range without unpacking.

An archive is a ZIP file whose members are stored, not compressed: the records
(each its own gzip member), an index with a line of JSON per record, and a
description.  The writer streams to the shared folder.  The reader knows only the
archive's address: it reads the end of the file, the central directory (with the
ZIP64 records where sizes or counts need them) and the local headers, takes the
index from its stored member, and then reads each record by its own range.

Payloads that are equal are written once, as the response with the largest id;
other rows become revisit records that name it.

Defined results
  null payload          empty, written as any other
  null id               such rows rank below all ids; they revisit the largest id
                        with that payload, and where there is none all of them
                        are responses
  repeated largest ids  each of these rows is a response
  null address          an empty target URI
  long payloads         a record is held whole by one task; archives are of bounded size
  a frequent payload    its rows are dealt over many tasks; revisits carry no body
  extra columns         stay behind
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._run import cut, scratch, ship

RECORDS, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
ARCHIVES_AT_ONCE = 4  # that a task reads, at most
DATE = "1970-01-01T00:00:00Z"
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- reading a ZIP file by ranges


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Where the data of each stored member begins, and its length, from the directory alone."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 22 - 65_535)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(_END)
    while k >= 0 and (len(tail) < k + 22 or len(tail) != k + 22 + struct.unpack_from("<H", tail, k + 20)[0]):
        k = tail.rfind(_END, 0, k)  # the mark can also stand in a comment, which ends the file
    if k < 0:
        raise ValueError("no end of a ZIP directory")
    entries, length, at = struct.unpack_from("<HII", tail, k + 10)
    where = tail_at + k - 20
    locator = read(where, 20) if where >= 0 else b""
    if locator[:4] == _LOCATOR64:
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != _END64:
            raise ValueError("no ZIP64 end of the directory where its locator points")
        entries, length, at = struct.unpack_from("<QQQ", end64, 32)
    directory, out, p = read(at, length), {}, 0
    for _ in range(entries):
        if directory[p : p + 4] != _ENTRY:
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
        local = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # ZIP64: of these only the fields that are all ones in the entry
                r = q + 4
                for missing, which in ((plain == 0xFFFFFFFF, 0), (packed == 0xFFFFFFFF, 1), (local == 0xFFFFFFFF, 2)):
                    if missing:
                        (value,) = struct.unpack_from("<Q", extra, r)
                        r += 8
                        plain, packed, local = (value, packed, local) if which == 0 else (plain, value, local) if which == 1 else (plain, packed, value)
            q += 4 + n
        p += 46 + n_name + n_extra + n_comment
        if method == zipfile.ZIP_STORED:
            head = read(local, 30)
            if head[:4] != _LOCAL:
                raise ValueError("no local header where the directory points")
            a, b = struct.unpack_from("<HH", head, 26)
            out[name] = (local + 30 + a + b, packed)
    return out


# --- records


def record(kind: str, page_id: int | None, url: str, payload: bytes | None, size: int, payload_digest: str, refers_to: int | None) -> bytes:
    """A WARC record; a revisit (payload None) keeps the full payload's digest and length in its header."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    body = payload if payload is not None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


class ArchiveWriter:
    """Streams records into one archive."""

    def __init__(self, out, zip64: bool = False):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.zip64 = zip64
        self.at, self.index = 0, []
        self.data = self.zip.open(RECORDS, "w", force_zip64=True)

    def add(self, key: str, data: bytes) -> None:
        packed = gzip.compress(data, 1, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"key": key, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        for name, text in ((INDEX, "".join(f"{x}\n" for x in self.index)), (ABOUT, json.dumps({"profile": "data-package", "resources": [{"path": RECORDS}, {"path": INDEX}]}))):
            with self.zip.open(name, "w", force_zip64=self.zip64) as f:
                f.write(text.encode())
        self.zip.close()


class _Counted(io.RawIOBase):
    """A stream that can only be appended to, for zipfile."""

    def __init__(self, out):
        self.out, self.n = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.n += len(data)
        return len(data)

    def tell(self) -> int:
        return self.n

    def flush(self) -> None:
        self.out.flush()


# --- over tables

#: Repeated digests that are sent to all executors, 28 bytes each and as much again to find them by: some 60 MB.
DIGESTS_SENT = 1 << 20

def write(df: DataFrame, folder: str, *, id_column: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = 64 << 20, zip64: bool = False, sent: int = DIGESTS_SENT) -> DataFrame:
    """Writes archives into ``folder``, an address that all executors reach, and returns their list.

    Payloads that come several times are told by a join with the list of their digests.  Up to
    ``sent`` of them go to all executors, so no page is shuffled; beyond, the join shuffles
    pages, and adaptive execution sizes its tasks by bytes.  A task
    writes archives of about ``archive_bytes``, under names of its own, so an
    attempt that is repeated leaves no part of another's; only the archives of
    attempts that succeeded are in the list.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("body").cast("binary"))))
    several = rows.select("id", "sha").groupBy("sha").agg(F.max("id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("sha", "largest", F.lit(True).alias("several"))
    several = cut(several, "several")  # a table, so that the join can be split at a frequent payload
    joined = rows.join(F.broadcast(several) if several.count() <= sent else several, "sha", "left").withColumn("largest", F.when(F.col("several"), F.col("largest")).otherwise(F.col("id")))
    response = F.col("id").eqNullSafe(F.col("largest"))
    source = joined.select("id", "url", F.when(response, F.col("body")).alias("body"), F.octet_length("body").cast("long").alias("size"), "sha", "largest", response.alias("response"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        done, archive, stream, path = [], None, None, ""
        context = TaskContext.get()
        part = context.partitionId() if context else 0

        def close():
            archive.close()
            stream.close()
            done.append((path, len(archive.index)))

        for batch in batches:
            for page, address, body, size, sha, top, is_response in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.wacz"
                    stream = fs.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}")
                    archive = ArchiveWriter(_Counted(stream), zip64)
                address = " ".join(address.split())
                data = body.encode("utf-8", "surrogatepass") if is_response else None
                archive.add(address, record("response" if is_response else "revisit", page, address, data, size, base64.b32encode(sha).decode(), None if is_response else top))
                if archive.at >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    return cut(source.mapInArrow(written, "archive string, records long"), "archives")


OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read(archives: DataFrame, *, archive: str = "archive", with_payload: bool = False, tasks: int | None = None, gap: int = 1 << 20) -> DataFrame:
    """A row for each record of the archives; the digest of a payload is made anew and has to equal its record's.

    Records that lie within ``gap`` bytes of each other are fetched by one range.
    """
    spark = archives.sparkSession
    ship(spark)
    names = [x.split()[0] for x in OUT.split(", ")] + ["payload"] * with_payload
    schema = OUT + ", payload binary" * with_payload

    def page(name: str) -> int | None:
        text = name.strip("<>").rpartition(":")[2]
        return None if text == "null" else int(text)

    def records(path: str) -> Iterator[tuple]:
        fs, place = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(place) as f:
            where = members(f, f.size())
            at, n = where[INDEX]
            f.seek(at)
            lines = [json.loads(x) for x in f.read(n).splitlines()]
            start, total = where[RECORDS]
            k = 0
            while k < len(lines):
                first, end, j = lines[k]["offset"], lines[k]["offset"] + lines[k]["length"], k + 1
                while j < len(lines) and end <= lines[j]["offset"] + gap and lines[j]["offset"] + lines[j]["length"] - first <= 4 * gap:
                    end, j = lines[j]["offset"] + lines[j]["length"], j + 1
                if end > total:
                    raise ValueError(f"{path}: the index points behind its records")
                f.seek(start + first)
                data = f.read(end - first)
                for line in lines[k:j]:
                    a = line["offset"] - first
                    fields, body = parse(zlib.decompress(data[a : a + line["length"]], 31))
                    told = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    if kind == "response" and (digest(body) != told or len(body) != int(fields["x-payload-length"])):
                        raise ValueError(f"{path}: a payload isn't what its record says")
                    refers = page(fields["warc-refers-to"]) if kind == "revisit" else None
                    yield (page(fields["warc-record-id"]), int(fields["x-payload-length"]), told, kind, refers, fields["warc-target-uri"], *([body] if with_payload else []))
                k = j

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

        def given(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list = []
                for r in records(path):
                    rows.append(r)
                    if len(rows) >= (256 if with_payload else 4096):
                        yield given(rows)
                        rows = []
                yield given(rows)

    paths = archives.select(archive)
    return paths.repartition(tasks or max(spark.sparkContext.defaultParallelism, -(-paths.count() // ARCHIVES_AT_ONCE))).mapInArrow(found, schema)


def round_trip(spark: SparkSession, df: DataFrame, **names: str) -> DataFrame:
    """Writes archives to the shared folder and reads them again."""
    return read(write(df, scratch(spark, "warc"), **names))
