"""WARC archives with a two-level capture index.

write() puts a record per page into gzip-per-record WARC files, each of which begins with a warcinfo record;
payloads that an earlier record holds become revisit records, which name that record's id.  Ids are derived from
the page's id, kind and payload digest, so a task's second attempt gives the same; rows that repeat share one.  index() sorts the captures' keys (host reversed, then the path, then the page's
id) into compressed blocks of LINES lines and keeps a sparse directory with each block's first key.
lookup() finds the index part, binary-searches its directory, and reads the one or two blocks that can
hold a key by range; fetch() reads records by range, neighbours in one go.

Files go to the shared folder through pyarrow's file systems, under names that no other attempt of a
task uses; only what a finished task reports is in the manifest and the index, so a lost executor leaves
unused files, never wrong ones.  The driver holds one entry for each index part (at most PARTS).

Defined cases: a null payload is empty; a page without url has the key of an empty host; equal payloads
of at least MIN_REVISIT bytes share the response of the smallest page_id (all rows that carry it are
responses), null ids refer to it too and are all responses if no id is known; rows that repeat are a
record each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
LINES = 512
PARTS = 4096
ROLL_BYTES = 256 << 20
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
TASK_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s).*?://", ""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column, page_id: Column) -> Column:
    """Reversed host, path and query, then the capture's id: com,example,www)/a?b 00000000000000000042."""
    host, _ = host_path(url)
    tail = F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^#]*)", 1), F.lit(""))
    full = F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail), r"[\x00-\x20\x7f]", "+")
    return F.concat(full, F.lit(" "), F.coalesce(F.format_string("%020d", page_id), F.lit("-")))


def record_id(page_id: int | None, kind: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=sha256(f'{kind} {page_id} {digest}'.encode()).digest()[:16], version=4)}>"


def info_record(name: str) -> bytes:
    """The record that a file begins with."""
    block = b"software: quern\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, 'warcinfo', name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """A WARC record; a revisit keeps the HTTP head with the payload's length, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, kind, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, 'response', digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record, with its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha256(payload).hexdigest() != digest):
        raise ValueError("a WARC payload doesn't have its digest")
    url, refers = fields.get("WARC-Target-URI"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": int(refers) if refers else None, "record_id": fields["WARC-Record-ID"], "refers_to_id": fields.get("WARC-Refers-To"),
    }


def _writer(folder: str):
    kind = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = common.open_fs(folder)
        out, name, at = None, "", 0
        for batch in batches:
            made: list[tuple] = []
            cols = [batch[c].to_pylist() for c in ("page_id", "url", "digest", "refers_to", "n", "key")]
            for k, (page, url, digest, refers, n, key) in enumerate(zip(*cols)):
                if out is None or at >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    head = gzip.compress(info_record(name), 4, mtime=0)
                    out.write(head)
                    at = len(head)
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = z.compress(record(page, url, batch["payload"][k].as_py() if refers is None else b"", digest, refers, n)) + z.flush()
                out.write(data)
                made.append((key, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in made], kind.field(c).type) for c in range(4)], schema=kind)
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives; returns their manifest: key, file, offset, length."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    n = F.octet_length("payload")
    # whole payloads never meet by digest: what revisits what is decided on ids and digests, and stored before it is joined back
    heads = common.stored(rows.where(n >= MIN_REVISIT).select("page_id", "digest").distinct(), f"{folder}/heads")
    again = heads.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null")
    again = common.stored(again.drop("c"), f"{folder}/again")
    later = heads.join(again, heads["digest"] == again["d"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("i"), "d", "first")
    later = common.stored(later, f"{folder}/later")
    known = rows.join(later, rows["page_id"].eqNullSafe(later["i"]) & (rows["digest"] == later["d"]), "left")
    refers = F.col("first")
    records = known.select("page_id", "url", "payload", "digest", n.cast("long").alias("n"), refers.alias("refers_to"), key_of(F.col("url"), F.col("page_id")).alias("key"))
    return common.stored(records.mapInArrow(_writer(f"{folder}/archive"), "key string, file string, offset long, length long"), f"{folder}/manifest")


def _indexer(folder: str):
    kind = pa.schema([("first", pa.string()), ("last", pa.string()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = common.open_fs(folder)
        name, out, at, first, last, lines, directory = uuid.uuid4().hex, None, 0, None, None, [], []

        def block() -> None:
            nonlocal at, lines
            data = gzip.compress("".join(lines).encode(), 6, mtime=0)
            directory.append([lines[0].split("\t", 1)[0], at, len(data)])
            out.write(data)
            at, lines = at + len(data), []

        for batch in batches:
            for key, file, offset, length in zip(*(batch[c].to_pylist() for c in ("key", "file", "offset", "length"))):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out, first = fs.open_output_stream(f"{path}/{name}.cdx.gz", compression=None), key
                lines.append(f"{key}\t{file}\t{offset}\t{length}\n")
                last = key
                if len(lines) == LINES:
                    block()
        if out is not None:
            if lines:
                block()
            out.close()
            with fs.open_output_stream(f"{path}/{name}.dir", compression=None) as d:
                d.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (first, last, name)], schema=kind)

    return run


def _parts(spark: SparkSession) -> int:
    return min(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def index(manifest: DataFrame, folder: str) -> list[tuple[bytes, bytes, str]]:
    """Writes the sorted blocks and directories; returns first key, last key and name of each part."""
    ordered = manifest.repartitionByRange(_parts(manifest.sparkSession), "key").sortWithinPartitions("key")
    parts = common.stored(ordered.mapInArrow(_indexer(f"{folder}/index"), "first string, last string, name string"), f"{folder}/parts").collect()
    return sorted((p["first"].encode(), p["last"].encode(), p["name"]) for p in parts)


class _Reader:
    """Binary search in one index part at a time; keeps the last directory and the last block."""

    def __init__(self, folder: str, parts: list[tuple[bytes, bytes, str]]):
        self.fs, self.path = common.open_fs(f"{folder}/index")
        self.parts, self.lasts = parts, [p[1] for p in parts]
        self.name, self.directory, self.firsts, self.file, self.at, self.lines = "", [], [], None, -1, []

    def _block(self, k: int) -> list[tuple[bytes, list[str]]]:
        if k != self.at:
            _, offset, length = self.directory[k]
            self.file.seek(offset)
            rows = [x.split("\t") for x in gzip.decompress(self.file.read(length)).decode().split("\n")[:-1]]
            self.at, self.lines = k, [(r[0].encode(), r) for r in rows]
        return self.lines

    def find(self, key: bytes) -> Iterator[list[str]]:
        for part in range(bisect.bisect_left(self.lasts, key), len(self.parts)):
            first, _, name = self.parts[part]
            if first > key:
                return
            if name != self.name:
                with self.fs.open_input_file(f"{self.path}/{name}.dir") as d:
                    self.directory = json.loads(d.read())
                self.firsts = [x[0].encode() for x in self.directory]
                self.file, self.name, self.at = self.fs.open_input_file(f"{self.path}/{name}.cdx.gz"), name, -1
            for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.directory)):
                if self.firsts[k] > key:
                    break
                lines = self._block(k)
                for j in range(bisect.bisect_left(lines, key, key=lambda x: x[0]), len(lines)):
                    if lines[j][0] != key:
                        break
                    yield lines[j][1]


def lookup(keys: DataFrame, parts: list[tuple[bytes, bytes, str]], folder: str) -> DataFrame:
    """key, file, offset and length of each capture that has one of the distinct keys."""
    kind = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder, parts)
        for batch in batches:
            found = [x for key in batch["key"].to_pylist() for x in reader.find(key.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([int(x[2]) for x in found], pa.int64()), pa.array([int(x[3]) for x in found], pa.int64())], schema=kind)

    wanted = keys.select("key").where("key is not null").distinct()
    ordered = wanted.repartitionByRange(_parts(keys.sparkSession), "key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "key string, file string, offset long, length long")


def fetch(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records at these places, read by range and checked against their digests."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = common.open_fs(f"{folder}/archive")
        name, file = None, None
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))))
            k = 0
            while k < len(rows):
                of, lo, n = rows[k]
                hi, end = lo + n, k + 1
                while end < len(rows) and rows[end][0] == of and lo <= rows[end][1] <= hi + GAP_BYTES and rows[end][1] + rows[end][2] - lo <= READ_BYTES:
                    hi, end = max(hi, rows[end][1] + rows[end][2]), end + 1
                if of != name:
                    file, name = fs.open_input_file(f"{path}/{of}"), of
                file.seek(lo)
                data = file.read(hi - lo)
                found = [parse(zlib.decompress(data[o - lo : o - lo + m], 31)) for _, o, m in rows[k:end]]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in zip(names, kinds)], names=names)
                k = end

    spark = captures.sparkSession
    places = common.stored(captures.select("file", "offset", "length"), common.scratch(spark, "places"))
    total = places.agg(F.sum("length")).first()[0] or 0  # tasks follow the archives' bytes, not the places'
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    near = places.withColumn("chunk", F.floor(F.col("offset") / READ_BYTES)).repartition(tasks, "file", "chunk").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return near.mapInArrow(run, RESULT + ", payload binary" * payloads)


def archive(pages: DataFrame, folder: str | None = None, **columns) -> tuple[str, list[tuple[bytes, bytes, str]]]:
    """Writes and indexes pages; returns the folder and the index parts."""
    folder = folder or common.scratch(pages.sparkSession, "warc")
    return folder, index(write(pages, folder, **columns), folder)
