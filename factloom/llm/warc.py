"""Deterministic sharded WARC writer and reader.

Writing: payload digests (SHA-1) are taken in the JVM; of equal payloads of at least `least` bytes the row with the largest
id is the response and the others revisit it. The records are range-sorted by (id, digest) and every task writes its range
as gzip members, one per record, to files that are rolled when their compressed size reaches `roll` bytes. Headers are made
anew from the record alone (record ids are name-based UUIDs, the date is a parameter, gzip members carry no time), so equal
input gives equal bytes. A task writes under temporary names that hold its attempt; only the attempt that Spark accepts
reports its files, so lost executors and speculative copies leave nothing that counts. The files reported are then renamed
and listed, with their sizes and SHA-256, in a manifest (a Parquet table written last); readers read what it lists.

Files are opened through pyarrow's file systems by the folder's full URI (a folder without a scheme lies on the default file
system, as for Spark itself), so the folder can be on any shared store.

Temporary files of attempts that did not count are removed once the manifest is written.

Defined results: null payloads are empty; repeated rows are records of their own, whose record ids are apart by the number of
the copy among the rows of equal page_id and payload; a
null url has no header and an empty one an empty header; control characters in a url are percent-encoded, which a header says,
and decoded on reading; a null page_id is written as an empty header; such a row revisits the copy with the largest id, and
where no copy has an id all are responses; very long payloads are written and read whole; an empty table gives an empty archive with an empty manifest.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialise, partitions, running_sums, scratch_folder, utf8_bytes

ROLL = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def _resolved(spark: SparkSession, folder: str) -> str:
    """The folder's full URI: without a scheme it lies where Spark itself would put it, on the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a full URI and the path in it."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def bare(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'factloom:{page}:{digest}:{copy}')}>"


_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def _uri(name: str, url: str | None) -> list[str]:
    """A header with a url: none for null. A url with control characters, which would break the header, is percent-encoded
    (these and the percent sign), and a second header says so."""
    if url is None:
        return []
    if not _CONTROL.search(url):
        return [f"{name}: {url}"]
    return [f"{name}: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url.replace('%', '%25'))}", f"X-{name}-Encoding: percent"]


def _url(fields: dict[str, str], name: str = "WARC-Target-URI") -> str | None:
    url = fields.get(name)
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url) if f"X-{name}-Encoding" in fields else url


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int = 0, referred: str | None = None) -> bytes:
    """One record, headers and block. A revisit's block holds the HTTP headers only, with the full payload's length."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest, copy)}", f"WARC-Date: {DATE}",
        *_uri("WARC-Target-URI", url), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-ID: {'' if page is None else page}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", *_uri("WARC-Refers-To-Target-URI", referred), f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}"]
    return CRLF.join([*(h.encode() for h in head), b"", block, b"", b""])


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without time or name."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


FIELDS = ["page_id", "url", "html", "digest", "refers_to", "referred", "copy"]
MANIFEST = "file string, temporary string, records long, bytes long, sha256 string, first_page long, last_page long"


def numbered(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows with `copy`, which numbers the rows of equal page_id and digest from 0 by url; pairs: how often each such pair occurs.

    Rows that are equal in the url too hold the same payload: they are grouped, numbered as one and put out again, so a
    third of all rows in one group is no more than one row until then.
    """
    again = pairs.filter("times > 1").select(F.col("digest").alias("_digest"), F.col("page_id").alias("_page"))
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    same = (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page"))
    groups = rows.join(again, same, "left_semi").groupBy("page_id", "digest", "url").agg(F.first("html").alias("html"), F.first("n").alias("n"), F.count("*").alias("times"))
    summed = running_sums(groups, ["page_id", "digest", "url"], {"times": "upto"}, "groups").withColumn("start", F.col("upto") - F.col("times"))
    first = summed.groupBy(F.col("digest").alias("_digest"), F.col("page_id").alias("_page")).agg(F.min("start").alias("first"))
    spread = summed.join(first, same).withColumn("copy", F.explode(F.sequence(F.col("start") - F.col("first"), F.col("upto") - F.col("first") - 1)))
    return rows.join(again, same, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(spread.select(*rows.columns, "copy"))


def write_archive(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL, level: int = 6) -> DataFrame:
    """Write pages (page_id, url, html) as an archive under folder; return its manifest."""
    spark = pages.sparkSession
    folder = _resolved(spark, folder)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), utf8_bytes(html).alias("n"))
    lowest = F.when(~F.max(F.col("url").isNull()), F.min("url"))  # the url of copy 0, nulls first
    pairs = materialise(rows.groupBy("digest", "page_id").agg(F.first("n").alias("n"), lowest.alias("url"), F.count("*").alias("times")), "pairs")
    keys = pairs.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("referred"), F.sum("times").alias("times")).filter("times > 1").drop("times")
    # written first, so that Spark knows its size: it is broadcast only if small, else both sides are shuffled
    keys = materialise(keys, "copies")
    linked = numbered(rows, pairs).join(keys, "digest", "left").withColumn("refers_to", F.when(F.col("n") >= least, F.col("refers_to")))
    linked = linked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))
    order = ["page_id", "digest", "copy"]  # no two rows are equal in these, so that no range is too large to split
    ordered = linked.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, top = _open(folder)
        part, attempt = task.partitionId(), task.taskAttemptId()
        done: list[tuple] = []
        out, seal, now = None, None, {}

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((now["file"], now["temporary"], now["records"], now["bytes"], seal.hexdigest(), now["first"], now["last"]))
                out = None

        for batch in batches:
            for page, url, html, sha1, refers, referred, copy in zip(*(batch.column(c).to_pylist() for c in FIELDS)):
                data = member(record(page, url, html.encode(), bare(sha1), refers, copy, referred), level)
                if out is None:
                    file = f"part-{part:05d}-{len(done):04d}.warc.gz"
                    now = {"file": file, "temporary": f".{file}.{attempt}", "records": 0, "bytes": 0, "first": page, "last": page}
                    out, seal = store.open_output_stream(f"{top}/{now['temporary']}", compression=None), hashlib.sha256()
                out.write(data)
                seal.update(data)
                now["records"], now["bytes"], now["last"] = now["records"] + 1, now["bytes"] + len(data), page
                if now["bytes"] >= roll:
                    close()
        close()
        if done:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], [c.split()[0] for c in MANIFEST.split(", ")])

    written = materialise(ordered.select(*FIELDS).mapInArrow(write, MANIFEST), "written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        for batch in batches:
            for file, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist()):
                if store.get_file_info(f"{top}/{temporary}").type != pafs.FileType.NotFound:  # else an earlier attempt renamed it
                    store.move(f"{top}/{temporary}", f"{top}/{file}")
            yield batch

    written.mapInArrow(commit, MANIFEST).drop("temporary").write.parquet(f"{folder}/manifest")
    for left in fs.get_file_info(pafs.FileSelector(root)):
        if left.base_name.startswith(".part-"):
            fs.delete_file(left.path)
    return spark.read.parquet(f"{folder}/manifest")


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(size)
        if not data:
            return
        out.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(CRLF * 2)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"{fields['WARC-Record-ID']}: its block does not have the digest that its header states")
    http, _, payload = block.partition(CRLF * 2)
    length = next(int(line.split(b":", 1)[1]) for line in http.split(CRLF) if line.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "length": length}


def read_archive(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the files that the manifest lists, with digests checked."""
    folder = _resolved(manifest.sparkSession, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for files in batches:
            for file in files.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{top}/{file}", compression=None) as stream:
                    for data in members(stream):
                        r = parse(data)
                        number = lambda k: int(r[k]) if r.get(k) else None
                        digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                        if r["WARC-Type"] == "response" and (len(r["payload"]) != r["length"] or base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest):
                            raise ValueError(f"{file}: a payload does not match its header")
                        rows.append((number("X-Page-ID"), _url(r), r["WARC-Type"], r["length"], digest, number("X-Refers-To-Page"), r["payload"] if payloads else None))
                        held += len(data) if payloads else 200
                        if held > 4_000_000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return manifest.select("file").repartition(partitions(manifest.sparkSession)).mapInArrow(read, READ)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = os.path.join(scratch_folder(spark), f"factloom-warc-{uuid.uuid4().hex}")
    manifest = write_archive(pages, folder)
    return read_archive(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 by five-bit groups: 160 bits are 32 of them
OP5_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p
), base32 AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(bits, 5 * i + 1, 5) AS BIT)::BIGINT::INTEGER, 1), '' ORDER BY i) AS digest
  FROM (SELECT DISTINCT hex, CAST(from_hex(hex) AS BIT)::VARCHAR AS bits FROM d), range(32) t(i)
  GROUP BY hex
), last AS (
  SELECT hex, payload_bytes, max(page_id) AS keeper FROM d GROUP BY hex, payload_bytes
)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, b.digest AS payload_digest,
       CASE WHEN d.page_id = l.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = l.keeper THEN NULL ELSE l.keeper END AS refers_to
FROM d JOIN base32 b ON d.hex = b.hex JOIN last l ON d.hex = l.hex AND d.payload_bytes = l.payload_bytes
"""
