"""A deterministic sharded WARC writer, and its reader."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.llm.rows import column, packed, table
from trustloom.llm.words import small_batches
from trustloom.session import materialise, scratch_path

MANIFEST = "manifest.json"
ROLL_BYTES = 32 << 20
GZIP = 31  # zlib's number for a gzip member
_CRLF = b"\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member; it holds no time or name, so equal data give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return packer.compress(data) + packer.flush()


# A member that holds nothing. It may stand between members, and so can be the line separator of a text file writer.
EMPTY_MEMBER = gzip_member(b"")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit that names the response and keeps the payload's length and digest.
    All headers come from the arguments; line ends in the URI are percent-encoded, as they would end the header."""
    digest, revisit = payload_digest(payload), refers_to is not None
    block = b"" if revisit else payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'null' if key is None else key}>"),
        ("WARC-Date", date),
        *([("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A"))] if uri is not None else []),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"),
           ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/octet-stream"),
        ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{name}: {value}".encode() + _CRLF for name, value in headers)
    return b"WARC/1.1" + _CRLF + head + _CRLF + block + _CRLF + _CRLF


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of one record; anything that does not fit is an error."""
    head, end, body = data.partition(_CRLF + _CRLF)
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block, tail = body[: int(headers["Content-Length"])], body[int(headers["Content-Length"]) :]
    if first != "WARC/1.1" or not end or tail != _CRLF + _CRLF:
        raise ValueError(f"broken WARC record {headers.get('WARC-Record-ID')}")
    if headers["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError(f"WARC record {headers['WARC-Record-ID']} does not match its digest")
    return headers, block


def _references(light: DataFrame, often: int) -> DataFrame:
    """Rows (key, digest, refers_to) for each page of ``light`` (key, digest) that revisits another: the largest key among
    equal payloads. Payloads stay where they are; the pages with the commonest payloads (``often``) get their response by
    a broadcast, so no payload's pages meet in one task."""
    groups = light.groupBy("digest").agg(F.max("key").alias("response"), F.count("*").alias("n"))
    groups = materialise(groups.where((F.col("n") > 1) & F.col("response").isNotNull()), "payloads")
    common = light.join(F.broadcast(groups.where(F.col("n") >= often)), "digest")
    rare = light.join(groups.where(F.col("n") < often), "digest")
    revisits = common.unionByName(rare).where(~F.col("key").eqNullSafe(F.col("response")))
    return materialise(revisits.select("key", "digest", F.col("response").alias("refers_to")).distinct(), "revisits")


def _crowds(light: DataFrame, references: DataFrame, often: int) -> DataFrame:
    """Rows (crowd_key, crowd_digest, refers_to) of the keys and digests that ``often`` rows or more share, such as empty
    pages without key. There are at most a thousand."""
    crowds = light.groupBy("key", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= often)
    named = references.withColumnsRenamed({"key": "to_key", "digest": "to_digest"})
    same = F.col("key").eqNullSafe(F.col("to_key")) & (F.col("digest") == F.col("to_digest"))
    return crowds.join(named, same, "left").select(
        F.col("key").alias("crowd_key"), F.col("digest").alias("crowd_digest"), "refers_to")


def _members(date: str, level: int):
    """Each record as a gzip member, with the compressed bytes before it in its partition. A row says itself what it refers
    to, or one without payload says so for the rows with its key and digest, which follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, named = 0, (None, None, None)
        for batch in small_batches(batches, "payload"):
            made = []
            cols = (batch.column(c).to_pylist() for c in ("part", "key", "digest", "uri", "payload", "refers_to"))
            for part, key, digest, uri, payload, refers_to in zip(*cols):
                if payload is None:
                    named = (key, digest, refers_to)
                    continue
                to = named[2] if refers_to is None and named[:2] == (key, digest) else refers_to
                member = gzip_member(record(key, uri, payload.encode(), to, date), level)
                made.append((part, key, before, member))
                before += len(member) + len(EMPTY_MEMBER)
            columns = list(zip(*made)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "key", "before", "member"])

    return run, "part int, key bigint, before bigint, member binary"


def write_warc(
    pages: DataFrame, path: str, *, id: str = "page_id", uri: str = "url", payload: str = "html", least_revisit: int = 0,
    roll_bytes: int = ROLL_BYTES, date: str = "1970-01-01T00:00:00Z", level: int = 6,
) -> DataFrame:
    """Write a record per row to ``path`` as ``part-00000.warc.gz``, ... and a manifest; returns the manifest's rows
    (file, records, bytes, first_key, last_key).

    1. Of equal payloads of at least ``least_revisit`` bytes the one with the largest key is the response, the others
       revisit it.
    2. Rows are range-partitioned and sorted by key, payload digest and URI, and each record is compressed by itself.
    3. The running compressed size in that order decides the file: a new one begins with the first record after every
       ``roll_bytes``. So files do not depend on how many tasks or machines there were, and a file is no larger than
       ``roll_bytes`` and one record.
    4. Spark writes the files under a temporary name in ``path`` (its commit protocol keeps the output of lost or
       repeated tasks out); they are then renamed, and the manifest, renamed last, commits them. A reader takes what the
       manifest lists. Writing the same pages again gives the same bytes; an old manifest is taken away first.

    A null payload is empty; a null URI has no header; a row with a null key revisits the page with the largest key that has
    its payload, and is a response if there is none. Rows repeated whole give repeated records, all of them responses if
    theirs is the largest key. No rows, no files and an empty manifest. Rows that share a key and a payload stay together,
    unless they are more than one in a thousand: these spread over any number of ranges.
    """
    spark = pages.sparkSession
    rows = packed(pages).select(
        column(id, "row").cast("long").alias("key"), column(uri, "row").alias("uri"),
        F.coalesce(column(payload, "row"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # What a page refers to travels as a row of its own to the page's place in the order, so payloads move only once.
    light = materialise(rows.where(F.octet_length("payload") >= least_revisit).select("key", "digest"), "digests")
    often = max(1000, light.count() // 1000)
    references = _references(light, often)
    in_crowd = F.col("key").eqNullSafe(F.col("crowd_key")) & (F.col("digest") == F.col("crowd_digest"))
    rows = rows.join(F.broadcast(_crowds(light, references, often)), in_crowd, "left")
    crowded = F.col("crowd_digest").isNotNull()
    rows = rows.select(
        "key", "digest", "uri", "payload", "refers_to", F.when(crowded, F.coalesce("uri", F.lit(""))).alias("spread"),
        F.when(crowded, F.xxhash64(F.monotonically_increasing_id())).alias("more"))
    both = rows.unionByName(references, allowMissingColumns=True)
    both = both.repartitionByRange("key", "digest", "spread", "more").sortWithinPartitions(
        "key", "digest", F.col("payload").isNotNull(), "uri")
    members = materialise(
        both.withColumn("part", F.spark_partition_id()).mapInArrow(*_members(date, level)), "members")

    size = (F.length("member") + len(EMPTY_MEMBER)).cast("long")
    parts = members.groupBy("part").agg(F.sum(size).alias("bytes"))
    offset = F.sum("bytes").over(Window.orderBy("part")) - F.col("bytes")  # one row per partition
    offsets = materialise(parts.select("part", offset.alias("offset")), "offsets")
    start = F.col("offset") + F.col("before")
    placed = members.join(F.broadcast(offsets), "part").select(
        F.floor(start / roll_bytes).cast("int").alias("file"), start.alias("start"), "key", "member", size.alias("size"))
    listing = placed.groupBy("file").agg(
        F.count("*").alias("records"), F.sum("size").alias("bytes"), F.min("key").alias("first_key"),
        F.max("key").alias("last_key"))
    listing = materialise(listing, "listing")

    fs = _Files(spark, path)
    fs.delete(f"{path}/{MANIFEST}")
    temporary = f"{path}/_temporary-warc"
    fs.delete(temporary)
    # A member's bytes are a line, the empty member the line separator.
    lines = placed.repartition("file").sortWithinPartitions("file", "start")
    lines = lines.select("file", F.col("member").cast("string").alias("value")).write.partitionBy("file")
    lines.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("ISO-8859-1")).text(temporary)
    for folder in fs.list(temporary):
        if folder.startswith("file="):
            (written,) = (f for f in fs.list(f"{temporary}/{folder}") if f.startswith("part-"))
            fs.rename(f"{temporary}/{folder}/{written}", f"{path}/{file_name(int(folder[5:]))}")
    fs.delete(temporary)
    entries = listing.select(_file_column(F.col("file")).alias("file"), "records", "bytes", "first_key", "last_key")
    fs.write(f"{path}/{MANIFEST}", "".join(
        json.dumps(r.asDict()) + "\n" for r in entries.orderBy("file").toLocalIterator()))
    return entries


def file_name(number: int) -> str:
    return f"part-{number:05d}.warc.gz"


def _file_column(number: Column) -> Column:
    return F.format_string("part-%05d.warc.gz", number)


class _Files:
    """The few file operations of a commit, on whatever file system the path is of."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)
        self.fs.mkdirs(self.path(path))

    def path(self, name: str):
        return self.hadoop.Path(name)

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, old: str, new: str) -> None:
        self.delete(new)
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def write(self, name: str, text: str) -> None:
        """Under a temporary name first, then renamed."""
        out = self.fs.create(self.path(f"{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.rename(f"{name}.tmp", name)


def _records(content: memoryview, piece: int = 1 << 16) -> Iterator[bytes]:
    """What each gzip member holds, without the empty ones. The content is fed in pieces, as a member's reader hands back
    what it was given beyond the member's end."""
    at = 0
    while at < len(content):
        reader, held = zlib.decompressobj(GZIP), []
        while not reader.eof:
            if at >= len(content):
                raise ValueError("a WARC file ends within a record")
            fed = content[at : at + piece]
            held.append(reader.decompress(fed))
            at += len(fed) - len(reader.unused_data)
        if any(held):
            yield b"".join(held)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file", pa.string()), ("key", pa.int64()), ("uri", pa.string()), ("payload", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64())])
    key_of = lambda urn: None if urn in (None, "<urn:page:null>") else int(urn[len("<urn:page:") : -1])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, held = [], 0
            for data in _records(memoryview(content.as_buffer())):
                headers, block = parse_record(data)
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = headers["WARC-Type"] == "revisit"
                if not revisit and digest != payload_digest(block):
                    raise ValueError(f"WARC record {headers['WARC-Record-ID']} does not match its payload digest")
                rows.append({
                    "file": path.rsplit("/", 1)[-1], "key": key_of(headers["WARC-Record-ID"]),
                    "uri": headers.get("WARC-Target-URI"), "payload": None if revisit else block.decode(),
                    "payload_bytes": int(headers["X-Payload-Length"]), "payload_digest": digest,
                    "record_type": headers["WARC-Type"], "refers_to": key_of(headers.get("WARC-Refers-To"))})
                held += len(data)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files that the manifest at ``path`` lists: file, key, uri, payload (null for a revisit, which
    has none), payload_bytes, payload_digest, record_type, refers_to. Lengths and digests are verified; a file is read
    by one task, a record at a time."""
    fields = "file string, records bigint, bytes bigint, first_key bigint, last_key bigint"
    listed = spark.read.schema(fields).json(f"{path}/{MANIFEST}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")
    # The manifest has a row per file of ``roll_bytes``: names only, some 100 bytes for each 32 MB.
    files = files.join(F.broadcast(listed.select("file")), F.element_at(F.split("path", "/"), -1) == F.col("file"), "left_semi")
    return files.mapInArrow(
        _parsed,
        "file string, key bigint, uri string, payload string, payload_bytes bigint, payload_digest string, "
        "record_type string, refers_to bigint")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pages-warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}

ORACLES: dict[str, str] = {}
