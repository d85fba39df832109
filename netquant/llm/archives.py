"""Legacy web archives: ARC files written and read, and converted to WARC.

An ARC file begins with a version block that names its version and the fields of its header lines; each record is one header line, the declared number of bytes, and a
line end. The converter parses the header line by its version and takes the declared length, then synthesises the WARC record: identifier from the file's name and the record's
offset, timestamp, type, and digests of block and payload. Payloads that occur more than once are stored once; the others become revisit records.

Spark reads whole files as binary rows, so writers end a file once it holds ``archive_bytes`` of text; a record is never cut.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquant.lineage import checkpoint_dir, cut

#: Text after which a file ends, and bytes of records that a task holds before it passes them on.
ARCHIVE_BYTES, HELD_BYTES = 64_000_000, 8_000_000
#: Least payload that is stored once only.
REVISIT_BYTES = 1000
#: Parts that the rows of one payload are dealt to.
SPOTS = 32

# Field definitions and header lines of the ARC versions, and WARC names.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HEADER = {
    1: re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{4,17}) (?P<type>\S.*?) (?P<length>\d+)"),
    2: re.compile(
        rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{4,17}) (?P<type>\S.*?) (?P<code>\d+|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)"
    ),
}
WARC_VERSION = b"WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LINE, GAP = b"\r\n", b"\r\n\r\n"


class ArcRecord(NamedTuple):
    """One record of an ARC file with what its header line declares."""

    archive: str
    offset: int
    url: bytes
    ip: bytes
    date: bytes
    content_type: bytes
    block: bytes


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes


def opened(content: bytes) -> io.BufferedReader | io.BytesIO:
    """Bytes of an archive; files of one or many gzip members are unpacked as they are read."""
    if content[:2] == b"\x1f\x8b":
        return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)
    return io.BytesIO(content)


def _exactly(stream, n: int, where: str) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"{where}: {n} bytes declared, {len(data)} found")
    return data


def parse_arc(content: bytes, name: str = "") -> Iterator[ArcRecord]:
    """Records of one ARC file; the version block gives the form of the others. A line that has not its version's form is an error."""
    stream, at, version, archive = opened(content), 0, 1, name
    while True:
        line = stream.readline()
        if not line:
            return
        start, at = at, at + len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        # The version block's own line always has the first version's fields.
        about = line.startswith(b"filedesc://")
        found = HEADER[1 if about else version].fullmatch(line)
        if found is None:
            raise ValueError(f"{name}: no header line of version {version} at {start}: {line[:80]!r}")
        block = _exactly(stream, int(found["length"]), f"{name} at {start}")
        at += len(block)
        if about:
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"{name}: ARC version {version} is not known")
            archive = found["url"].removeprefix(b"filedesc://").decode("utf-8", "replace")
        yield ArcRecord(archive, start, found["url"], found["ip"], found["date"], found["type"], block)


def iso_date(date: bytes) -> str:
    """WARC timestamp of an ARC date of 4 to 17 digits; missing parts count as their first, a date that does not exist as the epoch."""
    text = date.decode("ascii")
    full = (text + "00000101000000"[len(text) :])[:14]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(archive: str, offset: int) -> str:
    """The same identifier for the same place of the same archive, however often it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{archive}#{offset}')}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and payload, of an HTTP response."""
    end = block.find(GAP)
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def warc_type(record: ArcRecord) -> str:
    """``warcinfo`` for a version block, ``response`` for an HTTP response, else ``resource``."""
    if record.url.startswith(b"filedesc://"):
        return "warcinfo"
    return "response" if record.block.startswith(b"HTTP/") else "resource"


def as_warc(record: ArcRecord, refers_to: tuple[str, str, str] | None = None) -> bytes:
    """The equivalent WARC record; ``refers_to``: identifier, URL and date of the response that holds the same payload."""
    kind, block = warc_type(record), record.block
    date, url = iso_date(record.date), record.url.decode("utf-8", "replace")
    headers = [("WARC-Type", "revisit" if refers_to else kind), ("WARC-Record-ID", record_id(record.archive, record.offset)), ("WARC-Date", date)]
    if kind == "warcinfo":
        block = b"software: arc converter\r\nformat: WARC File Format 1.0\r\nisPartOf: %s\r\n" % record.archive.encode("utf-8")
        headers.append(("WARC-Filename", record.archive))
        content_type = "application/warc-fields"
    else:
        headers += [("WARC-Target-URI", url), ("WARC-IP-Address", record.ip.decode("ascii", "replace"))]
        if kind == "response":
            head, payload = http_parts(block)
            headers.append(("WARC-Payload-Digest", digest(payload)))
            content_type = "application/http; msgtype=response"
            if refers_to:
                target, target_url, target_date = refers_to
                headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", target), ("WARC-Refers-To-Target-URI", target_url), ("WARC-Refers-To-Date", target_date)]
                block = head
        else:
            content_type = record.content_type.decode("utf-8", "replace")
    headers += [("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = [WARC_VERSION, *(f"{k}: {v}".encode() for k, v in headers)]
    return LINE.join(lines) + GAP + block


def parse_warc(content: bytes, name: str = "") -> Iterator[WarcRecord]:
    """Records of one WARC file, blocks by their declared length."""
    stream = opened(content)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record: {line[:80]!r}")
        headers = {}
        while (field := stream.readline().rstrip(b"\r\n")):
            key, _, value = field.decode("utf-8", "replace").partition(":")
            headers[key] = value.strip()
        yield WarcRecord(headers, _exactly(stream, int(headers["Content-Length"]), name))


class _Files:
    """Places records in files of bounded text: a new file begins with its own first record."""

    def __init__(self, first: Callable[[int, int], bytes], gap: int, limit: int) -> None:
        self.first, self.gap, self.limit = first, gap, limit
        self.part: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, bytes]] = []
        self.held = 0

    def begin(self, kind: int, size: int) -> tuple[int, int]:
        """File and offset of the next record of about ``size`` bytes."""
        if kind not in self.part or self.size[kind] + size > self.limit:
            self.part[kind] = self.part.get(kind, -1) + 1
            self.size[kind] = 0
            self.add(kind, self.first(kind, self.part[kind]))
        return self.part[kind], self.size[kind]

    def add(self, kind: int, value: bytes) -> None:
        self.rows.append((kind, self.part[kind], self.size[kind], value))
        self.size[kind] += len(value) + self.gap
        self.held += len(value)

    def taken(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """The records held, if they have so many bytes."""
        if self.held >= least:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows), kinds)]
            self.rows, self.held = [], 0
            yield pa.RecordBatch.from_arrays(columns, ["kind", "part", "at", "value"])


PLACED = "kind int, part int, at long, value binary"


def _write(placed: DataFrame, folder: str, gap: bytes) -> None:
    """One file of each task, kind and part, records in order, each followed by ``gap``."""
    lines = placed.sortWithinPartitions("kind", "part", "at").select("kind", "part", F.col("value").cast("string").alias("value"))
    writer = lines.write.partitionBy("kind", "part").option("lineSep", gap.decode("ascii")).option("compression", "gzip")
    writer.option("maxRecordsPerFile", 0).text(folder)


def _fields(version: int, url: bytes, date: bytes, offset: int, archive: bytes, size: int) -> bytes:
    if version == 1:
        return b"%s 0.0.0.0 %s text/html %d\n" % (url, date, size)
    return b"%s 0.0.0.0 %s text/html 200 - - %d %s %d\n" % (url, date, offset, archive, size)


def write_arc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20000101000000", archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """ARC files of both versions, dealt by hash: an HTTP response per row, the id in its header ``X-Page-Id``.

    A null payload is empty, a null URL ``about:blank``, a null id has no header; white space in URLs is escaped. Other columns are ignored; an empty table writes no file.
    """
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")).cast("binary").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
        (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(url_col).cast("string")), F.lit(2)) + 1).cast("int").alias("version"),
    )

    def archive(task: int, version: int, part: int) -> bytes:
        return b"pages-v%d-%06d-%04d.arc" % (version, task, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def version_block(version: int, part: int) -> bytes:
            body = b"%d 0 netquant\n%s\n" % (version, FIELDS[version])
            return b"filedesc://%s 0.0.0.0 %s text/plain %d\n%s" % (archive(task, version, part), date.encode(), len(body), body)

        files = _Files(version_block, 1, archive_bytes)
        for batch in batches:
            ids, versions = batch.column("id").to_pylist(), batch.column("version").to_pylist()
            for page, version, url, payload in zip(ids, versions, batch.column("url"), batch.column("payload")):
                body = payload.as_py()
                named = b"" if page is None else b"X-Page-Id: %s\r\n" % page.encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (named, len(body), body)
                target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.as_py()) or b"about:blank"
                part, offset = files.begin(version, len(target) + len(block))
                files.add(version, _fields(version, target, date.encode(), offset, archive(task, version, part), len(block)) + block)
                yield from files.taken(HELD_BYTES)
        yield from files.taken()

    _write(rows.mapInArrow(run, PLACED), folder, b"\n")


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of every archive below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content")


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 200
        if total >= HELD_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def arc_index(spark: SparkSession, folder: str, rank_header: str) -> DataFrame:
    """``(id, url, date, payload_digest, payload_bytes, rank)`` of the HTTP responses of all ARC files below a folder; ``rank``: a whole number in the HTTP header of that name."""
    names = ["id", "url", "date", "payload_digest", "payload_bytes", "rank"]
    wanted = re.compile(rb"\r\n" + re.escape(rank_header.encode()) + rb": *(-?\d+)\r\n", re.IGNORECASE)

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for r in parse_arc(content.as_py(), path):
                    if warc_type(r) == "response":
                        head, payload = http_parts(r.block)
                        rank = wanted.search(head)
                        yield (record_id(r.archive, r.offset), r.url.decode("utf-8", "replace"), iso_date(r.date), digest(payload), len(payload), None if rank is None else int(rank[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 4 + [pa.int64()] * 2
        yield from _batches(responses(batches), names, types, lambda row: len(row[1]))

    return _archives(spark, folder).mapInArrow(run, "id string, url string, date string, payload_digest string, payload_bytes long, rank long")


def spot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SPOTS)).cast("int")


def revisits(index: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``(id, target, target_url, target_date)``: records that repeat the payload of another one, that of the largest rank (ties: the largest id).

    The rows of one payload are dealt to ``SPOTS`` parts and combined within tasks first, so that one payload of very many records is no hot key.
    """
    rows = index.filter(F.col("payload_bytes") >= least).withColumn("spot", spot("id"))
    key = ["payload_digest", "payload_bytes"]
    top = F.max(F.struct(F.coalesce("rank", F.lit(-(1 << 63))).alias("rank"), "id", "url", "date")).alias("top")
    spots = rows.groupBy(*key, "spot").agg(top, F.count("*").alias("n"))
    spots = cut(spots, "payload-spots")
    one = spots.groupBy(*key).agg(F.max("top").alias("best"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    found = rows.join(spots.select(*key, "spot").join(one, key), [*key, "spot"])
    kept = found.filter(F.col("id") != F.col("best.id"))
    return kept.select("id", F.col("best.id").alias("target"), F.col("best.url").alias("target_url"), F.col("best.date").alias("target_date"))


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, rank_header: str = "X-Page-Id", least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """WARC files with the records of all ARC files below a folder.

    HTTP responses of equal payloads of at least ``least`` bytes (by SHA-1 and length): the one with the largest whole number in the header ``rank_header`` (missing: the least;
    ties: the largest identifier) is a response, the others are revisits of it. Version blocks become warcinfo records, others than HTTP responses resource records.
    """
    index = cut(arc_index(spark, arc_folder, rank_header), "arc-index")
    # Written, so that the join knows its size: Spark sends it to all tasks if it is small and shuffles the records otherwise.
    repeats = cut(revisits(index, least), "revisits")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    for r in parse_arc(content.as_py(), path):
                        yield (record_id(r.archive, r.offset), r.archive, r.offset, r.url, r.ip, r.date, r.content_type, r.block)

        types = [pa.string(), pa.string(), pa.int64()] + [pa.binary()] * 5
        yield from _batches(rows(), ["id", *ArcRecord._fields], types, lambda row: len(row[7]))

    schema = "id string, archive string, offset long, url binary, ip binary, date binary, content_type binary, block binary"
    parsed = _archives(spark, arc_folder).mapInArrow(records, schema).filter(~F.startswith(F.col("url").cast("string"), F.lit("filedesc://")))
    joined = parsed.join(repeats, "id", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def warcinfo(_: int, part: int) -> bytes:
            name = f"pages-{task:06d}-{part:04d}.warc"
            return as_warc(ArcRecord(name, 0, b"filedesc://" + name.encode(), b"0.0.0.0", datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S").encode(), b"text/plain", b""))

        files = _Files(warcinfo, len(GAP), archive_bytes)
        for batch in batches:
            other = [batch.column(c).to_pylist() for c in ("archive", "offset", "url", "ip", "date", "content_type", "target", "target_url", "target_date")]
            for *fields, target, target_url, target_date, block in zip(*other, batch.column("block")):
                value = as_warc(ArcRecord(*fields, block.as_py()), (target, target_url, target_date) if target else None)
                files.begin(0, len(value))
                files.add(0, value)
                yield from files.taken(HELD_BYTES)
        yield from files.taken()

    _write(joined.mapInArrow(write, PLACED), warc_folder, GAP)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, type, url, date, target, header, digest, bytes, declared)``: all records of the WARC files below a folder.

    ``digest`` and ``bytes``: SHA-1 in hex and length of the payload that the record holds (of a response without its HTTP header), null for revisits; ``declared``: the payload digest of the record's header in hex.
    A response whose payload has another digest than declared is an error.
    """
    names = ["id", "type", "url", "date", "target", "header", "digest", "bytes", "declared"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for headers, block in parse_warc(content.as_py(), path):
                    kind = headers["WARC-Type"]
                    http = kind in ("response", "revisit") and headers["Content-Type"].startswith("application/http")
                    head, payload = http_parts(block) if http else (b"", block)
                    own = None if kind == "revisit" else hashlib.sha1(payload).hexdigest()
                    declared = headers.get("WARC-Payload-Digest")
                    declared = None if declared is None else base64.b32decode(declared.removeprefix("sha1:")).hex()
                    if own and declared and own != declared:
                        raise ValueError(f"{path}: payload of {headers['WARC-Record-ID']} has not the digest declared")
                    yield (
                        headers["WARC-Record-ID"], kind, headers.get("WARC-Target-URI"), headers["WARC-Date"], headers.get("WARC-Refers-To"),
                        head, own, None if kind == "revisit" else len(payload), declared,
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.binary(), pa.string(), pa.int64(), pa.string()]
        yield from _batches(rows(batches), names, types, lambda row: len(row[5]))

    return _archives(spark, folder).mapInArrow(run, "id string, type string, url string, date string, target string, header binary, digest string, bytes long, declared string")


def resolved(records: DataFrame, id_header: str = "X-Page-Id") -> DataFrame:
    """``(id, page, type, digest, bytes, target_page)`` of responses and revisits; a revisit takes digest and bytes from the response it refers to."""
    page = F.regexp_extract(F.col("header").cast("string"), rf"(?i)\r\n{re.escape(id_header)}: *([^\r\n]+)\r\n", 1)
    rows = records.filter(F.col("type").isin("response", "revisit")).select(
        "id", "type", "target", F.when(page != "", page).alias("page"), "digest", "bytes", spot("id").alias("spot")
    )
    rows = cut(rows, "warc-index")
    again = rows.filter("type = 'revisit'")
    held = rows.filter("type = 'response'").select(F.col("id").alias("target"), F.col("page").alias("target_page"), F.col("digest").alias("d"), F.col("bytes").alias("b"))
    spots = again.groupBy("target", "spot").agg(F.lit(0).alias("one")).drop("one").join(held, "target")
    seen = again.drop("digest", "bytes").join(spots, ["target", "spot"], "left")
    columns = ["id", "page", "type", "digest", "bytes", "target_page"]
    first = rows.filter("type = 'response'").withColumn("target_page", F.lit(None).cast("string")).select(columns)
    return first.union(seen.withColumnsRenamed({"d": "digest", "b": "bytes"}).select(columns))


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``(id_col, payload_bytes, payload_digest, record_type, refers_to)``: pages written as ARC, converted to WARC and read back, one row per row of ``pages``.

    Ids are whole numbers. Repeated rows are records of their own; of equal payloads with equal largest ids one is the response. A null id stays null and ranks least.
    """
    spark = pages.sparkSession
    base = f"{checkpoint_dir(spark)}/netquant/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{base}/arc", id_col, url_col, payload_col, archive_bytes=archive_bytes)
    if not _any_file(spark, f"{base}/arc"):
        return spark.createDataFrame([], f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    convert(spark, f"{base}/arc", f"{base}/warc", archive_bytes=archive_bytes)
    found = resolved(read_warc(spark, f"{base}/warc"))
    return found.select(
        F.col("page").cast("long").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("target_page").cast("long").alias("refers_to"),
    )


def _any_file(spark: SparkSession, folder: str) -> bool:
    return not spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder).drop("content").isEmpty()
