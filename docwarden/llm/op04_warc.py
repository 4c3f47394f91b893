"""Legacy ARC archives to WARC, and reading WARC back.

An ARC file begins with a version block (``filedesc://``) that names the fields of the URL records'
header lines: version 1 has five, version 2 ten. A record is one header line, as many payload bytes
as the line declares, and a newline. The converter reads header lines by the file's version and
payloads by their declared length only, then makes up what WARC asks for: a record id (a UUID of the
content, so a second run gives the same), an ISO date from the 14 digits, a type and a digest.

Writing is Spark's text writer, one archive per row, so any store that Spark can write will do; a
task closes an archive when it reaches ``ARCHIVE_BYTES``. Reading is the binaryFile source.
Payloads never enter a shuffle: which page repeats which is worked out on digests beforehand.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwarden.llm.common import blocks, durable, query, shared_path, text_bytes

ARCHIVE_BYTES = 8 << 20
REVISIT_BYTES = 1000
#: Smaller payloads are always stored in full.

# Field lists of the two ARC versions, and WARC's names.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"

EPOCH = 20_000_101_000_000
IP = "0.0.0.0"


def sha1(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


# ---------------------------------------------------------------- ARC


def arc_filedesc(name: str, version: int) -> bytes:
    fields = " ".join(ARC_FIELDS[version])
    body = f"{version} 0 docwarden\n{fields}\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": IP, "Archive-date": str(EPOCH), "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(line[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(url: str, date: str, kind: str, payload: bytes, version: int, name: str, offset: int) -> bytes:
    """White space in a URL is escaped, as the header line is split at blanks."""
    line = {"URL": re.sub(r"\s", lambda m: "%{:02X}".format(ord(m[0])), url) or "about:blank", "IP-address": IP, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": sha1(payload), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(payload))}
    return " ".join(line[f] for f in ARC_FIELDS[version]).encode() + b"\n" + payload


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each URL record."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        stop = data.index(b"\n", at)
        values = data[at:stop].decode("utf-8", "surrogateescape").split(" ")
        if fields is None:
            if not values[0].startswith("filedesc://"):
                raise ValueError("an ARC file must begin with its version block")
            length = int(values[-1])
            body = data[stop + 1 : stop + 1 + length].decode().split("\n")
            fields = ARC_FIELDS[int(body[0].split(" ")[0])]
            if tuple(body[1].split(" ")) != fields:
                raise ValueError("the version block names other fields than its version has")
        else:
            if len(values) != len(fields):
                raise ValueError(f"header line with {len(values)} fields, version has {len(fields)}")
            header = dict(zip(fields, values, strict=True))
            length = int(header["Archive-length"])
            payload = data[stop + 1 : stop + 1 + length]
            if len(payload) != length:
                raise ValueError("the archive ends within a record")
            yield header, payload
        at = stop + 1 + length


# ---------------------------------------------------------------- WARC


def warc_date(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"


def warc_record(header: dict[str, str], payload: bytes, page: str, refers_to: str | None) -> bytes:
    digest = sha1(payload)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": warc_date(header["Archive-date"]),
        "WARC-Target-URI": header["URL"],
        "WARC-IP-Address": header["IP-address"],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Page": page,
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "WARC-Refers-To-Page": refers_to, "WARC-Payload-Length": str(len(payload))}
        payload = b""
    fields |= {"Content-Type": header["Content-type"], "Content-Length": str(len(payload))}
    lines = [WARC_VERSION, *(f"{k}: {v}".encode("utf-8", "surrogateescape") for k, v in fields.items())]
    return CRLF.join(lines) + 2 * CRLF + payload


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == CRLF:
            at += 2
            continue
        stop = data.index(2 * CRLF, at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        header = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(header["content-length"])
        block = data[stop + 4 : stop + 4 + length]
        if len(block) != length:
            raise ValueError("the archive ends within a record")
        yield header, block
        at = stop + 4 + length


# ---------------------------------------------------------------- Spark


OWN_MARK = re.compile(r"#page=(-|-?[0-9]+)&same=(-|-?[0-9]+)\Z")


def _archives(parts: Iterator[bytes], separator: bytes, limit: int, begin=lambda n: b"") -> Iterator[bytes]:
    """Join records to archives of at most ``limit`` bytes, or of one record."""
    held, size, n = [], 0, 0
    for record in parts:
        if held and size + len(record) > limit:
            yield begin(n) + separator.join(held)
            held, size, n = [], 0, n + 1
        held.append(record)
        size += len(record)
    if held:
        yield begin(n) + separator.join(held)


def _write(archives: DataFrame, path: str, separator: str) -> None:
    """Payloads may be any bytes; the text writer writes a string's bytes as they are."""
    (
        archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", separator)
        .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    )


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def write_arc(pages: DataFrame, path: str, version: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Pages (page_id, url, html, refers_to) as ARC files; the page and what it repeats are in a
    fragment of the URL, for a legacy header line has no other place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            offset = 0
            for block in blocks(batches, "html"):
                payloads = text_bytes(block.column(2))
                for page, url, target, payload in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), block.column(3).to_pylist(), payloads, strict=True):
                    marked = f"{url or ''}#page={'-' if page is None else page}&same={'-' if target is None else target}"
                    date = str(EPOCH + (page or 0) % 1_000_000 % 60)
                    record = arc_record(marked, date, "text/html", payload, version, "pages.arc", offset)
                    offset += len(record)
                    yield record

        for archive in _archives(records(), b"\n", archive_bytes, lambda n: arc_filedesc("pages.arc", version) + b"\n"):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["value"])

    _write(pages.select("page_id", "url", "html", "refers_to").mapInArrow(work, "value binary"), path, "\n")


def arc_to_warc(spark: SparkSession, arc_path: str, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Convert every ARC file below ``arc_path``, whatever its version, to WARC files. A record of an archive
    that :func:`write_arc` did not write is a response with its whole payload and has no page id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    for header, payload in read_arc(gzip.decompress(batch.column(0)[i].as_py())):
                        own = OWN_MARK.search(header["URL"])
                        if own is None:  # an archive that write_arc did not write: every record keeps its payload
                            yield warc_record(header, payload, "-", None)
                            continue
                        page, target = own.groups()
                        yield warc_record(header | {"URL": header["URL"][: own.start()]}, payload, page, None if target == "-" else target)

        for archive in _archives(records(), 2 * CRLF, archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["value"])

    _write(_read(spark, arc_path).mapInArrow(work, "value binary"), path, "\r\n\r\n")


def read_warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to. The
    digest of a stored payload is computed from its bytes and must equal the header's."""
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for header, block in read_warc(gzip.decompress(batch.column(0)[i].as_py())):
                    digest = header["warc-payload-digest"].removeprefix("sha1:")
                    kind = header["warc-type"]
                    if kind == "response" and sha1(block) != digest:
                        raise ValueError(f"digest of {header['warc-record-id']} differs")
                    page = header["warc-page"]
                    rows.append((
                        None if page == "-" else int(page), header["warc-target-uri"],
                        len(block) if kind == "response" else int(header["warc-payload-length"]), digest, kind,
                        int(header["warc-refers-to-page"]) if kind == "revisit" else None,
                    ))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return _read(spark, path).mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def mark_revisits(pages: DataFrame) -> DataFrame:
    """Pages with ``refers_to``: the largest page id among equal payloads of at least REVISIT_BYTES,
    null for that page itself. Only digests are grouped, counted per group before the shuffle; the
    table of repeats is written, and so joined by its true size."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    light = pages.select("page_id", "html").select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    light = durable(light.filter((F.col("n") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).drop("n"), "op4-digests")
    groups = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("refers_to > least")
    repeats = light.join(groups, "digest").filter("page_id < refers_to").distinct()
    repeats = durable(repeats.select("page_id", "digest", "refers_to"), "op4-repeats")
    return pages.withColumn("digest", F.sha1(payload)).join(repeats, ["page_id", "digest"], "left")


def convert_pages(pages: DataFrame, version: int = 1) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are ignored) as ARC, convert to WARC, read
    that back: one row per page.

    A null html is an empty payload, a null url an empty one. A page without id is never a target of
    a revisit and always a response. Rows that repeat a page id and a payload are stored each. An
    empty table gives no rows."""
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "op4-arc"), shared_path(spark, "op4-warc")
    chosen = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    write_arc(mark_revisits(chosen), arc, version)
    arc_to_warc(spark, arc, warc)
    return read_warc_pages(spark, warc)


@query("op4_arc_to_warc", oracle=f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
            max(page_id) OVER (PARTITION BY html) AS target FROM p)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < target THEN target END AS refers_to
    FROM d
""")
def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")
