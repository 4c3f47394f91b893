"""ARC files that this library did not write."""

import gzip
import hashlib

from docwarden.llm import op04_warc as op04

VERSION_1 = b"1 0 Example\nURL IP-address Archive-date Content-type Archive-length\n"
VERSION_2 = b"2 0 Example\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def archive(version, records):
    body = VERSION_1 if version == 1 else VERSION_2
    out = b"filedesc://foreign.arc 0.0.0.0 20080430204825 text/plain "
    out += (b"" if version == 1 else b"200 - - 0 foreign.arc ") + b"%d\n" % len(body) + body
    for url, payload in records:
        middle = b"" if version == 1 else b"200 abc - 120 foreign.arc "
        out += b"\n" + url + b" 192.0.2.7 20080430204826 text/html " + middle + b"%d\n" % len(payload) + payload
    return gzip.compress(out)


def test_foreign_archives_keep_their_payloads(spark, tmp_path):
    records = [
        (b"http://example.org/", b"HTTP/1.1 200 OK\r\n\r\n<p>one</p>"), (b"http://example.org/#page=3", b"two\n\nlines"),
        (b"http://example.org/img", bytes(range(256)) * 5), (b"http://example.org/again", b"x" * 2000), (b"http://example.org/copy", b"x" * 2000),
        (b"http://example.org/empty", b""),
    ]
    (tmp_path / "arc").mkdir()
    for version in (1, 2):
        (tmp_path / "arc" / f"v{version}.arc.gz").write_bytes(archive(version, records))
    op04.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = sorted((r.url, r.payload_bytes, r.payload_digest, r.record_type, r.page_id) for r in op04.read_warc_pages(spark, str(tmp_path / "warc")).collect())
    assert got == sorted((u.decode(), len(p), hashlib.sha1(p).hexdigest(), "response", None) for u, p in records * 2)
