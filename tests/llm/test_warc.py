"""Archives: exact round trips, and damage that the reader must notice."""

import io
import struct

import pytest
import zstandard

from cohortspark.llm import warc


def test_round_trip(spark):
    html = "<html>é" + "x" * 300_000 + "</html>"
    rows = [(i, f"http://a/{i}", f"<p>page {i % 7}</p>", "k") for i in range(60)]
    rows += [(100, None, None, "k"), (101, "u", "", None), (102, "http://b\r\nX: y", html, "k"), (None, "n", html, "k"), (103, "d", "dup", "k"), (103, "d", "dup", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    got = warc.round_trip(pages).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (p or -1, len((h or "").encode()), warc.digest_text((h or "").encode())) for p, _, h, _ in rows
    )
    responses = {r.payload_digest: r for r in got if r.record_type == "response"}
    assert len(responses) == len({h or "" for _, _, h, _ in rows})
    texts = {bytes(r.payload).decode() for r in responses.values()}
    assert texts == {h or "" for _, _, h, _ in rows}
    for r in got:
        if r.record_type == "revisit":
            assert r.refers_to == responses[r.payload_digest].page_id
        else:
            assert r.refers_to is None
    assert {r.page_id for r in responses.values()} >= {101, 102, 103}
    assert warc.round_trip(pages.limit(0)).collect() == []
    large = warc.round_trip(pages, min_bytes=20).collect()
    assert sum(r.record_type == "revisit" for r in large) == 1


def archive(*records, dictionary=b"d" * 100):
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary + b"".join(map(c.compress, records))


def test_reader():
    one = warc.record_bytes(1, "u", b"abc", warc.digest_text(b"abc"), "response", None)
    two = warc.record_bytes(2, "u", b"abc", warc.digest_text(b"abc"), "revisit", 1)
    data = archive(one, two)
    assert list(warc.read_archive(io.BytesIO(data))) == [one, two]
    assert warc.parse_record(two)["warc-refers-to"] == "<urn:page:1>"
    for bad in (data[8:], data[:-3], data[:50]):
        with pytest.raises((warc.ArchiveError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))
    for bad in (one[:-1], one.replace(b"abc", b"abd"), b"X" + one, one.replace(b"WARC-Date", b"Other"), one + one):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)
