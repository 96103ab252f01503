"""WARC archives in Zstandard with a dictionary: writer, and a reader that decodes one frame per record.

An archive starts with a skippable frame that holds the dictionary; each record is one frame compressed with it. The
reader loads the dictionary, decodes frame after frame as it reads, and validates each record: version line, named
fields, that the content length fills the frame exactly, and that the payload's digest is the one stated.

Records of equal payloads: that of the largest page_id is a response, the others are revisits that name it and carry
the HTTP head only; payloads below ``min_bytes`` are always responses.

Cases. A null payload is empty; a null url becomes an empty field. Repeated rows (equal page_id and payload) are
records of their own: one of them, chosen by place, is the response. A null page_id counts as the smallest, and its
record is named by an empty id. An empty table gives no archive and an empty result. Extra columns are not written.

Scale. Each task streams its rows to one archive in the shared folder under a name of its own attempt; only names of
finished tasks enter the written list of archives, so that lost or repeated tasks leave nothing that is read. Only
the digests of repeated payloads are joined, never payloads.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.shared import bounded_batches, fresh, shared_folder, staged

#: Magic number of the skippable frame that holds a dictionary.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
LEVEL = 3
DICTIONARY_BYTES = 65_536
#: The dictionary is trained on at most so many payloads, of so many leading characters each (a model's sample).
SAMPLE_ROWS, SAMPLE_CHARS = 400, 4_000
#: Up to so many repeated payloads, their table is sent to every task; else it is joined by a shuffle.
BROADCAST_ROWS = 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20


class ArchiveError(ValueError):
    """An archive that is not as it should be."""


def open_file(path: str, mode: str):
    """A stream on a file of any store that pyarrow knows by its address."""
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    if mode == "w":
        store.create_dir(where.rsplit("/", 1)[0])
        return store.open_output_stream(where, compression=None)
    return store.open_input_stream(where, compression=None)


def digest_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise ArchiveError(f"record id {name}")
    return int(name[10:-1]) if name[10:-1] else None


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    clean = "".join(c for c in url or "" if c >= " ")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if kind == "revisit":
        fields += [("WARC-Refers-To", record_name(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Named fields (lower-case names), ``http`` fields and ``payload`` of one record; raises if it is damaged."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("no WARC version line or no end of the head")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise ArchiveError(f"field {line!r}")
        fields[key.strip().lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in fields:
            raise ArchiveError(f"no {key}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"content length {length} does not fill the frame")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    if not found:
        raise ArchiveError("no end of the HTTP head")
    http_lines = [x.partition(":") for x in http.decode("utf-8").split("\r\n")[1:]]
    fields["http"] = {k.strip().lower(): v.strip() for k, _, v in http_lines}
    fields["payload"] = payload
    if fields["warc-type"] == "response":
        if int(fields["http"].get("content-length", -1)) != len(payload):
            raise ArchiveError("HTTP content length")
        if fields.get("warc-payload-digest") != f"sha1:{digest_text(payload)}":
            raise ArchiveError("payload digest")
    return fields


def read_archive(stream) -> Iterator[bytes]:
    """Records of an archive, one frame each, as the stream is read."""
    head = stream.read(8)
    if len(head) < 8:
        raise ArchiveError("no dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ArchiveError("no dictionary frame in front")
    raw = stream.read(size)
    if len(raw) != size:
        raise ArchiveError("dictionary cut short")
    if raw[:4] == struct.pack("<I", FRAME):  # a dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    left = b""
    while True:
        left = left or stream.read(_CHUNK)
        if not left:
            return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else stream.read(_CHUNK)
            if not frame.eof and not left:
                raise ArchiveError("frame cut short")
        yield b"".join(parts)


def train_dictionary(pages: DataFrame, payload: str = "html") -> bytes:
    """A dictionary from a bounded sample of payloads, those that hash lowest; empty where they are too few.

    Hashes are chosen first; only the chosen payloads' first ``SAMPLE_CHARS`` characters reach the driver.
    """
    hashed = pages.where(F.col(payload) != "").select(F.xxhash64(payload).alias("h"), F.col(payload).alias("p"))
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).collect()]
    if not chosen:
        return b""
    least = pages.sparkSession.createDataFrame([(h,) for h in chosen], "h long")
    sample = hashed.join(F.broadcast(least), "h").select("h", F.substring("p", 1, SAMPLE_CHARS).alias("p"))
    rows = sample.groupBy("h").agg(F.min("p").alias("p")).orderBy("h").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["p"].encode("utf-8", "replace") for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_roles(pages: DataFrame, min_bytes: int = 0, payload: str = "html") -> DataFrame:
    """``pages`` with kind (response or revisit) and refers_to."""
    place, digest, first = (fresh(pages, f"record_{c}") for c in ("place", "digest", "first"))
    body = F.coalesce(F.col(payload), F.lit(""))
    marked = pages.withColumn(digest, F.sha1(body.cast("binary")))
    long_enough = F.octet_length(body) >= min_bytes
    ids = marked.where(long_enough).groupBy(F.col(digest).alias("digest"), "page_id").agg(F.count("*").alias("rows"))
    groups = ids.groupBy("digest").agg(F.max(F.struct("page_id", "rows")).alias("top"), F.sum("rows").alias("n")).where("n > 1")
    groups = staged(groups.select("digest", F.col("top.page_id").alias("id"), F.col("top.rows").alias("rows")))
    # Rows that share the largest page_id and the payload are told apart by their place in a written table.
    tied = groups.where("rows > 1")
    if tied.limit(1).count():
        marked = staged(marked.withColumn(place, F.monotonically_increasing_id()))
        same = (F.col(digest) == F.col("digest")) & F.col("page_id").eqNullSafe(F.col("id"))
        places = marked.where(long_enough).select(digest, "page_id", place).join(tied.hint("merge"), same)
        places = staged(places.groupBy("digest").agg(F.min(place).alias("least")))
        groups = staged(groups.join(places.hint("merge"), "digest", "left"))
    else:
        marked, groups = marked.withColumn(place, F.lit(0)), groups.withColumn("least", F.lit(None).cast("long"))
    groups = groups.select(F.col("digest").alias(digest), F.struct("id", "least").alias(first))
    groups = F.broadcast(groups) if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else groups.hint("merge")
    joined = marked.join(groups, digest, "left")
    itself = F.col("page_id").eqNullSafe(F.col(f"{first}.id")) & (F.coalesce(f"{first}.least", place) == F.col(place))
    other = F.col(first).isNotNull() & long_enough & ~itself
    return joined.select(
        *[F.col(f"`{c}`") for c in pages.columns],
        F.when(other, "revisit").otherwise("response").alias("kind"),
        F.when(other, F.col(f"{first}.id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives below ``folder``; a written table of their paths and counts."""
    rows = with_roles(pages.select("page_id", "url", "html"), min_bytes)
    dictionary = train_dictionary(pages)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.zst"
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out, n = None, 0
        for batch in batches:
            for page_id, url, html, kind, refers_to in batch.itertuples(index=False, name=None):
                if out is None:
                    out = open_file(path, "w")
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                payload = html.encode("utf-8", "replace") if isinstance(html, str) else b""
                # ids travel as text: pandas would turn a column with nulls into doubles
                ids = [None if x is None else int(x) for x in (page_id, refers_to)]
                url = url if isinstance(url, str) else ""
                out.write(compressor.compress(record_bytes(ids[0], url, payload, digest_text(payload), kind, ids[1])))
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "n_records": [n]})

    texts = rows.select(
        F.col("page_id").cast("string"), F.col("url").cast("string"), "html", "kind", F.col("refers_to").cast("string")
    )
    return staged(texts.mapInPandas(write, "path string, n_records long"))


def read_archives(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Records of the archives in the column ``path``: page_id, url, record_type, digest, bytes and payload (binary)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for path in batch["path"]:
                with open_file(path, "r") as stream:
                    for data in read_archive(stream):
                        f = parse_record(data)
                        refers = f.get("warc-refers-to")
                        rows.append(
                            (
                                _text(page_of(f["warc-record-id"])),
                                f.get("warc-target-uri"),
                                f["warc-type"],
                                f.get("warc-payload-digest", "").removeprefix("sha1:"),
                                int(f["http"]["content-length"]),
                                None if refers is None else _text(page_of(refers)),
                                f["payload"] if f["warc-type"] == "response" else None,
                            )
                        )
                        size += len(data)
                        if size > 8 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    schema = "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"
    spread = paths.select("path").repartition(max(1, min(paths.count(), 10_000)), "path")
    out = spread.mapInPandas(read, schema)
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def _text(value: int | None) -> str | None:
    return None if value is None else str(value)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    bounded_batches(spark)
    return read_archives(spark, write_archives(pages, shared_folder(spark), min_bytes))
