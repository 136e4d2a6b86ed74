"""WARC archives whose records are compressed one by one with a Zstandard dictionary that leads the file."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import scratch, small_batches, stored, table

#: Fixed values of the format: the skippable frame that holds a dictionary, and a Zstandard frame's first bytes.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: A dictionary is trained on the first records of its archive (which come in the order of their digests, so at random), as many bytes as SAMPLE_BYTES and RECORD_BYTES of each at most.
SAMPLE_BYTES, RECORD_BYTES, DICTIONARY_BYTES = 2 << 20, 16 << 10, 64 << 10
#: An archive is closed once its records have so many bytes before compression.
ARCHIVE_BYTES = 64 << 20
#: Tasks that read archives at most.
READ_TASKS = 100_000

WRITTEN = "archive string, records long, bytes long, with_dictionary boolean"
READ = "record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or None where the samples are too few or too short for one."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 8192:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes] | Iterator[bytes], samples: list[bytes]) -> tuple[bytes, bool]:
    """A whole archive: the dictionary's frame if there is one, then a frame for each record."""
    learned = train(samples)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=learned, write_content_size=True) if learned else zstandard.ZstdCompressor(level=3)
    out = []
    if learned:
        packed = zstandard.ZstdCompressor(level=10).compress(learned.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    out += [compressor.compress(r) for r in records]
    return b"".join(out), learned is not None


def records_of(data: memoryview) -> Iterator[bytes]:
    """The records of an archive, one after another; with or without a leading dictionary."""
    at, learned = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        (n,) = struct.unpack_from("<I", data, 4)
        held = bytes(data[8 : 8 + n])
        learned = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held, max_output_size=1 << 27) if held[:4] == ZSTD_FRAME else held)
        at = 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=learned) if learned else zstandard.ZstdDecompressor()
    while at < len(data):
        one, out, step = reader.decompressobj(), [], 1 << 12
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            out.append(one.decompress(data[at : at + step]))
            at += min(step, len(data) - at)
            step = min(step * 4, 1 << 20)
        at -= len(one.unused_data)
        yield b"".join(out)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header alone, whose Content-Length is the full payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; raises where lengths or the digest of a response don't fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    if fields["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload that its digest names")
    return {"record_type": fields["WARC-Type"], "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "refers_to": number("WARC-Refers-To"), "payload": payload}


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest (hexadecimal SHA-1 of the payload), refers_to (null: a response).

    Of pages with equal payloads of at least least_bytes, that with the largest page_id is the response, and so is any exact repeat of it;
    null page_ids come last, and a group without any id is all responses. The groups are joined back by digest: Spark splits the
    partition of a payload that very many pages share."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(payload.cast("binary")))
    last = rows.filter(F.octet_length(payload) >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    same = F.col("_last").isNull() | F.col("_last").eqNullSafe(F.col("page_id"))
    return rows.join(last, "digest", "left").select("page_id", "url", "html", "digest", F.when(~same, F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives below folder, a URI that the tasks can reach; returns their list (archive, records, bytes, with_dictionary).

    Each task fills its own archives under new names, so a task that is run again leaves at worst an archive that the list doesn't name.
    A null html is an empty payload, a null url an empty target, a null page_id an empty id; an empty table has no archives. Other
    columns are not written."""
    small_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        samples: list[bytes] = []
        size = sampled = 0

        def close() -> pa.RecordBatch:
            nonlocal held, samples, size, sampled
            data, learned = archive(held, samples)
            files.publish(name := f"{folder}/{uuid.uuid4().hex}.warc.zst", data)
            out = pa.RecordBatch.from_pydict({"archive": [name], "records": [len(held)], "bytes": [len(data)], "with_dictionary": [learned]})
            held, samples, size, sampled = [], [], 0, 0
            return out

        for batch in batches:
            for page, url, html, digest, refers in zip(*[batch.column(i) for i in range(5)], strict=True):
                payload = (html.as_py() or "").encode()
                raw = record("response" if refers.as_py() is None else "revisit", page.as_py(), url.as_py(), payload, base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers.as_py())
                held.append(raw)
                size += len(raw)
                if sampled < SAMPLE_BYTES:
                    samples.append(raw[:RECORD_BYTES])
                    sampled += len(samples[-1])
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    return stored(marked(pages, least_bytes).mapInArrow(write, WRITTEN), "warc-list")


def read_archives(listed: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the listed archives; every response's digest is computed anew. with_payload: the bytes held, too (a revisit has none).

    Each archive is a task of its own, up to READ_TASKS: the list is small, so Spark would otherwise read all archives in one."""
    schema = READ + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in schema.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = files.at(name)
                with store.open_input_stream(path, compression=None) as source:
                    data = memoryview(source.read())
                rows, size = [], 0
                for raw in records_of(data):
                    rows.append({n: x for n, x in parse(raw).items() if n in names})
                    size += len(raw)
                    if len(rows) >= 2048 or with_payload and size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return listed.select("archive").repartition(max(1, min(listed.count(), READ_TASKS))).mapInArrow(read, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back: a row per page. Null, empty and very long html, null and repeated page_ids and an empty table are as write_archives has them."""
    listed = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(listed).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 is spelt out from the digest's hexadecimal digits: five of them make four letters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
b AS (SELECT page_id, payload_bytes, h,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY h) AS last_id FROM d)
SELECT b.page_id, b.payload_bytes, b.payload_digest,
  CASE WHEN b.page_id = b.last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN b.page_id <> b.last_id THEN b.last_id END AS refers_to
FROM b
"""
