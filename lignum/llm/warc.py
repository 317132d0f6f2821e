"""WARC archives compressed record by record with a shared Zstandard dictionary.

The dictionary is built from a bounded sample of the payloads, and every archive starts with it in a
skippable frame, so each archive can be read alone. Each record is a frame of its own. Payloads that
occur again are written as revisit records, which name the response and hold no payload.

Tasks write archives into the shared folder and return a manifest row for each. Spark commits a row
once, whatever attempts were made, and readers go by the manifest: files of attempts that failed are
never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm.common import map_batches, scratch, table, written

#: Fixed value: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
#: The dictionary's size, and the sample it is built from: so many records, of longer ones a piece of so many characters.
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_CHARS = 65_536, 400, 32_768
#: Shortest payload that is stored once only, and how large an archive gets before the next one starts.
LEAST_REVISIT, ARCHIVE_BYTES = 1000, 32 << 20
LEVEL = 3
#: The tables say nothing about when a page was fetched.
FETCHED = "2024-01-01T00:00:00Z"
READ = 1 << 16


def with_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds ``payload, payload_digest, payload_bytes, record_type, refers_to`` to ``page_id, url, html``.

    Of payloads that are equal and have ``least`` bytes or more, the one with the largest page_id is the
    response and others revisit it.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    again = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    again = again.filter("n > 1 AND first IS NOT NULL").select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "first")
    # Short payloads never revisit: they stay out of the join, where empty ones would all share one key.
    long = rows.filter(F.col("payload_bytes") >= least).join(again, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    rows = long.unionByName(rows.filter(F.col("payload_bytes") < least), allowMissingColumns=True)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def build_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the records that come first by a hash of the id; empty only if all records are.

    Of a record longer than ``SAMPLE_CHARS`` a piece is taken, from a place that the hash tells. Where there is too little to
    train on, the pieces themselves, the last of them first to go, are the dictionary.
    """
    usable = pages.filter(F.length("html") > 0).withColumn("h", F.xxhash64("page_id"))
    drawn = usable.select("h").orderBy("h").limit(SAMPLE_RECORDS).agg(F.max("h")).first()[0]
    if drawn is None:
        return b""
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("html") - SAMPLE_CHARS + 1)).cast("int") + 1
    rows = usable.filter(F.col("h") <= drawn).select("h", F.substr("html", start, F.lit(SAMPLE_CHARS)).alias("piece")).orderBy("h", "piece").limit(SAMPLE_RECORDS).collect()
    samples = [r.piece.encode() for r in rows]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small
        return b"".join(samples)[:DICTIONARY_BYTES]


def record(page_id, url, payload: str | None, digest: str, size: int, refers_to) -> bytes:
    """One WARC record; a revisit has no payload."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {i}')}>"
    body = b"" if payload is None else payload.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", FETCHED),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + len(body))),
        ("Page-ID", "" if page_id is None else str(page_id)),
        ("Payload-Length", str(size)),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if payload is None:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields by name, and its payload under ``payload``."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    found = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = block[: int(found["Content-Length"])]
    return found | {"payload": block.partition(b"\r\n\r\n")[2]}


def frames(stream, chunk: int = READ) -> Iterator[bytes]:
    """The records of an archive, read chunk by chunk."""
    data = stream.read(8)
    words = None
    if data[:4] == DICTIONARY_MAGIC:
        words = zstandard.ZstdCompressionDict(stream.read(int.from_bytes(data[4:8], "little")))
        data = b""
    unpack = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    one, parts = None, []
    while True:
        data = data or stream.read(chunk)
        if not data:
            if one is not None:
                raise ValueError("the archive ends within a record")
            return
        if one is None:
            one, parts = unpack.decompressobj(), []
        parts.append(one.decompress(data))
        data = one.unused_data if one.eof else b""
        if one.eof:
            yield b"".join(parts)
            one = None


def write(typed: DataFrame, path: str, dictionary: bytes) -> DataFrame:
    """Writes the rows of :func:`with_types` as archives under ``path``; the manifest has ``file, records, bytes``."""
    shared = typed.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=words) if words else zstandard.ZstdCompressor(level=LEVEL)
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        out, name, records, size = None, "", 0, 0
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")], strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out, records, size = store.open_output_stream(f"{folder}/{name}"), 0, 0
                    if shared.value:
                        out.write(DICTIONARY_MAGIC + len(shared.value).to_bytes(4, "little") + shared.value)
                frame = pack.compress(record(*row))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield {"file": [name], "records": [records], "bytes": [size]}
        if out is not None:
            out.close()
            yield {"file": [name], "records": [records], "bytes": [size]}

    columns = ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")
    return written(map_batches(typed.select(*columns), run, "file string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, path: str) -> DataFrame:
    """All records of the archives in the manifest: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    Length and digest of a response come from its payload, and a digest that differs from the record's
    own raises; a revisit has no payload, and both come from its fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, folder = fs.FileSystem.from_uri(path)
        names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
        number = lambda text: int(text) if text else None
        for batch in batches:
            for file in batch["file"].to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{folder}/{file}") as stream:
                    for data in frames(stream):
                        r = parse(data)
                        digest = base64.b32decode(r["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size, payload = int(r["Payload-Length"]), None
                        if r["WARC-Type"] == "response":
                            payload = r["payload"]
                            if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                                raise ValueError(f"{file}: a payload differs from its digest")
                        rows.append((number(r["Page-ID"]), r.get("WARC-Target-URI"), None if payload is None else payload.decode(), size, digest, r["WARC-Type"], number(r.get("Refers-To-Page-ID"))))
                        held += len(data)
                        if held > 8 << 20:
                            yield dict(zip(names, zip(*rows, strict=True), strict=True))
                            rows, held = [], 0
                if rows:
                    yield dict(zip(names, zip(*rows, strict=True), strict=True))

    ddl = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # An archive is a task: the manifest is too small for Spark to see how much it stands for.
    return map_batches(manifest.select("file").repartition(max(1, manifest.count()), "file"), run, ddl)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all pages as archives and reads them back.

    ``pages`` has ``page_id, url, html``; other columns are ignored. Null html is an empty payload. Rows
    that repeat the largest page_id of a payload are all responses. A null page_id never is the largest;
    payloads whose ids are all null are all responses. An empty table writes no archive and gives no
    rows. A very long page is one record, held whole by one task.
    """
    path = path or scratch(pages.sparkSession, "warc")
    return read(write(with_types(pages), path, build_dictionary(pages)), path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with production parameters."""
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}
ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN latest END AS refers_to
FROM q"""
}
