"""WARC: archives of request, response, revisit and metadata records.

Records of one transaction name each other by WARC-Concurrent-To; reading
joins them through these identifiers into one nested row per capture.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, small_or_shuffled, stage, unstage

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
#: An archive is closed at this size, so that readers hold little at a time.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST_SCHEMA = "archive string, records long, bytes long"
RECORD_SCHEMA = """archive string, record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string,
 payload_digest string, payload_bytes long, fields map<string,string>, payload binary"""


def _record_id(kind: str, page_id: object, row: int) -> str:
    return f"<{uuid.UUID(hashlib.md5(f'{kind}:{page_id}:{row}'.encode()).hexdigest()).urn}>"


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One gzip member; white space that would break a header line becomes a blank."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(4, wbits=31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def _transaction(page_id: str | None, row: int, url: str | None, payload: bytes, sha1: str, target: tuple | None) -> list[bytes]:
    main = _record_id("main", page_id, row)
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = [("WARC-Type", "response")] if target is None else [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id("main", *target))]
    http = ("Content-Type", "application/http; msgtype=response")
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page_id", page_id),) if v is not None).encode()
    ask = f"GET {' '.join((url or '/').split())} HTTP/1.1\r\n\r\n".encode()
    return [
        _record([("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", page_id, row)), ("WARC-Concurrent-To", main), *shared, ("Content-Type", "application/http; msgtype=request")], ask),
        _record([*kind, ("WARC-Record-ID", main), ("WARC-Payload-Digest", digest), *shared, http], head + (payload if target is None else b"")),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", page_id, row)), ("WARC-Concurrent-To", main), *shared, ("Content-Type", "application/warc-fields")], fields),
    ]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write request, response or revisit, and metadata records of every row
    as ``*.warc.gz`` in ``folder``, each record a gzip member; returns the
    manifest ``archive, records, bytes`` of the files that count.

    The payload is the whole text in UTF-8, null is empty. Of payloads equal by
    length and SHA-1 with at least REVISIT_BYTES, the row with the largest id
    (null ids are smallest; of repeated ids one row) is the response and the
    others are revisits that refer to it. A null URL has no target header.
    Other columns, whatever their names, are not looked at. An empty table
    writes no archive. Rows are numbered and staged once, so that a task that
    runs again sees the same ones. Each attempt of a task writes files of its
    own names; the manifest, which Spark commits with the tasks, names those of
    the attempts that finished, and ``read_warc`` passes over all others.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"), F.monotonically_increasing_id().alias("row"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"),
    )
    rows, rows_path = stage(rows, "warc-rows")
    same = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("sha", "n").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("copies"))
    firsts, firsts_path = stage(same.where("copies > 1").select("sha", "n", F.col("first.page_id").alias("ref_id"), F.col("first.row").alias("ref_row")), "warc-firsts")
    marked = rows.join(small_or_shuffled(firsts), ["sha", "n"], "left").withColumn("revisit", F.col("ref_row").isNotNull() & (F.col("ref_row") != F.col("row")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        done, held, size, count = [], [], 0, 0

        def close() -> None:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for x in held:
                    out.write(x)
            done.append((name, count, size))
            held.clear()

        for batch in batches:
            for r in batch.itertuples(index=False):
                page_id, ref_id = (x if isinstance(x, str) else None for x in (r.page_id, r.ref_id))
                target = (ref_id, int(r.ref_row)) if r.revisit else None
                for x in _transaction(page_id, r.row, r.url if isinstance(r.url, str) else None, r.html.encode(), r.sha, target):
                    held.append(x)
                    size, count = size + len(x), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    size = count = 0
        if held:
            close()
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    named = marked.select(F.col("page_id").cast("string").alias("page_id"), "row", "url", "html", "sha", F.col("ref_id").cast("string").alias("ref_id"), "ref_row", "revisit")
    manifest, _ = stage(named.mapInPandas(write, MANIFEST_SCHEMA), "warc-manifest")
    unstage(spark, rows_path, firsts_path)
    return manifest


def _headers(stream: io.BufferedIOBase) -> list[tuple[str, str]]:
    found = []
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found.append((name.strip().lower(), value.strip()))
    return found


def _bare_digest(value: str | None) -> str | None:
    """Lower-case hex of ``sha1:BASE32``; other digests stay as they are, in lower case."""
    text = (value or "").rpartition(":")[2]
    if not text:
        return None
    try:
        return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()
    except binascii.Error:
        return text.lower()


def _size(value: str | None, otherwise: int) -> int:
    return int(value) if value is not None and value.isascii() and value.isdigit() else otherwise


def _parsed(headers: list[tuple[str, str]], block: bytes, payloads: bool) -> tuple:
    named = dict(headers)
    kind, fields, body, size, digest = named.get("warc-type"), None, None, None, _bare_digest(named.get("warc-payload-digest"))
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        inner = io.BytesIO(block)
        inner.readline()
        http = dict(_headers(inner))
        body = inner.read()
        size = _size(http.get("content-length"), len(body))
        if kind == "response":
            size, digest = len(body), hashlib.sha1(body).hexdigest()
    elif named.get("content-type") == "application/warc-fields":
        fields = dict(_headers(io.BytesIO(block)))
    return (
        named.get("warc-record-id"), kind, [v for k, v in headers if k == "warc-concurrent-to"], named.get("warc-refers-to"), named.get("warc-target-uri"),
        named.get("warc-date"), digest, size, fields, body if payloads and kind == "response" else None,
    )


def _records(content: bytes, payloads: bool) -> Iterator[tuple]:
    """The records of an archive. Lines between records that start none are
    skipped. Where it is damaged (bytes that do not unpack, a record without a
    length or cut short), a record of type ``damaged`` stands for what is left."""
    damaged = (None, "damaged", [], None, None, None, None, None, None, None)
    try:
        stream = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
        while version := stream.readline():
            if not version.startswith(b"WARC/"):
                continue
            headers = _headers(stream)
            size = _size(dict(headers).get("content-length"), -1)
            block = stream.read(size) if size >= 0 else b""
            if size < 0 or len(block) < size:
                yield damaged
                if size >= 0:
                    return
                continue
            yield _parsed(headers, block, payloads)
    except (EOFError, OSError, zlib.error):
        yield damaged


def read_warc(spark: SparkSession, path: str, payloads: bool = True, manifest: DataFrame | None = None) -> DataFrame:
    """The records of all ``*.warc`` and ``*.warc.gz`` under ``path``, compressed
    or not, in any store that Spark reads; with the ``manifest`` of
    ``write_warc``, of the archives that it names.

    ``payload_digest`` is bare lower-case hex; of a response, digest and bytes
    are taken from the payload itself; of a revisit, from its headers. Without
    ``payloads`` the bodies are left out. A folder without archives gives no
    rows. Damaged archives give the records before the damage and one of type
    ``damaged``. An archive is read whole by one task: 2 GB is Spark's limit.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "fields", "payload"]
        for batch in batches:
            for name, content in zip(batch["archive"], batch["content"], strict=True):
                held, size = [], 0
                for record in _records(content, payloads):
                    held.append((name, *record))
                    size += len(record[-1] or b"") + 500
                    if size > 8 << 20:
                        yield _typed(pd.DataFrame(held, columns=columns))
                        held, size = [], 0
                if held:
                    yield _typed(pd.DataFrame(held, columns=columns))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    files = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("archive"), "content")
    if manifest is not None:
        files = files.join(small_or_shuffled(manifest.select("archive")), "archive", "left_semi")
    return files.mapInPandas(parse, RECORD_SCHEMA)


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(payload_bytes=frame["payload_bytes"].astype("Int64"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture (response or revisit record).

    Requests and metadata are found through concurrent-to identifiers in
    either direction; of several, the one with the smallest record id stands
    in the row and ``parts`` counts all. Columns: ``capture_id, type,
    target_uri, date, payload_digest, payload_bytes, refers_to, payload,
    request, metadata, parts``; missing parts are null. Payloads travel only
    with the capture's own row. Records without an identifier link nothing;
    repeated records give repeated captures; no records, no rows; further
    columns are not looked at. Give staged records: they are read twice.
    """
    links = records.select("record_id", F.explode("concurrent_to").alias("other"))
    links = links.union(links.select("other", "record_id")).distinct()
    parts = records.where("type IN ('request', 'metadata')").select("record_id", "type", "date", "fields")
    part = F.struct("record_id", "date", F.map_entries("fields").alias("entries"))
    joined = (
        parts.join(links, "record_id")
        .groupBy(F.col("other").alias("capture_id"))
        .agg(F.min(F.when(F.col("type") == "request", part)).alias("request"), F.min(F.when(F.col("type") == "metadata", part)).alias("metadata"), F.count("*").alias("parts"))
    )
    unpacked = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.record_id"), F.col(f"{c}.date"), F.map_from_entries(F.col(f"{c}.entries")).alias("fields")))
    joined = joined.select("capture_id", unpacked("request").alias("request"), unpacked("metadata").alias("metadata"), "parts")
    main = records.where("type IN ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), "type", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", "payload")
    return main.join(joined, "capture_id", "left")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as WARC records, written and read back; null bodies are empty, equal bodies of 1000
    bytes and more revisit the row with the largest id; see ``write_warc`` and ``read_warc``."""
    folder = new_folder(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    records, records_path = stage(read_warc(spark, folder, payloads=False, manifest=manifest), "warc-records")
    captures = assemble(records).select("capture_id", "type", "payload_bytes", "payload_digest", "refers_to", F.col("metadata.fields")["page_id"].cast("long").alias("page_id"))
    captures, _ = stage(captures, "warc-captures")
    unstage(spark, records_path)
    again = captures.where("type = 'revisit'")
    named = captures.where("type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("ref"))
    # staged, so that the join below is between plain shuffles and the revisits of a popular payload split
    named, _ = stage(named.join(again.select("refers_to").distinct(), "refers_to", "left_semi"), "warc-named")
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type")]
    return captures.where("type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).union(again.join(named, "refers_to", "left").select(*columns, F.col("ref").alias("refers_to")))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""
