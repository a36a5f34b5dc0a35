"""Web archives: writing transactions as WARC records, reading them back, and assembling captures.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record. The records name
each other by WARC-Concurrent-To, in either direction and across files; assembly joins them into one nested row.

Archives are files of gzip members, one for each record, as the format recommends. Spark's text writer puts them
in place, so that any store Spark can reach will do, and a lost task leaves nothing half-written behind.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.frames import ship_package
from runledger.session import materialised

VERSION = b"WARC/1.1"
#: Payloads below this size are stored each time.
MIN_REVISIT_BYTES = 100
#: Compressed bytes gathered into one row of the writer, and rows in one file: a file has about 32 MB.
ROW_BYTES = 2 << 20
ROWS_PER_FILE = 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, payload_bytes long, payload_digest string, fields array<struct<key:string,value:string>>"


# --- records ---------------------------------------------------------------------


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed record."""
    lines = [VERSION, f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{record_id}>".encode(), f"WARC-Date: {DATE}".encode()]
    lines += [f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in headers]
    lines.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, list[str]], bytes]:
    """Headers (lower-case names; a name may repeat) and block of one uncompressed record; ValueError where it is damaged."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers: dict[str, list[str]] = {}
    for line in lines[1:]:
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        headers.setdefault(name.strip().lower(), []).append(value.strip())
    size = int(headers["content-length"][0])
    if len(rest) < size:
        raise ValueError(f"record of {len(rest)} bytes where {size} are announced")
    return headers, rest[:size]


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of the gzip members of a file; empty ones, which separate the writer's rows, are skipped.

    Input goes in by steps, as what follows a member is copied.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof and at < len(view):
            out.append(d.decompress(view[at : at + step]))
            at += len(view[at : at + step]) - len(d.unused_data)
        if not d.eof:
            raise ValueError("the last member is cut off")
        if any(out):
            yield b"".join(out)


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _uri(value: str | None) -> str:
    """Header values are one line."""
    return " ".join((value or "").split())


def transaction(uid: str, page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> list[bytes]:
    """The three records of one page. ``refers_to`` is the page of the stored payload when this capture repeats it.

    A page without an id says so by leaving the field out.
    """
    request, response, metadata = (f"urn:runledger:{kind}:{uid}" for kind in ("request", "response", "metadata"))
    uri, to = _uri(url), [("WARC-Concurrent-To", f"<{response}>")]
    common = [("WARC-Target-URI", uri)] if uri else []
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    headers = [*common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        main = record("response", response, headers, http + payload)
    else:
        main = record("revisit", response, [*headers, ("WARC-Profile", PROFILE)], http)
    get = f"GET {uri} HTTP/1.1\r\n\r\n".encode("utf-8", "surrogatepass")
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return [
        record("request", request, [*common, *to, ("Content-Type", "application/http; msgtype=request")], get), main,
        record("metadata", metadata, [*common, *to, ("Content-Type", "application/warc-fields")], fields)]


# --- writing ---------------------------------------------------------------------


def _separator() -> str:
    """An empty gzip member as the text writer's line separator (one byte for each character)."""
    return gzip_member(b"", 9).decode("latin-1")


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archive ``page_id, url, html`` of every row below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes those with the smallest page_id (null is the largest)
    are responses and the others revisits; smaller ones are responses. A null html is an empty payload. Other columns
    are not archived. Rows that repeat are archived each on its own; an empty table makes no records.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    big = F.octet_length("html") >= min_bytes
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("page_id"))
    # Reduced before the shuffle; only payloads that repeat are left to join.
    first = rows.where(big).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    marked = rows.join(first, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest",
        F.when(big & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.lit("yes")).alias("again"),
        F.monotonically_increasing_id().alias("uid"))
    ship_package(pages.sparkSession)

    def pack(batches):
        out: list[bytes] = []
        size = 0
        for b in batches:
            for page, url, text, digest, again, uid in zip(*(c.to_pylist() for c in b.columns)):
                for r in transaction(str(uid), page, url, text.encode(), digest, again):
                    out.append(gzip_member(r))
                    size += len(out[-1])
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])

    # The column is bytes; the text writer puts them out unchanged.
    rows = marked.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", _separator()).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


# --- reading and assembling ------------------------------------------------------


def _id(value: str) -> str:
    return value.strip().removeprefix("<").removesuffix(">")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record below ``path``: RECORD. Files are read whole, one task each; payloads stay in the task.

    ``payload_bytes`` and ``payload_digest`` of a response are computed from its payload; of other records the digest is the
    announced one and the size null. ``fields`` has the lines of a metadata record. A damaged record, or a payload
    that does not have the announced digest, is an error.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))])

    def one(raw: bytes) -> dict:
        h, block = parse(raw)
        get = lambda k: h.get(k, [None])[0]
        kind, digest, size, fields = get("warc-type"), get("warc-payload-digest"), None, []
        digest = digest.partition(":")[2] if digest else None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size, found = len(payload), hashlib.sha256(payload).hexdigest()
            if digest not in (None, found):
                raise ValueError(f"{get('warc-record-id')}: the payload does not have the announced digest")
            digest = found
        elif kind == "metadata":
            lines = [line.partition(":") for line in block.decode("utf-8", "replace").splitlines() if ":" in line]
            fields = [{"key": k.strip(), "value": v.strip()} for k, _, v in lines]
        return {"record_id": _id(get("warc-record-id")), "type": kind, "concurrent_to": [_id(x) for x in h.get("warc-concurrent-to", [])],
                "target_uri": get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "fields": fields}

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for raw in members(content.as_py()):
                    rows.append(one(raw))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id`` (the response's record id), ``request``, ``response``, ``metadata``.

    ``request`` and ``response`` are structs of RECORD, ``metadata`` an array of them. A request or metadata record belongs to the
    response that it names by concurrent-to, or that names it. One that meets no response gets a row of its own id without
    ``response``; a record that names several goes with each. Extra columns are ignored, a record id that repeats counts once
    for each time. ``records`` is read several times.
    """
    whole = F.struct("record_id", "type", "concurrent_to", "target_uri", "payload_bytes", "payload_digest", "fields")
    is_main = F.col("type").isin("response", "revisit")
    main = records.where(is_main).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    rest = records.where(F.col("type").isin("request", "metadata")).select(F.col("record_id").alias("_id"), F.explode_outer("concurrent_to").alias("_to"), whole.alias("_r"))
    # Responses that name their request or metadata; usually none do.
    named = main.select("capture_id", F.explode("response.concurrent_to").alias("_id"))
    forward = rest.join(named, "_id", "left").withColumn("capture_id", F.coalesce(named["capture_id"], F.col("_to"), F.col("_id")))
    kind = F.col("_r.type")
    parts = forward.groupBy("capture_id").agg(
        F.min_by("_r", F.when(kind == "request", F.col("_id"))).alias("request"),
        F.array_sort(F.collect_set(F.when(kind == "metadata", F.col("_r")))).alias("metadata"))
    return main.join(parts, "capture_id", "full_outer").select(
        "capture_id", "request", "response", F.coalesce("metadata", F.array().cast(parts.schema["metadata"].dataType)).alias("metadata"))


def resolved(captures: DataFrame, page_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, capture_id of each capture that has a response or revisit.

    A revisit names its payload by digest; the response that has it gives the size and, of several, the smallest page.
    ``captures`` is read several times.
    """
    page = F.get(F.filter(F.flatten(F.transform("metadata", lambda m: m["fields"])), lambda e: e["key"] == "page-id"), 0)["value"]
    rows = captures.where("response IS NOT NULL").select(
        page.cast(page_type).alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.payload_bytes").alias("_bytes"), "capture_id")
    again = F.col("record_type") == "revisit"
    wanted = rows.where(again).select("payload_digest").distinct()
    stored = rows.where(~again).join(wanted, "payload_digest", "left_semi")
    stored = stored.groupBy("payload_digest").agg(F.min("page_id").alias("_page"), F.max("_bytes").alias("_size"))
    return rows.join(stored, "payload_digest", "left").select(
        "page_id", F.when(again, F.col("_size")).otherwise(F.col("_bytes")).alias("payload_bytes"), "payload_digest", "record_type",
        F.when(again, F.col("_page")).alias("refers_to"), "capture_id")


def archive_round_trip(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive all pages below ``folder``, read the archives back, assemble the captures and resolve revisits."""
    write_archives(pages, folder, min_bytes)
    captures = materialised(assemble(materialised(read_records(pages.sparkSession, folder))))
    return resolved(captures, pages.schema["page_id"].dataType.simpleString())
