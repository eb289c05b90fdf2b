"""WARC archives: writing pages, reading records back, and segment reassembly.

Writing: a page becomes a response record whose block is an HTTP response
with the page as payload. Of pages with equal payloads of at least
`min_revisit` bytes the one with the smallest page_id stays a response; the
others become revisit records with HTTP headers only. A payload of
over `CHUNKED` bytes has chunked transfer framing. A block of over `SEGMENT`
bytes is cut into segments: the record itself and continuation records that
name it as their origin. Each task writes one file of gzip members, record by
record, under a name no other attempt uses; the manifest names the files of
successful attempts only.

Reading: a task streams through a file. A record that is whole is decoded at
once and gives a row without its payload's bytes moving anywhere. Segments
are grouped by the identifier of their origin record, ordered by segment
number, checked for gaps and against the stated total length, and only then
is the HTTP block decoded. What is wrong with a record is in `problem`.

Record identifiers are `<urn:page:PAGE?sha256=DIGEST>`, which a revisit refers
to. Rows that may share page_id and payload have `&row=N` added; a revisit of those names them without it.

Defined cases: a null html is an empty payload, a null url an empty target. A
null page_id counts as larger than any other, and is `null` in the identifier.
Rows that share the smallest page_id of a group are all responses. An empty
table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.scratch import new_dir, table

SEGMENT, CHUNKED, CHUNK = 32_768, 8_192, 4_000
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n"
RECORD = "record_id string, record_type string, refers_to long, segment int, total long, block binary, page_id long, payload_bytes long, payload_digest string, problem string"


def chunked(payload: bytes) -> bytes:
    """payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for at in range(0, len(payload), CHUNK) if (c := payload[at : at + CHUNK])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(END, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != END:
            raise ValueError("a chunk does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def http_block(payload: bytes, headers_only: bool = False) -> bytes:
    framing = b"Transfer-Encoding: chunked" if len(payload) > CHUNKED and not headers_only else b"Content-Length: %d" % len(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + framing + b"\r\n\r\n"
    return head if headers_only else head + (chunked(payload) if len(payload) > CHUNKED else payload)


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower-case names) and the payload of an HTTP block."""
    head, _, body = block.partition(END + END)
    fields = dict(f for f in (tuple(x.strip() for x in line.split(":", 1)) for line in head.decode("latin-1").split("\r\n")[1:]) if len(f) == 2)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", len(block))) if v is not None)
    squeeze = zlib.compressobj(3, wbits=31)
    return squeeze.compress(b"WARC/1.1\r\n" + head.encode() + END + block + END + END) + squeeze.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, row: str | None) -> Iterator[bytes]:
    """The records of one page; row tells it apart from others of the same page_id and payload."""
    name = f"<urn:page:{'null' if page_id is None else page_id}?sha256={digest}{f'&row={row}' if row else ''}>"
    target = "".join((url or "").split())
    block = http_block(payload, headers_only=revisit)
    shared = [("WARC-Target-URI", target), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), *shared, ("WARC-Payload-Digest", f"sha256:{digest}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}?sha256={digest}>")]
    pieces = [block[at : at + SEGMENT] for at in range(0, len(block), SEGMENT)]
    yield record(fields + [("WARC-Segment-Number", 1)] * (len(pieces) > 1), pieces[0])
    for number, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if number == len(pieces) else []
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:segment:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number)]
        yield record(own + shared[:2] + last, piece)


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record in a stream of gzip members, one member in memory at a time.

    A member that the stream does not hold as a whole gives a record of type `truncated`.
    """
    inflate, data, member = zlib.decompressobj(wbits=31), b"", []
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            if member:
                yield {"warc-type": "truncated", "warc-record-id": ""}, b""
            return
        member.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            head, _, rest = b"".join(member).partition(END + END)
            fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:])}
            yield fields, rest[: int(fields["content-length"])]
            inflate, member = zlib.decompressobj(wbits=31), []


def digests(pages: DataFrame) -> DataFrame:
    """pages' page_id, url, payload, its payload_bytes and payload_digest (hex SHA-256)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))


def revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, payload_digest, refers_to of the pages that repeat another's payload, and of those that occur more than once (alike)."""
    light = digests(pages).where(F.col("payload_bytes") >= min_revisit).select("page_id", "payload_digest")
    light = table(light, "digests")
    first = light.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = table(first.select("payload_digest", "refers_to"), "first_pages")
    again = light.join(first, "payload_digest").where("refers_to is not null or page_id is null")
    again = again.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to")), F.col("refers_to")))
    counted = again.groupBy("page_id", "payload_digest", "refers_to").agg((F.count(F.lit(1)) > 1).alias("alike"))
    return counted.where("alike or refers_to is not null")


def write(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """Writes all pages; the manifest: a row for each file with its path and number of records."""
    folder = new_dir(pages.sparkSession, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        part, rows, records = uuid.uuid4().hex, 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to, revisit, alike in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, at = fs.FileSystem.from_uri(folder)
                    store.create_dir(at, recursive=True)
                    path = f"part-{part}.warc.gz"
                    out = store.open_output_stream(f"{at}/{path}", compression=None)
                    out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(part)}>"), ("WARC-Date", DATE)], b"format: WARC File Format 1.1\r\n"))
                for data in page_records(page_id, url, payload, digest, refers_to, revisit, f"{part}.{rows}" if alike else None):
                    out.write(data)
                    records += 1
                rows += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": [records]}, pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    again = table(revisits(pages, min_revisit), "revisits").alias("r")
    own = digests(pages).alias("p")
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.payload_digest") == F.col("r.payload_digest"))
    rows = own.join(again, same, "left").select("p.page_id", "p.url", "p.payload", "p.payload_digest", "r.refers_to", F.col("r.refers_to").isNotNull().alias("revisit"), (F.coalesce("r.alike", F.lit(False)) | (F.octet_length("p.payload") < min_revisit)).alias("alike"))
    return table(rows.mapInArrow(work, "path string, n_records long"), "warc_files")


def _page(name: str) -> int | None:
    page = name.removeprefix("<urn:page:").removesuffix(">").split("?")[0]
    return None if page == "null" else int(page)


def _decoded(record_type: str, block: bytes, digest: str) -> tuple[int | None, str | None, str | None]:
    """payload_bytes, payload_digest and problem of a whole block."""
    try:
        fields, payload = http_parts(block)
    except ValueError as e:
        return None, None, f"framing: {e}"
    if record_type == "revisit":
        return int(fields["content-length"]), digest, None
    own = hashlib.sha256(payload).hexdigest()
    return len(payload), own, None if own == digest or not digest else "digest"


def read(manifest: DataFrame) -> DataFrame:
    """A row for each response, revisit and continuation record; segments keep their block, whole records are decoded.

    A file that ends within a record, or holds other than the number of records
    that the manifest states, gives one more row of type `truncated`.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for path, expected in zip(batch["path"], batch["n_records"], strict=True):
                seen = 0
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as file:
                    rows, held = [], 0
                    for fields, block in records_in(io.BufferedReader(file)):
                        kind = fields["warc-type"]
                        if kind == "truncated":
                            rows.append([path, kind, None, None, None, None, None, None, None, "the file ends within a record"])
                            expected = None
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        seen += 1
                        name, number = fields.get("warc-segment-origin-id", fields["warc-record-id"]), fields.get("warc-segment-number")
                        refers, total = fields.get("warc-refers-to"), fields.get("warc-segment-total-length")
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        row = [name, kind, refers and _page(refers), number and int(number), total and int(total)]
                        if number:
                            rows.append([*row, block, _page(name), None, digest or None, None])
                            held += len(block)
                        else:
                            rows.append([*row, None, _page(name), *_decoded(kind, block, digest)])
                        if len(rows) >= 5000 or held > 8_000_000:
                            yield pd.DataFrame(rows, columns=names).astype(INTS)
                            rows, held = [], 0
                    if expected is not None and not pd.isna(expected) and seen != expected:
                        rows.append([path, "truncated", None, None, None, None, None, None, None, f"{seen} of {int(expected)} records"])
                    if rows:
                        yield pd.DataFrame(rows, columns=names).astype(INTS)

    # as many partitions as files: the adaptive planner would put rows this few and small into one task
    stated = F.col("n_records") if "n_records" in manifest.columns else F.lit(None).cast("long").alias("n_records")
    return manifest.select("path", stated).repartition(max(1, manifest.count()), "path").mapInPandas(work, RECORD)


INTS = {"refers_to": "Int64", "segment": "Int32", "total": "Int64", "page_id": "Int64", "payload_bytes": "Int64"}


def reassemble(segments: DataFrame) -> DataFrame:
    """One row for each origin record of segments, in whatever order and files they lie."""

    def whole(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("segment")
        first, block = parts.iloc[0], b"".join(parts["block"])
        total = parts["total"].dropna()
        size, own, problem = None, None, None
        if list(parts["segment"]) != list(range(1, len(parts) + 1)):
            problem = "segments missing or repeated"
        elif not len(total) or int(total.iloc[-1]) != len(block):
            problem = "total length"
        else:
            size, own, problem = _decoded(first["record_type"], block, first["payload_digest"] or "")
        row = [first["record_id"], first["record_type"], None, None, None, None, first["page_id"], size, own, problem]
        return pd.DataFrame([row], columns=parts.columns).astype(INTS)

    return segments.groupBy("record_id").applyInPandas(whole, RECORD)


def decoded_pages(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and problem of every page in the archives."""
    records = table(read(manifest), "records")
    whole = records.where("segment is null").unionByName(reassemble(records.where("segment is not null")))
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
