"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Writing: each task fills archives of bounded size in a shared folder (any URI that pyarrow can open) and returns their names; only
archives of finished tasks are in the manifest, so a task that ran twice or died leaves at most an unlisted file. Equal payloads
of at least `least` bytes are one response (the smallest page_id) and revisits that carry the HTTP header only.

Reading: a record is found by walking the file: compressed chunks go through an incremental zlib object until its member ends, the
WARC header is parsed, Content-Length frames the block, and block and payload digests are verified. A reader holds one chunk and one
record. A member that fails (cut off, wrong length, wrong digest) is reported by its error column instead of stopping the job.

Edge cases: a null html is an empty payload; nulls in url leave the header out; control characters in urls are percent-encoded; a
null page_id has no id header and reads back as null, and its payload never is the smallest unless alone; rows repeated with the
same page_id and payload are all of them the response; empty tables write no archive; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_hot, new_path, stored

ARCHIVE_BYTES, CHUNK, LEAST = 16 << 20, 1 << 16, 100
#: Tasks that read archives, at most; each takes its archives one after the other.
READERS_MOST = 20_000
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, position long, error string"


# ---- one record


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The uncompressed bytes of a record; payload is the full payload for revisits too, whose block stops after the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: {_urn(page_id)}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: {_urn(refers_to)}")
    lines += [f"WARC-Block-Digest: sha256:{_digest(block)}", f"WARC-Payload-Digest: sha256:{_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream, chunk: int = CHUNK) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, bytes, error) of each gzip member, decompressed chunk by chunk; after an error nothing further can be framed."""
    offset, used, left = 0, 0, b""
    while True:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            data = left or stream.read(chunk)
            left = b""
            if not data:
                if used:
                    yield offset, b"".join(parts), "cut off"
                return
            try:
                parts.append(unpacker.decompress(data))
            except zlib.error as e:
                yield offset, b"".join(parts), f"not a gzip member: {e}"
                return
            left = unpacker.unused_data
            used += len(data) - len(left)
        yield offset, b"".join(parts), None
        offset += used


def parse(data: bytes) -> dict:
    """A record's fields; error says what does not hold."""
    out = dict.fromkeys(("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"))
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not gap or not lines[0].startswith("WARC/"):
        return out | {"error": "no WARC header"}
    page = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-record-id", ""))
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-refers-to", ""))
    out |= {"page_id": page and int(page[1]), "refers_to": refers and int(refers[1]), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type")}
    length = fields.get("content-length", "")
    if not length.isdigit() or rest[int(length) :] != b"\r\n\r\n":
        return out | {"error": "content length does not frame the block"}
    block = rest[: int(length)]
    if fields.get("warc-block-digest") != f"sha256:{_digest(block)}":
        return out | {"error": "block digest differs"}
    http, gap, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    out |= {"payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"), "payload_bytes": size and int(size[1])}
    if out["record_type"] == "response":
        out["payload"] = payload
        if len(payload) != out["payload_bytes"] or _digest(payload) != out["payload_digest"]:
            return out | {"error": "payload digest or length differs"}
    return out


# ---- the jobs


def open_uri(uri: str):
    """(filesystem, path) of a URI or local path."""
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def write_warc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes records (page_id, url, payload binary, refers_to, revisit) below path; returns the manifest (archive, records, bytes), stored."""
    bounded_batches(records.sparkSession)

    def run(frames):
        store, folder = open_uri(path)
        out, name, count, size = None, None, 0, 0
        store.create_dir(folder, recursive=True)
        for frame in frames:
            for row in frame.itertuples(index=False):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{folder}/{name}")
                ids = [None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to)]
                data = member(record(ids[0], row.url, bytes(row.payload or b""), ids[1], bool(row.revisit)))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [f"{path}/{name}"], "records": [count], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [f"{path}/{name}"], "records": [count], "bytes": [size]})

    # Ids as decimal strings: pandas would turn a long column with nulls into doubles.
    rows = records.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"), "revisit")
    return stored(rows.mapInPandas(run, "archive string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in manifest (column archive), one task reading an archive from its start to its end."""
    columns = [x.split()[0] for x in RECORD.split(", ")]

    def run(frames):
        for frame in frames:
            for archive in frame["archive"]:
                store, file = open_uri(archive)
                rows, held = [], 0
                with store.open_input_stream(file) as stream:
                    for offset, data, error in members(stream):
                        found = parse(data) if error is None else dict.fromkeys(columns) | {"error": error}
                        rows.append(found | {"archive": archive, "position": offset})
                        held += len(data)
                        if held > 1 << 22:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, columns)

    # Names are few bytes each: without a number of its own, one task would get them all.
    names = manifest.select("archive").distinct()
    return names.repartition(max(1, min(manifest.count(), READERS_MOST))).mapInPandas(run, RECORD)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "refers_to", "payload_bytes", "position"):
        frame[c] = pd.array(frame[c], dtype="Int64")
    return frame


def page_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): which pages are responses and which revisit the response of an equal payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).alias("size"))
    first = rows.select("page_id", "digest", "size").filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = join_hot(rows, first.select("digest", "first"), "digest", "left")  # many pages of one payload stay where they are
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    return read_warc(write_warc(page_records(pages), new_path(pages.sparkSession, "warc")))


