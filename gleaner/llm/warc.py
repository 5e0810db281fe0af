"""Web archives, index first: records are written with their place, and read by byte range.

Each task writes its own archive files into a shared folder, one gzip member per record,
and reports a row for every record: file, offset, length, url, digest. Those rows are the
index. Reading picks rows of the index, sorts them by place and fetches neighbouring
records in one request. A task that runs again writes under a new name and the index
names only the files of the attempt that counted.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import fresh_path, settle

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
FILE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20


def opened(folder: str):
    """A file system and the folder's path in it; any scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def record(page: int | None, url: str | None, kind: str, refers: int | None, digest: str, payload: bytes, date: str) -> bytes:
    """One archive record as a gzip member. Names outside ASCII and controls in a url are percent-encoded."""
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "about:blank"
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    block = "\r\n".join([*head, "", ""]).encode() + (payload if kind == "response" else b"")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    out = zlib.compressobj(1, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(fields).encode() + block + b"\r\n\r\n") + out.flush()


def parsed(member: bytes) -> dict:
    """Fields of a record (lower-case names), of its block, and the payload it holds."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not an archive record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["length"] = next(x.partition(": ")[2] for x in http.decode().split("\r\n") if x.startswith("Content-Length"))
    return fields | {"payload": payload}


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) and returns the index, a written table.

    Payload: html in UTF-8; null is empty. Of equal payloads of ``min_bytes`` or more the
    record with the smallest page_id holds the payload, the others refer to it; rows that
    share that page_id all hold it. A null page_id is never the smallest; if a group has no
    other, all its rows are responses. Other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    narrow = rows.where(F.length("payload") >= min_bytes).select("sha", "page_id")
    heads = settle(narrow.groupBy("sha").agg(F.min("page_id").alias("head"), F.count("*").alias("n")).where("n > 1"), "warc-heads")
    rows = rows.join(heads.drop("n"), "sha", "left").withColumn("head", F.when((F.length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = opened(folder)
        stream, place = None, ""
        for frame in frames:
            out = []
            for page, url, payload, sha, head in zip(frame.page_id, frame.url, frame.payload, frame.sha, frame["head"], strict=True):
                if stream is None:
                    place = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    stream, at = store.open_output_stream(place, compression=None), 0
                page, head = (None if pd.isna(x) else int(x) for x in (page, head))
                kind, digest = "response" if head is None else "revisit", base64.b32encode(bytes.fromhex(sha)).decode()
                data = record(page, url, kind, head, digest, payload, date)
                stream.write(data)
                out.append((page, url, place, at, len(data), digest, len(payload), kind, head))
                at += len(data)
                if at >= FILE_BYTES:
                    stream = stream.close()
            yield pd.DataFrame(out, columns=[x.split()[0] for x in INDEX.split(", ")], dtype=object)
        if stream is not None:
            stream.close()

    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)
    return settle(rows.select("page_id", "url", "payload", "sha", "head").mapInPandas(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows, read from their archives by coalesced byte ranges.

    Fields come from the records; the digest and length of a response are worked out from
    its payload and held against the record's. A revisit has no payload (null) and keeps
    the length and digest its record states.
    """
    parts = max(1, index.sparkSession.sparkContext.defaultParallelism, index.rdd.getNumPartitions())
    placed = index.select("page_id", "url", "file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        store, _ = opened(folder)
        stream, name = None, None
        for frame in frames:
            out, files, offsets, lengths = [], frame.file.tolist(), frame.offset.tolist(), frame.length.tolist()
            i = 0
            while i < len(files):
                j, end = i, offsets[i] + lengths[i]
                while j + 1 < len(files) and files[j + 1] == files[i] and offsets[j + 1] - end <= GAP_BYTES and offsets[j + 1] + lengths[j + 1] - offsets[i] <= READ_BYTES:
                    j += 1
                    end = max(end, offsets[j] + lengths[j])
                if name != files[i]:
                    if stream is not None:
                        stream.close()
                    stream, name = store.open_input_file(files[i]), files[i]
                data = stream.read_at(end - offsets[i], offsets[i])
                for k in range(i, j + 1):
                    start = offsets[k] - offsets[i]
                    got = parsed(data[start : start + lengths[k]])
                    kind, digest, size = got["warc-type"], got["warc-payload-digest"].removeprefix("sha1:"), int(got["length"])
                    if kind == "response" and (len(got["payload"]), base64.b32encode(hashlib.sha1(got["payload"]).digest()).decode()) != (size, digest):
                        raise ValueError(f"record at {files[k]}:{offsets[k]} does not hold what it states")
                    page, refers = (got.get(x, "").removeprefix("<urn:page:").removesuffix(">") for x in ("warc-record-id", "warc-refers-to"))
                    out.append((int(page) if page else None, frame.url.iat[k], kind, int(refers) if refers else None, digest, size, got["payload"] if kind == "response" else None))
                i = j + 1
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RECORD.split(", ")], dtype=object)
        if stream is not None:
            stream.close()

    return placed.mapInPandas(read, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Archives ``pages`` and reads every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, min_bytes), folder).drop("payload", "url")
