"""WARC archives with an index.

Writing gives, besides the archives, an index row per record: archive, offset, length, URL and payload digest. Reading takes
selected index rows, sorts their byte ranges, coalesces ranges that lie close together, and reads each run at once.
Archives are gzip files with a member per record, in the shared folder, so that any record can be read by itself.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import run_folder, stored

LEAST_SHARED = 100  # bytes from which equal payloads are stored once
NAMESPACE = uuid.UUID("8c0f36ec-5c5c-4a44-9d5b-0f5c7c0d4f6a")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INDEX = ("page_id long, url string, archive string, offset long, length long, payload_digest string, payload_bytes long, "
         "record_type string, refers_to long")
RECORDS = "page_id long, url string, record_type string, refers_to long, stated_digest string, payload binary"


def file_system(folder: str):
    """The file system and path of a folder: local, HDFS or an object store, by its URI."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder else folder.removeprefix("file:"))
    return system, path.rstrip("/")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def _header(value: str) -> str:
    return re.sub(r"[\r\n\x00]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One record; a revisit holds the HTTP header alone and points to the record that holds the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_header(refers_url)}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record and its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(names["Content-Length"])]
    number = lambda k: int(names[k]) if k in names else None
    revisit = names["WARC-Type"] == "revisit"
    return {"page_id": number("X-Page-Id"), "url": names.get("WARC-Target-URI"), "record_type": names["WARC-Type"],
            "refers_to": number("X-Refers-To-Page-Id"), "stated_digest": names["WARC-Payload-Digest"].removeprefix("sha256:"),
            "payload": None if revisit else block.partition(b"\r\n\r\n")[2]}


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of (page_id, url, html) below ``folder`` and return the index, itself a stored table.

    Null html counts as empty. Of the rows whose payloads are equal and at least 100 bytes long, those with the smallest
    page_id (more than one only if the id repeats) are responses and the others revisit it; a row without id revisits one
    with an id. Each task writes archives of its own, named so that a task that runs again never touches an earlier file; only
    files that the index names count.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest")
                 .agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
                 .where("n > 1 AND first IS NOT NULL").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    decided = rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisits, F.col("first_id")).alias("refers_to"), F.when(revisits, F.col("first_url")).alias("refers_url"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(folder)
        system.create_dir(f"{base}/archives", recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, body, digest, refers_to, refers_url in batch.itertuples(index=False, name=None):
                    page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    member = _member(record(page_id, url, body, digest, refers_to, refers_url, date))
                    out.write(member)
                    index.append((page_id, url, name, at, len(member), digest, len(body), "response" if refers_to is None else "revisit", refers_to))
                    at += len(member)
                frame = pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return stored(decided.mapInPandas(write, INDEX), folder, "index")


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, run_bytes: int = 8 << 20, segment_bytes: int = 64 << 20) -> DataFrame:
    """The records of the given index rows, read in coalesced runs: ``page_id, url, record_type, refers_to, stated_digest, payload``.

    Ranges that are at most ``gap`` bytes apart are read as one, up to ``run_bytes``; a task takes the ranges of one stretch of an
    archive at a time, so a large archive is read by many.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(folder)
        name, source = None, None

        def runs() -> Iterator[tuple[str, list[tuple[int, int]]]]:
            run: list[tuple[int, int]] = []
            current = None
            for batch in batches:
                for archive, offset, length in batch.itertuples(index=False, name=None):
                    if run and (archive != current or offset - sum(run[-1]) > gap or offset + length - run[0][0] > run_bytes):
                        yield current, run
                        run = []
                    current = archive
                    run.append((offset, length))
            if run:
                yield current, run

        try:
            for archive, run in runs():
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, system.open_input_file(f"{base}/{archive}")
                begin = run[0][0]
                data = source.read_at(sum(run[-1]) - begin, begin)
                found = [parse(zlib.decompress(data[o - begin:o - begin + n], 31)) for o, n in run]
                yield pd.DataFrame(found, columns=[c.split()[0] for c in RECORDS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if source is not None:
                source.close()

    ranges = index.select("archive", "offset", "length")
    stretch = F.floor(F.col("offset") / segment_bytes)
    return ranges.repartition("archive", stretch).sortWithinPartitions("archive", "offset").mapInPandas(read, RECORDS)


def payload_facts(records: DataFrame) -> DataFrame:
    """Per record: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``, from the payloads that were read.

    A revisit takes them from the record that it points to. A payload that does not have the digest its record states fails
    the job.
    """
    facts = records.select("page_id", "url", "record_type", "refers_to", "stated_digest",
                           F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha"))
    held = (facts.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "stated_digest")
                 .agg(F.max("n").alias("held_n"), F.max("sha").alias("held_sha")))
    joined = facts.join(held, ["refers_to", "stated_digest"], "left")
    digest = F.coalesce("sha", "held_sha")
    checked = F.when(digest == F.col("stated_digest"), digest).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ: "), F.col("stated_digest"))))
    return joined.select("page_id", "url", F.coalesce("n", "held_n").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, read every record back by the index, and report the facts."""
    folder = run_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return payload_facts(read_records(index, folder))


SQL = f"""
WITH sized AS (
  SELECT page_id, url, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), first AS (
  SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= {LEAST_SHARED} GROUP BY payload_digest
)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM sized LEFT JOIN first USING (payload_digest)
"""
