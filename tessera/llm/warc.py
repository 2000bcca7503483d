"""WARC archives with revisit records: repeated payloads are written once and referred to by digest."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.scratch import bit_filter, may_hold
from tessera.scratch import cut, new_folder

#: A new archive is begun after so many bytes of payload, so that a reader's task holds one bounded file.
ARCHIVE_BYTES = 32 << 20
#: Payloads shorter than this are always written in full.
LEAST_BYTES = 1000
#: Repeated digests up to this many are broadcast to the rows; beyond it a bit filter tells which rows are joined by shuffle.
BROADCAST_DIGESTS = 100_000
#: Fixed: the crawl date of all records, so that archives of equal input are equal.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(payload_digest, refers_to, refers_url) for each digest that several rows of at least ``least`` bytes share: their largest page_id and its url.

    headers: page_id, url, payload_bytes, payload_digest. Rows are pre-aggregated before the shuffle, so a digest that
    very many pages share costs one row per task. A null page_id is the smallest; of several rows with the largest one,
    the largest url is told.
    """
    long = headers.where(F.col("payload_bytes") >= least)
    first = F.max(F.struct("page_id", F.struct(F.col("url").isNull().alias("none"), "url").alias("at")))
    shared = long.groupBy("payload_digest").agg(first.alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1 AND x.page_id IS NOT NULL")
    return shared.select("payload_digest", F.col("x.page_id").alias("refers_to"), F.col("x.at.url").alias("refers_url"))


def _clean(url: str | None) -> str:
    return (url or "").replace("\r", "").replace("\n", "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_url: str | None, is_revisit: bool) -> bytes:
    """One gzip member holding a WARC/1.1 record with an identifier of its own.

    A response's block is an HTTP response of the payload; a revisit's is the HTTP header alone, and it names the
    original by payload digest, address and date.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_clean(refers_url)}", f"WARC-Refers-To-Date: {DATE}"]
    block = http if is_revisit else http + payload
    whole = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(whole, compresslevel=3, mtime=0)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, member after member."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"a record is cut short: {head}")
        yield head, block


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) into gzip archives in ``folder`` and returns their names and sizes.

    Null html is an empty payload, null url an empty one. Only rows of the largest page_id of a digest carry a repeated
    payload; should several rows share that page_id and payload, each is a response. Archives are written under a name
    of the attempt and renamed when whole, so a retried or speculative task leaves no half archive under a final name.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    headers = rows.select("page_id", "url", F.octet_length("payload").alias("payload_bytes"), "payload_digest")
    shared = cut(decide(headers, least), "revisits").withColumnRenamed("payload_digest", "_digest")
    same = F.col("payload_digest") == F.col("_digest")
    if shared.count() <= BROADCAST_DIGESTS:
        plan = rows.join(F.broadcast(shared), same, "left").drop("_digest")
    else:  # only rows that may have a repeated digest move
        told = bit_filter(shared.select(F.xxhash64("_digest").alias("h")), "h")
        hit = F.arrow_udf(lambda h: pa.array(may_hold(told, h.to_numpy())), T.BooleanType())
        marked = rows.withColumn("_may", hit(F.xxhash64("payload_digest")))
        alone = marked.where("NOT _may").drop("_may").select("*", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
        plan = marked.where("_may").drop("_may").join(shared, same, "left").drop("_digest").unionByName(alone)
    return plan.mapInArrow(lambda batches: _write(batches, folder), "archive string, records long, bytes long")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    out, held, count, done = None, 0, 0, []

    def close() -> None:
        nonlocal out, held, count
        if out is not None:
            out[1].close()
            store.move(out[0], name := out[0].replace(".open", ".warc.gz"))
            done.append((os.path.basename(name), count, held))
        out, held, count = None, 0, 0

    for batch in batches:
        for page_id, url, payload, digest, refers_to, refers_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "refers_url")), strict=True):
            if out is None:
                name = f"{path}/{uuid.uuid4().hex}.open"
                out = (name, store.open_output_stream(name))
            out[1].write(record(page_id, url, payload, digest, refers_url, refers_to is not None and refers_to != page_id))
            held, count = held + len(payload), count + 1
            if held >= ARCHIVE_BYTES:
                close()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "records", "bytes"])


def read_archives(folder: str, archives: DataFrame) -> DataFrame:
    """One row per record of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's digest and length are computed from its payload, and the digest must equal its header. A revisit is
    joined by digest to its original, the response of the largest page_id with that payload, and has its length; one
    without an original is an error. Records travel as headers only. Archives that the list does not name (left by a
    lost attempt) are skipped. An archive is read whole: a payload of some 2 GB, which Spark's binary files can't hold
    in one value, can't be read back.
    """
    spark = archives.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    named = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(archives.select("archive"), "archive", "left_semi")
    found = cut(named.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, url string"), "records")
    revisits = found.where("record_type = 'revisit'")
    asked = revisits.select(F.col("payload_digest").alias("_digest")).distinct()
    responses = found.where("record_type = 'response' AND page_id IS NOT NULL").join(asked, F.col("payload_digest") == F.col("_digest"), "left_semi")
    originals = responses.groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_bytes"))
    joined = revisits.join(originals, F.col("payload_digest") == F.col("_digest"), "left")
    lost = F.raise_error(F.concat(F.lit("no original has the payload "), F.col("payload_digest")))
    resolved = joined.select("page_id", F.when(F.col("_bytes").isNull(), lost.cast("long")).otherwise(F.col("_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")
    return found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "url").unionByName(resolved)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for data in batch.column("content"):
            rows = []
            for head, block in parse(data.as_py()):
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
                rows.append((int(head["X-Page-ID"]) if "X-Page-ID" in head else None, len(payload) if kind == "response" else None, digest, kind, head["WARC-Target-URI"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages as WARC archives into the shared scratch folder and returns what reading them back gives."""
    folder = new_folder(pages.sparkSession, "warc")
    archives = cut(write_archives(pages, folder), "archives")
    return read_archives(folder, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["archive_pages", "decide", "parse", "read_archives", "record", "write_archives"]
