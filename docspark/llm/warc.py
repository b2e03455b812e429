"""WARC archives with revisit resolution (operator 8).

Headers alone are shuffled by payload digest: of records whose payloads of at least `least` bytes are
equal, the one with the largest page_id is the response and the others revisit it. A revisit record needs no payload and is
made from its header. A response is written where its page is read: the pages that are revisits are left out by a join with
their keys, which are broadcast up to BROADCAST keys (about 50 MB); beyond that number Spark shuffles for this join.
Records get fresh headers and are written through Spark's own text writer, so commits survive lost executors and no
payload passes through the driver or Python. Each file is one gzip stream. Archives are read back as a stream of records, so memory holds
one record, not a file.

A null html is an empty payload. Null urls give an empty target. Rows with null page_id are written as
responses and never referred to. Repeated rows: equal ids with equal payloads are all responses if that id is the
largest, and all revisits if it isn't. Payloads may have any length below 2 GB and may hold record headers. Extra columns are
ignored, whatever their names. No rows give an empty archive.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.plans.storage import new_path, written

from .common import column

LEAST = 1000
#: The date of the fresh headers; a parameter, so that reruns write equal archives.
DATE = "2024-01-01T00:00:00Z"
#: Keys of revisits that are broadcast at most.
BROADCAST = 500_000
_VERSION, _END = "WARC/1.1\r\n", "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _pages(pages: DataFrame) -> DataFrame:
    p = pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), F.coalesce(column(pages, "html", "string"), F.lit("")).alias("html"))
    return p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, refers_to) of the records that revisit another one."""
    headers = written(_pages(pages).where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).drop("html"), "headers")
    last = headers.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return written(headers.join(last, "payload_digest").where("page_id < refers_to").select("page_id", "url", "payload_bytes", "payload_digest", "refers_to"), "revisits")


def _head(kind: str, date: str, block: Column, more: Column | None = None) -> Column:
    id_ = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none-"), F.monotonically_increasing_id().cast("string")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "%0A")
    return F.concat(
        F.lit(f"{_VERSION}WARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:"), id_, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("") if more is None else more,
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(_END),
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """Write one record a row into gzip files under `path`."""
    gone = revisits(pages, least)
    keys = gone.select(F.col("page_id").alias("k"), F.col("payload_digest").alias("d")).distinct()
    if gone.count() <= BROADCAST:
        keys = F.broadcast(keys)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    p = _pages(pages).withColumn("http", http)
    responses = p.join(keys, (F.col("page_id") == F.col("k")) & (F.col("payload_digest") == F.col("d")), "left_anti")
    responses = responses.select(F.concat(_head("response", date, F.octet_length("http") + F.col("payload_bytes")), "http", "html").alias("value"))
    more = F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))
    # The writer ends each record with two line ends.
    records_ = responses.unionByName(gone.select(_head("revisit", date, F.lit(0), more).alias("value")))
    records_.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(path)


def records(pieces):
    """(headers, block) of the records in texts that give an archive when joined: cut by Content-Length, whatever the blocks hold."""
    held = b""
    for piece in pieces:
        held += piece
        while True:
            held = held.removeprefix(b"\r\n\r\n")
            head, end, block = held.partition(b"\r\n\r\n")
            if not end:
                break
            version, *lines = head.decode("utf-8").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no record at {version[:40]!r}")
            names = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
            size = int(names["content-length"])
            if len(block) < size:
                break
            yield names, block[:size]
            held = block[size:]
    if held.strip():
        raise ValueError(f"the archive ends inside a record: {held[:40]!r}")


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """One row a record; with `payloads`, the html too (null for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["html"] * payloads
    schema = ", ".join(f"{n} string" for n in names)
    mark = (_VERSION + "WARC-Type: ").encode()

    def page(urn: str | None) -> str | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return None if not digits or digits.startswith("none-") else digits

    def row(head: dict, block: bytes) -> tuple:
        kind = head["warc-type"]
        got = (page(head["warc-record-id"]), head["x-payload-length"], head["warc-payload-digest"].removeprefix("sha1:"), kind, page(head.get("warc-refers-to")), head["warc-target-uri"])
        return (*got, None if kind == "revisit" else block.partition(b"\r\n\r\n")[2].decode("utf-8")) if payloads else got

    def run(batches):
        def joined():
            # The reader cuts the stream where a record seems to begin; the mark goes back in front. A file begins with an empty piece.
            for pdf in batches:
                for value in pdf["value"]:
                    if value:
                        yield mark + value.encode("utf-8")

        out, size = [], 0
        for head, block in records(joined()):
            out.append(row(head, block))
            size += len(block) * payloads + 500
            if size > 8 << 20:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    # Numbers pass as text: beside nulls pandas would make them floats.
    d = spark.read.option("lineSep", mark.decode()).text(path).mapInPandas(run, schema)
    return d.select(*(F.col(n).cast("long").alias(n) if n in ("page_id", "payload_bytes", "refers_to") else n for n in names))


def rewritten(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives (into the shared folder unless `path` is given) and read them back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).drop("url")
