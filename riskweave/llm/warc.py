"""WARC archives: a writer of gzip members with revisit records, and a splittable reader.

Archives are written by Spark's text writer, one gzip member a row, each followed by one zero byte, which gzip takes as
padding. The reader takes archives of others too: any record type, ids that are no page's, folded and non-ASCII headers; what
isn't a whole record is left out or, if asked for, returned as invalid. It gives Spark's text reader the gzip magic as the record separator: its tasks scan byte ranges for the
magic, and a range owns what starts inside it. Each candidate is validated by decoding its gzip and WARC headers; compressed
bytes that look like a magic only cut a member, so pieces are joined until one inflates whole with the right check sum, and
pieces that a range ends in are joined with the next range's in a second, small step.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.scratch import materialize, scratch_path

MAGIC = b"\x1f\x8b"
#: Payloads below this many bytes are never revisits.
MIN_REVISIT = 100


def member(headers: dict[str, str], block: bytes, level: int = 3) -> bytes:
    """One WARC record as one gzip member."""
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """Response with its HTTP head and payload, or a revisit of the record that refers_to names, with the HTTP head alone."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    clean = "".join(c for c in url or "" if c not in "\r\n")
    common = {"WARC-Record-ID": name(page_id), "WARC-Date": date, "WARC-Target-URI": clean, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return member({"WARC-Type": "response", **common}, http + payload)
    profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    return member({"WARC-Type": "revisit", **common, "WARC-Refers-To": name(refers_to), "WARC-Profile": profile}, http)


def write_archives(pages: DataFrame, path: str, *, date: str | None = None) -> None:
    """Write a record per row of pages (page_id, url, html; null html: empty) to archives under path, dated `date` or now.

    Of rows with equal payloads of MIN_REVISIT bytes or more, that with the smallest page_id is the response and the others
    revisit it; a row that repeats that page_id is a response too.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = rows.withColumn("digest", F.sha2("html", 256))
    copies = keyed.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(copies.select(F.col("digest").alias("digest_"), "first_id"), "warc_copies")
    joined = keyed.join(copies, F.col("digest") == F.col("digest_"), "left")

    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [record(i, u, h, d, f if f is not None and f != i else None, date) for i, u, h, d, f in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = joined.select("page_id", "url", "html", "digest", "first_id").mapInArrow(pack, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


def parse(raw: bytes) -> dict | None:
    """Fields (lower case) and block of an inflated member, or None if it is no whole WARC record."""
    top, found, rest = raw.partition(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or not found:
        return None
    fields: dict = {}
    last = ""
    for line in top.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        else:
            k, _, v = line.partition(":")
            last = k.strip().lower()
            fields.setdefault(last, v.strip())
    size = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size) or len(rest) < int(size):
        return None
    fields["block"] = rest[: int(size)]
    return fields


def join_pieces(pieces: list[bytes], final: bool = False) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(contents of members, pieces before the first of them, pieces from a start that doesn't end here) of the pieces
    between magics. A piece that begins no gzip member with a WARC head is part of what came before. final: nothing follows,
    so a start that doesn't end is none."""
    done: list[bytes] = []
    early: list[bytes] = []
    i = 0
    while i < len(pieces):
        z, out, j, whole = zlib.decompressobj(31), b"", i, False
        try:
            while j < len(pieces) and not whole:
                out += z.decompress(MAGIC + pieces[j])
                if not out.startswith(b"WARC/"[: len(out)]):
                    break
                j, whole = j + 1, z.eof
            if not whole and j == len(pieces) and not final:
                return done, early, pieces[i:]
        except zlib.error:
            whole = False
        if whole:
            done.append(out)
            i = j
        else:
            if not done:
                early.append(pieces[i])
            i += 1
    return done, early, []


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, payload binary"
KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def page(uri: str | None) -> int | None:
    """The page that a record id of our own names."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", uri or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def row(x: dict | None) -> tuple:
    """Values of SCHEMA of a record; None: all null but the type, which is invalid."""
    if x is None:
        return (None, None, None, None, "invalid", None, None, None, None)
    kind = x.get("warc-type")
    http = x.get("content-type", "application/http" if kind in ("response", "request", "revisit") else "").lower().startswith("application/http")
    top, found, rest = x["block"].partition(b"\r\n\r\n")
    payload = rest if http and found else b"" if http else x["block"]
    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", top + b"\r")
        size, digest, payload = int(length[1]) if length else None, x.get("warc-payload-digest", "").rpartition(":")[2] or None, None
    return (page(x.get("warc-record-id")), x.get("warc-target-uri"), size, digest, kind, page(x.get("warc-refers-to")), x.get("warc-record-id"), x.get("warc-date"), payload)


def _rows(contents: list[bytes]) -> pa.RecordBatch:
    out = [row(parse(x)) for x in contents]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(KINDS)], names=NAMES)


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = False, with_invalid: bool = False) -> DataFrame:
    """A row per record of the archives under path: page_id and refers_to (null unless the ids are pages of our own), url,
    payload_bytes, payload_digest, record_type, record_id, date.

    Payloads of HTTP records are what follows their HTTP head, those of others the block. Sizes and SHA-256 digests come from
    the payload that was read; a revisit has the length that its HTTP head states and the digest of its WARC header, or null.
    Members that begin like a record and aren't whole ones are left out, or rows of record_type `invalid` that can be
    counted; other members are left out. An archive without records, or an empty folder's, gives no rows.
    """
    pieces = spark.read.option("lineSep", "\u001f\u008b").option("encoding", "ISO-8859-1").text(path)
    pieces = pieces.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*NAMES, "file", "block", "early", "held", "whole"]
        kinds = [*KINDS, pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.bool_()]
        at_range, held, early, seen = None, [], [], False

        def close() -> Iterator[pa.RecordBatch]:
            if at_range is not None:
                values = [None] * len(NAMES) + [at_range[0], at_range[1], early, held, seen]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            files, blocks, raw = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_pylist()
            at = 0
            while at < len(raw):
                to = at + 1
                while to < len(raw) and to - at < 200 and files[to] == files[at] and blocks[to] == blocks[at]:
                    to += 1
                if at_range != (files[at], blocks[at]):
                    yield from close()
                    at_range, held, early, seen = (files[at], blocks[at]), [], [], False
                got, before, held = join_pieces([*held, *raw[at:to]])
                early = early if seen else early + before
                seen = seen or bool(got)
                out = _rows(got)
                columns = list(out.columns) if with_payload else [*out.columns[:-1], pa.nulls(out.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(out.num_rows, t) for t in kinds[len(NAMES) :])], names=names)
                at = to
        yield from close()

    scanned = materialize(pieces.mapInArrow(scan, SCHEMA + ", file string, block long, early array<binary>, held array<binary>, whole boolean"), "warc_scan")

    def stitch(key, table):
        contents: list[bytes] = []
        held: list[bytes] = []
        for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
            if r["whole"]:
                contents += join_pieces([*held, *r["early"]], final=True)[0]
                held = r["held"]
            else:
                held = [*held, *r["early"], *r["held"]]
        contents += join_pieces(held, final=True)[0]
        out = _rows(contents)
        return pa.Table.from_batches([out])

    cut = scanned.where("file is not null").select("file", "block", "early", "held", "whole")
    joined = cut.groupBy("file").applyInArrow(stitch, SCHEMA)
    whole = scanned.where("file is null").drop("file", "block", "early", "held", "whole").unionByName(joined)
    whole = whole if with_invalid else whole.where("record_type is null or record_type != 'invalid'")
    return whole if with_payload else whole.drop("payload")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write the archives of pages to the shared scratch folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
