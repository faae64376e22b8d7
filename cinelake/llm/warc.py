"""Operator 2, WARC archives with a two-level capture index: compressed blocks of sorted keys under a sparse directory."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import materialize, scratch_path, slices

#: Bytes at which a task starts another archive, and of records that a task reads; lines of an index block; captures of an index part.
ARCHIVE_BYTES, READ_BYTES, BLOCK_LINES, PART_LINES = 1 << 28, 1 << 22, 1_000, 100_000
#: Rows of one payload are dealt to so many groups when they learn which capture holds it.
SALTS = 16
#: Date of every capture whose rows have none.
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "page_id long, url string, file string, offset long, length long"


def surt(url: str | None) -> str:
    """The sort-friendly key of a URL: host labels reversed and joined by commas, then `)` and path with query; scheme, `www.`, default ports and fragment don't count."""
    if not url:
        return ")/"
    try:
        parts = urlsplit(url.strip() if "://" in url else "//" + url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")/" + re.sub(r"\s", "%20", url)
    host = re.sub(r"^www\d*\.", "", host)
    labels = ",".join(reversed(host.split("."))) if host else ""
    where = labels + (f":{port}" if port and port not in (80, 443) else "")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", "%20", f"{where}){rest.lower()}")


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str = "") -> bytes:
    """One WARC record, whose id is made of the page's and of `place`. A revisit keeps the HTTP head, whose Content-Length is the full payload's, and names the page it repeats."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}{'#' * bool(place)}{place}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        lines.insert(3, "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if refers_to is not None:
        lines[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers in lower case, `http` (head) and `payload` of one record. Raises ValueError where lengths don't agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(out["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length and its block differ")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return out | {"http": http, "payload": payload}


def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to): for rows whose payload another one with a larger id has, the largest such id.

    Payloads below `least_bytes` and rows without id refer to nothing. Only digests are grouped; the
    rows of a payload that many pages have are dealt by salt to several tasks.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    often = (
        rows.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= least_bytes)).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    refers = F.when((F.col("last") > F.col("page_id")), F.col("last"))
    return rows.join(often, ["digest", "salt"], "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of with_revisits() as .warc.gz files, a gzip member for each record, and returns the manifest.

    Each attempt of a task writes files of its own names; only those that a successful attempt's
    manifest rows name are ever read, so repeated and lost tasks do no harm. The folder is a URI that
    pyarrow opens (file, hdfs, s3, gs).
    """

    def run(batches):
        where, root = _filesystem(folder)
        out, name, at = None, "", 0
        for batch in slices(batches, "html"):
            found = []
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    where.create_dir(root, recursive=True)
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, f"{name}:{at}"), 6, mtime=0)
                out.write(member)
                found.append((page_id, url, name, at, len(member)))
                at += len(member)
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["page_id", "url", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialize(rows.mapInArrow(run, SCHEMA), "manifest")[0]


def with_keys(df: DataFrame) -> DataFrame:
    """Adds `key`: the SURT key, a space and the id in 20 digits."""

    def run(batches):
        for batch in batches:
            keys = [f"{surt(u)} {'' if i is None else f'{i + (1 << 63):020d}'}" for u, i in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], [*batch.schema.names, "key"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", key string")


class CaptureIndex:
    """Captures in the order of their keys: files of compressed blocks of lines under `folder`, and over them a sparse directory.

    A line is key, file, offset and length of a capture, so captures that share a key are told
    apart, and may lie in several blocks and parts. `directory` is a table (part, block, first,
    index_file, start, size) of blocks, `firsts` the first line of each part (of PART_LINES captures).
    Both steps are binary searches: from `firsts` to parts, and in a part's task from the first
    lines of its blocks to the blocks that are then read by range.
    """

    def __init__(self, manifest: DataFrame):
        parts = max(1, -(-manifest.count() // PART_LINES))
        line = F.concat_ws("\t", "key", "file", F.lpad(F.col("offset").cast("string"), 20, "0"), "length")
        ordered = with_keys(manifest).select(line.alias("line")).repartitionByRange(parts, "line").sortWithinPartitions("line").withColumn("part", F.spark_partition_id())
        folder = self.folder = scratch_path(manifest.sparkSession, "capture-index")

        def run(batches):
            where, root = _filesystem(folder)
            name, out, at, held, block, part = f"{uuid.uuid4().hex}.idx", None, 0, [], 0, 0

            def packed():
                nonlocal out, at, block
                if out is None:
                    where.create_dir(root, recursive=True)
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                data = zlib.compress("\n".join(held).encode("utf-8", "surrogatepass"), 6)
                out.write(data)
                row = (part, block, held[0], name, at, len(data))
                at, block = at + len(data), block + 1
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["part", "block", "first", "index_file", "start", "size"])

            for batch in batches:
                for text, part in zip(batch.column("line").to_pylist(), batch.column("part").to_pylist()):
                    held.append(text)
                    if len(held) == BLOCK_LINES:
                        yield packed()
                        held.clear()
            if held:
                yield packed()
            if out is not None:
                out.close()

        self.directory, _ = materialize(ordered.mapInArrow(run, "part int, block int, first string, index_file string, start long, size long"), "directory")
        self.firsts = sorted((r.first, r.part) for r in self.directory.filter("block = 0").select("first", "part").collect())

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """For the different (page_id, url) of `wanted` all captures: page_id, url, file, offset and length. Those that the index doesn't have have no row."""
        firsts, folder = self.firsts, self.folder
        keyed = with_keys(wanted.select("page_id", "url").distinct())

        def route(batches):
            names = [first for first, _ in firsts]
            for batch in batches:
                keys = batch.column("key").to_pylist()
                # captures of a key may begin in the part before the first line that has it
                spans = [(max(bisect_right(names, key + "\t") - 1, 0), bisect_right(names, key + "\t\U0010ffff")) for key in keys]
                rows = np.repeat(np.arange(len(keys)), [max(b - a, 0) for a, b in spans])
                parts = pa.array([firsts[i][1] for a, b in spans for i in range(a, b)], pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), parts], [*batch.schema.names, "part"])

        def probe(key: tuple, asked: pa.Table, blocks: pa.Table) -> pa.Table:
            where, root = _filesystem(folder)
            order = sorted(zip(*(blocks.column(c).to_pylist() for c in ("first", "index_file", "start", "size"))))
            directory, opened, lines, source, out = [f for f, *_ in order], -1, [], None, []
            for k, page_id, url in sorted(zip(*(asked.column(c).to_pylist() for c in ("key", "page_id", "url"))), key=lambda r: r[0]):
                for at in range(max(bisect_right(directory, k + "\t") - 1, 0), bisect_right(directory, k + "\t\U0010ffff")):
                    if at != opened:  # keys come in order: one block is open at a time
                        _, name, start, size = order[at]
                        source = source or where.open_input_file(f"{root}/{name}")  # a part has one file
                        source.seek(start)
                        opened, lines = at, zlib.decompress(source.read(size)).decode("utf-8", "surrogatepass").split("\n")
                    for i in range(bisect_right(lines, k + "\t"), len(lines)):
                        if not lines[i].startswith(k + "\t"):
                            break
                        _, file, offset, length = lines[i].split("\t")
                        out.append((page_id, url, file, int(offset), int(length)))
            columns = list(zip(*out)) or [()] * 5
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["page_id", "url", "file", "offset", "length"])

        routed = keyed.mapInArrow(route, "page_id long, url string, key string, part int")
        return routed.groupBy("part").cogroup(self.directory.groupBy("part")).applyInArrow(probe, SCHEMA)


def read_records(found: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, payload, refers_to), each from a range read of its archive.

    The payload of a revisit is null; its digest and length are those its record states. A stated
    digest that the payload of a response doesn't have raises an error.
    """

    def run(batches):
        where, root = _filesystem(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for page_id, url, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "file", "offset", "length"))):
                if file != name:
                    name, source = file, where.open_input_file(f"{root}/{file}")
                source.seek(offset)
                r = parse_record(gzip.decompress(source.read(length)))
                digest = r["warc-payload-digest"].removeprefix("sha1:")
                payload = r["payload"] if r["warc-type"] == "response" else None
                if payload is not None and base32_digest(payload) != digest:
                    raise ValueError(f"the payload of page {page_id} differs from its digest")
                size = int(re.search(rb"(?i)content-length: (\d+)", r["http"])[1])
                refers = re.fullmatch(r"<urn:page:(-?\d+)>", r.get("warc-refers-to", ""))
                own = re.match(r"<urn:page:(-?\d+)[#>]", r["warc-record-id"])
                rows.append((int(own[1]) if own else None, r.get("warc-target-uri"), r["warc-type"], digest, size, payload, int(refers[1]) if refers else None))
            columns = list(zip(*rows)) or [()] * 7
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "payload", "refers_to"])

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, payload binary, refers_to long"
    captures, _ = materialize(found, "captures")
    tasks = max(1, -(-(captures.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    return captures.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row, indexes the archives, looks every row up and reads its record back.

    Null html is an empty payload, null urls share the key `)/`; rows with a null id are responses.
    Rows that repeat an id, or have none, have a record each, and get their own record's values. Other columns don't matter.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(with_revisits(pages, least_bytes, id_col, url_col, html_col), folder)
    index = CaptureIndex(manifest)
    return read_records(index.lookup(manifest), folder)
