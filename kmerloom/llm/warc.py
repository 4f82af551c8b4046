"""WARC archives with a two-level capture index: sorted keys in compressed blocks, and a sparse block directory."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, materialise, shared_dir

#: Bytes after which a new archive begins, captures in a block of the index, and index shards at most.
ARCHIVE_BYTES, BLOCK_LINES, MAX_SHARDS = 1 << 30, 1000, 4096
RECORD = "urn:page:"


def url_key(url: Column) -> Column:
    """Reversed-host key: http://m.example.net/a?b#c becomes net,example,m)/a?b. Null and odd URLs sort under )."""
    u = F.coalesce(url, F.lit(""))
    split = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host, rest = F.lower(F.regexp_extract(u, split, 1)), F.regexp_extract(u, split, 2)
    return F.when(host == "", F.concat(F.lit(")"), u)).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest)))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI as Spark writes it; stores that pyarrow can't reach by themselves, such as viewfs, are an error."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    scheme, _, rest = uri.partition("://")
    if scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    elif scheme == "viewfs":
        raise ValueError(f"name the store behind {uri}: archives are written and read by pyarrow.fs")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _safe(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in value)


def build_record(page: str | None, url: str | None, payload: bytes, sha: str, refers: str | None, revisit: bool) -> bytes:
    """One gzip member; a revisit has the HTTP header alone, whose Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD}{'-' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_safe(url or '')}", f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers}>"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not fit its digest")
    bare = lambda x: None if x is None or (x := x.removeprefix(f"<{RECORD}").removesuffix(">")) == "-" else x
    return {"page": bare(h["WARC-Record-ID"]), "bytes": size, "sha": sha, "kind": h["WARC-Type"], "refers": bare(h.get("WARC-Refers-To")), "url": h["WARC-Target-URI"], "payload": payload}


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page, url, html, _first): the page that a record revisits, or null for a response.

    The first page of a payload is a pre-aggregated minimum, joined back by the payload's digest and size; the
    join's hot sides can be split. Payloads under `least` bytes, pages that share the smallest page_id, and
    payloads whose pages all have null ids are responses.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("_sha", F.sha1(F.col("html").cast("binary"))).withColumn("_n", F.octet_length("html"))
    first = p.groupBy("_sha", "_n").agg(F.min("page_id").alias("_first"))
    p = p.join(first, ["_sha", "_n"])
    again = (F.col("_n") >= least) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return p.select(F.col("page_id").cast("string").alias("page"), "url", url_key(F.col("url")).alias("key"), "html", F.when(again, F.col("_first").cast("string")).alias("_first"))


def write_archives(records: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; a table of captures (key, page, file, at, length).

    A file's name has the task attempt in it, so a capture always points into the file that its own attempt
    wrote, and attempts that failed leave files that nothing points to.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _fs(root)
        t = TaskContext.get()
        out, name, at, n = None, "", 0, 0
        try:
            for p in parts:
                rows = []
                for page, url, key, html, first in zip(p["page"], p["url"], p["key"], p["html"], p["_first"], strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(f"{base}/warc", recursive=True)
                        name, at, n = f"warc/{t.partitionId():05d}-{t.taskAttemptId()}-{n:04d}.warc.gz", 0, n + 1
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    payload = html.encode("utf-8", "surrogatepass")
                    member = build_record(page, url, payload, digest(payload), first, first is not None)
                    out.write(member)
                    rows.append((key, page, name, at, len(member)))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["key", "page", "file", "at", "length"])
        finally:
            if out is not None:
                out.close()

    return materialise(records.mapInPandas(run, "key string, page string, file string, at long, length long"), "captures")


def write_index(captures: DataFrame, root: str, shards: int, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Range-sort the captures by (key, page) into shards of compressed blocks, each with its block directory.

    Returns the sorted list of (first key, first page, shard, directory): a few words for each of at most
    MAX_SHARDS shards.
    """
    by = (F.col("key"), F.coalesce("page", F.lit("")))
    ordered = captures.repartitionByRange(min(shards, MAX_SHARDS), *by).sortWithinPartitions(*by, "file", "at")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _fs(root)
        t = TaskContext.get()
        name = f"index/{t.partitionId():05d}-{t.taskAttemptId()}"
        out, at, lines, directory = None, 0, [], []

        def flush() -> None:
            nonlocal at, lines
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            block = z.compress("\n".join(json.dumps(x) for x in lines).encode()) + z.flush()
            out.write(block)
            directory.append([lines[0][0], lines[0][1], at, len(block)])
            at, lines = at + len(block), []

        for p in parts:
            for x in zip(p["key"], p["page"], p["file"], p["at"], p["length"], strict=True):
                if out is None:
                    store.create_dir(f"{base}/index", recursive=True)
                    out = store.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
                lines.append([x[0], "" if x[1] is None else x[1], x[2], int(x[3]), int(x[4])])
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with store.open_output_stream(f"{base}/{name}.dir") as d:
                d.write("\n".join(json.dumps(x) for x in directory).encode())
            yield pd.DataFrame([(directory[0][0], directory[0][1], f"{name}.cdx.gz", f"{name}.dir")], columns=["key", "page", "shard", "dir"])

    got = ordered.mapInPandas(run, "key string, page string, shard string, dir string").collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0].encode(), r[1].encode()))


class Reader:
    """Finds captures by (key, page): binary search in the shards, the directory and the block, then range reads."""

    def __init__(self, root: str, shards: list[tuple]) -> None:
        self.store, self.base = _fs(root)
        self.shards = shards
        self.firsts = [(s[0].encode(), s[1].encode()) for s in shards]
        self.kept: dict[str, tuple] = {}
        self.files: dict[str, object] = {}

    def _range(self, name: str, at: int, length: int) -> bytes:
        f = self.files.get(name)
        if f is None:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            f = self.files[name] = self.store.open_input_file(f"{self.base}/{name}")
        f.seek(at)
        return f.read(length)

    def _directory(self, i: int) -> tuple[list, list]:
        if (have := self.kept.get("dir")) is None or have[0] != i:
            with self.store.open_input_stream(f"{self.base}/{self.shards[i][3]}") as d:
                rows = [json.loads(x) for x in d.read().decode().split("\n")]
            have = self.kept["dir"] = (i, rows, [(r[0].encode(), r[1].encode()) for r in rows])
        return have[1], have[2]

    def _block(self, i: int, j: int, row: list) -> list:
        if (have := self.kept.get("block")) is None or have[0] != (i, j):
            text = zlib.decompress(self._range(self.shards[i][2], row[2], row[3]), 31).decode()
            have = self.kept["block"] = ((i, j), [((x := json.loads(s))[0].encode(), x[1].encode(), *x[2:]) for s in text.split("\n")])
        return have[1]

    def find(self, key: str, page: str | None = None) -> Iterator[dict]:
        """All records under a key, or under a key and page ("" for pages without id)."""
        low = (key.encode(), (page or "").encode())
        i = max(0, bisect.bisect_left(self.firsts, low) - 1)
        for s in range(i, len(self.shards)):
            if s > i and self.firsts[s][0] > low[0]:
                return
            rows, firsts = self._directory(s)
            j = max(0, bisect.bisect_left(firsts, low) - 1)
            for b in range(j, len(rows)):
                if b > j and (firsts[b][0] > low[0] or page is not None and firsts[b] > low):
                    return
                lines = self._block(s, b, rows[b])
                for k in range(bisect.bisect_left(lines, low), len(lines)):
                    x = lines[k]
                    if x[0] != low[0] or page is not None and x[1] != low[1]:
                        return
                    yield parse_record(self._range(*x[2:]))


def read_back(wanted: DataFrame, root: str, shards: list[tuple], n: int) -> DataFrame:
    """Look up every (key, page) of `wanted` in the index; rows of the records found."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader(root, shards)
        for p in parts:
            rows = [(x["page"], x["bytes"], x["sha"], x["kind"], x["refers"]) for key, page in zip(p["key"], p["page"], strict=True) for x in r.find(key, page)]
            yield pd.DataFrame(rows, columns=["page", "payload_bytes", "payload_digest", "record_type", "refers"])

    ordered = wanted.repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page")
    return ordered.mapInPandas(run, "page string, payload_bytes long, payload_digest string, record_type string, refers string")


def archive_round_trip(pages: DataFrame, root: str | None = None, least: int = 0) -> DataFrame:
    """Write every page to archives, index them, and look every page up again.

    page_id, payload_bytes, payload_digest, record_type, refers_to; one row a page, repeated pages repeated.
    Html null is an empty payload. No pages: no archives, no rows.
    """
    spark = pages.sparkSession
    root = root or f"{shared_dir(spark).rstrip('/')}/kmerloom/archive-{uuid.uuid4().hex}"
    captures = write_archives(plan_records(pages, least), root)
    n = max(4, min(MAX_SHARDS, input_bytes(pages, "html") // (32 << 20)))
    shards = write_index(captures, root, n)
    wanted = captures.select("key", F.coalesce("page", F.lit("")).alias("page")).distinct()
    back = read_back(wanted, root, shards, n)
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))
