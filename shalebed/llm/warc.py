"""Operator 7: WARC archives with a two-level capture index.

write_archives puts one gzip member per record into shard files of the shared folder and returns a row per record.
build_index sorts reversed-host URL keys over range partitions into compressed blocks and keeps a sparse directory
(the first key of each run of blocks, at most max_directory of them, however large the archive). lookup finds a block
by binary search in the directory, the record by binary search in the block, and reads its range of the archive.

A shard's name is new on every attempt and rows name their shard, so a task that runs twice leaves a file that
nothing refers to, never a wrong record.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import keep, new_path, small_batches

MIN_BYTES, SALTS = 100, 8
DATE = "2020-01-01T00:00:00Z"  # pages carry no time of capture


def surt(url: str | None) -> str:
    """Reversed-host key of a url: com,example,www)/path?query (empty for null)."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").lower()
    except ValueError:
        return url
    tail = (u.path or "/") + ("?" + u.query if u.query else "")
    return ",".join(reversed(host.split("."))) + ")" + tail if host else url


def file_system(uri: str):
    """A pyarrow file system and path for the folder or file of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes, digest: str, first) -> bytes:
    """One gzip member: a response with its HTTP head and payload, or a revisit with the head alone that names the response's record."""
    kind = "response" if first is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if first is None else b"")
    clean = "".join(c for c in (url or "") if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}')}>", f"WARC-Refers-To-Page: {first}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(named fields, payload): what follows the HTTP head of the record's block."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


_WRITTEN = pa.schema([("key", pa.string()), ("seq", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _write(folder: str, shard_bytes: int):
    def run(batches):
        fs, base = file_system(folder)
        out = name = None
        at = 0
        try:
            for b in batches:
                rows = {f.name: [] for f in _WRITTEN}
                for page_id, url, html, digest, first in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    if out is None or at >= shard_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    m = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first)
                    out.write(m)
                    for k, v in (("key", surt(url)), ("seq", "" if page_id is None else f"{page_id:020d}"), ("file", name), ("offset", at), ("length", len(m))):
                        rows[k].append(v)
                    at += len(m)
                yield pa.RecordBatch.from_pydict(rows, schema=_WRITTEN)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = 256 << 20) -> DataFrame:
    """Archives in folder; a written table of (key, seq, file, offset, length), one row per record. Null html is empty."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    long_enough = F.octet_length("html") >= MIN_BYTES
    # a page is dealt over salts beside its digest, so that a payload of very many pages is no one task's work
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    firsts = keep(src.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "firsts")
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    joined = src.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(firsts.select("*", salted), ["digest", "salt"], "left")
    first = F.when(long_enough & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = joined.select("page_id", "url", "html", "digest", first.alias("first"))
    return keep(rows.mapInArrow(_write(folder, shard_bytes), "key string, seq string, file string, offset long, length long"), "records")


_BLOCK = pa.schema([("key", pa.string()), ("seq", pa.string()), ("last_key", pa.string()), ("last_seq", pa.string()), ("n", pa.int32()), ("blob", pa.binary())])


def _blocks(size: int):
    def run(batches):
        held: list = []

        def block(rows):
            blob = zlib.compress("\n".join(json.dumps(r) for r in rows).encode(), 6)
            return pa.RecordBatch.from_pydict({"key": [rows[0][0]], "seq": [rows[0][1]], "last_key": [rows[-1][0]], "last_seq": [rows[-1][1]], "n": [len(rows)], "blob": [blob]}, schema=_BLOCK)

        for b in batches:
            held += [list(r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            while len(held) >= size:
                yield block(held[:size])
                held = held[size:]
        if held:
            yield block(held)

    return run


def build_index(records: DataFrame, block_rows: int = 256, max_directory: int = 65_536) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(blocks, directory): blocks has a column `run`, the place of its run in the directory."""
    total = records.count()
    size = max(block_rows, -(-total // max_directory))
    runs = max(1, min(4096, -(-total // (size * 16))))
    dealt = records.repartitionByRange(runs, "key", "seq").sortWithinPartitions("key", "seq")
    blocks = keep(dealt.mapInArrow(_blocks(size), "key string, seq string, last_key string, last_seq string, n int, blob binary"), "blocks")
    directory = sorted((r["key"], r["seq"]) for r in blocks.select("key", "seq").collect())  # about max_directory rows at most
    return blocks, directory


def _run_of(directory_bc):
    """A request's run: the last block that starts at or before its key."""

    def run(batches):
        d = directory_bc.value
        for b in batches:
            at = [max(0, bisect.bisect_right(d, (k, s)) - 1) for k, s in zip(b.column("key").to_pylist(), b.column("seq").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "run"])

    return run


def _runs_of(directory_bc):
    """A block once for its first key's run and, where that is another one, for its last key's."""

    def run(batches):
        d = directory_bc.value
        place = lambda k, s: max(0, bisect.bisect_right(d, (k, s)) - 1)
        for b in batches:
            rows = b.to_pydict()
            out = [(r, blob) for k, s, lk, ls, blob in zip(*(rows[c] for c in ("key", "seq", "last_key", "last_seq", "blob")), strict=True) for r in {place(k, s), place(lk, ls)}]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["run", "blob"])

    return run


def _read(folder: str):
    """Of one block and the requests that fall in it: binary search, then range reads."""

    def run(key, requests, blocks):
        import pandas as pd

        fs, base = file_system(folder)
        open_files: dict = {}
        rows = []
        if len(requests):
            entries = sorted(tuple(json.loads(x)) for blob in blocks["blob"] for x in zlib.decompress(blob).decode().split("\n"))
            for k, s in zip(requests["key"], requests["seq"], strict=True):
                at = bisect.bisect_left(entries, (k, s))
                while at < len(entries) and entries[at][0] == k and entries[at][1] == s:
                    _, _, name, offset, length = entries[at]
                    at += 1
                    if name not in open_files:
                        if len(open_files) >= 64:
                            open_files.pop(next(iter(open_files))).close()
                        open_files[name] = fs.open_input_file(f"{base}/{name}")
                    f = open_files[name]
                    f.seek(offset)
                    head, body = parse_record(f.read(length))
                    digest = hashlib.sha256(body).hexdigest()
                    told = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = head["WARC-Type"]
                    if kind == "response" and (digest != told or len(body) != int(head["WARC-Payload-Length"])):
                        raise ValueError(f"{name}: the payload at {offset} is damaged")
                    page, to = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page")
                    rows.append((k, s, int(page) if page is not None else None, head["WARC-Target-URI"], int(head["WARC-Payload-Length"]), told, kind, int(to) if to is not None else None, body if kind == "response" else None))
            for f in open_files.values():
                f.close()
        names = ["key", "seq", "page_id", "target", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        out = pd.DataFrame(rows, columns=names)
        for c in ("page_id", "payload_bytes", "refers_to"):
            out[c] = out[c].astype("Int64")
        return out

    return run


def lookup(requests: DataFrame, blocks: DataFrame, directory: list[tuple[str, str]], folder: str, payloads: bool = True) -> DataFrame:
    """All records of the distinct (key, seq) requests, with their payloads (null for revisits)."""
    spark = requests.sparkSession
    bc = spark.sparkContext.broadcast(directory)
    asked = requests.select("key", "seq").distinct().mapInArrow(_run_of(bc), "key string, seq string, run int")
    # Equal (key, seq) may reach over a border of blocks: the block before it is also a part of the run that requests for it go to.
    held = blocks.select("key", "seq", "last_key", "last_seq", "blob").mapInArrow(_runs_of(bc), "run int, blob binary")
    found = asked.groupBy("run").cogroup(held.groupBy("run")).applyInPandas(_read(folder), "key string, seq string, page_id long, target string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return found if payloads else found.drop("payload")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_rows: int = 256) -> DataFrame:
    """Write archives, index them, read every record back by its key.

    One row per page: (id_col, payload_bytes, payload_digest, record_type, refers_to). Null html is an empty payload, null urls have the empty key.
    Rows that repeat an id share its key: each gets its record. A row that repeats the id of the response it equals is a response too.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    records = write_archives(pages, folder, id_col, url_col, html_col)
    blocks, directory = build_index(records, block_rows)
    requests = pages.select(F.col(url_col).alias("url"), F.col(id_col).cast("long").alias("page_id")).mapInArrow(_requests, "key string, seq string")
    found = lookup(requests, blocks, directory, folder, payloads=False)
    return found.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _requests(batches):
    schema = pa.schema([("key", pa.string()), ("seq", pa.string())])
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column(0).to_pylist()], pa.string()), pa.array(["" if p is None else f"{p:020d}" for p in b.column(1).to_pylist()], pa.string())], schema=schema)
