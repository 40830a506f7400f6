"""Deterministic sharded WARC writer, and a reader of what it commits.

Records are range-sorted by id into shards whose bounds come from the data
alone (a bottom-k sample by hash, so the same rows give the same bounds on any
cluster). A task writes its shard as gzip members, one for each record, rolls
to a new file when the compressed size passes a limit, and regenerates every
header and digest. Files are written under temporary names that carry the
task attempt and are renamed when complete; the manifest, written last, commits
them. Readers see only files that the manifest lists. A task that runs again
renames the same bytes over the same names.

Scale. Payloads are shuffled once. Which records revisit another is settled on
digests alone; that join may be split where a digest is hot, and its rows reach
the writer sorted ahead of their page. Only shard bounds go to the driver, at
most ``MOST_SHARDS * SAMPLE`` ids.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch
from .blocks import blocks

MOST_SHARDS, SAMPLE = 16384, 16
LAST = 9223372036854775807  # rows without an id stand in the last shard
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOFTWARE = "gleanery"

MANIFEST = "file string, shard int, roll int, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = "record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root)


def _name(page: int | None) -> str:
    return "null" if page is None else str(page)


def _record_id(page: int | None, digest: str, k: int) -> str:
    return f"<urn:page:{_name(page)}:{digest[:16]}:{k}>"


def record(kind: str, record_id: str, block: bytes, headers: dict[str, str]) -> bytes:
    """One WARC record with regenerated length and block digest, as a gzip member without time stamp."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **headers, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(head.encode()) + c.compress(block) + c.compress(b"\r\n\r\n") + c.flush()


def page_record(page: int | None, k: int, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{_name(page)}", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    if first is None:
        return record("response", _record_id(page, digest, k), http + payload, headers)
    return record("revisit", _record_id(page, digest, k), http, headers | {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(first, digest, 0)})


class _Shard:
    """Writes one shard's files; hands out a manifest row for each."""

    def __init__(self, uri: str, shard: int, attempt: str, roll_bytes: int):
        self.fs, self.root = _fs(uri)
        self.shard, self.attempt, self.roll_bytes, self.roll, self.out = shard, attempt, roll_bytes, 0, None

    def put(self, page: int | None, data: bytes) -> Iterator[dict]:
        if self.out is not None and self.size + len(data) > self.roll_bytes:
            yield self.close()
        if self.out is None:
            self.name = f"pages-{self.shard:05d}-{self.roll:05d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{self.attempt}.tmp"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.first, self.hash = 0, 0, page, hashlib.sha256()
            info = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
            self._write(record("warcinfo", f"<urn:file:{self.name}>", info, {"WARC-Filename": self.name, "Content-Type": "application/warc-fields"}))
        self._write(data)
        self.records += 1
        self.last = page

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> dict:
        self.out.close()
        self._commit(f"{self.root}/{self.name}")
        row = {"file": self.name, "shard": self.shard, "roll": self.roll, "records": self.records, "bytes": self.size, "sha256": self.hash.hexdigest(), "first_id": self.first, "last_id": self.last}
        self.out, self.roll = None, self.roll + 1
        return row


    def _commit(self, target: str) -> None:
        """Renames the file; another attempt may have left the same bytes there already."""
        there = self.fs.get_file_info(target)
        if there.is_file and there.size != self.size:
            self.fs.delete_file(target)
        if not there.is_file or there.size != self.size:
            try:
                self.fs.move(self.temporary, target)
                return
            except OSError:
                if not self.fs.get_file_info(target).is_file:
                    raise
        self.fs.delete_file(self.temporary)


def _writer(uri: str, roll_bytes: int, schema: pa.Schema) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = str(TaskContext.get().taskAttemptId()) if TaskContext.get() else "0"
        shard: _Shard | None = None
        page, revisits, seen = None, {}, {}

        def rows() -> Iterator[dict]:
            nonlocal shard, page, revisits, seen
            for batch in blocks(batches, 5):
                for s, p, kind, digest, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if shard is None or shard.shard != s:
                        if shard is not None and shard.out is not None:
                            yield shard.close()
                        shard = _Shard(uri, s, attempt, roll_bytes)
                    if p != page:
                        page, revisits, seen = p, {}, {}
                    if kind == 0:
                        revisits[digest] = first
                        continue
                    k = seen[digest] = seen.get(digest, -1) + 1
                    yield from shard.put(p, page_record(p, k, url, payload, digest, revisits.get(digest)))
            if shard is not None and shard.out is not None:
                yield shard.close()

        for row in rows():
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return write


def write_archive(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, shard_bytes: int = 16 << 20, roll_bytes: int = 64 << 20) -> str:
    """Write a record for each row; return the folder, committed by its manifest.

    Of records with equal payloads of at least ``least_bytes`` bytes, those with
    the smallest id are responses and the others revisit it; smaller payloads
    are all responses.

    Defined cases. Null payload: empty. Null url: a URN of the id. A null id
    sorts last. Rows that repeat an id each get a record of their own. No rows:
    an empty manifest. Other input columns are not looked at. A shard holds
    about ``shard_bytes`` of payload, more where ``MOST_SHARDS`` is reached.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("p"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha2("payload", 256)
    size, ids = rows.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)), F.count("*")).first()
    shards = int(min(MOST_SHARDS, max(1, -(-size // shard_bytes), -(-ids // 1_000_000))))
    sample = rows.where("p IS NOT NULL").select("p").orderBy(F.xxhash64("p"), "p").limit(shards * SAMPLE)
    sampled = np.sort(np.array([r[0] for r in sample.collect()], np.int64))
    bounds = np.unique(sampled[np.arange(1, shards) * len(sampled) // shards]) if len(sampled) else sampled

    large = rows.where(F.octet_length("payload") >= least_bytes).select("p", F.unhex(digest).alias("d"))
    firsts = large.groupBy("d").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.bool_or(F.isnull("p")).alias("none")).where("first < last OR (none AND first IS NOT NULL)")
    # joined on another expression than it was grouped by: both sides then have exchanges that can be split
    revisits = large.withColumn("k", F.hex("d")).join(firsts.select(F.hex("d").alias("k"), "first"), "k").where("coalesce(p > first, true)").groupBy("p", F.lower("k").alias("digest")).agg(F.min("first").alias("first"))

    @F.pandas_udf("int")
    def shard_of(p: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, p.to_numpy(), "right").astype(np.int32))

    null = lambda t: F.lit(None).cast(t)
    both = rows.select("p", F.lit(1).alias("kind"), digest.alias("digest"), "url", "payload", null("long").alias("first")).unionByName(revisits.select("p", F.lit(0).alias("kind"), "digest", null("string").alias("url"), null("binary").alias("payload"), "first"))
    both = both.select(shard_of(F.coalesce("p", F.lit(LAST))).alias("shard"), "*").repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("p").asc_nulls_last(), "kind", "digest", "url")

    fs, root = _fs(uri)
    fs.create_dir(root, recursive=True)
    schema = T._parse_datatype_string(MANIFEST)
    manifest = both.mapInArrow(_writer(uri, roll_bytes, to_arrow_schema(schema)), schema)
    manifest.write.mode("error").parquet(f"{uri}/_manifest")
    for left in fs.get_file_info(_selector(root)):  # of attempts that didn't end
        if left.base_name.startswith(".pages-") and left.base_name.endswith(".tmp"):
            fs.delete_file(left.path)
    return uri


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open file of gzip members; one record is held at a time."""
    inflate, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            if parts:
                raise ValueError("the file ends inside a record")
            return
        parts.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            whole = b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            block = rest[: int(headers["Content-Length"])]
            if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
                raise ValueError(f"a damaged record: {headers.get('WARC-Record-ID')}")
            yield headers, block


def _page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return None if page == "null" else int(page)


def _reader(uri: str, schema: pa.Schema) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in read_records(stream):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"a damaged payload: {headers['WARC-Record-ID']}")
                        refers = headers.get("WARC-Refers-To")
                        rows.append({"record_type": kind, "page_id": _page_of(headers["WARC-Record-ID"]), "target_uri": headers["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "refers_to": _page_of(refers) if refers else None})
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def read_archive(spark: SparkSession, uri: str) -> DataFrame:
    """A row for each response and revisit record of a committed archive; digests are checked on the way."""
    from pyspark.sql.pandas.types import to_arrow_schema

    manifest = spark.read.parquet(f"{uri}/_manifest").select("file")
    schema = T._parse_datatype_string(RECORDS)
    return manifest.repartition(max(1, manifest.count()), "file").mapInArrow(_reader(uri, to_arrow_schema(schema)), schema)


def op6_warc(spark, sf_dir):
    uri = scratch(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    return read_archive(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""

QUERIES = {"op6_warc": op6_warc}
ORACLES = {"op6_warc": OP6_SQL}
