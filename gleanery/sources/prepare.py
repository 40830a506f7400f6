"""Files or table rows to sources and chunks: validate, hash, extract, split, identify."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import split_long
from ..functions.text import wikilinks
from ..operators.index import chunk_id, source_key
from ..session import spread
from . import html, markdown, office, pdf, structured, tree
from .formats import MAX_BYTES, Extracted, Unreadable, format_identity_of, format_of, valid_path


#: Format to reader; a reader takes bytes.
READERS: dict[str, Callable[[bytes], Extracted]] = {
    "markdown": markdown.read, "text": structured.read_text, "base": structured.read_base, "canvas": structured.read_canvas, "excalidraw": structured.read_excalidraw,
    "html": html.read, "docx": office.read_docx, "excel": office.read_excel, "pdf": pdf.read,
}
ROLE_FORMATS = ("html", "excel", "docx")

CHUNK = "struct<chunk_ix:int,heading_path:array<string>,content:string,role:string,locator:string>"
PREPARED = f"vault_id string, room string, path string, format string, coverage string, content_hash string, byte_length long, mtime long, title string, description string, status string, date string, tags array<string>, aliases array<string>, properties string, notices array<string>, chunks array<{CHUNK}>"


def extract(fmt: str | None, data: bytes | None, length: int) -> Extracted:
    """Any source; what can't be read says why in its coverage."""
    if fmt is None:
        return Extracted("unreadable", notices=["the format is unknown"])
    if data is None or length > MAX_BYTES:
        return Extracted("quarantined" if fmt == "html" else "unreadable", notices=["the source is too large"])
    try:
        return READERS[fmt](data)
    except Unreadable as e:
        return Extracted(e.coverage, notices=[str(e)])


def prepare_one(row: dict) -> dict:
    fmt, data = row["format"], row["content"]
    got = extract(fmt, data, row["byte_length"])
    told = markdown.compact(got.properties)
    chunks = []
    for s in got.sections:
        for part in split_long(s.content):
            chunks.append({"chunk_ix": len(chunks), "heading_path": s.headings, "content": part, "role": s.role, "locator": s.locator})
    title = got.title or told.get("title")
    if not chunks and got.coverage in ("complete", "partial") and (got.properties or title):
        chunks.append({"chunk_ix": 0, "heading_path": [], "content": "", "role": "primary", "locator": None})  # carries the metadata
    try:
        properties = json.dumps(got.properties, ensure_ascii=False, allow_nan=False, default=str) if fmt != "canvas" else "{}"
    except ValueError:
        properties = "{}"
    keep = {k: row[k] for k in ("vault_id", "room", "path", "format", "byte_length", "mtime")}
    return keep | {"coverage": got.coverage, "content_hash": hashlib.sha256(data).hexdigest() if data is not None else None, "title": title, "description": told.get("description"), "status": told.get("status"), "date": told.get("date"), "tags": told["tags"], "aliases": markdown.aliases(got.properties), "properties": properties, "notices": got.notices, "chunks": chunks}


def prepare(files: DataFrame) -> DataFrame:
    """A row per source from (vault_id, room, path, content, byte_length, mtime), with its chunks nested."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(PREPARED)
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for row in b.to_pylist():
                rows.append(prepare_one(row))
                size += row["byte_length"] or 0
                if size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    some = files.where(valid_path(F.col("path"))).select("vault_id", "room", "path", format_of(F.col("path")).alias("format"), F.when(F.col("byte_length") <= MAX_BYTES, F.col("content")).alias("content"), F.col("byte_length").cast("long"), F.col("mtime").cast("long"))
    # readers cost time by the source: tables of many small ones lie in few file splits
    out = spread(some, "vault_id", "path").mapInArrow(run, schema)
    return out.withColumns({"source_key": source_key(F.col("vault_id"), F.col("path")), "format_identity": format_identity_of(F.col("format")), "outcome": F.when(F.col("coverage").isin("complete", "partial"), "indexed").otherwise("skipped"), "chunk_count": F.size("chunks").cast("long")})


def chunks(sources: DataFrame) -> DataFrame:
    """The chunk table of prepared sources. Which sections lose their boosts is the index's matter: a hit shows its headings."""
    c = sources.select("source_key", "vault_id", "room", "path", "format", "coverage", "mtime", "title", "description", "status", "date", "tags", "aliases", "properties", F.explode("chunks").alias("c"))
    role = F.when(F.col("format").isin(*ROLE_FORMATS), F.col("c.role"))
    return c.select(
        chunk_id(F.col("vault_id"), F.col("path"), F.col("c.heading_path"), F.col("c.chunk_ix"), role).alias("chunk_id"),
        "source_key", "vault_id", "room", "path", "format", "coverage", "mtime", "title", "description", "status", "date", "tags", "aliases",
        F.col("c.chunk_ix").alias("chunk_ix"), F.col("c.heading_path").alias("heading_path"),
        F.col("c.content").alias("content"), F.col("c.role").alias("role"), F.col("c.locator").alias("locator"), wikilinks(F.col("c.content")).alias("links_out"),
    )


def read_tree(spark: SparkSession, root: str, vault_id: str, room: str | None = None) -> DataFrame:
    """Files under a folder as rows for ``prepare``: those that enumeration finds and whose extension is known.

    Files that changed while they were read are left out; what is known of them stands (``tree.retained_rows``).
    """
    listed = tree.enumerate_tree(spark, root)
    rows = tree.read_files(listed.where(format_of(F.col("path")).isNotNull()), root).where("NOT transient")
    return rows.select(F.lit(vault_id).alias("vault_id"), F.lit(room).cast("string").alias("room"), "path", "content", "byte_length", "mtime")


def pages_as_files(pages: DataFrame) -> DataFrame:
    """The driver's web pages as HTML sources."""
    data = F.col("html").cast("binary")
    return pages.select(F.lit("web").alias("vault_id"), F.lit(None).cast("string").alias("room"), F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), data.alias("content"), F.octet_length(data).cast("long").alias("byte_length"), F.lit(0).cast("long").alias("mtime"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    data = F.col("text").cast("binary")
    return docs.select(F.col("source").alias("vault_id"), F.col("lang").alias("room"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), data.alias("content"), F.octet_length(data).cast("long").alias("byte_length"), F.lit(0).cast("long").alias("mtime"))


def conversations_as_files(turns: DataFrame) -> DataFrame:
    """A Markdown source per turn: conversation and role are its headings."""
    body = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n## "), "role", F.lit("\n\n"), F.coalesce("text", F.lit(""))).cast("binary")
    return turns.select(F.lit("talk").alias("vault_id"), F.col("role").alias("room"), F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".md")).alias("path"), body.alias("content"), F.octet_length(body).cast("long").alias("byte_length"), F.lit(0).cast("long").alias("mtime"))
