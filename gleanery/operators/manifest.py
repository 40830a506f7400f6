"""Incremental maintenance: manifests, decisions, deletion inference, generations."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sized_digest
from . import index

RACY_SECONDS = 2
KEPT_GENERATIONS = 3
AUDIT_SOURCES, AUDIT_BYTES = 16, 64 << 20
MAX_BYTES = 10 << 20


def observation(mode: str = "metadata_audit") -> Column:
    """Why a source is read again; null: its recorded facts stand.

    Columns of the old manifest are prefixed ``old_``. ``strict_hash`` reads
    everything; ``metadata_audit`` the first of these that holds.
    """
    if mode == "strict_hash":
        return F.lit("strict_hash")
    racy = F.col("observed_at") - F.col("mtime") <= RACY_SECONDS  # a time to come as well
    return (
        F.when(F.col("old_source_key").isNull(), "new")
        .when(~F.col("path").eqNullSafe(F.col("old_path")), "moved")
        .when(~F.col("registration").eqNullSafe(F.col("old_registration")), "registration")
        .when(~F.col("format_identity").eqNullSafe(F.col("old_format_identity")), "format_identity")
        .when(F.col("byte_length") != F.col("old_byte_length"), "size")
        .when(F.col("mtime") != F.col("old_mtime"), "mtime")
        .when(F.col("touched"), "event")
        .when(F.col("old_content_hash").isNull(), "backfill")
        .when(racy, "racy")
    )


def decision() -> Column:
    """What a read source means for the index, the first that holds."""
    return (
        F.when(F.col("old_source_key").isNull(), "new")
        .when(~F.col("room").eqNullSafe(F.col("old_room")), "resource_changed")
        .when(~F.col("registration").eqNullSafe(F.col("old_registration")), "registration_changed")
        .when(~F.col("format_identity").eqNullSafe(F.col("old_format_identity")), "format_identity_changed")
        .when(~F.col("outcome").eqNullSafe(F.col("old_outcome")), "outcome_changed")
        .when(~F.col("content_hash").eqNullSafe(F.col("old_content_hash")), "content_changed")
        .otherwise("unchanged")
    )


def manifest_diff(old: DataFrame, new: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """Each source of either manifest with its change: added, changed, unchanged, removed or retained.

    ``complete`` (vault_id, complete) says whose enumeration can be trusted:
    sources missing from a vault without it are retained, not removed.
    """
    a = old.select("source_key", F.col("vault_id").alias("old_vault"), F.col("content_hash").alias("old_hash"))
    b = new.select("source_key", F.col("vault_id").alias("new_vault"), F.col("content_hash").alias("new_hash"))
    rows = a.join(b, "source_key", "full_outer").withColumn("vault_id", F.coalesce("new_vault", "old_vault"))
    trusted = F.lit(True)
    if complete is not None:
        rows = rows.join(complete.select("vault_id", "complete"), "vault_id", "left")
        trusted = F.coalesce("complete", F.lit(False))
    change = F.when(F.col("old_vault").isNull(), "added").when(F.col("new_vault").isNull() & trusted, "removed").when(F.col("new_vault").isNull(), "retained").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return rows.select("source_key", "vault_id", change.alias("change"))


def reconcile(old: DataFrame, new: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """The manifest after a pass: new rows, and old rows that are retained."""
    kept = manifest_diff(old, new, complete).where("change = 'retained'").select("source_key")
    return new.unionByName(old.join(kept, "source_key", "left_semi").select(*new.columns))


def adopt(manifest: DataFrame, identities: DataFrame) -> DataFrame:
    """Rows whose format identity is still the current one; a null identity never is."""
    return manifest.join(identities.select("format", "format_identity"), ["format", "format_identity"], "left_semi")


def rolling_audit(candidates: DataFrame, after: str | None, sources: int = AUDIT_SOURCES, budget: int = AUDIT_BYTES) -> list[str]:
    """The next sources to read again behind a cursor, wrapping round; one too large for what is left is passed over.

    Each look is at the next few rows that fit what is left, so it finds one at
    least: there are no more looks than ``sources`` and two.
    """
    out, left = [], budget
    for here in (F.col("source_key") > (after or ""), F.col("source_key") <= (after or "")):
        last = F.lit(True)
        while len(out) < sources:
            want = sources - len(out)
            rows = candidates.where(here & last & (F.col("byte_length") <= left)).orderBy("source_key").limit(want).select("source_key", "byte_length").collect()
            for r in rows:
                if r.byte_length <= left:
                    out.append(r.source_key)
                    left -= r.byte_length
            if len(rows) < want:
                break
            last = F.col("source_key") > rows[-1].source_key
    return out


def with_scope(candidates: DataFrame, touched: DataFrame, audited: list[str] = ()) -> DataFrame:
    """Every candidate, and which of them a pass must read: touched paths and those whose turn in the audit it is.

    A scope adds reads and never leaves a candidate out. ``touched``: (vault_id, path).
    """
    named = touched.select(F.col("vault_id").alias("__v"), F.col("path").alias("__p")).distinct()
    rows = candidates.join(named, (F.col("vault_id") == F.col("__v")) & (F.col("path") == F.col("__p")), "left")
    forced = F.col("__p").isNotNull() | (F.col("source_key").isin(list(audited)) if audited else F.lit(False))
    return rows.withColumn("touched", forced).drop("__v", "__p")


def coverage_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("format", "coverage").agg(F.count("*").alias("n_sources"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """One row: indexed documents and all chunks."""
    return manifest.agg(F.count_if(F.col("outcome") == "indexed").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"))


def registration_fingerprint(vault: Column, root: Column, room: Column) -> Column:
    """Changes when a vault's id, folder or room does."""
    return sized_digest("gleanery registration 1", vault, root, F.coalesce(room, F.lit("")))


MANIFEST_COLUMNS = ("source_key", "vault_id", "path", "format", "format_identity", "outcome", "content_hash", "byte_length", "chunk_count")


def load_manifest(manifest: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """A stored manifest as a pass may use it: checked, and without rows of an outdated format identity.

    Raises where a column is missing, a source stands twice, or a row is
    neither indexed nor skipped, has a negative count, or was skipped with chunks.
    """
    if missing := [c for c in MANIFEST_COLUMNS if c not in manifest.columns]:
        raise ValueError(f"the manifest lacks {missing}")
    bad = ~F.col("outcome").isin("indexed", "skipped") | (F.col("chunk_count") < 0) | ((F.col("outcome") == "skipped") & (F.col("chunk_count") > 0)) | F.col("source_key").isNull() | F.col("outcome").isNull()
    wrong, rows = manifest.agg(F.count_if(bad), F.count("*")).first()
    if wrong:
        raise ValueError(f"{wrong} rows of the manifest contradict themselves")
    if not manifest.groupBy("source_key").count().where("count > 1").isEmpty():
        raise ValueError("a source stands twice in the manifest")
    return manifest if identities is None else adopt(manifest, identities)


def vault_status(sources: DataFrame) -> DataFrame:
    return sources.groupBy("vault_id").agg(F.count("*").alias("documents"), F.sum("chunk_count").cast("long").alias("chunks"), F.count_if(F.col("coverage") != "complete").alias("warnings"))


# Generations


def partition_id(tenant: str, vault: str, room: str | None) -> str:
    """The folder of a resource: tenant, vault and room, each with its length, in one digest."""
    parts = [x.encode() for x in (tenant, vault, room or "")]
    return "p" + hashlib.sha256(b"gleanery partition 1\n" + b"".join(str(len(x)).encode() + b":" + x for x in parts)).hexdigest()[:32]


def with_partition(frame: DataFrame, tenant: str = "local") -> DataFrame:
    """The same id as a column, of rows with vault_id and room."""
    digest = sized_digest("gleanery partition 1", F.lit(tenant), F.col("vault_id"), F.coalesce(F.col("room"), F.lit("")))
    return frame.withColumn(PARTITION, F.concat(F.lit("p"), F.left(digest, F.lit(32))))


PARTITION = "partition_id"


class Generations:
    """Immutable versions of the index's tables under one folder, and a pointer that is replaced as a whole.

    Readers that opened a version keep it; the newest ``KEPT_GENERATIONS`` stay.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files = hadoop.FileContext.getFileContext(path.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _rename(self, old: str, new: str, overwrite: bool) -> None:
        """In one step; without ``overwrite`` it fails where the new name is taken."""
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if overwrite else kind.NONE
        qualified = lambda n: self.fs.makeQualified(self._path(n))
        self.files.rename(qualified(old), qualified(new), how)

    def publish(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, sort_by: dict[str, tuple[str, ...]] | None = None) -> str:
        """Write a candidate, validate it, rename it into place, then move the pointer and drop old versions.

        A table may be a function that makes it of those written before it. Publishers that race take different numbers;
        the pointer goes to the one that moves it last.
        """
        candidate = f"candidate-{uuid.uuid4().hex}"
        written = lambda t: self.spark.read.parquet(f"{self.root}/{candidate}/{t}")
        for table, frame in tables.items():
            frame = frame(written) if callable(frame) else frame
            folders, order = (partition_by or {}).get(table, []), (sort_by or {}).get(table, ())
            if order:
                # each task sorts what it made: a key's rows stand in a row group of each file, and nothing is shuffled
                # (ranges would make every table twice, once to find their bounds)
                frame = frame.sortWithinPartitions(*folders, *order)
            writer = frame.write.partitionBy(*folders) if folders else frame.write
            writer.parquet(f"{self.root}/{candidate}/{table}")
        if "sources" in tables and "chunks" in tables:
            told = self.spark.read.parquet(f"{self.root}/{candidate}/sources").agg(F.sum("chunk_count")).first()[0] or 0
            held = self.spark.read.parquet(f"{self.root}/{candidate}/chunks").count()
            if told != held:
                self.fs.delete(self._path(candidate), True)
                raise ValueError(f"sources tell of {told} chunks, there are {held}")
        name = self._place(candidate)
        self._point(name)
        for old in self.list()[:-KEPT_GENERATIONS]:
            self.fs.delete(self._path(old), True)
        return name

    def _place(self, candidate: str) -> str:
        while True:
            number = max([0, *(int(g.split("-")[1]) for g in self.list())]) + 1
            name = f"gen-{number:08d}"
            try:
                self._rename(candidate, name, overwrite=False)
                return name
            except Exception as e:  # Java's; another publisher may have taken the number
                if not self.fs.exists(self._path(name)):
                    raise OSError(f"{candidate} can't be renamed") from e

    def _point(self, name: str) -> None:
        temporary = f".current-{uuid.uuid4().hex}"
        out = self.fs.create(self._path(temporary), True)
        out.write(bytearray(json.dumps({"generation": name}).encode()))
        out.close()
        self._rename(temporary, "current.json", overwrite=True)

    def list(self) -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        return sorted(n for s in self.fs.listStatus(self._path("")) if (n := s.getPath().getName()).startswith("gen-"))

    def current(self) -> str | None:
        """The pointer's version; without a pointer, the newest complete one."""
        if self.fs.exists(self._path("current.json")):
            return json.loads(self.spark.read.text(f"{self.root}/current.json", wholetext=True).first()[0])["generation"]
        return (self.list() or [None])[-1]

    def read(self, table: str, generation: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{generation or self.current()}/{table}")

    def reader(self, generation: str | None = None):
        """Tables of one version by name, whatever is published meanwhile."""
        held = generation or self.current()
        return lambda table: self.read(table, held)

    def publish_index(self, sources: DataFrame, chunks: DataFrame, tenant: str = "local") -> str:
        """Sources, chunks and all that a query reads, in folders of resources."""
        placed = with_partition(chunks, tenant)  # a chunk's folder is worked out once, not for each of its postings
        made = {k: v if PARTITION in v.columns else with_partition(v, tenant) for k, v in index.tables(placed, (PARTITION,)).items()}
        frames = {"sources": sources, "chunks": placed, **made}
        return self.publish(frames, dict.fromkeys(("chunks", *made), [PARTITION]), {**index.STORED, "chunks": ("chunk_id",)})


def retained(generations: DataFrame, kept: int = KEPT_GENERATIONS) -> DataFrame:
    """The newest valid versions of a table of them."""
    return generations.where("valid").withColumn("nth", F.row_number().over(Window.orderBy(F.desc("generation")))).where(F.col("nth") <= kept).drop("nth")


def check_integrity(chunks: DataFrame, postings: DataFrame, sources: DataFrame) -> dict[str, int]:
    """Counts that must all be 0: rows without their counterpart, and repeated ids."""
    return {
        "postings_without_chunk": postings.select("chunk_id").distinct().join(chunks, "chunk_id", "left_anti").count(),
        "chunks_without_source": chunks.join(sources, "source_key", "left_anti").count(),
        "sources_without_chunk": sources.where("chunk_count > 0").join(chunks, "source_key", "left_anti").count() if "chunk_count" in sources.columns else 0,
        "repeated_chunks": chunks.groupBy("chunk_id").count().where("count > 1").count(),
    }
