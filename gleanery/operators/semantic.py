"""Exact nearest neighbours, reciprocal-rank fusion, vector upkeep.

Queries are few and bounded by the caller; the vectors stay where they are and
every task keeps its own best ``k`` before anything moves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.text import sized_digest
from .index import embedding_text

RRF_K, LEG = 60, 100


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def knn(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by rank; score is 1 - distance, or the cosine. Ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = 1 - l2(F.col(vector_col), q) if metric == "l2" else cosine(F.col(vector_col), q)
    rows = vectors.where(F.size(vector_col) == len(query)).select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def knn_batch(vectors: DataFrame, queries: dict[int, list[float]], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact L2 neighbours of a bounded set of query vectors in one pass: blocked products, each task sends its best ``k``."""
    names, q = list(queries), np.array(list(queries.values()), float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_i = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            d = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0)
            d, i = np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(b.column(0).to_numpy(), (len(q), b.num_rows))])
            order = np.lexsort((i, d))[:, :k] if d.ndim == 2 else None
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        n = best_d.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n), pa.int64()), pa.array(best_i.ravel(), pa.int64()), pa.array(np.sqrt(best_d).ravel())], names=["query_id", id_col, "distance"])

    found = vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, f"query_id long, {id_col} long, distance double")
    found = found.withColumn("distance", F.round("distance", 6))
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K, limit: int = 20, key: str = "chunk_id") -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists of (key, rank); rank 0 stands for a list that lacks the key."""
    a, b = lexical.select(key, F.col("rank").alias("r1")), semantic.select(key, F.col("rank").alias("r2"))
    part = lambda r: F.coalesce(1 / (k + F.col(r)), F.lit(0.0))
    rows = a.join(b, key, "full_outer").select(key, F.coalesce("r1", F.lit(0)).alias("r1"), F.coalesce("r2", F.lit(0)).alias("r2"), F.round(part("r1") + part("r2"), 9).alias("score"))
    rows = rows.orderBy(F.desc("score"), key).limit(limit)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def _hashed(text: str | None) -> list[float]:
    v = np.zeros(32)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % 32] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


@arrow_udf(T.ArrayType(T.FloatType()))
def hash_embedding(texts: pa.Array) -> pa.Array:
    """A deterministic 32-dimensional stand-in for a model: signed hashed words, unit length."""
    return pa.array([_hashed(t) for t in texts.to_pylist()], pa.list_(pa.float32()))


def source_identity(content_hash: Column, identity: Column) -> Column:
    """What a source's vectors were made of: equal identities need no new vectors."""
    return sized_digest("gleanery embedding source 1", content_hash, identity)


@dataclass(frozen=True)
class EmbedderProfile:
    """Which model made vectors; vectors of another profile are dropped whole."""

    name: str
    dimensions: int
    version: str = "1"

    @property
    def fingerprint(self) -> str:
        return f"{self.name}/{self.version}/{self.dimensions}"


class Embedder:
    """The one pluggable function: passages are a column, a query is one text. Subclasses say how."""

    profile: EmbedderProfile

    def passages(self, text: Column) -> Column:
        raise NotImplementedError

    def query(self, text: str) -> list[float]:
        raise NotImplementedError


class HashEmbedder(Embedder):
    """Signed hashed words; a stand-in that needs no model."""

    profile = EmbedderProfile("hash", 32)

    def passages(self, text: Column) -> Column:
        return hash_embedding(text)

    def query(self, text: str) -> list[float]:
        return _hashed(text)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_id, source_key, fingerprint, embedding); vectors of another length than the profile's are left out."""
    text = embedding_text(F.col("heading_path"), F.col("content"))
    rows = chunks.select("chunk_id", "source_key", F.lit(embedder.profile.fingerprint).alias("fingerprint"), embedder.passages(text).alias("embedding"))
    return rows.where(F.size("embedding") == embedder.profile.dimensions)


def replace_vectors(vectors: DataFrame, changed: DataFrame) -> DataFrame:
    """Vectors with those of changed sources replaced; a source with an equal identity is left as it is."""
    same = vectors.select("source_key", "source_identity").distinct()
    new = changed.join(same, ["source_key", "source_identity"], "left_anti")
    return vectors.join(new.select("source_key").distinct(), "source_key", "left_anti").unionByName(new.select(*vectors.columns))


def retain_vectors(vectors: DataFrame, live: DataFrame) -> DataFrame:
    return vectors.join(live.select("source_key").distinct(), "source_key", "left_semi")


def fingerprint_matches(vectors: DataFrame, fingerprint: str) -> DataFrame:
    """Vectors of another embedder are all dropped."""
    return vectors.where(F.col("fingerprint") == fingerprint)
