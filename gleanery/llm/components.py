"""Connected components of a distributed edge list.

Alternating large-star and small-star rounds: every node links its neighbours
to the smallest of them. Each half round is a minimum per node, pre-aggregated,
and a join that may be split where a node is hot; neighbour lists are never
collected. The rounds end when the edges no longer change. Before the first
one, tasks of ``CONTRACTED`` edges at most replace their edges by a forest of
stars that joins the same nodes, as their files lie.

A round is one job: it writes its edges to the shared folder and counts them as
it writes. What is read back has the statistics of its files; a checkpoint
keeps estimates of where it came from, which joins multiply round by round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut, remove, scratch

_REKEY = 0x27D4EB2F
MOST_ROUNDS = 60
CONTRACTED = 500_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that edges name, and the smallest that each reaches."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    return names, names[root]


def _contract(most: int) -> Callable:
    """Edges to fewer that join the same nodes; about ``most`` are held at once, whatever comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) > most:
                a, b = stars(a, b)
                if len(a) > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a = b = a[:0]
        if len(a):
            a, b = stars(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, roots = smallest_reached(a, b)
        return names[names != roots], roots[names != roots]

    return run


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over rows (a, b): each a's smallest neighbour m, itself counted, takes over.

    Large: a's larger neighbours and a itself link to m; small: all its (smaller) neighbours and a do.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    # another key expression than the aggregate's: both sides get exchanges that can be split
    least = least.select(F.col("a").bitwiseXOR(F.lit(_REKEY)).alias("k"), F.least("a", "m").alias("m"))
    rows = edges.withColumn("k", F.col("a").bitwiseXOR(F.lit(_REKEY))).join(least, "k")
    other = F.when((F.col("b") > F.col("a")) if large else (F.col("b") != F.col("m")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    own = F.when(F.col("m") < F.col("a"), F.struct("a", F.col("m").alias("b")))
    return rows.select(F.explode(F.array(other, own)).alias("e")).where("e IS NOT NULL").select("e.a", "e.b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the component's smallest node, as a number) of each node that an edge names."""
    spark = edges.sparkSession
    folder = scratch(spark, "components")

    def kept(e: DataFrame, number: int) -> tuple[DataFrame, tuple]:
        seen = Observation()
        e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).write.parquet(f"{folder}/{number}")
        return spark.read.schema("a long, b long").parquet(f"{folder}/{number}"), (seen.get["n"], seen.get["x"])

    e, now = kept(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), 0)
    if now[0]:
        # files are read side by side as they lie, no node is dealt anywhere
        e, now = kept(e.coalesce(-(-now[0] // CONTRACTED)).mapInArrow(_contract(CONTRACTED), "a long, b long"), -1)
        remove(spark, f"{folder}/0")
    for number in range(1, MOST_ROUNDS):
        if not now[0]:
            break
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        last = now
        e, now = kept(_star(_star(both, large=True), large=False), number)
        remove(spark, f"{folder}/{number - 1 or -1}")
        if now == last:
            break
    else:
        raise RuntimeError("components did not settle")
    out = cut(e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    remove(spark, folder)
    return out
