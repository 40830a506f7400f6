"""Approximate nearest neighbours by largest inner product.

A hierarchical k-means tree is trained on a bounded sample and indexes every
vector. A query walks it best bin first: a priority queue holds branches by the
distance of their centres, the nearest is opened, and leaves are visited until
the calibrated number is reached. Calibration widens that number until, on
sampled queries answered exactly, the visited leaves hold ``recall`` of the true
neighbours.

Inner product becomes distance by one more coordinate: a vector x gets
sqrt(m^2 - |x|^2), m the largest norm, and a query 0.

Scale. Equal vectors are one index entry, named by 128 bits, that keeps its
``k + 1`` smallest ids, cut down on the map side, so copies cost nothing and
lose nothing. Leaves that
follow each other in the tree share a bucket of about ``BUCKET`` entries (a
larger leaf is dealt over several); a query goes to each bucket that it visits
once, with the leaves to look at there, and queries stream past the bucket. The
tree has about as many leaves as the square root of the entries and is bounded
by its sample (``SAMPLE`` vectors), whatever the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .blocks import tidy

#: The bounded, documented sample that the tree is fitted on, and that of calibration queries.
SAMPLE, CALIBRATION = 65536, 200
BRANCHES, LEAST_LEAF, BUCKET = 16, 32, 4096
BATCH = 128  # queries of a bucket that are answered together


@dataclass
class Tree:
    """Nodes in arrays: a node's children are ``first[n] .. first[n] + count[n]``; none: a leaf."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray  # number of a leaf, else -1

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at each level the child with the nearest centre."""
        node = np.zeros(len(x), np.int64)
        while (inner := self.count[node] > 0).any():
            for n in np.unique(node[inner]):
                at = np.flatnonzero(node == n)
                kids = np.arange(self.first[n], self.first[n] + self.count[n])
                node[at] = kids[np.argmin(_distances(x[at], self.centres[kids]), axis=1)]
        return self.leaf[node]

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves that a best-bin-first walk reaches."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < visits:
            _, n = heapq.heappop(queue)
            if not self.count[n]:
                out.append(int(self.leaf[n]))
                continue
            kids = slice(self.first[n], self.first[n] + self.count[n])
            d = self.centres[kids] - q
            for i, v in enumerate(np.einsum("ij,ij->i", d, d).tolist()):
                heapq.heappush(queue, (v, int(self.first[n]) + i))
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", c, c) - 2 * (x @ c.T)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    near = None
    for _ in range(rounds):
        new = np.argmin(_distances(x, centres), axis=1)
        if near is not None and (new == near).all():
            break
        near = new
        sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def build_tree(x: np.ndarray, leaf: int, branches: int = BRANCHES, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    width = x.shape[1] if x.ndim == 2 else 1
    centres, first, count, leaves = [np.zeros(width)], [0], [0], [-1]
    todo = [(0, x)]
    for node, members in todo:
        kids: list[np.ndarray] = []
        if len(members) > leaf:
            c = _kmeans(members, min(branches, len(members)), rng)
            near = np.argmin(_distances(members, c), axis=1)
            kids = [i for i in range(len(c)) if (near == i).any()]
        if len(kids) < 2:
            continue
        first[node], count[node] = len(centres), len(kids)
        for i in kids:
            todo.append((len(centres), members[near == i]))
            centres.append(c[i])
            first.append(0)
            count.append(0)
            leaves.append(-1)
    # numbered depth first: leaves near in the tree have near numbers
    number, stack = 0, [0]
    while stack:
        n = stack.pop()
        if count[n]:
            stack += range(first[n] + count[n] - 1, first[n] - 1, -1)
        else:
            leaves[n], number = number, number + 1
    return Tree(np.array(centres), np.array(first), np.array(count), np.array(leaves))


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def valid_vector(v: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _name(v: Column) -> Column:
    """Two 64-bit hashes side by side."""
    part = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    return F.unhex(F.concat(part(v), part(F.lit(97), v)))


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - np.einsum("ij,ij->i", x, x)))[:, None]])


def _lift_query(q: np.ndarray) -> np.ndarray:
    return np.hstack([q, np.zeros((len(q), 1))])


def _calibrate(entries: DataFrame, queries: DataFrame, tree: Tree, most: float, k: int, recall: float) -> int:
    """Leaf visits that reach the recall on sampled queries answered exactly."""
    sample = queries.select("vh", "v").orderBy(F.xxhash64("vh", F.lit(3)), "vh").limit(CALIBRATION).collect()
    if not sample:
        return 1
    q = np.array([r.v for r in sample], float)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_l = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0))
            s = np.hstack([best_s, q @ x.T])
            at = np.hstack([best_l, np.broadcast_to(tree.assign(_lift(x, most)), (len(q), len(x)))])
            top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, : k + 1]
            best_s, best_l = np.take_along_axis(s, top, 1), np.take_along_axis(at, top, 1)
        i = np.repeat(np.arange(len(q)), best_s.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(best_l.ravel(), pa.int64()), pa.array(best_s.ravel())], names=["q", "leaf", "s"])

    found = entries.select("v").mapInArrow(exact, "q long, leaf long, s double")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("r") <= k + 1)
    place = [{leaf: i for i, leaf in enumerate(tree.best_bins(x, tree.leaves))} for x in _lift_query(q)]
    depth = np.sort([place[r.q][r.leaf] + 1 for r in top.collect()])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) if len(depth) else 1


def _top(q: np.ndarray, wanted: list[np.ndarray], x: np.ndarray, leaf: np.ndarray, ids: list, k: int) -> Iterator[list[tuple[float, int]]]:
    """The nearest ``k + 1`` of a bucket's ids for each query, among the leaves that it wants."""
    some = np.unique(np.concatenate(wanted))
    columns = np.flatnonzero(np.isin(leaf, some))
    place = np.searchsorted(some, leaf[columns])
    use = np.zeros((len(q), len(some)), bool)
    for row, w in zip(use, wanted, strict=True):
        row[np.searchsorted(some, w)] = True
    near = np.where(use[:, place], q @ x[columns].T, -np.inf)
    most = min(k + 1, len(columns))
    edges = np.partition(near, len(columns) - most, axis=1)[:, len(columns) - most]
    for row, edge, mine in zip(near, edges, q, strict=True):
        # a little below the edge, so that rounding can't lose a place; then scored one by one
        take = columns[(row >= edge - 1e-9 * max(1.0, abs(edge))) & (row > -np.inf)]
        scores = np.einsum("ij,j->i", x[take], mine)
        yield sorted((-s, i) for s, j in zip(scores.tolist(), take, strict=True) for i in ids[j])[: k + 1]


def _search(k: int) -> Callable:
    """Rows sorted by bucket, its entries before its queries: the nearest entries of each query in it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, x = None, [], None
        for b in batches:
            where = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
            edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                bucket, kind = where[a].tolist()
                part = b.slice(a, z - a)
                if bucket != at:
                    at, held, x = bucket, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if x is None:
                    x = np.vstack([_matrix(h.column(3)) for h in held])
                    ids = [i for h in held for i in h.column(4).to_pylist()]
                    leaf = np.concatenate([h.column(5).to_numpy() for h in held])
                for o in range(0, part.num_rows, BATCH):
                    some = part.slice(o, BATCH)
                    names, out = some.column(2).to_pylist(), ([], [], [])
                    wanted = [np.array(w, np.int64) for w in some.column(4).to_pylist()]
                    for name, got in zip(names, _top(_matrix(some.column(3)), wanted, x, leaf, ids, k), strict=True):
                        out[0].extend([name] * len(got))
                        out[1].extend(i for _, i in got)
                        out[2].extend(-s for s, _ in got)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["vh", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.94) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` nearest rows but itself.

    Scores are inner products of the original vectors in double precision;
    ties go to the smaller id.

    Defined cases. Null or zero vectors and those with null or non-finite
    components, and rows with a null id, take no part. Vectors must share one
    length; the commonest is kept (ties: the shortest). Rows that repeat an id
    and its vector count once. Fewer candidates than ``k``: all of them. No
    rows: no rows. Other input columns are not looked at.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    rows = vectors.where(valid_vector(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("is_q"))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    rows = rows.where(F.size("v") == widths[0].w).withColumn("vh", _name(F.col("v")))
    # one entry per distinct vector with its k + 1 smallest ids: more can't be answers. Rows that repeat an id and its
    # vector are made one before they are ranked; the limit works before the second shuffle.
    ranked = rows.select("vh", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("vh").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = ranked.groupBy("vh").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = rows.groupBy("vh").agg(F.any_value("v").alias("v")).join(ids, "vh")
    entries = cut(entries)  # numbered, sampled and indexed from the same rows
    most, n = entries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.count("*")).first()

    sample = entries.select("v").orderBy(F.xxhash64("vh"), "vh").limit(SAMPLE).toArrow().column("v").combine_chunks()
    tree = build_tree(_lift(_matrix(sample), most), leaf=max(LEAST_LEAF, int(len(sample) / max(n, 1) ** 0.5)))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = tree.assign(_lift(_matrix(b.column(1)), most))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=["vh", "v", "ids", "leaf"])

    entries = cut(entries.mapInArrow(leaves, "vh binary, v array<double>, ids array<long>, leaf long"))
    asked = rows.where("is_q").groupBy("vh").agg(F.any_value("v").alias("v"))
    visits = _calibrate(entries, asked, tree, most, k, recall)

    # consecutive leaves fill buckets; one row per leaf, at most SAMPLE of them
    sizes = dict(entries.groupBy("leaf").count().collect())
    start, buckets, room = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64), 0
    last = -1
    for leaf in range(tree.leaves):
        size = sizes.get(leaf, 0)
        if last < 0 or room < size:
            start[leaf], buckets[leaf] = last + 1, max(1, -(-size // BUCKET))
            last += int(buckets[leaf])
            room = BUCKET - size if size < BUCKET else 0
        else:
            start[leaf], room = last, room - size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            leaf, vh = b.column(3).to_numpy(), np.frombuffer(b"".join(b.column(0).to_pylist()), "<u8")[::2]
            bucket = start[leaf] + (vh % np.uint64(1_000_003)).astype(np.int64) % buckets[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(vh), np.int32)), b.column(0), b.column(1), b.column(2), b.column(3)], names=layout)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o in range(0, b.num_rows, 200):
                part = b.slice(o, 200)
                rows: list[tuple] = []
                for i, q in enumerate(_lift_query(_matrix(part.column(1)))):
                    found = np.array(tree.best_bins(q, visits))
                    home, found = int(found[0]), np.sort(found)
                    found = found[[int(x) in sizes for x in found]]
                    went = start[found]
                    for bucket in np.unique(went):
                        mine = found[went == bucket].tolist()
                        rows += [(int(bucket) + more, i, mine, home) for more in range(int(buckets[mine[0]]))]
                at = pa.array([r[1] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([1] * len(rows), pa.int32()), part.column(0).take(at), part.column(1).take(at), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.int64())], names=layout)

    layout = ["bucket", "kind", "vh", "v", "numbers", "leaf"]
    shape = "bucket long, kind int, vh binary, v array<double>, numbers array<long>, leaf long"
    # queries walk side by side, however few they are
    walkers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = entries.mapInArrow(place, shape).unionByName(asked.repartition(walkers).mapInArrow(walk, shape))
    # queries of one home leaf follow each other and want nearly the same leaves
    work = work.repartition(max(1, min(last + 1, 4096)), "bucket").sortWithinPartitions("bucket", "kind", "leaf")
    found = work.mapInArrow(tidy(_search(k)), "vh binary, vec_id long, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("vh").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    answers = best.groupBy("vh").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("hits"))
    members = rows.where("is_q").select("id", F.col("vh").alias("vh2")).distinct()
    out = members.join(answers.withColumnRenamed("vh", "vh2"), "vh2")
    mine = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("id")), 1, k)
    return out.select(F.col("id").alias("query_id"), F.posexplode(mine).alias("p", "h")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.s")).alias("score"))


def op4_nearest(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


QUERIES = {"op4_nearest": op4_nearest}
ORACLES: dict = {}
