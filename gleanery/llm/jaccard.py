"""N-gram Jaccard join: every pair of shingle sets at or above a similarity, as components.

Equal sets are one node. A linked set shares its least overlap with others, so
a set with more shingles of its own than that leaves has no link. Every second
shingle, by its hash, is dealt out to be counted; sets with too many that stand
in one document alone go before anything is compared. This is done for all
documents, then for one document of each set that is left, so that copies don't
hold each other.

Of what is left, nodes that may link meet through exact candidate keys: all
shingles stand in one order, rare ones first, and of a set the first
``n - least overlap + 1`` are its keys, so a linked pair has a key in common.
The order comes from counts of these nodes' shingles in a table of fixed size;
whatever it is, no link is lost, and shingles that many nodes share are keys of
none but those that hold little else. Groups of nodes with a common key form
candidate clusters, and each cluster is joined by a signature tree: leaves are
sets, inner nodes hold the OR of their sets' token bitmaps and the range of
their sizes, and a dual traversal drops node pairs whose largest possible
overlap is too small. What is left is verified on the sets themselves.

Scale. One pass makes the sets of all texts: sizes, names and counted shingles,
8 bytes each. The other passes make those of nodes that are left: the second
count, the table, keys, and the sets of candidates. Keys travel as packed
arrays, not as rows, and nodes that share a key within a task are linked there,
so a key that many nodes hold says one entry per task; a counted shingle says
two a block of texts. Clusters above ``BLOCK`` nodes are first looked at through
signature trees without sets, a few bits for each shingle: by ranges of sizes
their blocks meet in pairs, and only nodes that could link stay together. What
is still above ``BLOCK`` nodes or ``BLOCK_TOKENS`` shingles is cut into blocks;
every block is joined in itself and with the cluster's hub, and only nodes that
have not reached the hub's component meet the blocks of their own and the
neighbouring range of sizes. Components come from star rounds over spanning
edges. Broadcast are the order's table and bitmaps, 8 MB each, whatever the
corpus.

Nodes are named by 128-bit hashes of their sets. Candidates go by one half of
the name, where a clash only makes a cluster larger.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import RecentCache, blocks, held_by_process, offsets_of, tidy
from .common import id_of, id_or_last
from .components import components

BLOCK, BLOCK_TOKENS = 1000, 1 << 20
#: Counted shingles that a part holds, about, and that a task gathers before it sends them; texts in a block (16 bits name one).
COUNTED, HELD_COUNTED, BLOCK_TEXTS = 1_000_000, 1_000_000, 1 << 16
#: Bytes of text for each counted shingle, about: every second one is.
COUNTED_BYTES = 10
#: Keys that are matched at once, about; tasks of the key exchange at most, each with parts one after the other.
PART_KEYS, MOST_TASKS = 400_000, 1 << 16
TASK_BYTES = 128 << 20  # of sets that one join task reads, at most
HELD_KEYS = 1_000_000  # that a task gathers before it sends them
FILTER_WORDS = 1 << 20  # 64-bit words of the broadcast bitmap
#: The table of counts: a shingle's entry is named by the first bits of its hash; it travels in slices.
COUNT_BITS, SLICES = 22, 64
_MULTIPLIER, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


# Shingle sets

_WORDS = RecentCache(200_000)
held_by_process(_WORDS.clear)


def _word_hashes(words: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(w) for w in words]


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, text after text, and the texts' bounds."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    n = len(texts)
    flat, doc = split.flatten(), np.repeat(np.arange(n), np.diff(offsets_of(split)))
    real = pc.greater(pc.binary_length(flat), 0)
    doc = doc[real.to_numpy(zero_copy_only=False)]
    coded = flat.filter(real).dictionary_encode()
    words = np.array(_WORDS.get_all(coded.dictionary.to_pylist(), _word_hashes), np.uint64)[coded.indices.to_numpy()]
    counts = np.bincount(doc, minlength=n)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        h = words[: max(0, len(words) - k + 1)].copy()
        for j in range(1, k):
            h = h * _MULTIPLIER + words[j : len(words) - k + 1 + j]
        h = mix(h)
        parts = []
        for i in range(n):
            a, c = bounds[i], counts[i]
            if c >= k:
                s = np.sort(h[a : a + c - k + 1])
                parts.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif c:
                v = np.uint64(c)  # a whole text of fewer words is one shingle, of a kind of its own
                for w in words[a : a + c]:
                    v = v * _MULTIPLIER + w
                parts.append(mix(np.array([v ^ _MIX2])))
            else:
                parts.append(h[:0])
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else h[:0]), np.concatenate([[0], np.cumsum(sizes)])


def _names(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two words for each set: its name."""
    import xxhash

    data = sets.tobytes()
    found = b"".join(xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


# Sizes, names, shingles that no other document holds

_TEXT = "id long, n long, node long, mark long, h long, g long"
_DEALT = f"part long, block long, at int, {_TEXT}, data binary"
_COUNTED = f"block long, at int, {_TEXT}, data binary"
_names_of = lambda schema: [x.split()[0] for x in schema.split(", ")]


def counted_shingles(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entries of every second shingle: 48 bits of its hash, 16 for the text ``at`` that holds it."""
    some = (sets & np.uint64(1)) == 0
    return (sets[some] & ~np.uint64(BLOCK_TEXTS - 1)) | at[some].astype(np.uint64)


def told(entries: np.ndarray) -> np.ndarray:
    """Sorted entries, two at most of a shingle: more would tell nothing else to others or to the texts that hold it."""
    out = np.sort(entries)
    name = out >> np.uint64(16)
    return out[np.concatenate([np.ones(min(2, len(out)), bool), name[2:] != name[:-2]])]


def held_alone(entries: np.ndarray) -> np.ndarray:
    """Which entries name a shingle that no other one names."""
    out = np.zeros(len(entries), bool)
    if len(entries):
        name = entries >> np.uint64(16)
        order = np.argsort(name)
        differ = name[order][1:] != name[order][:-1]
        out[order[np.concatenate([[True], differ]) & np.concatenate([differ, [True]])]] = True
    return out


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each run of ``values`` that ends at one of ``ends``."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _measure(k: int, parts: int, bitmap=None) -> Callable:
    """A row for each text, or each that the bitmap holds, and for each block of texts and part a row of counted shingles."""
    names = _names_of(_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
        block, texts, held = next(numbers), 0, []

        def out() -> pa.RecordBatch:
            entries = told(np.concatenate(held))
            # hashes are even: a part is a range of them
            part = (((entries >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            ends = np.flatnonzero(np.concatenate([part[1:] != part[:-1], [True]])) + 1 if len(part) else np.zeros(0, np.int64)
            n = len(ends)
            return pa.RecordBatch.from_arrays([pa.array(part[ends - 1]), pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 6, _binaries(entries, ends)], names=names)

        for some in blocks(batches):
            some = some if bitmap is None else some.filter(_held(bitmap, some.column(4)))
            for start in range(0, some.num_rows, BLOCK_TEXTS // 2):
                piece = some.slice(start, BLOCK_TEXTS // 2)
                n = piece.num_rows
                sets, bounds = shingle_sets(piece.column(1), k)
                if held and (texts + n > BLOCK_TEXTS or sum(map(len, held)) + len(sets) // 2 > HELD_COUNTED):
                    yield out()
                    block, texts, held = next(numbers), 0, []
                at = np.arange(texts, texts + n)
                held.append(counted_shingles(sets, np.repeat(at, np.diff(bounds))))
                texts += n
                node, mark = (pa.array(x) for x in _names(sets, bounds).T.copy())
                own = [pa.array((at + block) % parts), pa.array(np.full(n, block)), pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays([*own, piece.column(0), pa.array(np.diff(bounds)), node, mark, piece.column(2), piece.column(3), pa.nulls(n, pa.binary())], names=names)
        if held:
            yield out()

    return tidy(run)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in which a part's rows follow each other: texts as they are, and for each block the texts, one by one, of shingles held alone."""
    names = _names_of(_COUNTED)

    def matched() -> Iterator[pa.RecordBatch]:
        if held:
            n, entries = len(held), np.frombuffer(b"".join(held), np.uint64)
            alone = held_alone(entries)
            ends = np.concatenate([[0], np.cumsum(alone)])[np.cumsum([len(x) // 8 for x in held])]
            texts = (entries[alone] & np.uint64(BLOCK_TEXTS - 1)).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 6, _binaries(texts, ends)], names=names)

    at, held, owners = None, [], []
    for batch in batches:
        texts = pc.is_null(batch.column(9))
        yield batch.filter(texts).select(names)
        packed = batch.filter(pc.invert(texts))
        for part, block, data in zip(*(packed.column(i).to_pylist() for i in (0, 1, 9)), strict=True):
            if part != at:
                yield from matched()
                at, held, owners = part, [], []
            held.append(data)
            owners.append(block)
    yield from matched()


def _could_link(num: int, den: int) -> Callable:
    """Whole blocks to those of their texts that aren't known to hold too many shingles alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[pa.RecordBatch] = []
        alone: dict[int, np.ndarray] = {}
        for batch in batches:
            texts.append(batch.filter(pc.is_valid(batch.column(1))).select(["block", "at", "id", "n", "node", "mark"]))
            packed = batch.filter(pc.is_null(batch.column(1)))
            for block, data in zip(packed.column(0).to_pylist(), packed.column(8).to_pylist(), strict=True):
                if block not in alone:
                    alone[block] = np.zeros(BLOCK_TEXTS, np.int32)
                found = np.bincount(np.frombuffer(data, "<u2"))
                alone[block][: len(found)] += found.astype(np.int32)
        for batch in texts:
            block, at, n = (batch.column(i).to_numpy() for i in (0, 1, 3))
            own = np.zeros(len(n), np.int64)
            for b in np.unique(block).tolist():
                if b in alone:
                    own[block == b] = alone[b][at[block == b]]
            yield batch.filter(pa.array((n > 0) & (n - own >= -(-num * n // den)))).select(["id", "n", "node", "mark"])

    return tidy(run)


def _parts(spark, expected: int) -> int:
    """For so many counted shingles."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // COUNTED))


def _counted(base: DataFrame, words: int, expected: int, bitmap=None) -> DataFrame:
    """Texts, and for each block of them what is held alone."""
    parts = _parts(base.sparkSession, expected)
    tasks = min(parts, MOST_TASKS)
    rows = base.mapInArrow(_measure(words, parts, bitmap), _DEALT).repartitionById(tasks, F.expr(f"cast(part % {tasks} as int)"))
    return (rows.sortWithinPartitions("part") if tasks < parts else rows).mapInArrow(tidy(_alone), _COUNTED)


def _left(counted: DataFrame, expected: int, num: int, den: int) -> DataFrame:
    """One row, that with the smallest id, of each set that could link with another one."""
    n = min(_parts(counted.sparkSession, expected), MOST_TASKS)
    rows = counted.repartition(n, "block").mapInArrow(_could_link(num, den), "id long, n long, node long, mark long")
    return cut(rows.groupBy("node", "mark").agg(F.min(id_or_last("id")).alias("id"), F.min("n").alias("n")))


# Counts


def _count(k: int, bitmap) -> Callable:
    """Of a task's wanted texts, a row for each slice of the table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        for _, sets, _ in _wanted(batches, k, bitmap):
            counts += np.bincount((sets >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
        for i, part in enumerate(np.split(counts, SLICES)):
            if part.any():
                packed = pa.Codec("zstd").compress(part.tobytes(), asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed])], names=["slice", "counts"])

    return tidy(run)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of all tasks to the sums' logarithms, as 16-bit numbers."""
    held: dict[int, np.ndarray] = {}
    size = (1 << COUNT_BITS) // SLICES
    for b in batches:
        for i, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(i, np.zeros(size, np.uint64))
            held[i] += np.frombuffer(pa.Codec("zstd").decompress(packed, 4 * size, asbytes=True), np.uint32)
    for i, sums in held.items():
        ranks = np.minimum(np.log2(sums + np.uint64(1)) * 1000, 65535).astype("<u2")
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([ranks.tobytes()])], names=["slice", "ranks"])


def _order_of(counts: DataFrame) -> np.ndarray:
    """The rank of each entry of the table: how often its shingles occur, on a logarithmic scale. One row a slice comes to the driver."""
    rows = counts.repartition(SLICES, "slice").mapInArrow(tidy(_add_counts), "slice int, ranks binary").collect()
    out = np.zeros((SLICES, (1 << COUNT_BITS) // SLICES), np.uint16)
    for r in rows:
        out[r.slice] = np.frombuffer(r.ranks, "<u2")
    return out.ravel()


# Candidate keys


def prefix_keys(sets: np.ndarray, bounds: np.ndarray, use: np.ndarray, ranks: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the numbers of the sets that give them, for sets whose numbers are in ``use``.

    A set of size n overlaps with any set that it links to in ``num n / den``
    shingles at least. Of two sets that share so many, the first n less so many
    and one in a common order hold a common one. Sets too small to link with any
    other set give none.
    """
    order = (ranks[(sets >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(48)) | (sets & np.uint64((1 << 48) - 1))
    out, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in use.tolist():
        a, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
        if n * den < num * (n + 1):
            continue
        p = n + (-num * n) // den + 1
        out.append(np.partition(order[a : a + n], p - 1)[:p])
        who.append(np.full(p, i))
    return np.concatenate(out), np.concatenate(who)


#: Rows of the key exchange: 0 keys and their nodes, 1 edges that a task has found.
_PACKED = "part long, kind int, data binary"


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def _emit(k: int, num: int, den: int, parts: int, ranks, bitmap) -> Callable:
    """Wanted texts to packed rows of the key exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = RecentCache(100_000)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        turn = itertools.count(TaskContext.get().partitionId() if TaskContext.get() else 0)  # edges may go anywhere

        def out() -> Iterator[pa.RecordBatch]:
            keys, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            names, roots = _linked(keys, nodes)
            if len(names):
                yield _packed([(next(turn) % parts, 1, np.stack([names, roots]).tobytes())])
            # what shares a key here is linked here, one node speaks for the key elsewhere
            first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            keys, nodes = keys[first], nodes[first]
            part = (mix(keys) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, nodes, part = keys[order], nodes[order], part[order]
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
            rows = [(int(part[a]), 0, keys[a:b].tobytes() + nodes[a:b].tobytes()) for a, b in itertools.pairwise(edges)]
            if rows:
                yield _packed(rows)

        for _, sets, bounds in _wanted(batches, k, bitmap):
            nodes = _names(sets, bounds)[:, 0]
            fresh: set[int] = set()
            seen.get_all(nodes.tolist(), lambda new: (fresh.update(new), [True] * len(new))[1])
            # copies within a task say nothing new: a node's keys are sent once
            first = np.unique(nodes, return_index=True)[1]
            use = first[np.isin(nodes[first], np.fromiter(fresh, np.int64, len(fresh)))]
            keys, who = prefix_keys(sets, bounds, use, ranks.value, num, den)
            held.append((keys, nodes[who]))
            if sum(len(x) for x, _ in held) > HELD_KEYS:
                yield from out()
        if held:
            yield from out()

    return tidy(run)


def _roots(groups: np.ndarray, members: np.ndarray, n: int) -> np.ndarray:
    """The smallest member that each of ``n`` members reaches through shared groups; groups sorted."""
    label = np.arange(n)
    edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    size = np.diff(np.concatenate([edge, [len(groups)]]))
    while True:
        least = np.repeat(np.minimum.reduceat(label[members], edge), size)
        new = label.copy()
        np.minimum.at(new, members, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by key and node: nodes that share keys with smaller ones, and the smallest that each reaches."""
    same = (keys[1:] == keys[:-1]) & (nodes[1:] != nodes[:-1])
    shared = np.unique(keys[1:][same])
    if not len(shared):
        return nodes[:0], nodes[:0]
    at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
    hit = shared[at] == keys
    names, member = np.unique(nodes[hit], return_inverse=True)
    root = names[_roots(keys[hit], member, len(names))]
    differ = root != names
    return names[differ], root[differ]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in which a part's rows follow each other: edges from each node to the smallest that it reaches."""

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def matched() -> Iterator[pa.RecordBatch]:
        if held:
            packed = [np.frombuffer(x, np.int64).reshape(2, -1) for x in held]
            keys, nodes = (np.concatenate([p[i] for p in packed]) for i in (0, 1))
            order = np.lexsort((nodes, keys))
            a, b = _linked(keys[order], nodes[order])
            if len(a):
                yield edges(a, b)

    at, held = None, []
    for batch in batches:
        for part, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if kind:
                yield edges(*np.frombuffer(data, np.int64).reshape(2, -1))
                continue
            if part != at:
                yield from matched()
                at, held = part, []
            held.append(data)
    yield from matched()


# The signature tree


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row for each set: the bits of its tokens."""
    words = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(words, sets, strict=True):
        set_ = np.zeros(bits, bool)
        set_[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(set_, bitorder="little").view(np.uint64)
    return words


class Tree:
    """Sets under nodes that hold their OR-combined bitmaps and size ranges.

    ``excess`` of a node bounds how many tokens of a set below it share a bit
    with another of its tokens: an overlap is at most the common bits of two
    nodes and the smaller of their excesses. Without the sets themselves, what
    the bitmaps don't rule out counts as linked.
    """

    FAN = 8

    def __init__(self, words: np.ndarray, sizes: np.ndarray, least: np.ndarray, sets: list[np.ndarray] | None = None):
        order = np.lexsort((sizes, least))  # near copies share their smallest token
        self.at, self.size, self.words = order, sizes[order], words[order]
        self.sets = [sets[i] for i in order] if sets is not None else None
        self.extra = self.size - np.bitwise_count(self.words).sum(1).astype(np.int64)
        # levels[0] are the leaves; each node: start and end among the sets
        leaf = min(64, max(8, 2048 // words.shape[1]))  # what two leaves compare at once stays small
        spans = [(a, min(a + leaf, len(sizes))) for a in range(0, len(sizes), leaf)]
        self.nodes: list[tuple] = []
        level = [self._node(np.bitwise_or.reduce(self.words[a:b], axis=0), self.size[a:b], self.extra[a:b], (a, b), ()) for a, b in spans]
        while len(level) > 1:
            up = []
            for i in range(0, len(level), self.FAN):
                kids = tuple(level[i : i + self.FAN])
                got = [self.nodes[x] for x in kids]
                up.append(self._node(np.bitwise_or.reduce([g[0] for g in got], axis=0), np.array([[g[1], g[2]] for g in got]), np.array([g[3] for g in got]), None, kids))
            level = up
        self.root = level[0]

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], bits: int) -> Tree:
        return cls(bitmaps(sets, bits), np.array([len(s) for s in sets]), np.array([s[0] for s in sets]), sets)

    def _node(self, bits, sizes, extra, span, kids) -> int:
        self.nodes.append((bits, int(sizes.min()), int(sizes.max()), int(extra.max()), span, kids))
        return len(self.nodes) - 1

    def linked(self, p: int, other: Tree, q: int, num: int, den: int) -> bool:
        if self.sets is None:
            return True
        a, b = self.sets[p], other.sets[q]
        common = len(np.intersect1d(a, b, assume_unique=True))
        return den * common >= num * (len(a) + len(b) - common)


class Union:
    def __init__(self, labels: list):
        self.up: dict = {x: x for x in labels}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def tree_join(a: Tree, b: Tree, labels_a: list, labels_b: list, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Positions of linked sets that join two labels not joined yet: a spanning forest of the links.

    ``a`` may be ``b``. Pairs whose labels are already one are not looked at.
    """
    union = Union([*labels_a, *labels_b])
    open_labels = len(union.up)
    todo = [(a.root, b.root)]
    while todo and open_labels > 1:
        i, j = todo.pop()
        x, y = a.nodes[i], b.nodes[j]
        if x[2] * den < num * y[1] or y[2] * den < num * x[1]:
            continue
        need = -(-num * (x[1] + y[1]) // (num + den))
        if min(int(np.bitwise_count(x[0] & y[0]).sum()) + min(x[3], y[3]), x[2], y[2]) < need:
            continue
        if x[5] or y[5]:
            # open the larger node; a node with itself gives each pair of children once
            if a is b and i == j:
                todo += [(p, q) for n, p in enumerate(x[5]) for q in x[5][n:]]
            elif x[5] and (not y[5] or len(x[5]) >= len(y[5])):
                todo += [(p, j) for p in x[5]]
            else:
                todo += [(i, q) for q in y[5]]
            continue
        (xa, xb), (ya, yb) = x[4], y[4]
        most = np.bitwise_count(a.words[xa:xb, None, :] & b.words[None, ya:yb, :]).sum(2).astype(np.int64) + np.minimum(a.extra[xa:xb, None], b.extra[None, ya:yb])
        most = np.minimum(most, np.minimum(a.size[xa:xb, None], b.size[None, ya:yb]))
        both = a.size[xa:xb, None] + b.size[None, ya:yb]
        likely = (num + den) * most >= num * both
        if a is b and i == j:
            likely = np.triu(likely, 1)
        for p, q in zip(*np.nonzero(likely), strict=True):
            p, q = p + xa, q + ya
            la, lb = labels_a[a.at[p]], labels_b[b.at[q]]
            if union.find(la) == union.find(lb):
                continue
            if a.linked(p, b, q, num, den):
                union.join(la, lb)
                open_labels -= 1
                yield int(a.at[p]), int(b.at[q])


def _bits(sets: list[np.ndarray]) -> int:
    middle = sorted(map(len, sets))[len(sets) // 2]
    return 1 << min(16, max(8, (4 * middle).bit_length()))


def _join_blocks(num: int, den: int) -> Callable:
    """Rows sorted by (cluster, task, side): the linked pairs of each task.

    Side 0 alone is joined in itself; with rows of side 1, side 1 is joined with side 0.
    """

    def task(sides: tuple[dict, dict]) -> Iterator[tuple[int, int]]:
        names = [list(s) for s in sides]
        sets = [[s[x][0] for x in n] for s, n in zip(sides, names, strict=True)]
        labels = [[s[x][1] for x in n] for s, n in zip(sides, names, strict=True)]
        if not names[0] or (len(names[0]) == 1 and not names[1]):
            return
        bits = _bits(sets[0] + sets[1])
        a = Tree.of_sets(sets[0], bits)
        b, side = (Tree.of_sets(sets[1], bits), 1) if names[1] else (a, 0)
        for p, q in tree_join(a, b, labels[0], labels[side], num, den):
            yield names[0][p], names[side][q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ({}, {})
        pairs: list[tuple[int, int]] = []
        for batch in blocks(batches, 5):
            columns = [c.to_pylist() for c in batch.columns]
            for cluster, number, side, node, label, data in zip(*columns, strict=True):
                if (cluster, number) != at:
                    pairs += task(sides)
                    at, sides = (cluster, number), ({}, {})
                sides[side][node] = (np.frombuffer(data, np.uint64), label)
            if pairs:
                yield _edges(pairs)
                pairs = []
        yield _edges([*pairs, *task(sides)])

    return tidy(run)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int64()), pa.array([q for _, q in pairs], pa.int64())], names=["a", "b"])


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed ids: one word a row, 1M rows at most."""
    h = F.xxhash64("id")
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)), F.pmod(h, F.lit(64)).cast("int")
    rows = ids.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out


def _held(bitmap, hashes: pa.Array) -> pa.Array:
    """Which hashed ids the bitmap holds."""
    h = hashes.to_numpy(zero_copy_only=False)
    return pa.array(((bitmap.value[(h >> 6) % FILTER_WORDS] >> (h % 64)) & 1).astype(bool))


def _wanted(batches: Iterator[pa.RecordBatch], k: int, bitmap) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows whose ids the bitmap holds, with the sets of their texts."""
    for block in blocks(batches):
        some = block.filter(_held(bitmap, block.column(2)))
        if some.num_rows:
            yield some, *shingle_sets(some.column(1), k)


def _fetch_sets(k: int, bitmap) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, sets, bounds in _wanted(batches, k, bitmap):
            data, names = sets.tobytes(), _names(sets, bounds)
            tokens = pa.array([data[8 * a : 8 * b] for a, b in itertools.pairwise(bounds)], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), tokens], names=["id", "node", "mark", "tokens"])

    return tidy(run)


# Signatures of large clusters


def size_class(n: int, num: int, den: int) -> int:
    """Sizes of a linked pair lie in one class or two neighbouring ones; a little wider, so that rounding can't part them by two."""
    return int(math.log(n) / (1.0001 * math.log(den / num)))


def _class_bits(number: int, num: int, den: int) -> int:
    """Bits of a signature among sets of a class and the next one: two for each token of the largest, at least."""
    most = (den / num) ** (1.0001 * (number + 2)) + 1
    return 1 << min(16, max(8, math.ceil(math.log2(2 * most))))


def _signatures(k: int, num: int, den: int, bitmap) -> Callable:
    """Wanted texts to two signatures each: among sets of its class and the one above, and of its class and the one below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, sets, bounds in _wanted(batches, k, bitmap):
            rows, names = [], _names(sets, bounds)
            for i, (a, b) in enumerate(itertools.pairwise(bounds)):
                if a == b:
                    continue
                own = size_class(int(b - a), num, den)
                rows += [(i, c, bitmaps([sets[a:b]], _class_bits(c, num, den)).tobytes(), int(b - a), int(sets[a].view(np.int64))) for c in (own, own - 1)]
            if rows:
                at, c, bits, n, least = zip(*rows, strict=True)
                where = np.array(at)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(where)), pa.array(names[where, 0]), pa.array(names[where, 1]), pa.array(c, pa.int32()), pa.array(bits, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64())], names=["id", "node", "mark", "class", "bits", "size", "least"])

    return tidy(run)


def _join_signatures(num: int, den: int) -> Callable:
    """Rows sorted by (group, task, side) to a spanning forest of what signatures don't rule out."""

    def task(sides: tuple[dict, dict]) -> Iterator[tuple[int, int]]:
        trees, names = [], []
        for s in sides:
            if s:
                words = np.frombuffer(b"".join(x[0] for x in s.values()), np.uint64).reshape(len(s), -1)
                trees.append(Tree(words, np.array([x[1] for x in s.values()]), np.array([x[2] for x in s.values()])))
                names.append(list(s))
        if not trees or (len(trees) == 1 and len(names[0]) == 1):
            return
        for p, q in tree_join(trees[0], trees[-1], names[0], names[-1], num, den):
            yield names[0][p], names[-1][q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ({}, {})
        pairs: list[tuple[int, int]] = []
        for batch in blocks(batches, 4):
            for group, number, side, node, bits, size, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, number) != at:
                    pairs += task(sides)
                    at, sides = (group, number), ({}, {})
                sides[side][node] = (bits, size, least)
            if pairs:
                yield _edges(pairs)
                pairs = []
        yield _edges([*pairs, *task(sides)])

    return tidy(run)


def _refined(wanted: DataFrame, ordered: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Nodes of clusters by what their signatures leave together; nodes that could link with none go."""
    bitmap = wanted.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("id")))
    signed = ordered.mapInArrow(_signatures(words, num, den, bitmap), "id decimal(20,0), node long, mark long, class int, bits binary, size long, least long")
    rows = signed.join(wanted.select("id", "node", "mark", "num", "root"), ["id", "node", "mark"]).select(F.xxhash64("root", "class").alias("group"), "num", "bits", "size", "least")
    sizes = wanted.select(F.col("root"), F.explode(_classes(num, den)).alias("class")).groupBy(F.xxhash64("root", "class").alias("group")).agg(F.ceil(F.count("*") / (4 * BLOCK)).alias("blocks"))
    rows = rows.withColumn("k", _other("group", 81)).join(sizes.select(_other("group", 81).alias("k"), "blocks"), "k")
    mine, blocks_ = F.pmod(F.xxhash64("num"), F.col("blocks")), F.col("blocks")
    # every two blocks meet once, each block also itself
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks_ - 1)))
    task = F.least("mine", "other") * blocks_ + F.greatest("mine", "other")
    rows = rows.select("group", task.alias("task"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "num", "bits", "size", "least")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "group", "task").sortWithinPartitions("group", "task", "side").mapInArrow(_join_signatures(num, den), "a long, b long")
    together = components(found).select(F.col("node").alias("num"), F.col("root").alias("together"))
    return wanted.drop("root").join(together, "num").select("id", "node", "mark", "n", F.xxhash64(F.lit(5), "together").alias("root"), "num")


def _classes(num: int, den: int):
    """The classes that a node with ``n`` shingles is looked at in, as ``size_class`` has them."""
    own = F.floor(F.log("n") / (1.0001 * math.log(den / num))).cast("int")
    return F.array(own, own - 1)


def _other(column: str, salt: int):
    """Another key expression than the one before it: the join gets exchanges that can be split where a key is hot."""
    return F.col(column).bitwiseXOR(F.lit(salt))


def _number_of_blocks(rows, tokens):
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(tokens / BLOCK_TOKENS), F.lit(1)).cast("long")


def _named(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """Per row: ``id`` (as ``id_or_last`` has it), ``n``, two hashes of the text, and ``c1, c2, c3``, which name its component."""
    if not 0 < num <= den:
        raise ValueError("the similarity must lie in (0, 1]")
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    ident = id_or_last(id_col)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text), F.xxhash64(F.lit(97), text), F.xxhash64(ident))
    octets = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    expected = octets // COUNTED_BYTES
    measured = cut(_counted(base, words, expected))
    sets = measured.where("data IS NULL").select(id_or_last("id").alias("id"), "n", "node", "mark", "h", "g")
    nodes = _left(measured, expected, num, den)
    bitmap = spark.sparkContext.broadcast(_bitmap(nodes.select("id")))
    # once more: exact copies have told of each other, and many others have gone
    expected = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 2
    nodes = _left(_counted(base, words, expected, bitmap), expected, num, den)
    bitmap = spark.sparkContext.broadcast(_bitmap(nodes.select("id")))
    ordered = docs.select(ident.alias("id"), text.alias("text")).withColumn("h", F.xxhash64("id"))
    total, rows = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranks = spark.sparkContext.broadcast(_order_of(ordered.mapInArrow(_count(words, bitmap), "slice int, counts binary")))
    parts = int(max(1, -(-(total * (den - num) // den + rows) // PART_KEYS)))
    tasks = min(parts, MOST_TASKS)
    packed = ordered.mapInArrow(_emit(words, num, den, parts, ranks, bitmap), _PACKED)
    packed = packed.repartitionById(tasks, F.expr(f"cast(part % {tasks} as int)"))
    clusters = components((packed.sortWithinPartitions("part") if tasks < parts else packed).mapInArrow(tidy(_meet), "a long, b long"))

    # numbers that the checkpoint keeps: no two nodes share one
    wanted = cut(nodes.join(clusters.withColumnRenamed("node", "short"), F.col("node") == F.col("short")).select("id", "node", "mark", "n", "root", F.monotonically_increasing_id().alias("num")))
    if num < den:
        counts = wanted.groupBy("root").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK).select(_other("root", 76).alias("k"))
        keyed = wanted.withColumn("k", _other("root", 76))
        large = cut(keyed.join(counts, "k", "left_semi").drop("k"))
        if not large.isEmpty():
            wanted = cut(keyed.join(counts, "k", "left_anti").drop("k").unionByName(_refined(large, ordered, words, num, den)))
    sizes = wanted.groupBy("root").agg(F.min("num").alias("hub"), _number_of_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    sizes = sizes.select(_other("root", 77).alias("k"), "hub", "blocks")
    placed = cut(wanted.withColumn("k", _other("root", 77)).join(sizes, "k").drop("k").withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks"))))
    bitmap = spark.sparkContext.broadcast(_bitmap(placed.select("id")))
    tokens = ordered.mapInArrow(_fetch_sets(words, bitmap), "id decimal(20,0), node long, mark long, tokens binary")
    held = tokens.join(placed.drop("n"), ["id", "node", "mark"])
    # a cluster's hub goes to every block
    everywhere = F.when(F.col("num") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = held.select("root", F.explode(everywhere).alias("task"), F.lit(0).alias("side"), "num", F.col("num").alias("label"), "tokens")
    joined = components(_run_tasks(first, num, den, total))
    if num < den and not placed.where("blocks > 1").isEmpty():
        joined = _off_the_hub(placed.where("blocks > 1"), held.where("blocks > 1"), joined, num, den, total)

    joined = joined.select(F.col("node").alias("num"), F.col("root").alias("c"))
    names = placed.join(joined, "num").select(F.col("node").alias("node2"), F.col("mark").alias("mark2"), "c")
    named = sets.join(names, (F.col("node") == F.col("node2")) & (F.col("mark") == F.col("mark2")), "left")
    return named.select("id", "n", "h", "g", F.coalesce("c", "node").alias("c1"), F.when(F.col("c").isNull(), F.col("mark")).otherwise(0).alias("c2"), F.col("c").isNull().alias("c3"))


def _off_the_hub(placed: DataFrame, held: DataFrame, joined: DataFrame, num: int, den: int, total: int) -> DataFrame:
    """Components with the links of nodes in large clusters that the hubs' components don't hold.

    Sizes of a linked pair lie in one class or two neighbouring ones, so a
    cluster is looked at class by class, each with the next one.
    """
    label = joined.select(F.col("node").alias("num2"), F.col("root").alias("label"))
    large = placed.join(label, F.col("num") == F.col("num2"), "left").select("root", "hub", "num", "n", F.coalesce("label", "num").alias("label"))
    hubs = large.where("num = hub").select(F.col("root").alias("root2"), F.col("label").alias("of_hub"))
    large = large.join(hubs, F.col("root") == F.col("root2")).select("root", "num", "n", "label", (F.col("label") != F.col("of_hub")).alias("apart"))
    large = cut(large.withColumn("class", F.explode(_classes(num, den))).withColumn("root", F.xxhash64("root", "class")).drop("class"))
    asked = F.col("apart").cast("int")
    work = large.groupBy("root").agg(_number_of_blocks(F.count("*"), F.sum("n")).alias("blocks"), _number_of_blocks(F.sum(asked), F.sum(asked * F.col("n"))).alias("rounds"), F.sum(asked).alias("asked"))
    work = work.where("asked > 0").select(_other("root", 78).alias("k"), "blocks", "rounds")
    if work.isEmpty():
        return joined
    texts = held.select(F.col("num").alias("num3"), "tokens")
    rest = large.withColumn("k", _other("root", 78)).join(work, "k").join(texts, F.col("num") == F.col("num3"))
    block, mine = F.pmod(F.xxhash64("num"), F.col("blocks")), F.pmod(F.xxhash64("num", F.lit(9)), F.col("rounds"))
    several = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    layout = ["root", "task", "side", "num", "label", "tokens"]
    every = rest.withColumn("r", F.explode(several("rounds"))).withColumns({"task": F.col("r") * F.col("blocks") + block, "side": F.lit(0)}).select(*layout)
    asking = rest.where("apart").withColumn("b", F.explode(several("blocks"))).withColumns({"task": mine * F.col("blocks") + F.col("b"), "side": F.lit(1)}).select(*layout)
    more = _run_tasks(every.unionByName(asking), num, den, total)
    return components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _with_least(named: DataFrame) -> DataFrame:
    """Adds ``least``, the smallest id of a row's component; empty sets are alone."""
    least = named.where("n > 0").groupBy("c1", "c2", "c3").agg(F.min("id").alias("least")).select(_other("c1", 79).alias("k"), F.col("c2").alias("k2"), F.col("c3").alias("k3"), "least")
    out = named.withColumn("k1", _other("c1", 79)).join(least, (F.col("n") > 0) & (F.col("k1") == F.col("k")) & (F.col("c2") == F.col("k2")) & (F.col("c3") == F.col("k3")), "left")
    return out.select("id", "n", "h", "g", "c1", "c2", "c3", F.coalesce("least", "id").alias("least"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: the id, ``n_shingles`` and ``component_id``.

    Two rows link when ``den`` times the overlap of their shingle sets is at
    least ``num`` times the union; a component is named by its smallest id.

    Defined cases. Null or empty text: an empty set, linked with nothing. A
    text with fewer words is one shingle. A null id sorts last; its row's
    component is null where no other id is in it. Rows that repeat an id get a
    result each, and link like others. No rows: no rows. Texts are read whole.
    Other input columns are not looked at.
    """
    out = _with_least(_named(docs, id_col, text_col, words, num, den))
    return out.select(id_of(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), id_of(F.col("least")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each component, and all rows with empty sets; columns as they are.

    The row with the smallest id stays; among rows that share it, one chosen by
    hashes of text and row. Only what goes is joined with the texts: up to
    ``SENT`` rows are sent to the executors, more are joined by a shuffle.
    Defined cases are those of ``near_components``.
    """
    found = cut(_with_least(_named(docs, id_col, text_col, words, num, den)).where("n > 0"))
    gone = found.where("id <> least").select("id", "h", "g")
    at_least = found.where("id = least").groupBy("c1", "c2", "c3", "id").agg(F.count("*").alias("rows"))
    ties = cut(at_least.where("rows > 1").drop("rows"))
    twice = None
    if not ties.isEmpty():
        tied = found.join(ties, ["c1", "c2", "c3", "id"]).groupBy("c1", "c2", "c3", "id", "h", "g").agg(F.count("*").alias("rows"))
        first = tied.groupBy("c1", "c2", "c3", "id").agg(F.min(F.struct("h", "g")).alias("first"))
        tied = cut(tied.join(first, ["c1", "c2", "c3", "id"]).withColumn("stays", F.struct("h", "g") == F.col("first")))
        gone = gone.unionByName(tied.where("NOT stays").select("id", "h", "g"))
        twice = tied.where("stays AND rows > 1").select("id", "h", "g")
    marked = docs.withColumns({"__i": id_or_last(id_col), "__h": F.xxhash64(F.col(f"`{text_col}`").cast("string")), "__g": F.xxhash64(F.lit(97), F.col(f"`{text_col}`").cast("string"))})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = _without(marked, gone).select(*columns)
    if twice is not None and not twice.isEmpty():
        repeated = twice.select(F.col("id").alias("__i"), F.col("h").alias("__h"), F.col("g").alias("__g"))
        one = marked.join(repeated, ["__i", "__h", "__g"]).groupBy("__i", "__h", "__g").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row"))
        out = _without(marked, gone.unionByName(twice)).select(*columns).unionByName(one.select("__row.*"))
    return out


#: Rows that are sent to the executors; more are joined by a shuffle.
SENT = 1 << 18


def _without(marked: DataFrame, gone: DataFrame) -> DataFrame:
    gone = cut(gone.distinct().toDF("__i", "__h", "__g"))
    return marked.join(F.broadcast(gone) if gone.count() <= SENT else gone, ["__i", "__h", "__g"], "left_anti")


def _run_tasks(tasks: DataFrame, num: int, den: int, total: int) -> DataFrame:
    """``total``: shingles of all nodes that could link, a bound on what the tasks read."""
    n = max(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-8 * total // TASK_BYTES), MOST_TASKS))
    return tasks.repartition(n, "root", "task").sortWithinPartitions("root", "task", "side").mapInArrow(_join_blocks(num, den), "a long, b long")


def op3_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs, words=4, num=85, den=100)


QUERIES = {"op3_jaccard": op3_jaccard}
ORACLES: dict = {}
