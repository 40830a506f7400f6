"""Suffix-array dedup: remove every byte that a long repeated string covers.

The sorted suffixes are sparse. Every window of ``length`` bytes owns the
position, its anchor, at which the hash of ``GRAM`` bytes is least in it; equal
windows own anchors at equal distances. So only suffixes at anchors are sorted,
each for all windows that own it, and only anchors whose gram occurs again.

A task sorts its suffixes into a run and front-codes it: each suffix says how
many bytes it shares with the one before, and the rest. Runs are exchanged by
gram and merged by a loser tree in which every contender knows the prefix it
shares with the last winner: unequal prefixes decide a match without a look at
the strings, equal ones are compared behind the known prefix only, and the
winner's successor brings its prefix from the front code. The merged order with
its common prefixes tells, for each window, which others continue equally to
its right; equal bytes to the left (a rolling hash) complete a repeat.

Scale. Texts are shuffled once; all else is anchors, about one in 85 bytes.
Copies within a task are settled there and say one suffix to the exchange. A
gram so frequent that its many different contexts would fill a merge is dealt
out window by window instead; there are at most ``MOST_HOT`` such grams, by
construction. Long texts are cut into pieces whose windows overlap.

Hashes of 64 bits stand for a document's key, for left contexts and for the
windows of frequent grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .blocks import tidy
from .jaccard import mix

LENGTH, GRAM = 200, 32
PIECE = 1 << 20  # bytes that are hashed at once
RUN = 300_000  # anchors in a run
#: A gram is frequent from this many occurrences on, or 1/MOST_HOT of all bytes.
HOT, MOST_HOT = 4096, 1 << 22
PART_BYTES = 8 << 20  # of text for each part of an exchange
TASK_BYTES = 128 << 20  # of text in a task that reads texts again, at most
MOST_TASKS = 1 << 16  # of an exchange; with more parts, a task takes several one after the other

_B = 0x9E3779B97F4A7C15 | 1
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

ANCHOR = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("most", "u1"), ("least", "u1"), ("many", "<u4")])
WINDOW = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("more", "u1")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
#: Rows of an exchange: for a part, or passing through to a document.
ROWS = "part int, kind int, doc long, data binary"
_ROWS = ["part", "kind", "doc", "data"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, doc, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(doc, pa.int64()), pa.array(data, pa.binary())], names=_ROWS)


def _by(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Groups of equal keys, in order."""
    order = np.argsort(key, kind="stable")
    key, arrays = key[order], [a[order] for a in arrays]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield key[a], *(x[a:b] for x in arrays)


# Anchors


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes at each position, by doubling."""
    h, size, power = _BYTES[data], 1, _B
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
    return mix(h)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts side by side (under 2^24 bytes): each anchor's position, its first and last window, and gram hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = _gram_hashes(data)
    low = np.uint64(0xFFFFFF)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    owner = (_sliding_least(key, length - GRAM + 1) & low).astype(np.int64)
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    p = np.arange(int(count.sum())) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    if not len(p):
        return none, none, none, np.zeros(0, np.uint64)
    o = owner[p]
    edge = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
    last = np.concatenate([edge[1:], [len(p)]]) - 1
    return o[edge], p[edge], p[last], h[o[edge]]


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """Texts side by side with bounds, documents and offsets; a long text in pieces whose windows are all its own."""
    held, docs, bases, size = [], [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            view = memoryview(text.as_buffer() or b"")
            for base in range(0, max(1, len(view) - length + 1), PIECE):
                part = view[base : base + PIECE + length - 1]
                if len(part) < length:
                    continue
                held.append(part)
                docs.append(doc)
                bases.append(base)
                size += len(part)
                if size >= PIECE:
                    yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), docs, bases
                    held, docs, bases, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), docs, bases


def _find_anchors(length: int, parts: int) -> Callable:
    """Grams to the exchange; anchors of grams that a task holds twice pass straight on."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held)
        _, first, inverse, count = np.unique(every["gram"], return_index=True, return_inverse=True, return_counts=True)
        here = count[inverse] > 1
        sent = every[first]
        sent["many"] = count
        rows = [(int(part), 0, 0, some.tobytes()) for part, some in _by((sent["gram"] % np.uint64(parts)).astype(np.int64), sent)]
        rows += [(int(doc) % parts, 1, int(doc), some.tobytes()) for doc, some in _by(every["doc"][here], every[here])]
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for data, bounds, docs, bases in _pieces(batches, length):
            at, first, last, gram = anchors(data, bounds, length)
            which = np.searchsorted(bounds, at, "right") - 1
            a = np.zeros(len(at), ANCHOR)
            a["gram"], a["doc"], a["at"] = gram, np.array(docs, np.int64)[which], at - bounds[which] + np.array(bases, np.int64)[which]
            a["most"], a["least"], a["many"] = at - first, at - last, 1
            held.append(a)
            n += len(a)
            if n >= RUN:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _match_grams(hot: int) -> Callable:
    """Anchors whose gram occurs again, by document; kind 2: frequent grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: list[np.ndarray] = []
        for b in batches:
            kind = b.column(1).to_numpy(zero_copy_only=False)
            data = b.column(3).to_pylist()
            sent += [np.frombuffer(data[i], ANCHOR) for i in np.flatnonzero(kind == 0)]
            keep = [(0, 1, d, x) for d, k, x in zip(b.column(2).to_pylist(), kind, data, strict=True) if k == 1]
            if keep:
                yield _rows(keep)
        if not sent:
            return
        every = np.concatenate(sent)
        sent = []
        _, inverse = np.unique(every["gram"], return_inverse=True)
        total = np.bincount(inverse, every["many"])[inverse]
        again = every[(total > 1) & (every["many"] == 1)]
        often = np.unique(every["gram"][total >= hot])
        rows = [(0, 1, int(doc), some.tobytes()) for doc, some in _by(again["doc"], again)]
        yield _rows([*rows, (0, 2, 0, often.tobytes())] if len(often) else rows)

    return run


# Front-coded runs and their merge


def encode_run(rights: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Of sorted strings: the prefix that each shares with the one before, and all remaining bytes."""
    width = max(map(len, rights), default=0)
    if not width:
        return np.zeros(len(rights), np.uint8), b""
    grid = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rights), np.uint8).reshape(-1, width)
    size = np.fromiter(map(len, rights), np.int64, len(rights))
    differ = grid[1:] != grid[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.concatenate([[0], np.minimum(lcp, np.minimum(size[1:], size[:-1]))]).astype(np.uint8)
    return lcp, b"".join(r[k:] for r, k in zip(rights, lcp.tolist(), strict=True))


def _extend(a: bytes, b: bytes, k: int) -> int:
    """The common prefix of two strings that share their first ``k`` bytes."""
    end = min(len(a), len(b))
    if a[k:end] == b[k:end]:
        return end
    low, high = k, end
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low if a[low] != b[low] else high


class LoserTree:
    """Merges sorted front-coded runs; a contender is (string, prefix shared with the last winner)."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self.runs, self.k = runs, len(runs)
        self.head: list[bytes | None] = [None] * self.k
        self.shared = [-1] * self.k
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._next(i, first=True)
        self.winner = self._play(1) if self.k > 1 else 0

    def _next(self, i: int, first: bool = False) -> None:
        item = next(self.runs[i], None)
        # the run's last string was the last winner, so its front code is the prefix shared with it
        self.head[i], self.shared[i] = (None, -1) if item is None else (item[0], 0 if first else item[1])

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        return self._match(node, self._play(2 * node), self._play(2 * node + 1))

    def _match(self, node: int, a: int, b: int) -> int:
        """The winner of two; the loser stays at the node with the prefix it shares with the winner."""
        x, y = self.shared[a], self.shared[b]
        if x < y:
            a, b = b, a
        elif x == y and x >= 0:
            s, t = self.head[a], self.head[b]
            k = _extend(s, t, x)
            if k < len(t) and (k == len(s) or s[k] < t[k]) or k == len(t) == len(s):
                self.shared[b] = k
            else:
                self.shared[a] = k
                a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, prefix shared with the string before) in sorted order."""
        while self.k and self.head[self.winner] is not None:
            i = self.winner
            yield i, self.shared[i]
            self._next(i)
            node, i = (i + self.k) // 2, i
            while node >= 1:
                i = self._match(node, i, self.loser[node])
                node //= 2
            self.winner = i


def _pack(lcp: np.ndarray, rest: bytes, size: np.ndarray, a: np.ndarray, left: bytes) -> bytes:
    data = b"".join([np.array([len(a), len(rest)], "<u4").tobytes(), lcp.tobytes(), size.astype(np.uint8).tobytes(), a.tobytes(), rest, left])
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, bytes]:
    data = pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)
    n, r = (int(x) for x in np.frombuffer(data, "<u4", 2))
    at = 8
    lcp = np.frombuffer(data, np.uint8, n, at)
    size = np.frombuffer(data, np.uint8, n, at + n)
    a = np.frombuffer(data, ANCHOR, n, at + 2 * n)
    at += 2 * n + n * ANCHOR.itemsize
    return lcp, size, a, data[at : at + r], data[at + r :]


def _strings(lcp: np.ndarray, size: np.ndarray, rest: bytes) -> Iterator[tuple[bytes, int]]:
    last, at = b"", 0
    for k, n in zip(lcp.tolist(), size.tolist(), strict=True):
        last = last[:k] + rest[at : at + n - k]
        at += n - k
        yield last, k


def _each_part(work: Callable) -> Callable:
    """``work`` on one part after the other, of rows in which a part's rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            part = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                if held and part[a] != at:
                    yield from work(iter(held))
                    held = []
                at = part[a]
                held.append(b.slice(a, z - a))
        if held:
            yield from work(iter(held))

    return run


def _dealt(rows: DataFrame, parts: int, work: Callable) -> DataFrame:
    """Rows dealt out by part, each part worked on alone."""
    tasks = min(parts, MOST_TASKS)
    dealt = rows.repartitionById(tasks, F.expr(f"pmod(part, {tasks})").cast("int"))
    if tasks < parts:
        return dealt.sortWithinPartitions("part").mapInArrow(tidy(_each_part(work)), ROWS)
    return dealt.mapInArrow(tidy(work), ROWS)


def _send_suffixes(length: int, parts: int, hot) -> Callable:
    """Documents with their matched anchors to front-coded runs, and spans that are settled here."""

    class Out:
        def __init__(self):
            self.anchors: list[np.ndarray] = []
            self.texts: list[bytes] = []
            self.windows: list[np.ndarray] = []
            self.held = 0

        def flush(self) -> Iterator[pa.RecordBatch]:
            spans: list[tuple[int, int, int]] = []
            rows: list[tuple] = []
            if self.anchors:
                rows += self._suffixes(spans)
            if self.windows:
                rows += self._windows(spans)
            if spans:
                s = np.array(spans, np.int64)
                for doc, start, end in _by(s[:, 0], s[:, 1], s[:, 2]):
                    rows.append((int(doc) % parts, 1, int(doc), _spans(start, end)))
            self.__init__()
            yield _rows(rows)

        def _suffixes(self, spans) -> list[tuple]:
            a = np.concatenate(self.anchors)
            # equal pieces with equal windows are settled: one goes on, to tell others
            seen: dict[tuple, int] = {}
            keep, twice = [], np.zeros(len(a), bool)
            at, most, least = a["at"].tolist(), a["most"].tolist(), a["least"].tolist()
            members: dict[int, list[int]] = {}
            for i, text in enumerate(self.texts):
                key = (text, most[i])
                j = seen.setdefault(key, i)
                if j == i:
                    keep.append(i)
                else:
                    twice[j] = True
                    members.setdefault(j, [j]).append(i)
            for group in members.values():
                for i in group:
                    spans.append((int(a["doc"][i]), at[i] - most[i], at[i] - least[i] + length))
            part = (a["gram"] % np.uint64(parts)).astype(np.int64).tolist()
            rights = [self.texts[i][most[i] :] for i in range(len(a))]
            keep.sort(key=lambda i: (part[i], rights[i]))
            a = a.copy()
            a["many"] = np.where(twice, 2, 1)
            rows = []
            keep = np.array(keep)
            for p, some in _by(np.array(part)[keep], keep):
                mine = [rights[i] for i in some]
                lcp, rest = encode_run(mine)
                left = b"".join(self.texts[i][: most[i]][::-1] for i in some)
                rows.append((int(p), 0, 0, _pack(lcp, rest, np.fromiter(map(len, mine), np.int64, len(mine)), a[some], left)))
            return rows

        def _windows(self, spans) -> list[tuple]:
            w = np.concatenate(self.windows)
            _, first, inverse, count = np.unique(w["hash"], return_index=True, return_inverse=True, return_counts=True)
            for x in w[count[inverse] > 1]:
                spans.append((int(x["doc"]), int(x["at"]), int(x["at"]) + length))
            sent = w[first]
            sent["more"] = count > 1
            return [(int(p), 2, 0, some.tobytes()) for p, some in _by((sent["hash"] % np.uint64(parts)).astype(np.int64), sent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out()
        for batch in batches:
            for doc, text, lists in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                view = text.as_buffer().to_pybytes()
                a = np.concatenate([np.frombuffer(x, ANCHOR) for x in lists])
                often = np.zeros(len(a), bool)
                if len(hot.value):
                    often = hot.value[np.minimum(np.searchsorted(hot.value, a["gram"]), len(hot.value) - 1)] == a["gram"]
                plain = a[~often]
                if len(plain):
                    out.anchors.append(plain)
                    out.texts += [view[x - m : x - k + length] for x, m, k in zip(plain["at"].tolist(), plain["most"].tolist(), plain["least"].tolist(), strict=True)]
                for x in a[often]:
                    start = int(x["at"]) - int(x["most"])
                    h = window_hashes(np.frombuffer(view, np.uint8, int(x["most"]) - int(x["least"]) + length, start), length)
                    w = np.zeros(len(h), WINDOW)
                    w["hash"], w["doc"], w["at"] = h, doc, start + np.arange(len(h))
                    out.windows.append(w)
                    out.held += len(h) // 10
                out.held += len(plain)
                if out.held >= RUN // 3:
                    yield from out.flush()
        if out.anchors or out.windows:
            yield from out.flush()

    return run


with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(512, _B, np.uint64))


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of up to 511 bytes, that of equal windows equal anywhere."""
    n = len(data) - length + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * _POWERS[: len(data)])])
        # scaled to a common power, so that the place doesn't matter
        return mix((sums[length:] - sums[:n]) * _POWERS[::-1][:n])


def _spans(start, end) -> bytes:
    s = np.zeros(len(start), SPAN)
    s["start"], s["end"] = start, end
    return s.tobytes()


def _merge_runs(length: int) -> Callable:
    """Runs of one part to the spans of repeated windows, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, windows = [], []
        for b in batches:
            kinds, docs, data = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            runs += [_unpack(x) for k, x in zip(kinds, data, strict=True) if k == 0]
            windows += [np.frombuffer(x, WINDOW) for k, x in zip(kinds, data, strict=True) if k == 2]
            keep = [(0, 1, d, x) for k, d, x in zip(kinds, docs, data, strict=True) if k == 1]
            if keep:
                yield _rows(keep)
        doc, start, end = [], [], []
        for found in (_repeats(runs, length), _window_repeats(windows, length)):
            if found is not None:
                for whole, x in zip((doc, start, end), found, strict=True):
                    whole.append(x)
        if doc:
            yield _rows([(0, 1, int(d), _spans(s, e)) for d, s, e in _by(*(np.concatenate(x) for x in (doc, start, end)))])

    return run


def _window_repeats(windows: list[np.ndarray], length: int):
    if not windows:
        return None
    w = np.concatenate(windows)
    _, inverse = np.unique(w["hash"], return_inverse=True)
    times = np.bincount(inverse, 1 + w["more"])[inverse]
    w = w[(times > 1) & (w["more"] == 0)]
    return w["doc"], w["at"].astype(np.int64), w["at"].astype(np.int64) + length


def _repeats(runs: list[tuple], length: int):
    if not runs:
        return None
    n = sum(len(r[0]) for r in runs)
    base = np.cumsum([0, *(len(r[0]) for r in runs)])
    order, lcp, position = np.empty(n, np.int64), np.empty(n, np.int64), base[:-1].tolist()
    for t, (i, k) in enumerate(LoserTree([_strings(r[0], r[1], r[3]) for r in runs])):
        order[t], lcp[t] = position[i], k
        position[i] += 1
    a = np.concatenate([r[2] for r in runs])
    # left contexts, nearest byte first, as rows of one width
    most = a["most"].astype(np.int64)
    left = np.zeros((n, length - GRAM), np.uint8)
    flat = np.frombuffer(b"".join(r[4] for r in runs), np.uint8)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(most) - most, most)
    left[np.repeat(np.arange(n), most), column] = flat
    # groups that share the gram; alone in it, a suffix has no repeat
    same = lcp >= GRAM
    same[:1] = False
    near = same | np.concatenate([same[1:], [False]])
    order, lcp = order[near], np.where(same, lcp, 0)[near]
    if not len(order):
        return None
    a, left = a[order], left[order]
    most, least, more = a["most"].astype(np.int64), a["least"].astype(np.int64), a["many"] > 1
    repeated = np.zeros((len(a), length - GRAM + 1), bool)
    hashed = np.zeros(len(a), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(length - GRAM + 1):
            if r:
                hashed = hashed * np.uint64(_B) + _BYTES[left[:, r - 1]]
            use = np.flatnonzero((least <= r) & (r <= most))
            if len(use) < 2:
                continue
            interval = np.cumsum(lcp < length - r)[use].astype(np.uint64)
            key = mix(mix(hashed[use]) + interval * np.uint64(_B))
            sort = np.argsort(key)
            equal = key[sort][1:] == key[sort][:-1]
            repeated[use[sort[1:][equal]], r] = True
            repeated[use[sort[:-1][equal]], r] = True
    repeated[more] = False  # settled where they were found
    edge = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, behind = np.nonzero(edge == -1)
    at = a["at"].astype(np.int64)[row]
    return a["doc"][row], at - behind + 1, at - first + length


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans = [], [], []
        for text, lists in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            if not lists:
                kept.append(data)
                removed.append(0)
                spans.append(0)
                continue
            s = np.concatenate([np.frombuffer(x, SPAN) for x in lists])
            level = np.bincount(s["start"], minlength=len(data) + 1) - np.bincount(s["end"], minlength=len(data) + 1)
            gone = np.cumsum(level)[:-1] > 0
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=["id", "kept", "n_removed", "n_spans"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes that stay).

    A byte goes if a string of ``length`` bytes (``GRAM`` to 255) that covers it
    starts anywhere else too, in the same text or another. Matches never cross
    texts; texts are UTF-8 bytes, so ``kept`` may cut a character.

    Defined cases. Null or empty text, and texts under ``length`` bytes: nothing
    is removed. Null ids pass through; rows that repeat an id, even with the
    same text, are texts of their own. No rows: no rows. Texts are read whole,
    up to 2 GB each. Other input columns are not looked at.
    """
    if not GRAM <= length <= 255:
        raise ValueError(f"length must lie in {GRAM} to 255")
    spark = docs.sparkSession
    data = F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b""))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), data.alias("data")).withColumn("doc", F.xxhash64(F.isnull("id"), "id", "data"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    parts = int(max(1, -(-total // PART_BYTES)))
    found = base.select("doc", "data").mapInArrow(_find_anchors(length, parts), ROWS)
    hot = int(max(HOT, total // MOST_HOT))
    matched = cut(_dealt(found, parts, _match_grams(hot)))
    # sorted, at most MOST_HOT of them
    often = spark.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[0], "<u8") for r in matched.where("kind = 2").select("data").collect())])))

    # the session's number, or more where its share of the texts would be too large
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    texts = base.select("doc", "data", "id").repartition(n, "doc")
    lists = matched.where("kind = 1").groupBy("doc").agg(F.collect_list("data").alias("lists"))
    sent = texts.join(lists.hint("shuffle_hash"), "doc").select("doc", "data", "lists").mapInArrow(tidy(_send_suffixes(length, parts, often)), ROWS)
    spans = _dealt(sent, parts, _merge_runs(length))
    gone = spans.groupBy("doc").agg(F.collect_list("data").alias("lists"))
    out = texts.join(gone.hint("shuffle_hash"), "doc", "left").select("id", "data", "lists").mapInArrow(_remove, "id long, kept binary, n_removed long, n_spans long")
    return out.select(F.col("id").alias(id_col), (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept")


def op2_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES: dict = {}
