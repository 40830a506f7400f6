"""Packing examples into training sequences by vector bin packing.

A piece of an example is a vector: its tokens, one segment, and its tokens that
bear loss. A sequence is a bin with a limit in each dimension. The dot-product
heuristic fills one bin at a time: among the waiting pieces that fit, it places
the one whose vector has the largest dot product with what the bin has left,
each dimension taken as a share of its limit. Where no waiting piece fits and
cutting is allowed, of those whose start fits the best one is cut to what is
left in tokens and in loss. A bin that ends underfull is cut into sequences
whose lengths are powers of two, which need no padding.

Scale. Every task packs the rows of its own partition out of a bounded pool of
waiting pieces: no shuffle, no group, memory independent of the input. A rerun
of a task over the same partition packs it the same way.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import RecentCache, blocks, held_by_process, offsets_of, take_ranges, tidy

#: A unit is a word with the space before it; ids of at most twice this many are kept.
CACHE_UNITS = 250_000
#: Limits of the registered query and the pipeline: tokens, segments and loss-bearing tokens of a sequence.
#: The first CONTEXT tokens of a document are only read: a full sequence holds so many at least.
TOKENS, SEGMENTS, LOSS, CONTEXT = 2048, 6, 2016, 32
#: Sequence ids: the partition's number, then the sequence's number in it.
SEQUENCE_BITS = 40


class Encoder:
    """Ids of a byte-level BPE tokenizer file, the same as the file's own tokenizer gives.

    Where white space never doubles, the tokenizer's splitting never crosses
    the start of a ' ' + word unit, so ids of units can be kept and joined;
    other texts are encoded whole.
    """

    #: White space that doubles, and anything that could start a special token.
    WHOLE = r"[\t-\r \x{85}\p{Z}\x1c-\x1f]{2}|<\|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache = RecentCache(CACHE_UNITS)
        self.fast = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        """The quick encoder over the same vocabulary, if its file lies beside; else None."""
        import base64
        import os

        ranks_path = path.rsplit(".", 1)[0] + ".tiktoken"
        if not os.path.exists(ranks_path):
            return None
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # inside a unit no white space doubles: a look-ahead for its end isn't needed
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
        return tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, units: list[str]) -> list[bytes]:
        if self.fast:
            return [array("I", self.fast(u)).tobytes() for u in units]
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(units, add_special_tokens=False)]

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.WHOLE).to_numpy(zero_copy_only=False))
        split = pc.split_pattern(texts, " ")
        flat, bounds = split.flatten(), offsets_of(split)
        first = np.zeros(len(flat), bool)
        first[bounds[:-1]] = True
        units = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(pa.scalar(""), flat, " ")).dictionary_encode()
        known = self.cache.get_all(units.dictionary.to_pylist(), self._encode)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        values = np.frombuffer(b"".join(known), np.uint32)
        code = units.indices.to_numpy()
        ids = take_ranges(values, (np.cumsum(sizes) - sizes)[code], sizes[code])
        ends = np.concatenate([[0], np.cumsum(sizes[code])])[bounds]
        out = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


@dataclass
class Piece:
    """Tokens ``start`` to ``start + len(ids)`` of an example; those from ``loss_from`` on bear loss."""

    example: int
    start: int
    ids: np.ndarray
    loss_from: int
    total: int

    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.loss_from))

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.example, self.start, self.ids[:at], self.loss_from, self.total), Piece(self.example, self.start + at, self.ids[at:], self.loss_from, self.total)


class VectorPacker:
    """Bins with limits on tokens, segments and loss-bearing tokens."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int = 512, cutting: bool = True):
        if min(tokens, segments, loss, pool) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.most_loss, self.pool, self.cutting = tokens, segments, loss, pool, cutting
        self.waiting: list[Piece | None] = [None] * pool
        self.vectors = np.zeros((pool, 2))  # tokens and loss of the waiting; 0 tokens: free
        self.free = list(range(pool))[::-1]

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes a piece; yields the bins that are full."""
        while True:
            part = self._whole_bin(piece)
            if part == 0:
                break
            head, piece = piece.cut(part)
            if part == self.tokens or not self.cutting:
                yield [head]
            else:  # loss is full before tokens are: what bears none may fill the rest
                if not self.free:
                    yield from self._fill()
                self._wait(head)
            if not len(piece.ids):
                return
        if not self.free:
            yield from self._fill()
        self._wait(piece)

    def _wait(self, piece: Piece) -> None:
        slot = self.free.pop()
        self.waiting[slot], self.vectors[slot] = piece, (len(piece.ids), piece.loss())

    def _whole_bin(self, piece: Piece) -> int:
        """Tokens of a piece that fill a bin by themselves; 0 if it may wait as it is."""
        n = self._prefix(piece, self.tokens, self.most_loss)
        return n if n < len(piece.ids) or n == self.tokens else 0

    @staticmethod
    def _prefix(piece: Piece, tokens: int, loss: int) -> int:
        """The longest start of a piece within both."""
        return min(len(piece.ids), tokens, max(piece.loss_from - piece.start, 0) + loss)

    def _take(self, slot: int) -> Piece:
        piece, self.waiting[slot] = self.waiting[slot], None
        self.vectors[slot] = 0
        self.free.append(slot)
        return piece

    def _fill(self) -> Iterator[list[Piece]]:
        """One bin from the pool."""
        bin_: list[Piece] = []
        left = self.limits.copy()
        while left[0] > 0 and left[1] > 0:
            t, lo = self.vectors[:, 0], self.vectors[:, 1]
            dot = t * (left[0] / self.limits[0] ** 2) + (t > 0) * (left[1] / self.limits[1] ** 2) + lo * (left[2] / self.limits[2] ** 2)
            fits = (t > 0) & (t <= left[0]) & (lo <= left[2])
            if fits.any():
                piece = self._take(int(np.argmax(np.where(fits, dot, -1.0))))
            elif self.cutting:
                # loss stands at a piece's end, so t - lo tokens bear none
                starts = np.minimum(np.minimum(t, left[0]), t - lo + left[2])
                slot = int(np.argmax(np.where(starts > 0, dot, -1.0)))
                if starts[slot] <= 0:
                    break
                piece, rest = self.waiting[slot].cut(int(starts[slot]))
                self.waiting[slot], self.vectors[slot] = rest, (len(rest.ids), rest.loss())
            else:
                break
            bin_.append(piece)
            left -= (len(piece.ids), 1, piece.loss())
        yield from self._close(bin_)

    def _close(self, bin_: list[Piece]) -> Iterator[list[Piece]]:
        """A bin as sequences: as it is if full, else cut at powers of two where cutting is allowed.

        What stands behind the first cut waits again, where there is room for it.
        """
        size = sum(len(p.ids) for p in bin_)
        if not self.cutting or size == self.tokens:
            if bin_:
                yield bin_
            return
        todo = bin_[::-1]
        while size:
            want = 1 << (size.bit_length() - 1)
            size -= want
            part: list[Piece] = []
            while want:
                piece = todo.pop()
                if len(piece.ids) > want:
                    piece, rest = piece.cut(want)
                    todo.append(rest)
                part.append(piece)
                want -= len(piece.ids)
            yield part
            if len(todo) < len(self.free) < self.pool - len(todo):
                for piece in todo:
                    self._wait(piece)
                return

    def finish(self) -> Iterator[list[Piece]]:
        while len(self.free) < self.pool:
            yield from self._fill()


_ENCODERS: dict[str, Encoder] = {}
held_by_process(_ENCODERS.clear)


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _packer(path: str, end_id: int | None, limits: tuple[int, int, int], pool: int, cutting: bool, schema: pa.Schema) -> Callable:
    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(path)
        packer = VectorPacker(*limits, pool=pool, cutting=cutting)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << SEQUENCE_BITS
        names: dict[int, object] = {}  # ids of examples with tokens that wait
        left: dict[int, int] = {}
        rows: list[tuple] = []
        held = 0

        def put(sequence: list[Piece]) -> None:
            nonlocal number, held
            offset = 0
            for p in sequence:
                rows.append((names[p.example], p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.total, number, offset, p.loss()))
                offset += len(p.ids)
                left[p.example] -= len(p.ids)
                if not left[p.example]:
                    del names[p.example], left[p.example]
            held += offset
            number += 1

        def out() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            rows.clear()
            held = 0
            return batch

        example = 0
        for block in blocks(batches, limit=8 << 20):
            keys, starts = block.column(0).to_pylist(), block.column(2).to_pylist()
            for key, loss_from, ids in zip(keys, starts, encoder.texts(block.column(1)), strict=True):
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                if not len(ids):
                    continue
                names[example], left[example] = key, len(ids)
                for sequence in packer.add(Piece(example, 0, ids, min(max(loss_from or 0, 0), len(ids)), len(ids))):
                    put(sequence)
                example += 1
                if held > 500_000:
                    yield out()
        for sequence in packer.finish():
            put(sequence)
        yield out()

    return pack_partition


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None, tokenizer: str | None = None, end_id: int | None = 1, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, context: int = CONTEXT, pool: int = 512, cutting: bool = True) -> DataFrame:
    """Pack texts into sequences of at most ``tokens`` tokens, ``segments`` pieces and ``loss`` loss-bearing tokens.

    A row per piece: the id, ``start`` (tokens of its text before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset`` in the sequence, ``loss_tokens``. Tokens from
    ``loss_from_col`` on bear loss (null: all; no column: from ``context`` on).
    ``cutting=False`` cuts only what no bin can hold.

    Defined cases. Null or empty text: ``end_id`` alone, or no row where that
    is None. Null ids pass through; rows that repeat an id are packed each.
    No rows: no rows. Texts of any length are packed whole. Other input
    columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("loss_tokens", T.LongType()),
    ])
    loss_from = F.col(f"`{loss_from_col}`").cast("long") if loss_from_col else F.lit(context).cast("long")
    work = _packer(tokenizer or default_tokenizer(), end_id, (tokens, segments, loss), pool, cutting, to_arrow_schema(schema))
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), loss_from).mapInArrow(tidy(work), schema)


def pack_digest(docs: DataFrame, **options) -> DataFrame:
    out = pack(docs, **options)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark, sf_dir):
    return pack_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict = {}
