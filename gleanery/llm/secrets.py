"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
that every match must contain. A segment of documents gets postings for those
trigrams, the queries are answered by intersecting and uniting postings, and
only candidate documents are run through the expression. A rule without any
mandatory trigram scans every document.

Scale. An index segment is a few MB of text inside one task, like the segments
of a code-search index: postings never leave the task, there is no shuffle, no
broadcast but the rules, and a lost task is simply run again.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks

ALL = ("all",)
_MOST_STRINGS, _LONGEST, _LARGEST_CLASS = 64, 32, 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0  # whose length must reach ``least``
    base: bool = False

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in re.finditer(self.pattern, text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


#: The base kinds, in the order in which ties are listed, then the method's own.
RULES = (
    Rule("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, True),
    # runs of under 16 would be dropped; asked for like this they aren't matched first
    Rule("hex", r"[0-9a-f]{16,}", 16, 0, True),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
)


def fold(data: bytes) -> bytes:
    """A-Z to a-z: the index and the queries see folded bytes."""
    return data.lower()


def _both(a: tuple, b: tuple) -> tuple:
    return b if a == ALL else a if b == ALL or a == b else ("and", a, b)


def _either(parts: list[tuple]) -> tuple:
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[bytes]) -> tuple:
    """Some of these strings stands in the text."""
    options = []
    for s in sorted(strings):
        grams = sorted({s[i : i + 3] for i in range(len(s) - 2)})
        q = ALL
        for g in grams:
            q = _both(q, ("gram", g))
        options.append(q)
    return _either(options)


def _alone(code: int, flags: int) -> bytes | None:
    """The folded bytes that a character matches; None where it also matches others than its ASCII cases.

    With case ignored outside ASCII, a character may match any that Unicode
    folds to it, even an ASCII one: k the Kelvin sign, s the long s, i the
    dotted and the dotless i.
    """
    c = chr(code)
    if flags & re.IGNORECASE and not flags & re.ASCII and (not c.isascii() or c.lower() in "ksi"):
        return None
    return fold(c.encode())


def _sequence(items, flags: int) -> tuple[set[bytes] | None, tuple]:
    """The strings that the items match, if few; else None and a query that holds for each match."""
    now, query, whole = {b""}, ALL, True
    for op, arg in items:
        exact, sub = _item(op, arg, flags)
        if exact is not None and len(exact) * len(now) <= _MOST_STRINGS and max(map(len, exact)) + max(map(len, now)) <= _LONGEST:
            now = {a + b for a in now for b in exact}
            continue
        query, whole = _both(query, _of_strings(now)), False
        if exact is not None:
            now = exact
        else:
            query, now = _both(query, sub), {b""}
    return (now, ALL) if whole else (None, _both(query, _of_strings(now)))


def _item(op, arg, flags: int) -> tuple[set[bytes] | None, tuple]:
    if op is sre.LITERAL:
        one = _alone(arg, flags)
        return (None, ALL) if one is None else ({one}, ALL)
    if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
        return {b""}, ALL
    if op is sre.IN:
        codes: list[int] = []
        for kind, value in arg:
            if kind is sre.LITERAL:
                codes.append(value)
            elif kind is sre.RANGE and value[1] - value[0] <= _LARGEST_CLASS:
                codes += range(value[0], value[1] + 1)
            else:
                return None, ALL
        chars = {_alone(c, flags) for c in codes}
        return (chars, ALL) if 0 < len(chars) <= _LARGEST_CLASS and None not in chars else (None, ALL)
    if op is sre.SUBPATTERN:
        _, more, less, inner = arg
        return _sequence(inner, (flags | more) & ~less)
    if op is sre.BRANCH:
        parts = [_sequence(p, flags) for p in arg[1]]
        if all(e is not None for e, _ in parts) and len(u := set().union(*(e for e, _ in parts))) <= _MOST_STRINGS:
            return u, ALL
        return None, _either([_of_strings(e) if e is not None else q for e, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        exact, sub = _sequence(inner, flags)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {b""}, ALL
        if least == 0:
            return None, ALL
        if exact is None:
            return None, sub
        if least == most and len(exact) ** least <= _MOST_STRINGS and max(map(len, exact)) * least <= _LONGEST:
            out = {b""}
            for _ in range(least):
                out = {a + b for a in out for b in exact}
            return out, ALL
        return None, _of_strings(exact)
    return None, ALL


def trigram_query(pattern: str) -> tuple:
    """``("all",)``, ``("gram", g)``, ``("and", ..)`` or ``("or", ..)``: true of every text with a match."""
    tree = sre_parse.parse(pattern)
    exact, query = _sequence(tree, tree.state.flags)
    return _of_strings(exact) if exact is not None else query


def grams_of(query: tuple) -> set[bytes]:
    if query[0] == "gram":
        return {query[1]}
    return set().union(*map(grams_of, query[1:])) if query != ALL else set()


@dataclass
class SegmentIndex:
    """Postings of the wanted trigrams over one segment of texts."""

    wanted: list[bytes]
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        # three folded bytes to the trigram's number; 16M entries, whatever the data
        self.table = np.full(1 << 24, -1, np.int16)
        for i, g in enumerate(self.wanted):
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """A row for each trigram, a column for each text."""
        found = np.zeros((max(1, len(self.wanted)), len(texts)), bool)
        data = np.frombuffer(fold(b"\n\n".join(texts)), np.uint8)
        if len(data) < 3 or not self.wanted:
            return found
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        code = data[:-2].astype(np.int32)
        for more in (data[1:-1], data[2:]):
            code <<= 8
            code |= more
        hit = self.table[code]
        at = np.flatnonzero(hit >= 0)
        doc = np.searchsorted(starts, at, "right") - 1
        found[hit[at], doc] = True
        return found


def _answer(query: tuple, found: np.ndarray, number: dict[bytes, int]) -> np.ndarray:
    if query == ALL:
        return np.ones(found.shape[1], bool)
    if query[0] == "gram":
        return found[number[query[1]]]
    parts = [_answer(q, found, number) for q in query[1:]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def _scanner(rules: tuple[Rule, ...], schema: pa.Schema) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        wanted = sorted(set().union(*map(grams_of, queries)))
        index, number = SegmentIndex(wanted), {g: i for i, g in enumerate(wanted)}
        for block in blocks(batches):
            texts = [t or "" for t in block.column(1).to_pylist()]
            found = index.postings([t.encode() for t in texts])
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for r, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                for d in np.flatnonzero(_answer(query, found, number)):
                    spans[d] += [(a, r, b) for a, b in rule.spans(texts[d])]
            counts = [[sum(r == k for _, r, _ in s) for s in spans] for k, rule in enumerate(rules)]
            say = lambda s, only: ",".join(f"{rules[r].kind}:{a}:{b}" for a, r, b in sorted(s) if rules[r].base or not only)
            columns = [block.column(0), *counts, [say(s, True) for s in spans], [say(s, False) for s in spans]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return scan


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: the id, ``n_<kind>`` of each rule, ``base_spans`` and ``spans``.

    Spans are ``kind:start:end`` in code points, ends exclusive, by start, then
    in the rules' order, joined by commas; leftmost non-overlapping per kind, so
    spans that start together are of different kinds and all are listed.

    Defined cases. Null or empty text: no spans. Null ids and repeated rows
    pass through, a result for each row. No rows: no rows. Texts are scanned
    whole, at any length. Other input columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *[T.StructField(f"n_{r.kind}", T.LongType()) for r in rules], T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(_scanner(tuple(rules), to_arrow_schema(schema)), schema)


def op10_secret_scan(spark, sf_dir):
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES: dict = {}
