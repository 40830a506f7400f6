"""Lexical functions: folding, tokens, identifiers, excerpts, paths, dates, pointers."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Fixed values of the lexical profile.
MAX_NORMALIZED_BYTES = 4096
LONG_TOKEN_BYTES = 40
EXCERPT_CHARS = 240
IDENTIFIER = r"(?i)\b(?:cve(?:-\d{4}-\d+| \d{4} \d+)|rfc(?:[- ]?\d+)|[a-z0-9][a-z0-9._/:+\-]{2,})\b"

TOKEN = r"[\p{L}\p{N}]+"


#: White space as Unicode has it; splitting and collapsing use it on both sides, driver and executors.
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def fold_text(value: str) -> str:
    """Lower-case each character, decompose, drop combining marks."""
    if value.isascii():
        return value.lower()
    lowered = "".join(c.lower() for c in value)
    return "".join(c for c in unicodedata.normalize("NFD", lowered) if not unicodedata.category(c).startswith("M"))


@lru_cache(1)
def _fold_table() -> tuple[str, str, str]:
    """Characters that fold to one other, those they fold to, and a pattern of what a table can't fold.

    Folding works character by character, so a table says all of it but for
    characters that become several, and those outside the first plane.
    Characters that fold to nothing stand at the end of the first string.
    """
    one, gone, several = {}, [], []
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000))):
        to = fold_text(c)
        if len(to) > 1:
            several.append(ord(c))
        elif not to:
            gone.append(c)
        elif to != c:
            one[c] = to
    runs: list[list[int]] = []
    for code in several:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    others = "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in runs)
    return "".join((*one, *gone)), "".join(one.values()), f"[{others}\\x{{10000}}-\\x{{10FFFF}}]"


@arrow_udf(T.StringType())
def _fold_whole(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else fold_text(v) for v in values.to_pylist()], pa.string())


def fold(column: Column) -> Column:
    """Folding of a column, in the JVM but for values that a table of characters can't fold; all others are null to Python."""
    before, after, other = _fold_table()
    odd = column.rlike(other)
    plain = F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, before, after))
    return F.when(odd, _fold_whole(F.when(odd, column))).otherwise(plain)


def normalize_text(value: str) -> str | None:
    """White space collapsed, folded; None if empty or too long."""
    out = fold_text(re.sub(f"[{WHITE}]+", " ", value).strip(" "))
    return out if out and len(out.encode()) <= MAX_NORMALIZED_BYTES else None


def collapsed(column: Column) -> Column:
    return fold(F.btrim(F.regexp_replace(column, f"[{WHITE}]+", " ")))


def normalized(column: Column) -> Column:
    return bounded(collapsed(column))


def bounded(one: Column) -> Column:
    return F.when((F.length(one) > 0) & (F.octet_length(one) <= MAX_NORMALIZED_BYTES), one)


def tokens(column: Column) -> Column:
    """Folded tokens in order; tokens of ``LONG_TOKEN_BYTES`` or more are dropped, their places stay counted."""
    return F.regexp_extract_all(fold(column), F.lit(TOKEN), F.lit(0))


def short_token(token: Column) -> Column:
    return F.octet_length(token) < LONG_TOKEN_BYTES


def short_tokens(column: Column) -> Column:
    """The tokens that are kept, in order."""
    return F.filter(tokens(column), short_token)


def tokenize(value: str) -> list[str]:
    """The same tokens on the driver, for query text."""
    return [t for t in re.findall(r"[^\W_]+", fold_text(value)) if len(t.encode()) < LONG_TOKEN_BYTES]


def _counts_as_identifier(candidate: str) -> bool:
    digit = any(c.isascii() and c.isdigit() for c in candidate)
    return digit and (any(c.isalpha() for c in candidate) or any(c in "-_./:+ " for c in candidate))


def identifier_spans(source: str) -> list[tuple[int, int, str]]:
    out = []
    for m in re.finditer(IDENTIFIER, source):
        name = normalize_text(m[0]) if _counts_as_identifier(m[0]) else None
        if name:
            out.append((m.start(), m.end(), name))
    return out


def identifiers(column: Column) -> Column:
    """Distinct technical identifiers in order of first place."""
    found = F.regexp_extract_all(column, F.lit(IDENTIFIER), F.lit(0))
    has_digit = lambda x: x.rlike("[0-9]")
    fits = lambda x: x.rlike(r"\p{L}") | x.rlike(r"[-_./:+ ]")
    return F.array_distinct(F.transform(F.filter(found, lambda x: has_digit(x) & fits(x)), lambda x: F.lower(x)))


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name before its last dot; all of it where nothing would be left."""
    return F.regexp_replace(filename(path), r"(?<=.)\.[^.]*$", "")


def wikilinks(column: Column) -> Column:
    targets = F.regexp_extract_all(column, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    plain = F.transform(targets, lambda t: F.trim(F.element_at(F.split(F.element_at(F.split(t, r"\|"), 1), "#"), 1)))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda t: t != "")))


def is_calendar_date(column: Column) -> Column:
    return column.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(column, "yyyy-MM-dd").isNotNull()


def pointer_part(key: Column) -> Column:
    """One step of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def sized_digest(domain: str, *parts: Column) -> Column:
    """SHA-256 over a domain name and length-prefixed parts."""
    return F.sha2(F.concat(F.lit(domain + "\n"), *[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def subject_digest(subject: Column) -> Column:
    """What a log names a subject by."""
    return sized_digest("gleanery subject 1", subject)


def f64_bits(values: Column) -> Column:
    """The 16 hex digits of a double's bits: equality of doubles is by these."""
    return _bits(values.cast("double"))


@arrow_udf(T.StringType())
def _bits(values: pa.Array) -> pa.Array:
    import struct

    return pa.array([None if v is None else struct.pack(">d", v).hex() for v in values.to_pylist()], pa.string())


def excerpt(column: Column, chars: int = EXCERPT_CHARS) -> Column:
    return F.concat(F.left(column, F.lit(chars)), F.when(F.length(column) > chars, F.lit("…")).otherwise(F.lit("")))


def flat_excerpt(column: Column) -> Column:
    return F.btrim(F.regexp_replace(column, f"[{WHITE}]+", " "))


def snippet(terms: list[str], width: int = 160):
    """A UDF: the window around the first hit, HTML-escaped, hits in <b>; null where there is no hit."""
    from html import escape

    wanted = {fold_text(t) for t in terms if t}

    @arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            hits = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", v or "") if fold_text(m[0]) in wanted]
            if not hits:
                out.append(None)
                continue
            start = max(0, hits[0][0] - width // 3)
            end, at, text = min(len(v), max(start + width, hits[0][1])), start, ""
            for a, b in hits:
                if a >= start and b <= end:
                    text += escape(v[at:a]) + "<b>" + escape(v[a:b]) + "</b>"
                    at = b
            out.append(text + escape(v[at:end]))
        return pa.array(out, pa.string())

    return run


def highlight_terms(query: str, most: int = 32) -> list[str]:
    """Words of a query worth marking: no operators, no field names, at most ``most``."""
    words = re.findall(r"[^\W_]+", re.sub(r"\b(?:AND|OR|NOT)\b|\b\w+:", " ", query))
    return list(dict.fromkeys(fold_text(w) for w in words))[:most]


def hydrate_excerpt(content: str, terms: list[str], window: int = EXCERPT_CHARS, lead: int = 80, most: int = 512) -> str:
    """A flat window that starts ``lead`` characters before the first term, or the start of the text."""
    flat = re.sub(f"[{WHITE}]+", " ", content).strip(" ")
    folded = [fold_text(c) for c in flat]
    place = [i for i, f in enumerate(folded) for _ in f]  # folding may shorten or lengthen what stands before a hit
    whole = "".join(folded)
    at = min((i for i in (whole.find(t) for t in terms[:32] if t) if i >= 0), default=-1)
    start = max(0, place[at] - lead) if at >= 0 else 0
    cut = flat[start : start + min(window, most)]
    return ("…" if start else "") + cut + ("…" if start + len(cut) < len(flat) else "")
