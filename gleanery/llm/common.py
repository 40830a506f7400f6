"""Expressions that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a null id inside an operator: it sorts after every real id, and no real id is so large.
NULL_ID = "9223372036854775808"
ORDERED = "decimal(20,0)"

#: Code points 20 and 09 to 0D (hex): the white space of every contract here.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; the cheap ``lower`` serves where every byte is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def id_or_last(name: str) -> Column:
    """A whole number that orders rows by id, a null id last."""
    return F.coalesce(F.col(f"`{name}`").cast("long").cast(ORDERED), F.lit(NULL_ID).cast(ORDERED))


def id_of(ordered: Column) -> Column:
    """The id that ``id_or_last`` has put in order."""
    return F.when(ordered < F.lit(NULL_ID).cast(ORDERED), ordered.cast("long"))
