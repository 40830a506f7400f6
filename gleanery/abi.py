"""Preparation and planning one call at a time, in plain values, for hosts without a session."""

from __future__ import annotations

from dataclasses import asdict

from .plans import planner
from .sources import formats, prepare


def _descriptor(source: dict) -> dict:
    """A source's descriptor: vault_id, path, byte_length; room and mtime may be missing. The format comes of the path."""
    path = str(source.get("path", ""))
    steps = path.split("/")
    if not source.get("vault_id") or not path or any(s in ("", ".", "..") for s in steps):
        raise ValueError("a source has a vault and a normalised relative path")
    ending = steps[-1].rpartition(".")
    known = formats.EXTENSIONS.get(ending[2].lower()) if ending[0] else None
    if known is None or source.get("format", known) != known:
        raise ValueError("the path's ending names no format, or another one")
    return {"vault_id": source["vault_id"], "room": source.get("room"), "path": path, "format": known, "mtime": int(source.get("mtime", 0))}


def prepare_source(source: dict, data: bytes) -> dict:
    """What ``prepare`` makes of one source."""
    return prepare.prepare_one(_descriptor(source) | {"content": data, "byte_length": len(data)})


def prepare_oversized(source: dict) -> dict:
    """The same for a source that is too large to be read."""
    length = int(source.get("byte_length", 0))
    if length <= formats.MAX_BYTES:
        raise ValueError("the source is not too large")
    return prepare.prepare_one(_descriptor(source) | {"content": None, "byte_length": length})


def prepare_query(query: str) -> dict:
    """A plan as plain values; ``finalize_query`` takes it back with what the corpus answered."""
    return asdict(planner.prepare(query))


def finalize_query(query: str, frequency: dict[int, int], expansions: dict[int, list[str]] | None = None, metadata_match: bool = False) -> dict:
    """The stages of a query; evidence is by the terms' numbers in the plan that ``prepare_query`` gave."""
    plan = planner.prepare(query)
    if unknown := [i for i in (*frequency, *(expansions or {})) if not 0 <= i < len(plan.terms)]:
        raise planner.QueryError("invalid_evidence", f"no terms have the numbers {unknown}")
    if any(len(v) > planner.MAX_EXPANSIONS for v in (expansions or {}).values()):
        raise planner.QueryError("invalid_evidence", "a term has too many expansions")
    grown = {i: tuple(v) for i, v in (expansions or {}).items()}
    return asdict(planner.finalize(plan, planner.Evidence(dict(frequency), grown, metadata_match)))


def prepare_typo(query: str) -> dict:
    """Which terms a vocabulary should be asked for."""
    word = planner.typo_word(query)
    return {"term": word, "prefix": word and word[: planner.TYPO_PREFIX], "most_candidates": planner.TYPO_CANDIDATES}


def finalize_typo(query: str, candidates: list[tuple[str, int]]) -> str | None:
    """The commonest candidate (term, frequency) one edit from the query's word."""
    word = planner.typo_word(query)
    if word is None or len(candidates) > planner.TYPO_CANDIDATES:
        return None
    near = [(-n, t) for t, n in candidates if n > 0 and t.startswith(word[: planner.TYPO_PREFIX]) and one_edit(word, t)]
    return min(near)[1] if near else None


def one_edit(a: str, b: str) -> bool:
    """Whether one letter more, less or other makes the words equal."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]
