"""Typed properties as narrow rows, rules over them, and metadata reranking."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_calendar_date

SCALARS = "property string, pointer string, scalar_type string, exact_value string, numeric_value double, date_value string"
MAX_DEPTH = 64


def _kind(value) -> tuple[str, str, float | None]:
    if value is None:
        return "null", "null", None
    if isinstance(value, bool):
        return "bool", "true" if value else "false", None
    if isinstance(value, int):
        return ("i64" if -(1 << 63) <= value < 1 << 63 else "u64"), str(value), float(value)
    if isinstance(value, float):
        return "f64", repr(value), value
    return "string", str(value), None


def flatten_json(text: str | None) -> Iterator[tuple]:
    """(property, pointer, type, exact, numeric) of every scalar in an object; non-finite numbers are left out."""
    try:
        top = json.loads(text) if text else {}
    except ValueError:
        return
    if not isinstance(top, dict):
        return
    for name, value in top.items():
        todo = [(value, "", 0)]
        while todo:
            v, pointer, depth = todo.pop()
            if isinstance(v, (dict, list)):
                if depth < MAX_DEPTH:
                    items = v.items() if isinstance(v, dict) else enumerate(v)
                    todo += [(x, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}", depth + 1) for k, x in items]
                continue
            kind, exact, number = _kind(v)
            if number is None or math.isfinite(number):
                yield name, pointer, kind, exact, number


def property_scalars(rows: DataFrame, key: str, json_col: str) -> DataFrame:
    """(key, property, pointer, scalar_type, exact_value, numeric_value, date_value) of JSON objects, whatever their nesting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for row in flatten_json(text):
                    at.append(i)
                    found.append(row)
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[key, "property", "pointer", "scalar_type", "exact_value", "numeric_value"])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(key, F.col(json_col).cast("string")).mapInArrow(run, f"{key} {kind}, property string, pointer string, scalar_type string, exact_value string, numeric_value double")
    return out.withColumn("date_value", F.when((F.col("scalar_type") == "string") & is_calendar_date(F.col("exact_value")), F.col("exact_value")))


@dataclass(frozen=True)
class PropertyRule:
    """A typed test: presence, equality, or an inclusive range; values never change type."""

    rule_id: str
    property: str
    points: int
    kind: str | None = None  # of equality and ranges
    equals: str | None = None
    low: float | str | None = None
    high: float | str | None = None
    pointer: str | None = None

    def condition(self) -> Column:
        out = F.col("property") == self.property
        if self.pointer is not None:
            out &= F.col("pointer") == self.pointer
        if self.equals is not None:
            out &= (F.col("scalar_type") == self.kind) & (F.col("exact_value") == self.equals)
        if self.low is not None or self.high is not None:
            out &= F.col("date_value").isNotNull() if self.kind == "date" else F.col("scalar_type") == self.kind
            value, end = self._ordered()
            if self.low is not None:
                out &= value >= end(self.low)
            if self.high is not None:
                out &= value <= end(self.high)
        return out

    def _ordered(self):
        """The column that a range is over, and how an end of it is said: whole numbers are never doubles."""
        if self.kind == "date":
            return F.col("date_value"), F.lit
        if self.kind in ("i64", "u64"):
            return F.when(F.col("scalar_type") == self.kind, F.col("exact_value").try_cast("decimal(20,0)")), lambda x: F.lit(str(int(x))).cast("decimal(20,0)")
        return F.col("numeric_value"), lambda x: F.lit(float(x))


def property_points(scalars: DataFrame, rules: list[PropertyRule], key: str = "source_key") -> DataFrame:
    """Per source the points of the rules that it meets, each once. Rules are few and fixed."""
    tests = [F.max(F.when(r.condition(), F.lit(r.points))).alias(f"p{i}") for i, r in enumerate(rules)]
    total = sum((F.coalesce(F.col(f"p{i}"), F.lit(0)) for i in range(len(rules))), F.lit(0))
    return scalars.groupBy(key).agg(*tests).select(key, total.cast("int").alias("points"))


# Profiles

HORIZON_DAYS = (7, 30, 90, 365)
MAX_RULES, MAX_PROPERTY_RULES, MAX_POINTS = 32, 8, 32
POINTS = (-4, -2, -1, 1, 2, 4)


@dataclass(frozen=True)
class Profile:
    """A relevance profile; every signal adds its points, and points order hits inside a tier only."""

    recency_days: int | None = None
    recency_points: int = 0
    depth_at_most: int | None = None
    depth_at_least: int | None = None
    depth_points: int = 0
    folders: tuple[tuple[str, int], ...] = ()  # authority (+) and archive (-); the longest that holds a path wins
    properties: tuple[PropertyRule, ...] = ()

    def __post_init__(self):
        used = [p for p in (self.recency_points, self.depth_points, *(p for _, p in self.folders), *(r.points for r in self.properties)) if p]
        if any(p not in POINTS for p in used) or len(used) > MAX_RULES or len(self.properties) > MAX_PROPERTY_RULES or sum(map(abs, used)) > MAX_POINTS:
            raise ValueError("the profile's points are out of bounds")
        if self.recency_days is not None and self.recency_days not in HORIZON_DAYS:
            raise ValueError(f"recency is one of {HORIZON_DAYS} days")


def within_folder(path: Column, folder: str) -> Column:
    """By whole components: ``a/b`` holds ``a/b/c`` but not ``a/bc``."""
    return F.startswith(path, F.lit(folder.rstrip("/") + "/"))


def folder_depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def is_recent(mtime: Column, now: int, days: int) -> Column:
    return (mtime > 0) & (mtime <= now) & (now - mtime <= days * 86400)


def signals(profile: Profile, now: int) -> dict[str, Column]:
    """What each signal of a profile adds to a row with ``path`` and ``mtime``, but for property rules."""
    out = {}
    if profile.recency_days:
        out["recency"] = F.when(is_recent(F.col("mtime"), now, profile.recency_days), profile.recency_points).otherwise(0)
    depth, test = folder_depth(F.col("path")), F.lit(True)
    if profile.depth_at_most is not None:
        test &= depth <= profile.depth_at_most
    if profile.depth_at_least is not None:
        test &= depth >= profile.depth_at_least
    if profile.depth_points:
        out["depth"] = F.when(test, profile.depth_points).otherwise(0)
    if profile.folders:
        choice = None
        for folder, points in sorted(profile.folders, key=lambda f: (-len(f[0]), f[0])):
            held = within_folder(F.col("path"), folder)
            choice = F.when(held, points) if choice is None else choice.when(held, points)
        out["folder"] = choice.otherwise(0)
    return {k: F.coalesce(v, F.lit(0)).cast("int") for k, v in out.items()}


def signal_points(profile: Profile, now: int) -> Column:
    """Their sum."""
    return sum(signals(profile, now).values(), F.lit(0)).cast("int")


def explained(profile: Profile, now: int) -> Column:
    """The signals that moved a hit, by name in order: an array of (signal, points)."""
    every = F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("points")) for k, v in sorted(signals(profile, now).items())])
    return F.filter(every, lambda s: s["points"] != 0)


#: Fixed table: what the state of a signal's evidence allows an evaluation to conclude.
SIGNAL_STATES = {
    "matched": "strict", "nonmatched": "strict", "absent": "strict",
    "unsupported": "neutralized", "stale": "neutralized", "unavailable": "neutralized", "untrusted": "neutralized",
    "malformed": "fatal", "conflicting": "fatal", "missing": "fatal", "unauthorized": "fatal", "over_limit": "fatal",
}


def evaluation_verdict(states: DataFrame, key: str = "case_id", state: str = "state") -> DataFrame:
    """Per case the gravest of its signals' verdicts: fatal, then neutralized (its points count 0), then strict. An unknown state is fatal."""
    known = F.create_map(*[x for k, v in SIGNAL_STATES.items() for x in (F.lit(k), F.lit(v))])
    verdict = F.coalesce(F.element_at(known, F.col(state)), F.lit("fatal"))
    rank = F.when(verdict == "fatal", 2).when(verdict == "neutralized", 1).otherwise(0)
    out = states.groupBy(key).agg(F.max(rank).alias("r"), F.count_if(verdict == "neutralized").alias("neutralized_signals"))
    return out.select(key, F.element_at(F.array(F.lit("strict"), F.lit("neutralized"), F.lit("fatal")), F.col("r") + 1).alias("verdict"), "neutralized_signals")


def rerank(hits: DataFrame, sources: DataFrame, profile: Profile, now: int, scalars: DataFrame | None = None) -> DataFrame:
    """Hits (with tier_no, rank, path, source_key) by tier, then points, then their first order.

    ``sources`` has source_key and mtime; only sources of hits are looked up.
    """
    some = sources.join(hits.select("source_key").distinct(), "source_key", "left_semi").select("source_key", "mtime")
    rows = hits.join(some, "source_key", "left").withColumn("points", F.coalesce(signal_points(profile, now), F.lit(0)))
    if profile.properties and scalars is not None:
        near = scalars.join(hits.select("source_key").distinct(), "source_key", "left_semi")
        more = property_points(near, list(profile.properties)).withColumnRenamed("points", "more")
        rows = rows.join(more, "source_key", "left").withColumn("points", F.col("points") + F.coalesce("more", F.lit(0))).drop("more")
    order = Window.orderBy("tier_no", F.desc("points"), "rank", "chunk_id", "path")
    return rows.withColumn("new_rank", F.row_number().over(order))


def compare_rankings(reranked: DataFrame) -> DataFrame:
    """Where each hit stood by text alone, where it stands now, and why."""
    moved = F.col("rank") - F.col("new_rank")
    return reranked.select("chunk_id", "path", F.col("rank").alias("text_rank"), F.col("new_rank").alias("balanced_rank"), moved.alias("moved"), "points", F.when(moved > 0, "raised").when(moved < 0, "lowered").otherwise("unmoved").alias("verdict"))
