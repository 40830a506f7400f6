"""File events as a stream: debounced batches of touched paths, with a rescan latch.

Events are classified, collected per vault until the vault is quiet or the
oldest event is old enough, and handed to a reconcile function. Late or
repeated events only force another look, so replays are harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUIET_MS, OLDEST_MS = 300, 2000
MOST_PATHS = 4096

BATCHES = "vault_id string, first_ms long, last_ms long, n_events long, n_paths long, full_rescan boolean, paths array<string>"
STATE = "first long, last long, events long, rescan boolean, paths array<string>"


MOST_ROOTS = 10_000


def classify(events: DataFrame, roots: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vault_id, path, ts, rescan) of raw events (kind, path, ts): a path may lie under several roots.

    Roots are configuration: there are ``MOST_ROOTS`` at most, so they may be sent to every task.
    """
    if roots.limit(MOST_ROOTS + 1).count() > MOST_ROOTS:
        raise ValueError(f"there are more than {MOST_ROOTS} roots")
    rescan = F.col("kind").isin("error", "rescan", "overflow", "config")
    named = events.withColumn("rescan", rescan).join(F.broadcast(roots), F.startswith(F.col("path"), F.concat(F.col("root"), F.lit("/"))) | F.col("rescan"))
    inside = F.when(~F.col("rescan"), F.substring("path", F.length("root") + 2, F.length("path")))
    return named.select(*keep, "vault_id", inside.alias("path"), "ts", "rescan")


def debounce_batches(events: DataFrame, quiet_ms: int = QUIET_MS, oldest_ms: int = OLDEST_MS, key: str = "vault_id", ts: str = "ts") -> DataFrame:
    """The batch rule over a finished table of events: a pause of ``quiet_ms``, or a first event ``oldest_ms`` old, ends a batch.

    Pauses are found by a window. Where a batch grows old depends on where it
    began, so within a run without pauses the times are folded in order.
    """
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    pause = F.coalesce((us - F.lag(us).over(w) >= quiet_ms * 1000).cast("int"), F.lit(1))
    runs = events.withColumn("__pause", pause).withColumn("__run", F.sum("__pause").over(w))
    times = runs.groupBy(key, "__run").agg(F.array_sort(F.collect_list(us)).alias("__ts"))
    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(None).cast("bigint").alias("first"))

    def step(held, x):
        new = held["first"].isNull() | (x["t"] - held["first"] >= oldest_ms * 1000)
        return F.struct(F.when(new, F.concat(held["starts"], F.array(x["i"]))).otherwise(held["starts"]).alias("starts"), F.when(new, x["t"]).otherwise(held["first"]).alias("first"))

    numbered = F.transform("__ts", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    rows = times.withColumn("__starts", F.aggregate(numbered, none, step)["starts"])
    spans = F.transform("__starts", lambda a, k: F.struct(a.alias("a"), F.coalesce(F.get("__starts", k + 1), F.size("__ts")).alias("z")))
    rows = rows.select(key, "__ts", F.explode(spans).alias("s")).select(key, F.get("__ts", F.col("s.a")).alias("first"), F.get("__ts", F.col("s.z") - 1).alias("last"), (F.col("s.z") - F.col("s.a")).cast("long").alias("n_events"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("first")).cast("long")
    at = lambda c: F.timestamp_micros(c).cast(events.schema[ts].dataType)
    return rows.select(key, number.alias("batch"), "n_events", at("first").alias("first_ts"), at("last").alias("last_ts"))


def rescan_latch(batches: DataFrame, paths: str = "n_paths", said: str | None = None) -> DataFrame:
    """More than ``MOST_PATHS`` paths, or an event that says so, make a batch a full rescan."""
    full = F.col(paths) > MOST_PATHS
    return batches.withColumn("full_rescan", full | F.coalesce(F.col(said), F.lit(False)) if said else full)


def merge_back(pending: DataFrame, failed: DataFrame) -> DataFrame:
    """What waits after a pass failed: its batch joins what came meanwhile, per vault; a full rescan stays one.

    Both: (vault_id, paths, full_rescan).
    """
    rows = pending.select("vault_id", "paths", "full_rescan").unionByName(failed.select("vault_id", "paths", "full_rescan"))
    paths = F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths"))))
    out = rows.groupBy("vault_id").agg(paths.alias("paths"), F.bool_or("full_rescan").alias("said"))
    out = out.withColumn("full_rescan", F.col("said") | (F.size("paths") > MOST_PATHS))
    return out.select("vault_id", F.when(F.col("full_rescan"), F.array().cast("array<string>")).otherwise(F.col("paths")).alias("paths"), "full_rescan")


SAFETY_SECONDS = 60


def safety_passes(passes: DataFrame, until, every: int = SAFETY_SECONDS, key: str = "vault_id", ts: str = "ts") -> DataFrame:
    """Full passes that fall due between and after the passes of a vault: one each ``every`` seconds without any."""
    w = Window.partitionBy(key).orderBy(ts)
    rows = passes.select(key, F.col(ts).cast("timestamp").alias("__at"), F.coalesce(F.lead(F.col(ts).cast("timestamp")).over(w), until.cast("timestamp")).alias("__next"))
    due = F.floor((F.unix_micros("__next") - F.unix_micros("__at") - 1) / F.lit(every * 1_000_000).cast("long")).cast("int")
    rows = rows.where(due >= 1).select(key, "__at", F.explode(F.sequence(F.lit(1), due)).alias("k"))
    return rows.select(key, F.timestamp_micros(F.unix_micros("__at") + F.col("k") * F.lit(every * 1_000_000).cast("long")).alias(ts))


def safety_stream(spark, vaults: list[str], every: int = SAFETY_SECONDS) -> DataFrame:
    """The same as a stream: a full-rescan batch for each vault at each tick, in the shape of ``pending_batches``."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % every == every - 1)
    ms = F.unix_millis("timestamp")
    return ticks.select(F.explode(F.array(*map(F.lit, vaults))).alias("vault_id"), ms.alias("first_ms"), ms.alias("last_ms"), F.lit(0).cast("long").alias("n_events"), F.lit(0).cast("long").alias("n_paths"), F.lit(True).alias("full_rescan"), F.array().cast("array<string>").alias("paths"))


def _pending(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    first, last, events, rescan, paths = state.get if state.exists else (None, None, 0, False, [])
    paths, out = dict.fromkeys(paths), []

    def close():
        nonlocal first, last, events, rescan, paths
        out.append({"vault_id": key[0], "first_ms": first, "last_ms": last, "n_events": events, "n_paths": len(paths), "full_rescan": rescan, "paths": [] if rescan else sorted(paths)})
        first, last, events, rescan, paths = None, None, 0, False, {}

    if state.hasTimedOut:
        if events:
            close()
    else:
        rows = pd.concat(list(frames)).sort_values("ms", kind="stable")
        for ms, path, again in zip(rows["ms"], rows["path"], rows["rescan"], strict=True):
            if first is not None and (ms - last >= QUIET_MS or ms - first >= OLDEST_MS):
                close()
            first, last, events = ms if first is None else first, ms, events + 1
            rescan = bool(rescan or again)
            if path is not None and not rescan:
                paths[path] = None
                rescan = len(paths) > MOST_PATHS
    if events:
        state.update((int(first), int(last), int(events), rescan, [] if rescan else list(paths)))
        state.setTimeoutDuration(QUIET_MS)
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out)


def pending_batches(classified: DataFrame) -> DataFrame:
    """The streaming form: state per vault holds at most ``MOST_PATHS`` paths, then only the latch."""
    rows = classified.select("vault_id", "path", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "rescan")
    return rows.groupBy("vault_id").applyInPandasWithState(_pending, BATCHES, STATE, "append", "ProcessingTimeTimeout")


def run_reconcile(batches: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, follow: Callable[[DataFrame, int], None] | None = None, available_now: bool = True):
    """Hand each batch to ``act``; ``follow`` (vectors) runs after it and may fail without undoing it."""
    failures: list[str] = []

    def both(frame: DataFrame, epoch: int) -> None:
        act(frame, epoch)
        if follow is not None:
            try:
                follow(frame, epoch)
            except Exception as e:  # a warning by contract: the lexical side is committed
                failures.append(f"epoch {epoch}: {e}")

    writer = batches.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).outputMode("append")
    query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{QUIET_MS} milliseconds")).start()
    query.failures = failures
    return query


def drain(query, seconds: float = 120.0) -> None:
    """Stops a stream once a trigger has found nothing new to read.

    Timers of processing time always have something to do, so such a stream
    neither ends by itself nor tells that all is processed.
    """
    for _ in range(int(seconds * 5)):
        if query.awaitTermination(0.2):
            return
        read = [p["numInputRows"] for p in query.recentProgress]
        if any(read) and not read[-1]:
            break
    query.stop()


STALE_AFTER = 120.0


def freshness(age_seconds: float | None, reconciling: bool, stale_after: float = STALE_AFTER) -> str:
    """The state that a status row shows."""
    if age_seconds is None:
        return "unavailable"
    return "reconciling" if reconciling else "stale" if age_seconds > stale_after else "current"


def freshness_state(age_seconds: Column, reconciling: Column, stale_after: float = STALE_AFTER) -> Column:
    """The same over columns."""
    return F.when(age_seconds.isNull(), "unavailable").when(reconciling, "reconciling").when(age_seconds > stale_after, "stale").otherwise("current")
