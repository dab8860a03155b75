"""Live shot triggers with Structured Streaming: parsing, de-duplication, bursts, windows, enrichment."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotframe.operators.triggers import parse_line


def landed_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Trigger lines of files that land in a folder (whole files, moved in)."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def parsed(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """The lines that are triggers, with their fields."""
    return lines.withColumn("trigger", parse_line(F.col(text_col))).where("trigger IS NOT NULL")


def deduplicated(rows: DataFrame, keys: list[str], ts: str, horizon: str) -> DataFrame:
    """Of repeated messages within the horizon the first; state older than it goes."""
    return rows.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def shots_per_window(rows: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def collapsed(rows: DataFrame, key: str, millis: str, window_ms: int, late_ms: int = 60_000, forget_ms: int = 3_600_000) -> DataFrame:
    """(key, ms) of events, told at once: a touch that comes window_ms or more after the event before it.

    A touch that comes late is judged by its place in time: it is an event if it is that far from the event before it and from the one
    after it. State: the events of the last late_ms (those that came before are as good as one); it goes when nothing has come for forget_ms."""

    def step(keys, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [], millis: []})
            return
        events = json.loads(state.get[0]) if state.exists else []
        out = []
        for t in sorted(int(t) for part in parts for t in part[millis].dropna()):
            at = bisect.bisect_right(events, t)
            if (not at or t - events[at - 1] >= window_ms) and (at == len(events) or events[at] - t >= window_ms):
                events.insert(at, t)
                out.append(t)
        state.update((json.dumps([t for t in events if t >= events[-1] - late_ms]),))
        state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({key: [keys[0]] * len(out), millis: out})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, millis).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {millis} long", "events string", "append", "ProcessingTimeTimeout")


def collapsed_in_order(rows: DataFrame, key: str, millis: str, window_ms: int, wait_ms: int | None = None) -> DataFrame:
    """(key, ms) of events as ``collapsed`` has them, but exact for touches out of order: told once the watermark is past them.

    Touches are held until the watermark is wait_ms (by default window_ms) past them, so that those of later batches that came earlier are
    judged in their place; a touch that comes after that is late and dropped. State: the touches held and the last event's time; it
    goes when nothing is held and the last event is too old to matter. The watermark is set on the time that ``millis`` stands for."""

    def step(keys, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held, last = json.loads(state.get[0]) if state.exists else ([], None)
        if not state.hasTimedOut:
            held = sorted([*held, *(int(t) for part in parts for t in part[millis] if t > now)])
        out = []
        for t in [t for t in held if t <= now]:
            if last is None or t - last >= window_ms:
                out.append(t)
                last = t
        held = [t for t in held if t > now]
        if held or (last is not None and now - last < window_ms):
            state.update((json.dumps([held, last]),))
            # When the watermark has reached the first touch held, or the last event doesn't matter any more.
            state.setTimeoutTimestamp(max(now + 1, (held[0] if held else last + window_ms) - 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [keys[0]] * len(out), millis: out})

    wait, kind = window_ms if wait_ms is None else wait_ms, dict(rows.dtypes)[key]
    timed = rows.select(F.col(key), F.col(millis).cast("long").alias(millis)).where(F.col(millis).isNotNull()).withColumn("at", F.timestamp_millis(millis)).withWatermark("at", f"{wait} milliseconds")
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {millis} long", "held string", "append", "EventTimeTimeout")


def settled(sightings: DataFrame, key: str, size: str, modified: str, settle_ms: int, forget_ms: int) -> DataFrame:
    """(key, size, modified, settled_at) of landed files: one row for each landing, once its size has held still for settle_ms.

    sightings: a row for each time that a file was seen (key, size, modified in milliseconds, seen as a timestamp). A file that still
    grows is armed again; a sighting of size 0 or none drops what was known of its growth; the same landing (by its modification time)
    is told once. A file that isn't seen again has settled when the watermark is settle_ms past its last change. State: size, modification
    and time of the last change, and the landing told; it goes forget_ms after the file was last seen."""

    def step(keys, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        grown, told, latest = json.loads(state.get[0]) if state.exists else (None, None, 0)
        rows = [] if state.hasTimedOut else [(int(pd.Timestamp(at).value // 1_000_000), s, m) for part in parts for at, s, m in zip(part["seen"], part["size"], part["modified"], strict=True)]
        out = []

        def settle(at: int) -> None:
            nonlocal grown, told
            if grown[1] != told:
                told = grown[1]
                out.append((keys[0], grown[0], told, at))
            grown = None

        for at, s, m in sorted(rows, key=lambda x: x[0]):
            if at < latest:
                continue  # seen before what is known
            latest = at
            if pd.isna(s) or s <= 0:
                grown = None
            elif grown is None or grown[0] != s:
                grown = [int(s), int(m), at]
            else:
                grown[1] = int(m)
                if at - grown[2] >= settle_ms:
                    settle(at)
        if grown and now >= max(grown[2] + settle_ms, latest):
            settle(grown[2] + settle_ms)
        if grown or now < latest + forget_ms:
            state.update((json.dumps([grown, told, latest]),))
            state.setTimeoutTimestamp(max(now + 1, (max(grown[2] + settle_ms, latest) if grown else latest + forget_ms) - 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "size", "modified", "settled_at"])

    kind = dict(sightings.dtypes)[key]
    timed = sightings.select(F.col(key), F.col(size).cast("long").alias("size"), F.col(modified).cast("long").alias("modified"), "seen").withWatermark("seen", f"{settle_ms} milliseconds")
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, size long, modified long, settled_at long", "known string", "append", "EventTimeTimeout")


def with_landed_files(shots: DataFrame, files: DataFrame, number: str, ts: str, wait: str) -> DataFrame:
    """shots with the file of their number that lands within ``wait``; shots without one are kept."""
    a = shots.withWatermark(ts, wait).alias("s")
    b = files.withColumnRenamed(ts, "landed").withColumnRenamed(number, "file_number").withWatermark("landed", wait).alias("f")
    return a.join(b, F.expr(f"s.{number} = f.file_number AND f.landed BETWEEN s.{ts} AND s.{ts} + INTERVAL {wait}"), "leftOuter")
