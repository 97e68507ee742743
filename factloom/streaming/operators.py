"""Stateful operators. State is keyed, kept by Spark, and without event time: revisions order results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: open documents at most.
OPEN_DOCUMENTS = 512


def _rows(frames: Iterator[pd.DataFrame], *order: str) -> list[dict]:
    parts = [f for f in frames if len(f)]
    return pd.concat(parts).sort_values(list(order), kind="stable").to_dict("records") if parts else []


def documents(events: DataFrame) -> DataFrame:
    """Editor events (uri, seq, kind, text, start, end, version) folded into documents.

    ``open`` sets the text, ``change`` replaces code points from start to end (all of it with a null
    start), ``save`` keeps it, ``close`` ends it. A second open of another text, a change of a closed
    document and an old version are refused. Each event gives a row: uri, seq, status, version, text.
    """

    def fold(key, frames, state: GroupState):
        text, version, opened = state.get if state.exists else ("", -1, False)
        out = []
        for e in _rows(frames, "seq"):
            status, new = "accepted", None if pd.isna(e["version"]) else int(e["version"])
            if e["kind"] == "open":
                if opened and e["text"] != text:
                    status = "refused: open with another text"
                else:
                    text, version, opened = e["text"], -1 if new is None else new, True
            elif not opened:
                status = "refused: not open"
            elif e["kind"] == "change":
                if new is not None and new <= version:
                    status = "refused: old version"
                elif pd.isna(e["start"]):
                    text, version = e["text"], version if new is None else new
                elif not 0 <= e["start"] <= e["end"] <= len(text):
                    status = "refused: range"
                else:
                    text, version = text[: int(e["start"])] + e["text"] + text[int(e["end"]) :], version if new is None else new
            elif e["kind"] == "close":
                opened = False
            out.append((key[0], int(e["seq"]), status, version, text))
        state.update((text, version, opened))
        yield pd.DataFrame(out, columns=["uri", "seq", "status", "version", "text"])

    return events.groupBy("uri").applyInPandasWithState(fold, "uri string, seq long, status string, version long, text string", "text string, version long, opened boolean", "append", GroupStateTimeout.NoTimeout)


def stale_results(results: DataFrame) -> DataFrame:
    """Results (key, seq, revision) with ``accepted``: not older than the greatest revision before them.

    The revision is the watermark. Spark's own watermark goes by clock and would drop others.
    """

    def fold(key, frames, state: GroupState):
        seen = state.get[0] if state.exists else None
        out = []
        for e in _rows(frames, "seq"):
            ok = seen is None or e["revision"] >= seen
            seen = max(seen if seen is not None else e["revision"], e["revision"])
            out.append((key[0], int(e["seq"]), int(e["revision"]), bool(ok)))
        if seen is not None:
            state.update((int(seen),))
        yield pd.DataFrame(out, columns=["key", "seq", "revision", "accepted"])

    return results.groupBy("key").applyInPandasWithState(fold, "key string, seq long, revision long, accepted boolean", "seen long", "append", GroupStateTimeout.NoTimeout)


def coalesced(requests: DataFrame) -> DataFrame:
    """Requests (key, request_id, start_ms, takes_ms) with the leader that was running when they came."""

    def fold(key, frames, state: GroupState):
        until, leader = state.get if state.exists else (-1, -1)
        out = []
        for e in _rows(frames, "start_ms", "request_id"):
            if leader < 0 or e["start_ms"] >= until:
                until, leader = int(e["start_ms"] + e["takes_ms"]), int(e["request_id"])
            out.append((key[0], int(e["request_id"]), leader))
        state.update((until, leader))
        yield pd.DataFrame(out, columns=["key", "request_id", "leader_id"])

    return requests.groupBy("key").applyInPandasWithState(fold, "key string, request_id long, leader_id long", "until long, leader long", "append", GroupStateTimeout.NoTimeout)


def memo(requests: DataFrame) -> DataFrame:
    """A memo: requests (key, seq, kind, revision, value) as hit, miss or invalidated.

    ``get`` is a hit while a value of the same revision is held, else a miss. ``put`` stores a value,
    but not one of an older revision; ``invalidate`` forgets values up to its revision.
    """

    def fold(key, frames, state: GroupState):
        value, revision = state.get if state.exists else ("", -1)
        out = []
        for e in _rows(frames, "seq"):
            r, answer = int(e["revision"]), None
            if e["kind"] == "put":
                outcome = "stored" if r >= revision else "stale"
                value, revision = (e["value"], r) if r >= revision else (value, revision)
            elif e["kind"] == "invalidate":
                outcome = "invalidated" if 0 <= revision <= r else "kept"
                value, revision = ("", -1) if 0 <= revision <= r else (value, revision)
            else:
                outcome = "hit" if revision == r else "miss"
                answer = value if outcome == "hit" else None
            out.append((key[0], int(e["seq"]), outcome, answer))
        state.update((value, revision))
        yield pd.DataFrame(out, columns=["key", "seq", "outcome", "value"])

    return requests.groupBy("key").applyInPandasWithState(fold, "key string, seq long, outcome string, value string", "value string, revision long", "append", GroupStateTimeout.NoTimeout)


def file_changes(scans: DataFrame) -> DataFrame:
    """Polled files (path, scan, sha256; null for a file that is gone) as created, modified and deleted.

    The first scan of a path that comes with scan 0 is the baseline and gives nothing. A failed scan
    sends no rows, so the last state stays.
    """

    def fold(key, frames, state: GroupState):
        known, digest = state.get if state.exists else (False, "")
        out = []
        for e in _rows(frames, "scan"):
            there = isinstance(e["sha256"], str)
            change = None
            if there and not digest:
                change = "created" if known or e["scan"] > 0 else None
            elif there and e["sha256"] != digest:
                change = "modified"
            elif not there and digest:
                change = "deleted"
            known, digest = True, e["sha256"] if there else ""
            if change:
                out.append((key[0], int(e["scan"]), change))
        state.update((known, digest))
        yield pd.DataFrame(out, columns=["path", "scan", "change"])

    return scans.groupBy("path").applyInPandasWithState(fold, "path string, scan long, change string", "known boolean, digest string", "append", GroupStateTimeout.NoTimeout)


def backend_states(events: DataFrame, quarantine: int = 5) -> DataFrame:
    """Backend events (backend, seq, kind) as states: start → running, crash → backoff or quarantined, stop → stopped.

    Each start of a running epoch raises it; the wait doubles with consecutive crashes.
    """

    def fold(key, frames, state: GroupState):
        name, epoch, crashes = state.get if state.exists else ("stopped", 0, 0)
        out = []
        for e in _rows(frames, "seq"):
            wait = 0
            if name == "quarantined":
                pass
            elif e["kind"] == "start":
                name, epoch = "running", epoch + 1
            elif e["kind"] == "healthy":
                crashes = 0
            elif e["kind"] == "crash":
                crashes += 1
                name = "quarantined" if crashes >= quarantine else "backoff"
                wait = 0 if name == "quarantined" else min(10_000, 100 * 2 ** (crashes - 1))
            elif e["kind"] == "stop":
                name = "stopped"
            out.append((key[0], int(e["seq"]), name, epoch, wait))
        state.update((name, epoch, crashes))
        yield pd.DataFrame(out, columns=["backend", "seq", "state", "epoch", "wait_ms"])

    return events.groupBy("backend").applyInPandasWithState(fold, "backend string, seq long, state string, epoch long, wait_ms long", "name string, epoch long, crashes long", "append", GroupStateTimeout.NoTimeout)


def minute_latency(requests: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling minutes of a stream of requests (at, method, latency_ms)."""
    return requests.withWatermark("at", lateness).groupBy(F.window("at", "1 minute"), "method").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms")).select(F.col("window.start").alias("minute"), "method", "n", "total_ms", "max_ms")


def debounced(events: DataFrame, quiet: str, lateness: str) -> DataFrame:
    """The last event (at, uri, id) of each quiet gap of a stream."""
    return events.withWatermark("at", lateness).groupBy(F.session_window("at", quiet), "uri").agg(F.max_by("id", "at").alias("last_id"), F.count("*").alias("n")).select("uri", "last_id", "n")


def to_completion(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet table, and read that."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)
