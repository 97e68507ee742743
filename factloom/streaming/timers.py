"""Streams with timers: deadlines and cancellation of requests, restartable debouncing; and the lifecycle of a session.

Events of a key are taken in the order of their time, as soon as the watermark has passed
them, so that results depend neither on the order of arrival within the lateness nor on
where micro-batches are cut. A key holds timers by name, which event time ends: they are
set, moved and taken back by events, and go off once the watermark has passed them. A
timer that is due no later than an event goes off before it.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, name string, seq bigint, outcome string, at_ms bigint"
NAMES = ["key", "name", "seq", "outcome", "at_ms"]


def timed(events: DataFrame, lateness: str, meet: Callable[[dict | None, dict], tuple[dict | None, list]], ring: Callable[[dict], list]) -> DataFrame:
    """Events (key, name, seq, at, kind, amount) folded by ``meet`` (timer, event) -> (timer, results); ``ring`` is what a timer gives.

    A key has a timer for each of its names, a dict with ``due`` in milliseconds. Results are
    (seq, outcome, at_ms). Events later than the watermark are dropped by Spark; events of one time
    are taken by their ``seq``.
    """

    def fold(key, frames, state: GroupState):
        timers, waiting = json.loads(state.get[0]) if state.exists else ({}, [])
        for f in frames:
            waiting += [[int(at), int(seq), name, kind, None if pd.isna(amount) else float(amount)] for at, seq, name, kind, amount in zip(f["at_ms"], f["seq"], f["name"], f["kind"], f["amount"])]
        passed, out = state.getCurrentWatermarkMs(), []
        clock = [(t["due"], name) for name, t in timers.items()]
        heapq.heapify(clock)

        def until(at: int) -> None:
            """Timers that are due before ``at`` go off; those moved or taken back meanwhile stand elsewhere in the queue or nowhere."""
            while clock and clock[0][0] < at:
                due, name = heapq.heappop(clock)
                if name in timers and timers[name]["due"] == due:
                    out.extend((name, *r) for r in ring(timers.pop(name)))

        waiting.sort(key=lambda e: (e[0], e[1]))
        done = bisect_left(waiting, [passed])
        for at, seq, name, kind, amount in waiting[:done]:
            until(at + 1)
            timer, results = meet(timers.pop(name, None), {"at": at, "seq": seq, "kind": kind, "amount": amount})
            out.extend((name, *r) for r in results)
            if timer:
                timers[name] = timer
                heapq.heappush(clock, (timer["due"], name))
        until(passed)
        waiting = waiting[done:]
        if not timers and not waiting:
            state.remove() if state.exists else None
        else:
            state.update((json.dumps((timers, waiting)),))
            state.setTimeoutTimestamp(max(min([t["due"] for t in timers.values()] + [e[0] for e in waiting[:1]]), passed) + 1)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=NAMES)

    rows = events.withWatermark("at", lateness).select("key", "at", "name", "seq", "kind", "amount", (F.unix_micros("at") / 1000).cast("long").alias("at_ms"))
    return rows.groupBy("key").applyInPandasWithState(fold, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def deadlines(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Requests of clients (key, name: start with their milliseconds as amount, end, cancel): each start gives one of done, cancelled, deadline.

    What comes for a request that isn't running is ``refused``: a second start, an end or a
    cancellation after the outcome.
    """

    def meet(timer, e):
        if e["kind"] == "start":
            return (timer, [(e["seq"], "refused", e["at"])]) if timer else ({"due": e["at"] + int(e["amount"]), "seq": e["seq"]}, [])
        if timer is None:
            return None, [(e["seq"], "refused", e["at"])]
        return None, [(timer["seq"], {"end": "done", "cancel": "cancelled"}[e["kind"]], e["at"])]

    return timed(events, lateness, meet, lambda timer: [(timer["seq"], "deadline", timer["due"])])


def debounced(events: DataFrame, quiet_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """Diagnostics computed once a document (key, name) has been quiet for a while, published only if it still is afterwards.

    Each event restarts the quiet time; then the computation runs for ``amount`` milliseconds. An
    event before it starts gives ``restarted``, one while it runs ``cancelled``; a computation that
    ends undisturbed is ``published``.
    """

    def meet(timer, e):
        begins = e["at"] + quiet_ms
        out = [] if timer is None else [(timer["seq"], "restarted" if e["at"] < timer["begins"] else "cancelled", e["at"])]
        return {"due": begins + int(e["amount"] or 0), "begins": begins, "seq": e["seq"]}, out

    return timed(events, lateness, meet, lambda timer: [(timer["seq"], "published", timer["due"])])


#: Methods of the protocol that change a session's state.
INITIALIZE, INITIALIZED, SHUTDOWN, EXIT = "initialize", "initialized", "shutdown", "exit"


def lifecycle(messages: DataFrame) -> DataFrame:
    """Messages (session, seq, method, request) under the protocol's lifecycle, one ordered state a session.

    Outcomes: ``accepted``; requests before initialize are ``not_initialized``, a second initialize
    and requests after shutdown are ``invalid``; other notifications out of their time are
    ``dropped``; ``exit`` ends the session with code 0 after a shutdown and 1 else, and all that
    follows is ``closed``. The state outlives a restart of the stream.
    """

    def fold(key, frames, state: GroupState):
        phase, out = state.get[0] if state.exists else "new", []
        rows = [f for f in frames if len(f)]
        for m in pd.concat(rows).sort_values("seq", kind="stable").to_dict("records") if rows else []:
            method, request, outcome = m["method"], bool(m["request"]), "accepted"
            if phase == "closed":
                outcome = "closed"
            elif method == EXIT:
                outcome, phase = ("exit_0" if phase == "down" else "exit_1"), "closed"
            elif method == INITIALIZE and phase == "new":
                phase = "ready"
            elif method == INITIALIZE or phase == "down":
                outcome = "invalid" if request else "dropped"
            elif phase == "new":
                outcome = "not_initialized" if request else "dropped"
            elif method == SHUTDOWN:
                phase = "down"
            out.append((key[0], int(m["seq"]), method, outcome))
        state.update((phase,))
        yield pd.DataFrame(out, columns=["session", "seq", "method", "outcome"])

    return messages.groupBy("session").applyInPandasWithState(fold, "session string, seq bigint, method string, outcome string", "phase string", "append", GroupStateTimeout.NoTimeout)
