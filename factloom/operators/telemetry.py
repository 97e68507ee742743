"""Latency, resources, queues and sessions: ordered analytics over logs."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.running import running_sum


def micros(at: Column | str) -> Column:
    """Microseconds of a time, with or without a zone."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The smallest value that has at least the share q of the values at or below it."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(name) for name, q in quantiles.items()])


def floor_rank(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The value at place int((n - 1) * q) of the sorted values. Not the same as ``nearest_rank``.

    Values are counted before they are ordered, so that a key's rows needn't be in one place: what
    is sorted is one row per distinct value.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("times of value"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto to value", F.sum("times of value").over(upto)).withColumn("n of all", F.sum("times of value").over(w))
    place = lambda q: F.floor((F.col("n of all") - 1) * F.lit(q))
    hit = lambda q: (F.col("upto to value") > place(q)) & (F.col("upto to value") - F.col("times of value") <= place(q))
    return ranked.groupBy(*keys).agg(F.max("n of all").alias("n"), *[F.max(F.when(hit(q), F.col(value))).alias(name) for name, q in quantiles.items()])


def minute_windows(log: DataFrame) -> DataFrame:
    """Requests per wall minute and method: count, sum and greatest latency."""
    return log.groupBy(F.date_trunc("minute", "at").alias("minute"), "method").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms"))


def resource_windows(samples: DataFrame, window: Column) -> DataFrame:
    """First, last, median, least and greatest value of each window (at, value)."""
    return samples.groupBy(window.alias("window")).agg(
        F.count("*").alias("n"),
        F.min_by("value", F.struct("at", "id")).alias("first"),
        F.max_by("value", F.struct("at", "id")).alias("last"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    )


def theil_sen(points: DataFrame, keys: list[str]) -> DataFrame:
    """Median of the slopes of all pairs of points (x, y) of a key; null with fewer than two places.

    Points are few by nature: one per window, of which a trend has ten.
    """
    a, b = points.alias("a"), points.alias("b")
    same = F.col("a.x") < F.col("b.x")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    slopes = a.join(b, same).select(*[F.col(f"a.{k}").alias(k) for k in keys], ((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("slope"))
    return slopes.groupBy(*keys).agg(F.median("slope").alias("slope"), F.count("*").alias("pairs"))


#: Windows of a trend, and growth in bytes and handles over it that is a leak.
TREND_WINDOWS, PRIVATE_LIMIT, HANDLE_LIMIT = 10, 512 << 20, 1024


def trends(windows: DataFrame, limit: float, size: int = TREND_WINDOWS) -> DataFrame:
    """For each window (x, y) the trend of the last ``size`` ones: slope, growth over their span, and whether it trips."""
    order = Window.orderBy("x")
    tail = order.rowsBetween(1 - size, Window.currentRow)
    held = windows.withColumn("ps", F.collect_list(F.struct("x", "y")).over(tail))
    pairs = F.flatten(F.transform("ps", lambda a: F.transform(F.filter("ps", lambda b: b["x"] > a["x"]), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))))
    ranked = held.withColumn("slopes", F.array_sort(pairs)).withColumn("k", F.size("slopes"))
    middle = (F.get("slopes", F.floor((F.col("k") - 1) / 2).cast("int")) + F.get("slopes", F.floor(F.col("k") / 2).cast("int"))) / 2
    span = F.col("x") - F.get("ps", F.lit(0))["x"]
    return ranked.select("x", "y", F.when(F.col("k") > 0, middle).alias("slope"), F.size("ps").alias("windows"), span.alias("span")).withColumn("growth", F.col("slope") * F.col("span")).withColumn("trips", F.coalesce((F.col("windows") == size) & (F.col("growth") >= limit), F.lit(False)))


def gaps(ticks: DataFrame, keys: list[str], most_seconds: float = 10, steady: str | None = None, most_drift: float = 20) -> DataFrame:
    """Ticks (at, id) that go back in time or come later than allowed after the one before.

    ``steady`` names microseconds of a clock that stands still while a machine sleeps; a wall clock
    that ran further ahead of it than ``most_drift`` seconds is a gap as well.
    """
    order = Window.partitionBy(*keys).orderBy("id")
    gap = micros("at") - micros(F.lag("at").over(order))
    found = (F.col("gap_us") < 0) | (F.col("gap_us") > most_seconds * 1e6)
    if steady is None:
        return ticks.withColumn("gap_us", gap).where(found)
    rows = ticks.withColumn("gap_us", gap).withColumn("drift_us", gap - (F.col(steady) - F.lag(steady).over(order)))
    return rows.where(found | (F.col("drift_us") > most_drift * 1e6))


def stalls(progress: DataFrame, keys: list[str], most_seconds: float = 120, settle_seconds: float = 120, maintenance: str | None = None) -> DataFrame:
    """Rows (at, id, done) at which the count hasn't grown for too long, once the key was active long enough.

    Where ``maintenance`` is true no growth is due: the clock starts anew, and no such row is a stall.
    """
    order = Window.partitionBy(*keys).orderBy("at", "id")
    grew = F.col("done") > F.coalesce(F.lag("done").over(order), F.lit(-1))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    due = F.lit(True) if maintenance is None else ~F.coalesce(F.col(maintenance), F.lit(False))
    rows = progress.withColumn("grew_at", F.when(grew | ~due, F.col("at")))
    rows = rows.withColumn("last_growth", F.max("grew_at").over(upto)).withColumn("since", F.min("at").over(upto))
    us = lambda a, b: micros(a) - micros(b)
    return rows.where((us("at", "last_growth") > most_seconds * 1e6) & (us("at", "since") >= settle_seconds * 1e6)).drop("grew_at", "since")


def continuous(windows: DataFrame) -> DataFrame:
    """Whether each minute number follows the one before."""
    return windows.withColumn("follows", F.coalesce(F.col("minute") - F.lag("minute").over(Window.orderBy("minute")) == 1, F.lit(True)))


def streaks(outcomes: DataFrame, keys: list[str], failed: Column, quarantine: int = 5) -> DataFrame:
    """Runs of failures in the order of (at, id): start, length, and whether it leads to quarantine."""
    order = Window.partitionBy(*keys).orderBy("at", "id")
    rows = outcomes.withColumn("bad", failed).withColumn("i", F.row_number().over(order))
    rows = rows.where("bad").withColumn("island", F.col("i") - F.row_number().over(order))
    return rows.groupBy(*keys, "island").agg(F.count("*").alias("length"), F.min("at").alias("begins"), F.min("id").alias("first_id")).withColumn("quarantined", F.col("length") >= quarantine).drop("island")


def last_rows(evidence: DataFrame, n: int = 64) -> DataFrame:
    """The last ``n`` rows by (at, id), oldest first."""
    return evidence.orderBy(F.desc("at"), F.desc("id")).limit(n).orderBy("at", "id")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key in the given order, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, "r.*")


def coalesced(requests: DataFrame, keys: list[str], window_ms: Column) -> DataFrame:
    """Requests joined to the leader that is still running: one row per request with leader_id.

    A request that comes while a leader with the same key runs joins it; the next one after its
    end leads. Leaders depend on one another, so a key's requests are folded in order.
    """
    item = F.struct(micros("at").alias("start"), "request_id", (window_ms.cast("long") * 1000).alias("takes"))
    by = requests.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("rs"))
    empty = F.expr("cast(array() as array<struct<request_id:bigint,leader_id:bigint>>)")
    start = F.struct(F.lit(-(2**62)).cast("long").alias("until"), F.lit(None).cast("long").alias("leader"), empty.alias("out"))

    def step(a: Column, r: Column) -> Column:
        joins = r["start"] < a["until"]
        leader = F.when(joins, a["leader"]).otherwise(r["request_id"])
        return F.struct(F.when(joins, a["until"]).otherwise(r["start"] + r["takes"]).alias("until"), leader.alias("leader"), F.concat(a["out"], F.array(F.struct(r["request_id"].alias("request_id"), leader.alias("leader_id")))).alias("out"))

    return by.select(*keys, F.explode(F.aggregate("rs", start, step)["out"]).alias("o")).select(*keys, "o.*")


def stale_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """Results (at, id, revision) with ``accepted``: not older than the greatest revision seen before them."""
    before = Window.partitionBy(*keys).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    return results.withColumn("seen", F.max("revision").over(before)).withColumn("accepted", F.coalesce(F.col("revision") >= F.col("seen"), F.lit(True)))


def debounced(events: DataFrame, keys: list[str], quiet: str = "1 hour") -> DataFrame:
    """The last event of each run of events that are closer together than ``quiet``."""
    return events.groupBy(*keys, F.session_window("at", quiet).alias("s")).agg(F.count("*").alias("n"), F.max_by("id", F.struct("at", "id")).alias("last_id"), F.max("at").alias("last_at")).select(*keys, "n", "last_id", "last_at")


def concurrency(requests: DataFrame, most: int) -> DataFrame:
    """Requests (request_id, at, latency_ms) with how many run when each starts, and whether the cap admits it."""
    start = micros("at")
    points = requests.select(start.alias("t"), F.lit(1).alias("d"), "request_id").union(requests.select((start + (F.col("latency_ms") * 1000).cast("long")).alias("t"), F.lit(-1).alias("d"), "request_id"))
    return running_sum(points, ["t", "d", "request_id"], F.col("d"), "running").where("d = 1").select("request_id", F.col("running"), (F.col("running") <= most).alias("admitted"))


def admission(requests: DataFrame, lane: list[str], in_flight: int = 256, queued: int = 64) -> DataFrame:
    """Requests (request_id, at, waits_ms, latency_ms) with what runs and what waits in their lane when each comes.

    One waits from ``at`` for ``waits_ms`` in its lane (class and priority), and counts as in flight
    until ``latency_ms`` after ``at``. ``status`` says which bound it would have met: ``in_flight``
    first, then ``queue``, else ``admitted``.
    """
    us = lambda c: (F.col(c).cast("double") * 1000).cast("long")
    start = micros("at")

    def running(ends: Column, within: list, out: str) -> DataFrame:
        ids = [F.struct(*within).alias("lane"), "request_id"]
        points = requests.select(*ids, start.alias("t"), F.lit(1).alias("d")).union(requests.select(*ids, ends.alias("t"), F.lit(-1).alias("d")))
        total = running_sum(points, ["lane", "t", "d", "request_id"], F.col("d"), out)
        return total.where("d = 1").select("request_id", out)

    # Sums go on from lane to lane, but a lane that has ended adds nothing: every start has its end.
    both = running(start + us("latency_ms"), [F.lit(0).alias("all")], "running").join(running(start + us("waits_ms"), lane, "waiting"), "request_id")
    status = F.when(F.col("running") > in_flight, "in_flight").when(F.col("waiting") > queued, "queue").otherwise("admitted")
    return requests.select("request_id", *lane).join(both, "request_id").withColumn("status", status)


def memo_outcomes(requests: DataFrame, keys: list[str]) -> DataFrame:
    """What each request (request_id, at, takes_ms, outcome) of a memo key does: compute, join or hit; and by whom it is answered.

    ``outcome`` is what a computation begun by the request would come to: ok and stable failures are
    remembered, anything else (transient) is forgotten when it ends. Requests that come while one
    computes join it. Computations depend on one another, so a key's requests are gone through in
    order; one that stays makes the rest of the key hits.
    """
    have = [c for c in requests.columns if c in keys]
    fields = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in have)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "request_id"])
        did, by, until, leader, stays = [], [], None, None, False
        for start, takes, request, outcome in zip(rows.start, rows.takes, rows.request_id, rows.outcome):
            if until is not None and start < until:
                did.append("join")
            elif stays:
                did.append("hit")
            else:
                did.append("compute")
                until, leader, stays = start + takes, request, outcome in ("ok", "stable")
            by.append(leader)
        return rows[[*have, "request_id"]].assign(did=did, answered_by=by)

    rows = requests.select(*have, "request_id", micros("at").alias("start"), (F.col("takes_ms").cast("double") * 1000).cast("long").alias("takes"), "outcome")
    return rows.groupBy(*have).applyInPandas(run, f"{fields}, request_id long, did string, answered_by long")


def committed(staged: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """Staged rows (seq) with the ``commit_seq`` that sends them on: the first of their request after them.

    What no commit follows is left out. The order on the other side is (commit_seq, seq).
    """
    cols = staged.columns
    last = F.min("own commit").over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(0, Window.unboundedFollowing))
    both = staged.withColumn("own commit", F.lit(None).cast("long")).unionByName(commits.select(*keys, "seq", F.col("seq").alias("own commit")), allowMissingColumns=True)
    rows = both.withColumn("commit_seq", last).where("`own commit` IS NULL AND commit_seq IS NOT NULL")
    return rows.select(*cols, "commit_seq")


def answered(messages: DataFrame) -> DataFrame:
    """Requests and responses of sessions (session, seq, dir, request_id) matched in log order, with faults.

    Statuses: answered, unanswered, reused (an id that is still open), unrequested.
    """
    order = Window.partitionBy("session", "request_id").orderBy("seq")
    rows = messages.withColumn("before", F.lag("dir").over(order)).withColumn("after", F.lead("dir").over(order)).withColumn("after_seq", F.lead("seq").over(order))
    status = (
        F.when((F.col("dir") == "in") & (F.col("before") == "in"), "reused")
        .when((F.col("dir") == "in") & (F.col("after") == "out"), "answered")
        .when(F.col("dir") == "in", "unanswered")
        .when((F.col("dir") == "out") & (F.coalesce("before", F.lit("")) != "in"), "unrequested")
    )
    return rows.withColumn("status", status).where("status IS NOT NULL").select("session", "request_id", "seq", "status", F.when(F.col("status") == "answered", F.col("after_seq")).alias("response_seq"))


#: Shares of the limit from which memory pressure has each name.
PRESSURE = [(1.0, "critical"), (0.90, "reject"), (0.80, "throttle"), (0.70, "evict")]


def pressure(used: Column, limit: Column) -> Column:
    share = used / F.nullif(limit, F.lit(0))
    out = None
    for bound, name in PRESSURE:
        out = F.when(share >= bound, name) if out is None else out.when(share >= bound, name)
    return out.otherwise("normal")


def memory(usage: DataFrame, limits: DataFrame, budget: int | None = None) -> DataFrame:
    """Bytes in use (category, bytes) against limits (category, most): a row a category with its share, and one in total with its band.

    The total is held against ``budget``, or else the sum of limits. What has no limit, or one of 0,
    has a share of 0 and counts in the total. The total's row has a null category and ``in_total``.
    """
    used = usage.where("category IS NOT NULL").groupBy("category").agg(F.sum("bytes").alias("used"))
    rows = used.join(limits.select("category", F.col("most").cast("long").alias("most")), "category", "full_outer")
    rows = rows.select("category", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("most", F.lit(0)).alias("most"), F.lit(False).alias("in_total"))
    whole = F.sum("most") if budget is None else F.lit(budget).cast("long")
    total = rows.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.coalesce(whole, F.lit(0)).alias("most"))
    both = rows.unionByName(total.select(F.lit(None).cast("string").alias("category"), "used", "most", F.lit(True).alias("in_total")))
    share = F.coalesce(F.col("used") / F.nullif(F.col("most"), F.lit(0)), F.lit(0.0))
    return both.withColumn("share", share).withColumn("band", F.when(F.col("in_total"), F.coalesce(pressure(F.col("used"), F.col("most")), F.lit("normal"))))


def admitted(asks: DataFrame, total: DataFrame) -> DataFrame:
    """Requests for bytes with ``admitted``: each by itself would leave the total of ``memory`` below the band that rejects."""
    reject = next(bound for bound, name in PRESSURE if name == "reject")
    room = total.where("in_total").select(F.col("used").alias("used in total"), F.col("most").alias("most in total"))
    ok = F.coalesce((F.col("used in total") + F.col("bytes")) / F.nullif(F.col("most in total"), F.lit(0)) < reject, F.lit(True))
    return asks.crossJoin(F.broadcast(room)).withColumn("admitted", ok).drop("used in total", "most in total")


def token_bucket(requests: DataFrame, keys: list[str], capacity: float, per_second: float) -> DataFrame:
    """Requests (at, request_id) with ``allowed``: a bucket per key refills with time and each request takes one token."""
    by = requests.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(micros("at").alias("t"), "request_id"))).alias("rs"))
    start = F.struct(F.lit(float(capacity)).alias("left"), F.lit(None).cast("long").alias("t"), F.expr("cast(array() as array<struct<request_id:bigint,allowed:boolean>>)").alias("out"))

    def step(a: Column, r: Column) -> Column:
        filled = F.least(F.lit(float(capacity)), a["left"] + F.coalesce((r["t"] - a["t"]) / 1e6 * per_second, F.lit(0.0)))
        ok = filled >= 1.0
        return F.struct(F.when(ok, filled - 1.0).otherwise(filled).alias("left"), r["t"].alias("t"), F.concat(a["out"], F.array(F.struct(r["request_id"].alias("request_id"), ok.alias("allowed")))).alias("out"))

    return by.select(*keys, F.explode(F.aggregate("rs", start, step)["out"]).alias("o")).select(*keys, "o.*")


def quiet_values(values: DataFrame, keys: list[str], quiet_ms: float) -> DataFrame:
    """Runs of equal consecutive values (at, id, value): served once a second equal one came and the run is long enough."""
    order = Window.partitionBy(*keys).orderBy("at", "id")
    rows = values.withColumn("new", (~F.col("value").eqNullSafe(F.lag("value").over(order))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    by = rows.groupBy(*keys, "run").agg(F.first("value").alias("value"), F.count("*").alias("n"), F.min("at").alias("since"), F.max("at").alias("until"))
    return by.withColumn("admitted", (F.col("n") >= 2) & (micros("until") - micros("since") >= quiet_ms * 1000))


def backoff(attempt: Column, base_ms: int = 100, most_ms: int = 10_000) -> Column:
    """Wait before a restart without its jitter: doubles with each attempt (from 1) up to a bound."""
    return F.least(F.lit(most_ms), F.lit(base_ms) * F.pow(F.lit(2), F.least(attempt - 1, F.lit(30)))).cast("long")


def lru(entries: DataFrame, most_bytes: int, most_items: int) -> DataFrame:
    """Entries (key, bytes, last_used) that stay: the last used ones within both bounds."""
    # Beyond the bound of items nothing stays, so only so many rows are ordered.
    order = Window.partitionBy().orderBy(F.desc("last_used"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newest = entries.orderBy(F.desc("last_used"), "key").limit(most_items)
    return newest.withColumn("sum_bytes", F.sum("bytes").over(order)).withColumn("place", F.count("*").over(order)).where(F.col("sum_bytes") <= most_bytes)


def fifo(entries: DataFrame, most: int = 4096) -> DataFrame:
    """Entries (key, inserted) that stay: the last inserted ones."""
    return entries.orderBy(F.desc("inserted"), F.desc("key")).limit(most)


def generations_kept(generations: DataFrame, depth: int = 3) -> DataFrame:
    rank = F.dense_rank().over(Window.partitionBy().orderBy(F.desc("generation")))
    return generations.withColumn("rank", rank).where(F.col("rank") <= depth).drop("rank")


def progress_faults(messages: DataFrame) -> DataFrame:
    """Tokens (session, token, seq, kind) whose end doesn't come after their begin and before the response."""
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("seq")))
    by = messages.groupBy("session", "token").agg(at("begin").alias("b"), at("end").alias("e"), at("response").alias("r"))
    return by.where(~F.coalesce((F.col("b") < F.col("e")) & (F.col("e") < F.col("r")), F.lit(False)))


def timing(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms"))


def phases(trace: DataFrame, names: list[str]) -> DataFrame:
    """A wide row per request (request_id, one column of milliseconds per phase) as one row per phase that was sampled."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("phase"), F.col(n).alias("ms")) for n in names]))
    return trace.select("request_id", each.alias("p")).select("request_id", "p.*").where("ms IS NOT NULL")


def reservoir(rows: DataFrame, keys: list[str], id_col: str, most: int = 256) -> DataFrame:
    """Up to ``most`` rows of each key, the same in every run: those whose id has the smallest hashes."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(id_col), id_col)
    return rows.withColumn("place in reservoir", F.row_number().over(order)).where(F.col("place in reservoir") <= most).drop("place in reservoir")


#: Fixed value: after this wait a request is taken as one priority higher.
AGING_MS = 5000


def schedule(requests: DataFrame, workers: int, caps: dict[str, int]) -> DataFrame:
    """When requests (server, request_id, at_ms, takes_ms, priority, cost) start: lowest priority number first.

    A request waits for a worker and for its cost class to be under its cap; each ``AGING_MS`` of
    waiting raises it by one. Every start depends on those before it, so a server's log is simulated
    in one task.
    """

    def simulate(rows: pd.DataFrame) -> pd.DataFrame:
        todo = rows.sort_values(["at_ms", "request_id"]).to_dict("records")
        waiting, running, out, now, k = [], [], [], 0, 0
        busy: dict[str, int] = {}
        while k < len(todo) or waiting or running:
            while k < len(todo) and todo[k]["at_ms"] <= now:
                waiting.append(todo[k])
                k += 1
            while running and running[0][0] <= now:
                busy[heapq.heappop(running)[2]] -= 1
            able = [r for r in waiting if busy.get(r["cost"], 0) < caps.get(r["cost"], workers)] if len(running) < workers else []
            if able:
                r = min(able, key=lambda r: (r["priority"] - (now - r["at_ms"]) // AGING_MS, r["at_ms"], r["request_id"]))
                waiting.remove(r)
                heapq.heappush(running, (now + r["takes_ms"], r["request_id"], r["cost"]))
                busy[r["cost"]] = busy.get(r["cost"], 0) + 1
                out.append((r["server"], r["request_id"], now))
                continue
            events = [r["at_ms"] for r in todo[k : k + 1]] + [r[0] for r in running[:1]]
            if not events:  # what still waits is of a class that may not run
                break
            now = min(events)
        return pd.DataFrame(out, columns=["server", "request_id", "start_ms"])

    return requests.groupBy("server").applyInPandas(simulate, "server string, request_id long, start_ms long")
