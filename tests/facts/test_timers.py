"""Timers on streams: hand-made logs, cut and arranged in several ways, with restarts in between."""

import datetime as dt

import pytest

from factloom.streaming import operators, timers

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
MS = int(START.timestamp() * 1000)
SCHEMA = "key string, name string, at timestamp, seq long, kind string, amount double"


def run(spark, folder, batches, schema, fold):
    """Each batch is a file and a run of its own, from the checkpoint of the last."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = operators.to_completion(fold(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/state", f"{folder}/out")
    return out.collect()


def event(key, name, second, seq, kind, amount=None):
    return key, name, START + dt.timedelta(seconds=second), seq, kind, amount


LATE = event("z", "z", 3600, 99, "end")  # moves the watermark past all others
REQUESTS = [
    event("a", "1", 0, 1, "start", 5000.0), event("a", "1", 4, 2, "end"), event("a", "2", 1, 3, "start", 5000.0), event("a", "2", 3, 4, "cancel"), event("a", "2", 3, 5, "end"),
    event("b", "1", 0, 6, "start", 5000.0), event("b", "1", 5, 7, "end"), event("b", "2", 2, 8, "start", 5000.0), event("b", "2", 4, 9, "start", 5000.0), event("c", "1", 9, 10, "cancel"),
]
OUTCOMES = {
    ("a", "1", 1, "done", 4), ("a", "2", 3, "cancelled", 3), ("a", "2", 5, "refused", 3), ("b", "1", 6, "deadline", 5), ("b", "1", 7, "refused", 5),
    ("b", "2", 9, "refused", 4), ("b", "2", 8, "deadline", 7), ("c", "1", 10, "refused", 9),
}


@pytest.mark.parametrize("arrange", [lambda rows: [rows + [LATE]], lambda rows: [rows[::-2], rows[-2::-2], [LATE]]])
def test_deadlines(spark, tmp_path, arrange):
    got = run(spark, tmp_path, arrange(REQUESTS), SCHEMA, lambda s: timers.deadlines(s, "1 minute"))
    assert {(r.key, r.name, r.seq, r.outcome, (r.at_ms - MS) // 1000) for r in got} == OUTCOMES and len(got) == len(OUTCOMES)


@pytest.mark.parametrize("arrange", [lambda rows: [rows + [LATE]], lambda rows: [rows[3:], rows[:3], [LATE]]])
def test_debounce(spark, tmp_path, arrange):
    """Quiet for two seconds, then a second's work: 0 restarted at 1, 1 cancelled at 3.5 while it ran, 3.5 published at 6.5, 6.5 cancelled by nothing."""
    rows = [event("u", "d", s, i, "change", 1000.0) for i, s in enumerate([0, 1, 3.5, 6.5])] + [event("u", "e", 3, 7, "change", 0.0)]
    got = run(spark, tmp_path, arrange(rows), SCHEMA, lambda s: timers.debounced(s, 2000, "1 minute"))
    assert {(r.name, r.seq, r.outcome, (r.at_ms - MS) / 1000) for r in got} == {("d", 0, "restarted", 1), ("d", 1, "cancelled", 3.5), ("d", 2, "published", 6.5), ("d", 3, "published", 9.5), ("e", 7, "published", 5)}


def test_what_the_watermark_has_not_passed_stays_open(spark, tmp_path):
    got = run(spark, tmp_path, [[event("a", "1", 0, 1, "start", 5000.0), event("a", "2", 40, 2, "start", 1.0)]], SCHEMA, lambda s: timers.deadlines(s, "1 minute"))
    assert got == []


def test_lifecycle_over_restarts(spark, tmp_path):
    calls = ["hover", "didOpen", "initialize", "initialized", "hover", "initialize", "shutdown", "hover", "didChange", "shutdown", "exit", "hover", "exit"]
    wanted = ["not_initialized", "dropped", "accepted", "accepted", "accepted", "invalid", "accepted", "invalid", "dropped", "invalid", "exit_0", "closed", "closed"]
    request = {"hover", "initialize", "shutdown"}
    rows = [("s", i, m, m in request) for i, m in enumerate(calls)] + [("t", 0, "exit", False), ("t", 1, "initialize", True), ("u", 0, "initialize", True), ("u", 1, "exit", False)]
    got = run(spark, tmp_path, [rows[:5] + rows[13:15], rows[5:9] + rows[15:], rows[9:13]], "session string, seq long, method string, request boolean", timers.lifecycle)
    assert [r.outcome for r in sorted(got, key=lambda r: r.seq) if r.session == "s"] == wanted
    assert [(r.session, r.outcome) for r in sorted(got, key=lambda r: (r.session, r.seq)) if r.session != "s"] == [("t", "exit_1"), ("t", "closed"), ("u", "accepted"), ("u", "exit_1")]
