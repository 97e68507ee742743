"""Recorded sessions played to streaming programs: what differs, what is missing or too much, and restarts."""

import pytest
from pyspark.sql import functions as F

from factloom.plans.programs import _running_words
from factloom.streaming import player

SCHEMA = "session long, seq long, dir string, payload string"


def said(total, stamp=0):
    return f'{{"timestamp": {stamp}, "total": {total}}}'


#: session -> entries in order, and (status, reason, seq, steps, fed, matched).
SESSIONS = {
    1: ([("in", "a b"), ("out", said(2)), ("in", "c"), ("out", said(3)), ("in", ""), ("out", said(3, 9))], ("reproduced", None, None, 3, 3, 3)),
    2: ([("in", "a b"), ("out", said(2)), ("in", "c"), ("out", said(4)), ("in", "d"), ("out", said(4))], ("diverged", "payload", 3, 2, 2, 1)),
    3: ([("in", "a"), ("in", "b c"), ("out", said(1)), ("out", said(3))], ("reproduced", None, None, 1, 2, 2)),
    4: ([("in", "a"), ("out", said(1)), ("out", said(1)), ("in", "b"), ("out", said(2))], ("diverged", "missing", 2, 1, 1, 1)),
    5: ([("in", "a"), ("out", said(1)), ("in", "b")], ("diverged", "surplus", None, 2, 2, 1)),
    6: ([("out", said(0)), ("in", "b"), ("out", said(1))], ("diverged", "missing", 0, 1, 0, 0)),
    7: ([("in", "a"), ("out", "not JSON")], ("diverged", "payload", 1, 1, 1, 0)),
    8: ([("identity", "x"), ("in", "é  ü"), ("identity", "y"), ("out", said(2)), ("in", None), ("out", None)], ("diverged", "payload", 5, 2, 2, 1)),
    9: ([("identity", "x")], None),
}


@pytest.fixture()
def entries(spark):
    rows = [(s, i, *e) for s, (own, _) in SESSIONS.items() for i, e in enumerate(own)] + [(None, 0, "in", "a")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def outcomes(rows):
    return {r.session: (r.status, r.reason, r.seq, r.steps, r.fed, r.matched) for r in rows.collect()}


EXPECTED = {s: x for s, (_, x) in SESSIONS.items() if x}


def counting(stream):
    return _running_words(stream.withColumn("payload", F.coalesce("payload", F.lit(""))))


def test_steps(entries):
    got = {(r.session, r.seq): r.step for r in player.steps(entries).collect()}
    assert [got[1, i] for i in range(6)] == [0, 0, 1, 1, 2, 2]
    assert [got[3, i] for i in range(4)] == [0] * 4 and [got[6, i] for i in range(3)] == [0, 1, 1] and (9, 0) not in got


def test_play(spark, entries, tmp_path):
    folder = str(tmp_path / "play")
    assert outcomes(player.Player(entries, folder).play(counting)) == EXPECTED
    fed = spark.read.parquet(*[f"{folder}/in/{k}" for k in range(3)])
    # A session that has diverged is given nothing more.
    assert fed.where("session = 2").count() == 2 and fed.where("session = 4").count() == 1
    # All is known already: nothing is played again.
    assert outcomes(player.Player(entries, folder).play(counting)) == EXPECTED


def test_play_goes_on_after_a_failure(spark, entries, tmp_path):
    """The program's worker fails in the third step; a new player goes on from the same folder."""
    folder = str(tmp_path / "play")

    def failing(stream):
        def check(frames):
            for f in frames:
                if ((f["session"] == 1) & (f["seq"] == 4)).any():
                    raise RuntimeError("worker lost")
                yield f

        return counting(stream.mapInPandas(check, stream.schema))

    first = player.Player(entries, folder)
    with pytest.raises(Exception, match="worker lost"):
        first.play(failing)
    assert outcomes(first.verdicts()) == EXPECTED | {1: ("reproduced", None, None, 2, 2, 2)}
    assert outcomes(player.Player(entries, folder).play(counting)) == EXPECTED


def test_judging_twice_changes_nothing(spark, entries, tmp_path):
    """A step whose batch wasn't committed is judged again with the same verdict."""
    own = player.Player(entries, str(tmp_path / "play"))
    outputs = spark.createDataFrame([(1, 0, 0, said(2, 5)), (2, 0, 0, said(2))], "session long, seq long, part long, payload string")
    own._judge(outputs, 0)
    before = outcomes(own.verdicts())
    own._judge(outputs, 0)
    assert outcomes(own.verdicts()) == before and before[1][0] == "reproduced" and before[3][1] == "missing"


def test_nothing_recorded(spark, tmp_path):
    rows = spark.createDataFrame([], SCHEMA)
    assert player.Player(rows, str(tmp_path / "play")).play(counting).count() == 0
