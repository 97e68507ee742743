"""Strict records: each negative is one refused batch with its reason."""

import json

from factloom import schema
from factloom.sources import strict

RANGE = {"start_line": 1, "start_char": 0, "end_line": 1, "end_char": 4}
GOOD = {"symbol_id": "a", "scope_id": "s", "uri": "u", "range": RANGE, "role": "reference", "source_hash": "h", "build_context": "b"}


def line(**changes):
    return json.dumps({**GOOD, **changes})


def without(*names):
    return json.dumps({k: v for k, v in GOOD.items() if k not in names})


NEGATIVE = {
    "unknown field": (line(more=1), "unknown field in $"),
    "unknown inner field": (line(range={**RANGE, "x": 1}), "unknown field in $.range"),
    "other case": (json.dumps({**{k: v for k, v in GOOD.items() if k != "role"}, "Role": "reference"}), "unknown field in $"),
    "repeated": (line()[:-1] + ', "uri": "v"}', "repeated field"),
    "repeated inside": (line(range=None).replace('"range": null', '"range": {"start_line": 1, "start_line": 2}'), "not one JSON value, or a repeated field"),
    "number as text": (line(uri=5), "$.uri is of another type"),
    "text as number": (line(range={**RANGE, "end_char": "4"}), "$.range.end_char is of another type"),
    "fraction": (line(range={**RANGE, "end_char": 4.5}), "$.range.end_char is of another type"),
    "list as object": (line(range=[1, 2]), "$.range is of another type"),
    "negative": (line(range={**RANGE, "start_line": -1}), "$.range.start_line is out of bounds"),
    "33 bits": (line(range={**RANGE, "end_line": 2**32}), "$.range.end_line is out of bounds"),
    "missing": (without("symbol_id"), "$.symbol_id is missing"),
    "null": (line(scope_id=None), "$.scope_id is missing"),
    "empty": (line(uri=""), "$.uri is missing"),
    "not JSON": (line()[:-1], "not one JSON value, or a repeated field"),
    "trailing": (line() + " x", "not one JSON value, or a repeated field"),
    "two values": (line() + "," + line(), "not one JSON value, or a repeated field"),
    "closes a list": (line() + "],[" + line(), "not one JSON value, or a repeated field"),
    "closes an object": (line() + '},"s":{', "not one JSON value, or a repeated field"),
    "list": ("[" + line() + "]", "not an object"),
    "scalar": ("5", "not an object"),
    "no value": (None, "not one JSON value, or a repeated field"),
    "too long": (line(uri="u" * 3000), "record too long"),
}


def test_each_negative_refuses_its_batch(spark):
    rows = [("good", i, "occurrences", line(uri=f"é{i}")) for i in range(3)] + [("nulls", 0, "occurrences", line(range=None, role=None)), ("short", 0, "occurrences", without("range", "role", "source_hash"))]
    rows += [("most", 0, "occurrences", line(range={**RANGE, "end_char": 2**32 - 1})), ("space", 0, "occurrences", "  " + line() + " \n")]
    rows += [("kind", 0, "things", line()), ("no kind", 0, None, line()), ("mixed", 0, "occurrences", line()), ("mixed", 1, "files", '{"uri": "u"}'), ("long", 0, "occurrences", line()), *[("long", i, "occurrences", line(uri="u" * 900)) for i in range(1, 9)]]
    for name, (value, _) in NEGATIVE.items():
        rows += [(name, 0, "occurrences", line()), (name, 1, "occurrences", value), (name, 2, "occurrences", value)]
    df = spark.createDataFrame(rows, "batch string, seq int, kind string, value string")
    typed, refused = strict.decode(df, record_bytes=2000, batch_bytes=7500)
    got = {r.batch: (r.faults, r.reason, r.seq) for r in refused.collect()}
    expected = {name: (2, reason, 1) for name, (_, reason) in NEGATIVE.items()}
    assert got == {**expected, "kind": (1, "unknown kind", 0), "no kind": (1, "unknown kind", 0), "mixed": (0, "several kinds", None), "long": (0, "batch too long", None)}
    out = {(r.batch, r.seq): r for r in typed["occurrences"].collect()}
    assert set(out) == {("good", 0), ("good", 1), ("good", 2), ("nulls", 0), ("short", 0), ("most", 0), ("space", 0)}
    assert out["good", 1].uri == "é1" and out["good", 1].range.asDict() == RANGE and out["nulls", 0].range is None and out["most", 0].range.end_char == 2**32 - 1
    assert typed["files"].isEmpty()


def test_metadata(spark):
    scopes = lambda rows: spark.createDataFrame(rows, "scope_id string, language string, root_uri string, build_context string")
    provenance = lambda rows: spark.createDataFrame(rows, "scope_id string, schema_version long, extractor string, version string, toolchain string, language string, tools array<struct<name:string,path:string,version:string,sha256:string>>")
    coverage = lambda rows: spark.createDataFrame(rows, "scope_id string, fact string, state string, reason string")
    tool = ("go", "/bin/go", "1", "a" * 64)
    own = lambda s, **c: [(s, k, c.get(k, "complete"), None) for k in schema.FACT_KINDS]
    good = ([("a", "go", "r", "b")], [("a", 1, "x", "1", "t", "go", [tool])], own("a"))
    faults = lambda s, p, c: sorted((r.fault, r.subject) for r in strict.metadata_faults(scopes(s), provenance(p), coverage(c), 1).collect())
    assert faults(*good) == []
    bad_scopes = [("a", "go", "r", "b"), ("a", "go", "r", "b"), ("b", "go", "", "b"), ("c", "c", "r", "b")]
    bad_provenance = [("a", 2, "x", "1", "t", "go", [("go", "/bin/../go", "1", "a" * 64)]), ("c", 1, "", "1", "t", "c", [("cc", "p", "1", "A" * 64)]), ("d", 1, "x", "1", "t", "go", []), ("b", 1, "x", "1", "t", "rust", [])]
    bad_coverage = own("a", call="maybe") + own("b", call="unknown")[1:] + own("c") + own("c")[:1] + [("z", "call", "complete", None)]
    assert faults(bad_scopes, bad_provenance, bad_coverage) == sorted([
        ("another schema version", "a"), ("backend of another language", "b"), ("coverage given twice", "c/symbol"), ("coverage missing", "b/symbol"), ("coverage of no scope", "z/call"), ("coverage without a reason", "a/call"),
        ("coverage without a reason", "b/call"), ("incomplete provenance", "c"), ("incomplete scope", "b"), ("provenance of no scope", "d"), ("scope named twice", "a"), ("unknown coverage", "a/call"), ("unsound tool", "a"), ("unsound tool", "c"),
    ])
