"""Schemas of the fact relations and the value domains of their columns."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B = T.StringType(), T.LongType(), T.BooleanType()


def struct(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


# Positions are zero-based; characters count UTF-16 units. Unsigned 32-bit values need BIGINT.
RANGE = struct(("start_line", L), ("start_char", L), ("end_line", L), ("end_char", L))
TOOL = struct(("name", S), ("path", S), ("version", S), ("sha256", S))
BUILD_INPUTS = struct(
    ("env", T.MapType(S, S)), ("defines", T.MapType(S, S)), ("options", T.MapType(S, S)), ("arguments", T.ArrayType(S)),
    ("patterns", T.ArrayType(S)), ("includes", T.ArrayType(S)), ("features", T.ArrayType(S)), ("tests", B),
)

FILE = struct(("uri", S, False), ("language", S), ("size", L), ("sha256", S), ("scope_id", S))
SYMBOL = struct(("id", S, False), ("scope_id", S, False), ("name", S), ("kind", S), ("signature", S))
OCCURRENCE = struct(("symbol_id", S, False), ("scope_id", S, False), ("uri", S, False), ("range", RANGE), ("role", S), ("source_hash", S), ("build_context", S))
EDGE = struct(("from", S, False), ("to", S, False), ("scope_id", S), ("kind", S), ("source_uri", S), ("range", RANGE), ("source_hash", S), ("build_context", S))
SCOPE = struct(("id", S, False), ("language", S), ("root_uri", S), ("build_context", S), ("inputs", BUILD_INPUTS))
COVERAGE = struct(("scope_id", S, False), ("fact", S, False), ("state", S), ("reason", S))
PROVENANCE = struct(("schema_version", L), ("scope_id", S), ("extractor", S), ("version", S), ("backend", S), ("epoch", L), ("toolchain", S), ("tools", T.ArrayType(TOOL)))
EVIDENCE = struct(("kind", S), ("assurance", S), ("snapshot", L), ("build_context", S), ("backend", S), ("epoch", L), ("generation", L), ("source_hash", S), ("detail", S), ("at", T.TimestampType()))
DIAGNOSTIC = struct(("range", RANGE), ("severity", L), ("code", S), ("source", S), ("message", S))
REPLAY_ENTRY = struct(("session", S), ("seq", L), ("dir", S), ("snap_rev", L), ("request_id", S), ("payload", S))

# The domains of the enumerated columns.
FACT_KINDS = ["symbol", "declaration", "definition", "reference", "implementation", "type_relation", "call", "import", "include", "module", "generated_source"]
EDGE_FACT = {
    "implementation": "implementation", "type_relation": "type_relation", "call": "call", "import": "import",
    "include": "include", "module": "module", "generated": "generated_source",
}
COVERAGE_STATES = ["complete", "incomplete_known_subset", "unknown", "unavailable"]
ROLES = ["definition", "declaration", "reference"]
STATUSES = ["exact", "partial", "unknown", "unavailable"]
GRAPH_KINDS = ["module_graph_node", "synthetic_script_scope"]
MAPPING_QUALITY = ["exact", "many-to-one", "one-to-many", "unmapped-generated"]
COST_CLASSES = ["tiny", "small", "medium", "large", "very_large"]

#: Size bounds of a record, a batch and a segment, in bytes.
RECORD_BYTES, BATCH_BYTES, SEGMENT_BYTES = 1 << 20, 8 << 20, 64 << 20
#: Fixed value: rows that a symbol search returns at most.
SEARCH_LIMIT = 100
