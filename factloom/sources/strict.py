"""Strict decoding of fact records: lines of JSON in batches of one kind.

A record has the fields of its kind and no others, each once and of its own type,
within the bounds of a record; a batch has records of a known kind, within the
bounds of a batch. One fault refuses the whole batch. Values are never converted:
a number isn't a text, and a position has 32 bits without a sign.

All checks are expressions over the text and over its variant form, whose parser
refuses repeated keys at any depth; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schema

#: Kinds of batches and what their records hold; places count in 32 bits.
KINDS = {"files": schema.FILE, "symbols": schema.SYMBOL, "occurrences": schema.OCCURRENCE, "edges": schema.EDGE}
MOST = 2**32 - 1
#: Beginnings of the names that variants have for types.
NAMES = {T.StringType: "STRING", T.LongType: "BIGINT", T.BooleanType: "BOOLEAN", T.StructType: "OBJECT<", T.ArrayType: "ARRAY<", T.MapType: "OBJECT<"}


def whole(value: Column) -> Column:
    """The variant of a text that is one JSON value and nothing behind it; null if it isn't."""
    # What follows a value would have to close a list and an object at once.
    listed = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    boxed = F.concat(F.lit('{"r":'), value, F.lit("}"))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & F.try_parse_json(boxed).isNotNull() & (F.size(F.json_object_keys(boxed)) == 1)
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def fields_of(kind: T.StructType, path: str = "$") -> list[tuple[str, T.StructField]]:
    """The paths of all fields, inner ones behind their object."""
    out = []
    for f in kind:
        out.append((f"{path}.{f.name}", f))
        if isinstance(f.dataType, T.StructType):
            out += fields_of(f.dataType, f"{path}.{f.name}")
    return out


def unknown_fields(keys: Column, kind: T.StructType, path: str) -> Column:
    return F.when(F.size(F.array_except(keys, F.array(*[F.lit(f.name) for f in kind]))) > 0, F.lit(f"unknown field in {path}"))


def judged(records: DataFrame, kind: T.StructType, record_bytes: int = schema.RECORD_BYTES) -> DataFrame:
    """Records of one kind with ``fault``, the first thing that is wrong with each, null if nothing is.

    The value is parsed once: what several checks ask of it are columns of their own.
    """
    rest = records.columns
    value = F.col("value")
    once = records.select(*rest, whole(value).alias("variant"), F.json_object_keys(value).alias("keys"))
    each = fields_of(kind)
    names = [F.schema_of_variant(F.try_variant_get("variant", path, "variant")).alias(f"type {i}") for i, (path, _) in enumerate(each)]
    once = once.select(*rest, "variant", "keys", F.schema_of_variant("variant").alias("type"), *names)
    checks = [
        F.when(value.isNull(), "not one JSON value, or a repeated field").when(F.octet_length(value) > record_bytes, "record too long").when(F.size(F.array_distinct("keys")) < F.size("keys"), "repeated field")
        .when(F.col("variant").isNull(), "not one JSON value, or a repeated field").when(~F.startswith("type", F.lit("OBJECT<")), "not an object"),
        unknown_fields(F.col("keys"), kind, "$"),
    ]
    for i, (path, f) in enumerate(each):
        name = F.col(f"type {i}")
        absent = name.isNull() | (name == "VOID")
        if not f.nullable:
            checks.append(F.when(absent, F.lit(f"{path} is missing")))
        checks.append(F.when(~absent & ~F.startswith(name, F.lit(NAMES[type(f.dataType)])), F.lit(f"{path} is of another type")))
        if isinstance(f.dataType, T.LongType):
            number = F.try_variant_get("variant", path, "bigint")
            checks.append(F.when((name == "BIGINT") & ~number.between(0, MOST), F.lit(f"{path} is out of bounds")))
        if isinstance(f.dataType, T.StringType) and not f.nullable:
            checks.append(F.when(F.try_variant_get("variant", path, "string") == "", F.lit(f"{path} is missing")))
        if isinstance(f.dataType, T.StructType):
            checks.append(F.when(F.startswith(name, F.lit("OBJECT<")), unknown_fields(F.json_object_keys(F.get_json_object(value, path)), f.dataType, path)))
    return once.select(*rest, F.coalesce(*checks).alias("fault"))


def decode(records: DataFrame, kinds: dict[str, T.StructType] | None = None, record_bytes: int = schema.RECORD_BYTES, batch_bytes: int = schema.BATCH_BYTES) -> tuple[dict[str, DataFrame], DataFrame]:
    """Records (batch, seq, kind, value) as typed rows by kind, and the refused batches (batch, faults, reason, seq).

    ``reason`` and ``seq`` are those of a batch's first fault. Rows have the columns batch, seq and
    the fields of their kind. A null value is no JSON value; a batch of several kinds is refused.
    """
    kinds = kinds or KINDS
    records = records.select("batch", "seq", "kind", "value")
    each = records.where(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).withColumn("fault", F.lit("unknown kind"))
    for name, fields in kinds.items():
        each = each.unionByName(judged(records.where(F.col("kind") == name), fields, record_bytes))
    by = each.groupBy("batch").agg(
        F.count_if(F.col("fault").isNotNull()).alias("faults"), F.min(F.when(F.col("fault").isNotNull(), F.struct("seq", "fault"))).alias("first"),
        F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"), F.count_distinct("kind").alias("kinds"),
    )
    reason = F.when(F.col("bytes") > batch_bytes, "batch too long").when(F.col("kinds") > 1, "several kinds").otherwise(F.col("first.fault"))
    refused = by.where(reason.isNotNull()).select("batch", "faults", reason.alias("reason"), F.col("first.seq").alias("seq"))
    sound = records.join(refused.select("batch"), "batch", "left_anti")
    typed = {}
    for name, fields in kinds.items():
        loose = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
        typed[name] = sound.where(F.col("kind") == name).select("batch", "seq", F.from_json("value", loose, {"mode": "FAILFAST"}).alias("r")).select("batch", "seq", "r.*")
    return typed, refused


def hexadecimal(value: Column, prefix: str = "") -> Column:
    return F.coalesce(value.rlike(f"^{prefix}[0-9a-f]{{64}}$"), F.lit(False))


def metadata_faults(scopes: DataFrame, provenance: DataFrame, coverage: DataFrame, schema_version: int) -> DataFrame:
    """What makes the metadata of a generation unusable: fault, subject.

    Scopes (scope_id, language, root_uri, build_context) are complete and named once, each has one
    provenance (scope_id, schema_version, extractor, version, toolchain, language, tools) of its
    language with named, hashed tools, and each kind of fact has one coverage (scope_id, fact, state,
    reason), which says why it isn't complete.
    """
    fault = lambda rows, what, subject: rows.select(F.lit(what).alias("fault"), F.col(subject).cast("string").alias("subject"))
    blank = lambda *names: F.greatest(*[F.coalesce(F.col(n), F.lit("")) == "" for n in names], F.lit(False))
    ids = scopes.select("scope_id").distinct()
    tool = provenance.select("scope_id", F.explode("tools").alias("t"))
    path = F.coalesce("t.path", F.lit(""))
    bad_tool = blank("t.name", "t.version") | (path == "") | path.rlike(r"(^|/)\.\.(/|$)") | ~hexadecimal(F.col("t.sha256"))
    wanted = ids.select("scope_id", F.explode(F.array(*map(F.lit, schema.FACT_KINDS))).alias("fact"))
    key = F.concat_ws("/", "scope_id", "fact")
    parts = [
        fault(scopes.where(blank("scope_id", "language", "root_uri", "build_context")), "incomplete scope", "scope_id"),
        fault(scopes.groupBy("scope_id").count().where("count > 1"), "scope named twice", "scope_id"),
        fault(ids.join(provenance.select("scope_id"), "scope_id", "left_anti"), "no provenance", "scope_id"),
        fault(provenance.join(ids, "scope_id", "left_anti"), "provenance of no scope", "scope_id"),
        fault(provenance.groupBy("scope_id").count().where("count > 1"), "two provenances", "scope_id"),
        fault(provenance.where(F.coalesce(F.col("schema_version") != schema_version, F.lit(True))), "another schema version", "scope_id"),
        fault(provenance.where(blank("extractor", "version", "toolchain")), "incomplete provenance", "scope_id"),
        fault(provenance.alias("p").join(scopes.alias("s"), "scope_id").where(~F.col("p.language").eqNullSafe(F.col("s.language"))), "backend of another language", "scope_id"),
        fault(tool.where(bad_tool), "unsound tool", "scope_id"),
        fault(coverage.withColumn("k", key).join(ids, "scope_id", "left_anti"), "coverage of no scope", "k"),
        fault(coverage.withColumn("k", key).where(~F.coalesce(F.col("fact").isin(schema.FACT_KINDS) & F.col("state").isin(schema.COVERAGE_STATES), F.lit(False))), "unknown coverage", "k"),
        fault(coverage.withColumn("k", key).where((F.col("state") != "complete") & (F.coalesce("reason", F.lit("")) == "")), "coverage without a reason", "k"),
        fault(coverage.groupBy("scope_id", "fact").count().where("count > 1").withColumn("k", key), "coverage given twice", "k"),
        fault(wanted.join(coverage, ["scope_id", "fact"], "left_anti").withColumn("k", key), "coverage missing", "k"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
