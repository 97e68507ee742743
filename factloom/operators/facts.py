"""Queries over symbols and occurrences. Refusals are data: an answer that can't be proven has a status that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import schema
from factloom.operators.filters import name_contains, visible, with_role

LOCATION = ("uri", "line", "start_char", "end_char")
KEY = ["scope_id", "symbol_id"]


#: Orders of stored occurrences: by place inside a document, by place inside a symbol; of scopes.
URI_ORDER = ["uri", "line", "start_char", "end_line", "end_char", "scope_id", "symbol_id", "role"]
SYMBOL_ORDER = ["symbol_id", "uri", "line", "start_char", "end_line", "end_char", "role", "scope_id"]
SCOPE_ORDER = ["language", "root_uri", "scope_id"]


def index(occurrences: DataFrame, order: list[str]) -> DataFrame:
    """Occurrences dealt out by ranges of the order and sorted inside each; written as Parquet, a look-up
    reads the files whose statistics hold the key. Ranges go by the whole order, so a common key spans several.
    Ranges of one line have no ``end_line``."""
    have = [c for c in order if c in occurrences.columns]
    return occurrences.repartitionByRange(*have).sortWithinPartitions(*have)


def locations(occurrences: DataFrame, targets: DataFrame) -> DataFrame:
    """Occurrences of the target symbols (query_id, scope_id, symbol_id), once each."""
    return occurrences.join(targets, KEY).select("query_id", *KEY, *LOCATION, "role").dropDuplicates(["query_id", *LOCATION])


def ordered_locations(rows: DataFrame, declaration_first: bool = False) -> DataFrame:
    """In the total order of places; definitions before others if asked."""
    lead = [F.when(F.col("role").isin("definition", "declaration"), 0).otherwise(1)] if declaration_first else []
    return rows.orderBy("query_id", *lead, *LOCATION)


def references(occurrences: DataFrame, targets: DataFrame, include_declaration: bool = False) -> DataFrame:
    return locations(with_role(occurrences, "references", include_declaration), targets)


def reference_summary(occurrences: DataFrame, targets: DataFrame, include_declaration: bool = False) -> DataFrame:
    """For each query its number of places and documents, its least line and the sum of its columns.

    Places (each of them one row) are put together once for each symbol, before the queries are
    joined, so many queries for one common symbol cost a row each.
    """
    rows = with_role(occurrences, "references", include_declaration)
    by_document = rows.groupBy(*KEY, "uri").agg(F.count("*").alias("n"), F.min("line").alias("least"), F.sum("start_char").alias("s"))
    by = by_document.groupBy(*KEY).agg(F.sum("n").alias("places"), F.count("*").alias("documents"), F.min("least").alias("least_line"), F.sum("s").alias("starts"))
    return targets.select("query_id", *KEY).distinct().join(by, KEY)


def best_definitions(occurrences: DataFrame) -> DataFrame:
    """The defining place of each symbol: a definition before a declaration, then the smallest place."""
    rank = F.when(F.col("role") == "definition", 0).when(F.col("role") == "declaration", 1)
    sites = occurrences.where(rank.isNotNull())
    best = F.min(F.struct(rank.alias("rank"), *LOCATION)).alias("d")
    return sites.groupBy(*KEY).agg(best).select(*KEY, *[f"d.{c}" for c in LOCATION])


def search_order() -> list[Column]:
    return [F.lower("name"), F.col("language"), F.col("name"), F.col("scope_id"), F.col("id")]


def workspace_symbols(symbols: DataFrame, definitions: DataFrame, query: str, limit: int = schema.SEARCH_LIMIT) -> DataFrame:
    """Symbols whose name has the query in it, with their defining places.

    The first ``limit`` by (name without case, language, name, key) are chosen before places are
    looked up; the answer is then in the order of (name without case, language, place). If one of
    the chosen has no place, the whole answer is unknown: all rows say so.
    """
    chosen = visible(symbols).where(name_contains(F.col("name"), query)).orderBy(*search_order()).limit(limit)
    d = definitions.withColumnRenamed("symbol_id", "id")
    found = chosen.join(d, ["scope_id", "id"], "left")
    lost = F.bool_or(F.col("uri").isNull()).over(Window.partitionBy())
    rows = found.withColumn("status", F.when(lost, "unknown").otherwise("exact"))
    return rows.select("name", "language", "kind", "scope_id", "id", *LOCATION, "status").orderBy(F.lower("name"), "language", "uri", "line", "start_char", "id")


def overlay_symbols(symbols: DataFrame, definitions: DataFrame, query: str, limit: int = schema.SEARCH_LIMIT) -> DataFrame:
    """As ``workspace_symbols`` for unsaved documents: only symbols with a place count toward the limit."""
    hits = visible(symbols).where(name_contains(F.col("name"), query))
    found = hits.join(definitions.withColumnRenamed("symbol_id", "id"), ["scope_id", "id"])
    return found.orderBy(F.lower("name"), "scope_id", "id").limit(limit)


def stale(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """Occurrences whose file is gone or has other content than they were derived from."""
    f = files.select("uri", F.col("sha256").alias("current"))
    joined = occurrences.join(f, "uri", "left")
    reason = F.when(F.col("current").isNull(), "missing file").when(F.col("current") != F.col("source_hash"), "content changed")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL")


def coverage_gaps(scopes: DataFrame, coverage: DataFrame, facts: list[str]) -> DataFrame:
    """The (scope_id, fact) that a query needs and that aren't complete."""
    needed = scopes.select("scope_id", F.explode(F.array(*map(F.lit, facts))).alias("fact"))
    return needed.join(coverage.where("state = 'complete'"), ["scope_id", "fact"], "left_anti")


def coverage_faults(scopes: DataFrame, coverage: DataFrame) -> DataFrame:
    """Scopes that don't have each kind of fact exactly once."""
    by = coverage.groupBy("scope_id").agg(F.count("*").alias("n"), F.count_distinct("fact").alias("kinds"), F.count_if(~F.col("fact").isin(schema.FACT_KINDS)).alias("unknown"))
    want = len(schema.FACT_KINDS)
    joined = scopes.select("scope_id").join(by, "scope_id", "left")
    return joined.where(~((F.coalesce("n", F.lit(0)) == want) & (F.coalesce("kinds", F.lit(0)) == want) & (F.coalesce("unknown", F.lit(0)) == 0)))


def covers_all(owners: DataFrame, wanted: DataFrame, owner: str, item: list[str]) -> DataFrame:
    """Relational division: owners that have every wanted item."""
    have = owners.select(owner, *item).distinct().join(wanted.select(*item).distinct(), item)
    need = wanted.select(*item).distinct().agg(F.count("*").alias("need"))
    return have.groupBy(owner).agg(F.count("*").alias("have")).crossJoin(need).where("have = need").select(owner)


def unresolved(references_: DataFrame, symbols: DataFrame, coverage: DataFrame) -> DataFrame:
    """Referenced ids that nothing declares; an error only where the symbols of the referencing scope are complete."""
    missing = references_.join(symbols.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_anti")
    state = coverage.where("fact = 'symbol'").select("scope_id", "state")
    return missing.join(state, "scope_id", "left").withColumn("is_error", F.coalesce(F.col("state") == "complete", F.lit(False))).drop("state")


def declared_twice(symbols: DataFrame) -> DataFrame:
    """Ids that several scopes declare: ids are unique over all scopes of a generation."""
    return symbols.groupBy("id").agg(F.count_distinct("scope_id").alias("scopes"), F.min("scope_id").alias("first_scope")).where("scopes > 1")


def document_of_symbols(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Symbols with the smallest defining document; ``external`` if none defines them."""
    d = occurrences.where("role = 'definition'").groupBy(*KEY).agg(F.min("uri").alias("document"))
    return symbols.join(d.withColumnRenamed("symbol_id", "id"), ["scope_id", "id"], "left").withColumn("external", F.col("document").isNull())


def delta_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens (uri, line, start_char, length, type) as differences to the one before; columns start anew on each line."""
    order = Window.partitionBy("uri").orderBy("line", "start_char")
    line, char = F.lag("line").over(order), F.lag("start_char").over(order)
    return tokens.select("uri", "line", "start_char", (F.col("line") - F.coalesce(line, F.lit(0))).alias("delta_line"), F.when(line == F.col("line"), F.col("start_char") - char).otherwise(F.col("start_char")).alias("delta_start"), "length", "type")


def rename_edits(occurrences: DataFrame, targets: DataFrame, new_name: str) -> DataFrame:
    """One edit for each place of the target symbols."""
    return references(occurrences, targets, include_declaration=True).select("query_id", *LOCATION, F.lit(new_name).alias("new_text"))


def implementations(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Types (type, method, signature) whose methods hold all those of an interface (interface, method, signature)."""
    m, i = methods.distinct(), interfaces.distinct()
    need = i.groupBy("interface").agg(F.count("*").alias("need"))
    have = m.join(i, ["method", "signature"]).groupBy("type", "interface").agg(F.count("*").alias("have"))
    return have.join(need, "interface").where("have = need").select("type", "interface")
