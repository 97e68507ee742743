"""The query facade: every answer has a status, completeness and a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import build_context_id, exported
from factloom.operators import facts, filters, gates, intervals
from factloom.storage import fixed


@dataclass
class Workspace:
    """One generation of facts. ``occurrences`` has flat ranges; ``files`` are those in view now."""

    files: DataFrame
    symbols: DataFrame
    occurrences: DataFrame
    coverage: DataFrame
    scopes: DataFrame

    def _target(self, uri: str, line: int, char: int, strict: bool) -> DataFrame:
        spark = self.files.sparkSession
        query = spark.createDataFrame([(1, uri, line, char)], "query_id long, uri string, line long, char long")
        rows = self.occurrences.where(F.col("uri") == uri)
        ranges = rows.select("uri", F.concat_ws("\x00", "scope_id", "symbol_id").alias("symbol_id"), F.col("line").alias("start_line"), "start_char", F.col("line").alias("end_line"), "end_char")
        hit = (intervals.only_symbol if strict else intervals.narrowest)(query, ranges)
        parts = F.split("symbol_id", "\x00")
        return hit.select("query_id", F.get(parts, F.lit(0)).alias("scope_id"), F.get(parts, F.lit(1)).alias("symbol_id"), "status", "reason")

    def _gates(self, target: DataFrame, needed: list[str]) -> DataFrame:
        own = self.occurrences.join(target.select("scope_id", "symbol_id"), ["scope_id", "symbol_id"])
        return gates.violations(
            no_single_symbol=target.where("status <> 'exact'"),
            unknown_role=filters.unknown_roles(own),
            stale_source=facts.stale(own, self.files),
            coverage=facts.coverage_gaps(target.select("scope_id").where("scope_id IS NOT NULL"), self.coverage, needed),
        )

    def verified(self, ask, files_now) -> DataFrame:
        """``ask(self)``, run once and then held against the files that ``files_now()`` gives afterwards."""
        answer = fixed(ask(self))
        print_of = lambda files: files.select("uri", F.col("sha256").alias("fingerprint"))
        return gates.rechecked(answer, gates.fingerprint_changed(print_of(self.files), print_of(files_now()), ["uri"]))

    def definition(self, uri: str, line: int, char: int, strict: bool = False) -> DataFrame:
        target = self._target(uri, line, char, strict)
        rows = facts.locations(filters.with_role(self.occurrences, "definition"), target.where("status = 'exact'"))
        return gates.envelope(rows.select(*facts.LOCATION), self._gates(target, ["definition"]))

    def declaration(self, uri: str, line: int, char: int) -> DataFrame:
        target = self._target(uri, line, char, False)
        rows = facts.locations(filters.with_role(self.occurrences, "declaration"), target.where("status = 'exact'"))
        return gates.envelope(rows.select(*facts.LOCATION), self._gates(target, ["declaration"]))

    def references(self, uri: str, line: int, char: int, include_declaration: bool = False, strict: bool = False) -> DataFrame:
        target = self._target(uri, line, char, strict)
        rows = facts.references(self.occurrences, target.where("status = 'exact'"), include_declaration)
        return gates.envelope(rows.select(*facts.LOCATION), self._gates(target, ["reference", "definition"]))

    def hover(self, uri: str, line: int, char: int) -> DataFrame:
        target = self._target(uri, line, char, False)
        known = target.where("status = 'exact'").select("scope_id", F.col("symbol_id").alias("id"))
        rows = self.symbols.join(known, ["scope_id", "id"]).select("name", "kind", "signature")
        return gates.envelope(rows, self._gates(target, ["symbol"]))

    def workspace_symbols(self, query: str) -> DataFrame:
        definitions = facts.best_definitions(self.occurrences)
        rows = facts.workspace_symbols(self.symbols, definitions, query)
        return gates.envelope(rows.drop("status"), gates.violations(coverage=facts.coverage_gaps(self.scopes, self.coverage, ["symbol"]), no_definition=rows.where("status <> 'exact'")))

    def rename(self, uri: str, line: int, char: int, new_name: str) -> DataFrame:
        """Edits, or one row that says why there are none."""
        target = self._target(uri, line, char, False)
        edits = facts.rename_edits(self.occurrences, target.where("status = 'exact'"), new_name).select(*facts.LOCATION, "new_text")
        own = self.symbols.join(target.select("scope_id", F.col("symbol_id").alias("id")), ["scope_id", "id"])
        taken = self.symbols.where(F.col("name") == new_name).join(target.select("scope_id"), "scope_id", "left_semi")
        places = edits.select("uri", F.col("line"), F.monotonically_increasing_id().alias("edit_id"), (F.col("line") * (1 << 20) + F.col("start_char")).alias("start"), (F.col("line") * (1 << 20) + F.col("end_char")).alias("end"))
        checks = self._gates(target, ["reference", "definition"]).unionByName(gates.violations(exported_symbol=own.where(exported(F.col("name"))), name_is_taken=taken, overlapping_edits=intervals.edit_conflicts(places)))
        return gates.envelope(edits, checks)

    def document_symbols(self, uri: str, nodes: DataFrame) -> DataFrame:
        """Nodes (uri, node_id, start, end) of a document with their parents."""
        return intervals.nearest_container(nodes.where(F.col("uri") == uri))

    def semantic_tokens(self, uri: str) -> DataFrame:
        rows = self.occurrences.where(F.col("uri") == uri)
        return facts.delta_tokens(rows.select("uri", "line", "start_char", (F.col("end_char") - F.col("start_char")).alias("length"), F.col("role").alias("type")))

    def diagnostics(self, diagnostics: DataFrame, start: int, end: int) -> DataFrame:
        return filters.in_lines(diagnostics, start, end)

    def status(self) -> DataFrame:
        """One row: sizes of the relations, and whether every source is as it was."""
        counts = self.occurrences.agg(F.count("*").alias("occurrences"), F.count_distinct("uri").alias("documents"))
        return counts.crossJoin(self.symbols.agg(F.count("*").alias("symbols"))).crossJoin(facts.stale(self.occurrences, self.files).agg((F.count("*") == 0).alias("fresh")))

    #: Read-only tools by name, for programs that call by name.
    TOOLS = ("definition", "references", "hover", "workspace_symbols", "status")

    def call(self, tool: str, **arguments) -> DataFrame:
        if tool not in self.TOOLS:
            raise ValueError(f"no such tool: {tool}")
        return getattr(self, tool)(**arguments)


#: What made the facts, as their provenance names it.
EXTRACTOR = "words-1"


def generation_checks(t: dict[str, DataFrame]) -> DataFrame:
    """The gates of a whole generation, its provenance among them."""
    context = gates.violations(build_context=gates.wrong_build_context(t["scopes"], t["provenance"]))
    return gates.generation_gates(t["scopes"], t["symbols"], gates.use_counts(t["occurrences"]), t["coverage"], t["files"]).unionByName(context)


def reindex(store, documents: DataFrame) -> int:
    """Build facts from documents, check them and publish a generation; a failed gate leaves the last one."""
    from factloom import schema
    from factloom.sources import tables

    files = tables.files(documents)
    occ = tables.occurrences(files)
    definitions = tables.definitions(occ)
    with_roles = tables.with_roles(occ, definitions)
    symbols = tables.symbols(definitions).withColumn("id", F.concat_ws("/", "scope_id", "id"))
    occurrences = with_roles.withColumn("symbol_id", F.concat_ws("/", "scope_id", "symbol_id"))
    canonical = F.concat_ws("|", F.lit(EXTRACTOR), "scope_id")
    scopes = files.select("scope_id").distinct().withColumn("language", F.lit("text")).withColumn("canonical", canonical)
    scopes = scopes.withColumn("build_context", build_context_id(F.col("language"), F.col("canonical")))
    provenance = scopes.select("scope_id", "build_context", F.lit(EXTRACTOR).alias("extractor"))
    coverage = scopes.select("scope_id", F.explode(F.array(*map(F.lit, schema.FACT_KINDS))).alias("fact")).withColumn("state", F.when(F.col("fact").isin("symbol", "definition", "reference"), "complete").otherwise("unavailable"))
    relations = {"files": files.drop("text"), "symbols": symbols, "occurrences": occurrences, "scopes": scopes, "coverage": coverage, "provenance": provenance}
    return store.write(relations, generation_checks)
