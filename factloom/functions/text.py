"""Widths, hashes, names and classes of text values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import schema


def utf8_width(s: Column) -> Column:
    return F.octet_length(s)


def utf16_width(s: Column) -> Column:
    """UTF-16 units: code points, and one more for each outside the basic plane."""
    # Plain ASCII, told by its bytes, needs no encoding.
    return F.when(F.octet_length(s) == F.char_length(s), F.char_length(s)).otherwise(F.floor(F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int"))


def utf32_width(s: Column) -> Column:
    return F.char_length(s)


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def short_digest(parts: Iterable[Column], length: int = 24) -> Column:
    """Digest of fields that are separated by NUL."""
    return F.substring(F.sha2(F.concat_ws("\x00", *parts).cast("binary"), 256), 1, length)


def build_context_id(language: Column, canonical: Column) -> Column:
    """Language and truncated digest of a canonical text of everything that went into a build."""
    return F.concat(language, F.lit(":sha256:"), F.substring(F.sha2(canonical.cast("binary"), 256), 1, 32))


def tools_digest(tools: Column) -> Column:
    """Digest of a list of tools that doesn't depend on its order."""
    return F.sha2(F.to_json(F.array_sort(tools)).cast("binary"), 256)


def config_hash(config: Column) -> Column:
    """Digest of a map; its entries are sorted first."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(config))).cast("binary"), 256)


def memo_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def packed_position(line: Column, char: Column) -> Column:
    return F.shiftleft(line.cast("long"), 32) + char


def signed_delta(a: Column, b: Column) -> Column:
    return a.cast("long") - b.cast("long")


def segment_checksum(content: Column) -> Column:
    return F.crc32(content.cast("binary"))


#: File extensions and the languages they stand for.
EXTENSIONS = {
    "go": "go", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "ipp": "cpp", "inl": "cpp", "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript",
    "tsx": "typescriptreact", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascriptreact",
}


def language_of(path: Column) -> Column:
    """Language by extension; empty if it isn't known."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))), F.lit(""))


#: Parts of a kind's name and the kind each stands for; the first that is found counts.
KIND_RULES = [
    "interface", "class", "struct", "enum", "method", "function", "constructor", "constant", "property", "field",
    "variable", "package", "module",
]


def symbol_kind(kind: Column) -> Column:
    name = F.lower(F.trim(kind))
    out = None
    for rule in KIND_RULES:
        out = F.when(F.contains(name, F.lit(rule)), rule) if out is None else out.when(F.contains(name, F.lit(rule)), rule)
    return out.otherwise("variable")


#: Methods by cost class and by priority; others are medium and maintenance.
COSTS = {
    "tiny": "textDocument/hover textDocument/completion textDocument/signatureHelp".split(),
    "small": "textDocument/definition textDocument/declaration textDocument/typeDefinition textDocument/implementation textDocument/documentSymbol textDocument/inlayHint textDocument/codeAction textDocument/formatting textDocument/diagnostic textDocument/prepareRename".split(),
    "medium": "textDocument/rename textDocument/semanticTokens/full textDocument/semanticTokens/range".split(),
    "large": "textDocument/references workspace/symbol".split(),
    "very_large": "server/reindex".split(),
}
PRIORITIES = {
    "P0-completion": "textDocument/completion textDocument/signatureHelp".split(),
    "P1-hover": "textDocument/hover".split(),
    "P1-definition": "textDocument/definition textDocument/declaration textDocument/typeDefinition textDocument/implementation".split(),
    "P1-references": "textDocument/references textDocument/rename".split(),
    "P2-diagnostics": "textDocument/diagnostic textDocument/codeAction".split(),
    "P3-semantic-tokens": "textDocument/semanticTokens/full textDocument/semanticTokens/range textDocument/inlayHint".split(),
}
#: The share of the workers that a class may take.
CLASS_SHARE = {"tiny": 1.0, "small": 1.0, "medium": 0.75, "large": 0.5, "very_large": 0.25}


def _lookup(value: Column, table: dict[str, list[str]], default: str) -> Column:
    out = None
    for name, members in table.items():
        out = F.when(value.isin(members), name) if out is None else out.when(value.isin(members), name)
    return out.otherwise(default)


def cost_class(method: Column) -> Column:
    return _lookup(method, COSTS, "medium")


def priority(method: Column) -> Column:
    return _lookup(method, PRIORITIES, "P5-maintenance")


def class_cap(cost: Column, workers: Column) -> Column:
    """Requests of a class that may run at once: a share of the workers, one at least."""
    share = F.create_map(*[F.lit(x) for pair in CLASS_SHARE.items() for x in pair])
    return F.greatest(F.lit(1), F.floor(F.greatest(workers, F.lit(1)) * F.element_at(share, cost))).cast("long")


#: What marks a mismatch as another tool's, the build's, or intended; the first group that is found counts.
TRIAGE = [
    ("upstream_bug", ["gopls", "pyright", "tsserver", "rust-analyzer"]),
    ("build_context", ["version", "flags", "env", "build context"]),
    ("semantic_difference", ["by design", "documented"]),
]


def triage(keywords: Column) -> Column:
    """Class of a mismatch from an array of symptoms; ``engine_bug`` if nothing else explains it."""
    out = None
    for name, marks in TRIAGE:
        pattern = "|".join(marks)
        found = F.exists(keywords, lambda k: F.lower(k).rlike(pattern))  # noqa: B023
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("engine_bug")


#: Fixed value: a key that names a credential, and its value in any of the shapes configuration has.
SECRET = r"""(?i)("?[a-z0-9_.-]*(?:token|password|secret|authorization|api[_-]?key|bearer)[a-z0-9_.-]*"?)\s*[=:]\s*(?:bearer\s+)?(?:\[[^\[\]]*\]|"[^"]*"|[^\s&;]+)"""


def redacted(s: Column) -> Column:
    return F.regexp_replace(s, SECRET, "$1=[REDACTED]")


def mentions_version(text: Column, version: Column) -> Column:
    """Whether the version is in the text as a whole token."""
    quoted = F.concat(F.lit(r"\Q"), version, F.lit(r"\E"))
    return F.rlike(text, F.concat(F.lit(r"(?:^|[^0-9A-Za-z.+\-])"), quoted, F.lit(r"(?:$|[^0-9A-Za-z.+\-])")))


def diagnostic_code(raw: Column) -> Column:
    """A diagnostic's code as text, from its JSON: a text is what it says, a whole number is in decimal, null is empty, all else stays JSON."""
    bare = F.regexp_replace(raw, r"^\s+|\s+$", "")
    spoken = F.get_json_object(F.concat(F.lit('{"v":'), bare, F.lit("}")), "$.v")
    number = F.when(bare.rlike(r"^-?(0|[1-9][0-9]*)$"), bare.try_cast("long").cast("string"))
    own = F.when(bare.rlike(r'^"([^"\\]|\\.)*"$'), spoken).otherwise(number)
    return F.when(F.coalesce(bare, F.lit("")).isin("", "null"), "").otherwise(F.coalesce(own, bare))


def same_members(a: Column, b: Column) -> Column:
    """Equality of lists as multisets."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def exported(name: Column) -> Column:
    return F.substring(name, 1, 1).rlike(r"^\p{Lu}")


def known_enum(value: Column, domain: list[str]) -> Column:
    """The value, or an error if it isn't in the domain."""
    return F.when(value.isin(domain), value).otherwise(F.raise_error(F.concat(F.lit("unknown value "), F.coalesce(value, F.lit("NULL")))))


def edge_fact(kind: Column) -> Column:
    """The kind of fact that an edge is; null for an unknown kind."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in schema.EDGE_FACT.items() for x in pair]), kind)


def occurrence_fact(role: Column) -> Column:
    r = F.lower(role)
    return F.when(r.isin("definition", "declaration"), r).otherwise("reference")


def valid_text(s: Column) -> Column:
    """Not empty, and without NUL and line ends."""
    return s.isNotNull() & (s != "") & ~s.rlike("[\\x00\\r\\n]")


def valid_hash(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^sha256:[0-9a-f]{64}$"), F.lit(False))


def valid_range(r: Column) -> Column:
    start, end = F.struct(r["start_line"], r["start_char"]), F.struct(r["end_line"], r["end_char"])
    return (r["start_line"] >= 0) & (r["start_char"] >= 0) & (start <= end)


#: Directories that a scan leaves out, and extensions of files without text.
SKIPPED_DIRECTORIES = [".git", ".hg", ".svn", "node_modules", "vendor", "target", "dist", "build", "__pycache__"]
BINARY_EXTENSIONS = ["exe", "dll", "so", "dylib", "a", "o", "obj", "png", "jpg", "jpeg", "gif", "zip", "gz", "tar", "pdf", "class", "jar", "wasm"]


def scannable(path: Column) -> Column:
    skipped = path.rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in SKIPPED_DIRECTORIES) + ")/")
    return ~skipped & ~F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(BINARY_EXTENSIONS)


def inside(path: Column, root: Column) -> Column:
    """Whether a path is the root or below it; one that leaves by ``..`` isn't."""
    base = F.rtrim(root, F.lit("/"))
    return ~path.rlike(r"(^|/)\.\.(/|$)") & ((path == base) | F.startswith(path, F.concat(base, F.lit("/"))))


def scip_range(values: Column) -> Column:
    """A range of three numbers (one line) or four; of fewer, those that are missing are null."""
    three = F.size(values) == 3
    at = lambda i: F.try_element_at(values, F.lit(i)).cast("long")
    return F.struct(at(1).alias("start_line"), at(2).alias("start_char"), F.when(three, at(1)).otherwise(at(3)).alias("end_line"), F.when(three, at(3)).otherwise(at(4)).alias("end_char"))


#: SCIP's numbers of the kinds of symbols that facts have, kinds that it has no number of its own for, families of languages.
SCIP_KINDS = {"class": 7, "constant": 8, "function": 17, "interface": 21, "method": 26, "variable": 61}
SCIP_ALIASES = {"struct": "class", "field": "variable"}
SCIP_FAMILIES = {"c": "c-family", "c++": "c-family", "cpp": "c-family", "go": "go", "javascript": "ts-js-family", "javascriptreact": "ts-js-family", "python": "python", "rust": "rust", "typescript": "ts-js-family", "typescriptreact": "ts-js-family"}


def _mapped(value: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def scip_kind(kind: Column) -> Column:
    """SCIP's number of a kind of symbol; 0, unspecified, where it has none."""
    return F.coalesce(_mapped(F.lower(kind), {**SCIP_KINDS, **{k: SCIP_KINDS[v] for k, v in SCIP_ALIASES.items()}}), F.lit(0))


def kind_of_scip(number: Column) -> Column:
    """The kind of symbol that a number of SCIP stands for; empty where facts have none."""
    return F.coalesce(_mapped(number.cast("int"), {v: k for k, v in SCIP_KINDS.items()}), F.lit(""))


def language_family(language: Column) -> Column:
    """The family whose languages share symbols in SCIP; empty for others."""
    return F.coalesce(_mapped(F.lower(F.trim(language)), SCIP_FAMILIES), F.lit(""))


def import_line_removable(line: Column) -> Column:
    """Whether a line holds one quoted import path at its end and nothing that a removal would break."""
    code = F.substring_index(line, "//", 1)
    return F.coalesce(~line.rlike("[;{}]") & code.rlike(r"""(?U)(^|\s)["`]\S*\s*$"""), F.lit(False))


def compiler_position(raw: Column) -> Column:
    """``file:line:column`` as a struct with both from 1; null where it isn't that."""
    part = lambda i: F.regexp_extract(raw, r"(?s)^(.+):([+-]?[0-9]+):([+-]?[0-9]+)$", i)
    line, column = part(2).try_cast("long"), part(3).try_cast("long")
    return F.when((line >= 1) & (column >= 1), F.struct(part(1).alias("file"), line.alias("line"), column.alias("column")))


def is_identifier(s: Column) -> Column:
    """A letter or underscore, then letters, decimal digits and underscores."""
    return F.coalesce(s.rlike(r"^[_\p{L}][_\p{L}\p{Nd}]*\z"), F.lit(False))


def selection_end(end: Column, line: Column, char: Column, name: Column, width=utf16_width) -> Column:
    """Where a symbol's selection ends: ``end`` (line, char) where it is known, else past the name."""
    return F.coalesce(end, F.struct(line.alias("line"), (char + width(name)).alias("char")))
