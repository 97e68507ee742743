"""Source trees, project files and configuration as tables."""

from __future__ import annotations

import json
import os
import re
import shlex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import content_hash, inside, language_of, redacted, scannable
from factloom.operators.running import running_sum

#: Bounds of a scan.
FILE_BYTES, TREE_DEPTH = 1 << 20, 16


def scan(spark: SparkSession, root: str, most_bytes: int = FILE_BYTES, depth: int = TREE_DEPTH, content: bool = True) -> DataFrame:
    """Files below ``root``: path, size, modified, language, sha256 and content.

    Too large or deep files, skipped directories and binary files are left out before their bytes
    are hashed; without ``content`` only the listing is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split(":", 1)[-1].rstrip("/")
    path = F.regexp_replace("path", rf"^.*?\Q{base}\E/+", "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    rows = rows.where(scannable(F.concat(F.lit("/"), F.col("path"))) & (F.col("size") <= most_bytes) & (F.size(F.split("path", "/")) <= depth)).withColumn("language", language_of(F.col("path")))
    return rows.withColumn("sha256", content_hash(F.col("content"))) if content else rows


def within_budget(files: DataFrame, most_bytes: int) -> DataFrame:
    """The files in the order of paths up to a budget of bytes."""
    return running_sum(files, ["path"], F.col("size"), "upto").where(F.col("upto") <= most_bytes).drop("upto")


def compilation_database(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a C or C++ compilation database: file, directory and arguments."""
    raw = spark.read.option("multiLine", "true").schema("directory string, file string, command string, arguments array<string>, output string").json(path)
    words = split_command(F.col("command"))
    return raw.select("file", "directory", F.coalesce("arguments", words).alias("arguments")).select("*", *_parts())


def split_command(command: Column) -> Column:
    """Words of a shell command. Quotes and escapes nest, which SQL can't follow."""

    @F.udf("array<string>", useArrow=True)
    def run(s):
        try:
            return None if s is None else shlex.split(s)
        except ValueError:
            return None

    return run(command)


def _parts() -> list[Column]:
    flagged = lambda flag: F.transform(F.filter("arguments", lambda a: F.startswith(a, F.lit(flag)) & (F.length(a) > len(flag))), lambda a: F.substr(a, F.lit(len(flag) + 1)))
    return [flagged("-D").alias("defines"), flagged("-I").alias("includes")]


def lenient_json(text: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON; strings are left as they are."""

    pattern = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=\s*(?://[^\n]*\s*|/\*.*?\*/\s*)*[}\]])', re.S)

    @F.udf("string", useArrow=True)
    def run(s):
        return None if s is None else pattern.sub(lambda m: m[0] if m[0][0] == '"' else " ", s)

    return run(text)


def project_references(configs: DataFrame) -> DataFrame:
    """Edges (src, dst) of projects (config, text) that extend or refer to others."""
    parsed = F.from_json(lenient_json(F.col("text")), "extends string, references array<struct<path:string>>")
    rows = configs.select("config", parsed.alias("j"))
    to = F.concat(F.when(F.col("j.extends").isNotNull(), F.array("j.extends")).otherwise(F.expr("cast(array() as array<string>)")), F.coalesce(F.transform("j.references", lambda r: r["path"]), F.expr("cast(array() as array<string>)")))
    return rows.select(F.col("config").alias("src"), F.explode(to).alias("dst"))


#: Settings of a Python project that are understood, those among them that are handed on, and the name of no file.
PYTHON_SETTINGS = ["pythonVersion", "pythonPlatform", "stubPath", "extraPaths", "typeCheckingMode", "strict", "include", "exclude"]
PYTHON_CONFIGS, DEFAULT_CONFIG = ["pyrightconfig.json", "pyproject.toml"], "<default>"


def ancestors(path: Column) -> Column:
    """The directories that a path lies in, the root (empty) among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def python_scopes(files: DataFrame) -> DataFrame:
    """Scopes of the Python projects among files (path, text): scope_id, root, config, digest, stub_path, unsupported.

    Every ``pyrightconfig.json`` makes its folder a scope, a ``pyproject.toml`` does where the folder
    has none of them. Settings that aren't understood are named, sorted; those of a TOML file aren't
    read. Files outside all scopes, or no configuration, add a default scope at the root; without
    Python files there are no scopes.
    """
    name, folder = F.lower(F.regexp_extract("path", r"[^/]*$", 0)), F.regexp_replace("path", "/?[^/]*$", "")
    python = files.where(F.lower("path").rlike(r"\.pyi?$")).select("path")
    configs = files.where(name.isin(PYTHON_CONFIGS)).select("path", folder.alias("root"), name.alias("config"), "text")
    configs = configs.join(configs.where(F.col("config") == PYTHON_CONFIGS[0]).select(F.col("root").alias("r"), F.lit(True).alias("own")).distinct(), F.col("r") == F.col("root"), "left")
    configs = configs.where((F.col("config") == PYTHON_CONFIGS[0]) | F.col("own").isNull())
    plain = lenient_json(F.col("text"))
    keys = F.json_object_keys(plain)
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, PYTHON_SETTINGS))))
    is_json = F.col("config") == PYTHON_CONFIGS[0]
    problem = F.when(~is_json, F.array(F.lit("pyproject.toml"))).when(keys.isNull(), F.array(F.lit("not JSON"))).otherwise(unknown)
    stub = F.when(is_json, F.get_json_object(plain, "$.stubPath"))
    own = configs.select(F.concat(F.lit("python-config:"), "path").alias("scope_id"), "root", "config", content_hash(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce(F.when(stub != "", stub), F.lit("none")).alias("stub_path"), problem.alias("unsupported"))
    some = python.limit(1).select(F.lit(1).alias("one"))
    orphans = python.select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(own.select("root").distinct().withColumn("hit", F.lit(1)), "root", "left").groupBy("path").agg(F.max("hit").alias("hit")).where("hit IS NULL")
    none = F.lit(DEFAULT_CONFIG)
    default = orphans.limit(1).select(F.lit("python-default:").alias("scope_id"), F.lit("").alias("root"), none.alias("config"), content_hash(none).alias("digest"), F.lit("none").alias("stub_path"), F.array().cast("array<string>").alias("unsupported"))
    return own.join(F.broadcast(some), F.lit(True), "left_semi").unionByName(default)


CARGO = "workspace_members array<string>, packages array<struct<id:string,name:string,version:string,manifest_path:string,targets:array<struct<name:string,kind:array<string>,src_path:string>>>>"


def cargo_packages(metadata: DataFrame) -> DataFrame:
    """Workspace members of cargo's metadata (root, text): root, name, version, manifest, target, src, fault.

    One row a target, paths from the root. Faults: ``undecodable``, ``no_members``, ``incomplete``
    (a member without name, version or manifest) and ``outside`` (a path that isn't below the root).
    """
    j = metadata.select("root", F.from_json("text", CARGO).alias("j"))
    known = F.coalesce(F.size("j.workspace_members"), F.lit(0)) > 0
    whole = j.where(~known).select("root", *[F.lit(None).cast("string").alias(c) for c in ("name", "version", "manifest", "target", "src")], F.when(F.col("j").isNull() | F.col("j.workspace_members").isNull(), "undecodable").otherwise("no_members").alias("fault"))
    members = j.where(known).select("root", F.col("j.workspace_members").alias("ms"), F.explode("j.packages").alias("p")).where(F.array_contains("ms", F.col("p.id")))
    rows = members.select("root", "p", F.explode_outer("p.targets").alias("t"))
    below = lambda c: F.when(inside(c, F.col("root")), F.substr(c, F.length(F.rtrim("root", F.lit("/"))) + 2))
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    manifest, src = below(F.col("p.manifest_path")), below(F.col("t.src_path"))
    fault = F.when(~(filled("p.name") & filled("p.version") & filled("p.manifest_path")), "incomplete").when(manifest.isNull() | (F.col("t").isNotNull() & src.isNull()), "outside")
    return rows.select("root", "p.name", "p.version", manifest.alias("manifest"), F.col("t.name").alias("target"), src.alias("src"), fault.alias("fault")).unionByName(whole)


def bill_of_materials(requirements: DataFrame, sums: DataFrame) -> DataFrame:
    """Dependencies (line) and their checksums (line) as components: name, version, hash."""
    name, version = F.regexp_extract("line", r"^\s*(?:require\s+)?([^\s()]+)\s+(v[^\s]+)", 1), F.regexp_extract("line", r"^\s*(?:require\s+)?([^\s()]+)\s+(v[^\s]+)", 2)
    need = requirements.select(name.alias("name"), version.alias("version"), F.contains("line", F.lit("// indirect")).alias("indirect")).where("name <> ''")
    parts = F.split("line", r"\s+")
    have = sums.select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("version"), F.get(parts, F.lit(2)).alias("hash")).where("hash IS NOT NULL AND version NOT LIKE '%/go.mod'")
    return need.join(have, ["name", "version"], "left")


def bundle(files: DataFrame, mode: str) -> DataFrame:
    """Rows of a reproduction bundle: metadata only, redacted texts, or full texts."""
    if mode not in ("metadata", "redacted", "full"):
        raise ValueError(f"no such mode: {mode}")
    meta = files.select("uri", "language", "size", "sha256", *([] if mode == "metadata" else ["text"]))
    return meta.withColumn("text", redacted(F.col("text"))) if mode == "redacted" else meta


def configuration(defaults: dict, path: str | None = None, prefix: str = "FACTLOOM_", environment: dict[str, str] | None = None) -> dict:
    """Settings in layers: defaults, a JSON file, the environment. Unknown names and other types are errors."""
    out = dict(defaults)
    layers = []
    if path:
        with open(path) as f:
            layers.append(json.load(f))
    env = os.environ if environment is None else environment
    layers.append({k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)})
    for layer in layers:
        for k, v in layer.items():
            if k not in defaults:
                raise ValueError(f"unknown setting {k}")
            want = type(defaults[k])
            if isinstance(v, str) and want is not str:
                v = v.lower() in ("1", "true", "yes") if want is bool else want(v)
            if not isinstance(v, want):
                raise ValueError(f"{k} must be {want.__name__}")
            out[k] = v
    return out
