"""Versioned generations of fact tables. A generation is there as soon as its manifest is.

A table of a generation is a list of segments: immutable files of bounded size, each with
its rows and a checksum in the manifest. Compaction writes small segments together and
takes the others over as they are, so several manifests may name one file; files go when
no manifest names them. A damaged segment is found and set aside by itself.

A manifest is written beside its place and renamed to it, once, and never changed;
the newest one names the current generation, so there is no moment at which a
reader finds none, and a crash leaves the last generation as it was. Writers take
turns by a lease, readers may hold one on the generation they read; both end by
themselves when their holder is lost.

Data is written by Spark; only the manifest, a few lines of JSON, is handled by
the driver, through Spark's own file system layer, so any store works.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.schema import BATCH_BYTES, SEGMENT_BYTES

DEPTH = 3
#: Seconds after which a lease ends whose holder didn't give it back.
LEASE_SECONDS = 6 * 3600
#: Tables that say what a generation is; compaction takes them over as they are, behind all others.
METADATA = ("scopes", "coverage", "provenance")


MASK = (1 << 64) - 1


class StoreError(Exception):
    pass


def row_hash(table: DataFrame) -> Column:
    """A 64-bit hash of a row's values and of which are null. Maps, which hashes don't take, go by their JSON form."""
    values = []
    for f in sorted(table.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        values.append(F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c)
        values.append(c.isNull())
    return F.xxhash64(*values)


def own_path() -> Column:
    """The path of a row's file from the root of its store."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"^.*/(gen=[0-9]+/.*)$", 1)


class FactStore:
    """Generations under ``root``: data in ``gen=N`` and one manifest each; the newest is the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.root))

    # ---- small files

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Write beside the target, then rename to it; a target that is there is an error."""
        temporary, target = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self.fs.create(temporary, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.fs.exists(target) or not self.fs.rename(temporary, target):
            self.fs.delete(temporary, False)
            raise StoreError(f"{name} could not be published")

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))]

    def _expired(self, name: str) -> bool:
        """Whether a lease file is over; one without a time in it is held until it is made again."""
        try:
            text = self._read(name)
            return text is None or json.loads(text)["until"] < time.time()
        except ValueError:
            return False

    @contextlib.contextmanager
    def lease(self, name: str = "writer", seconds: float = LEASE_SECONDS):
        """Hold a lease file while the block runs; one holder at a time, over all processes.

        A lease whose time is over is taken out of the way by a rename, which only one of those
        who wait can do.
        """
        file, holder = f".lease-{name}", uuid.uuid4().hex
        try:
            self._write(file, json.dumps({"holder": holder, "until": time.time() + seconds}))
        except StoreError as e:
            old = self._path(f"{self.root}/.over-{holder}")
            if not (self._expired(file) and self.fs.rename(self._path(f"{self.root}/{file}"), old)):
                raise StoreError(f"{name} is leased by another") from e
            self.fs.delete(old, False)
            self._write(file, json.dumps({"holder": holder, "until": time.time() + seconds}))
        try:
            yield
        finally:
            own = self._read(file)
            if own and json.loads(own)["holder"] == holder:
                self.fs.delete(self._path(f"{self.root}/{file}"), False)

    @contextlib.contextmanager
    def reading(self, number: int | None = None, seconds: float = LEASE_SECONDS):
        """The number of a generation that isn't pruned while the block runs."""
        number = self.current() if number is None else number
        with self.lease(f"reader-{number}-{uuid.uuid4().hex}", seconds):
            self.manifest(number)
            yield number

    def _read_now(self) -> set[int]:
        """Generations with a reader."""
        names = [n for n in self._names() if n.startswith(".lease-reader-")]
        return {int(n.split("-")[2]) for n in names if not self._expired(n)}

    # ---- generations

    def history(self) -> list[int]:
        """Numbers of published generations, the newest first."""
        return sorted((int(n[9:-5]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json")), reverse=True)

    def current(self) -> int | None:
        return next(iter(self.history()), None)

    def _next(self) -> int:
        """One more than any number that was ever used; numbers never go back."""
        used = [int(n.split("=")[1].split(".")[0]) for n in self._names() if n.startswith(("gen=", "quarantine="))]
        return max([*self.history(), *used, 0]) + 1

    def write(self, tables: dict[str, DataFrame], gates: Callable[[dict[str, DataFrame]], DataFrame] | None = None, records_per_file: int = 0, notes: dict | None = None, segment_bytes: int = SEGMENT_BYTES) -> int:
        """Stage tables, check them as they were written, and publish them as a new generation.

        The writer holds the lease from the choice of its number on. If a gate fails the staged
        data goes and the last generation stays. ``notes`` are kept in the manifest. A table whose
        files are larger than ``segment_bytes`` is written again with fewer records a file; a record
        that is larger by itself is an error.
        """
        with self.lease():
            number = self._next()

            def fill(place: str) -> dict:
                for name, table in tables.items():
                    self._bounded(table, f"{place}/{name}", records_per_file, segment_bytes)
                made = {name: self._described(self.spark.read.parquet(f"{place}/{name}"), f"gen={number}/{name}") for name in tables}
                if gates:
                    broken = gates({name: self._table(d) for name, d in made.items()}).where("violations > 0").collect()
                    if broken:
                        raise StoreError(f"gates failed: {sorted(r.gate for r in broken)}")
                return made

            return self._staged(number, fill, notes)

    def stage(self, fill: Callable[[str], None], notes: dict | None = None) -> int:
        """As ``write``, of tables that ``fill`` itself writes into the generation's place, each in a folder of its name."""
        with self.lease():
            number = self._next()

            def made(place: str) -> dict:
                fill(place)
                names = [s.getPath().getName() for s in self.fs.listStatus(self._path(place))]
                return {name: self._described(self.spark.read.parquet(f"{place}/{name}"), f"gen={number}/{name}") for name in sorted(names)}

            return self._staged(number, made, notes)

    def bounded(self, table: DataFrame, place: str, records: int) -> None:
        """Write a table with at most so many records a file, and no file larger than a segment."""
        self._bounded(table, place, records, SEGMENT_BYTES)

    def _staged(self, number: int, fill: Callable[[str], dict], notes: dict | None = None) -> int:
        """Publish what ``fill`` writes into a generation's place and describes; nothing stays if it fails."""
        place = f"{self.root}/gen={number}"
        try:
            manifest = {"generation": number, "at": int(time.time()), "tables": fill(place), "notes": notes or {}}
            self._write(f"manifest-{number}.json", json.dumps(manifest))
        except BaseException:
            self.fs.delete(self._path(place), True)
            raise
        return number

    def _bounded(self, table: DataFrame, place: str, records: int, most: int) -> None:
        while True:
            writer = table.write.mode("errorifexists")
            (writer.option("maxRecordsPerFile", records) if records else writer).parquet(place)
            large = {f"{place}/{n}": size for n, size in self._files(place).items() if size > most}
            if not large:
                return
            rows = {r.f: r.n for r in self.spark.read.parquet(*large).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()}
            fewer = min(max(1, rows[p.rsplit("/", 1)[1]] * most * 8 // (size * 10)) for p, size in large.items())
            if any(rows[p.rsplit("/", 1)[1]] == 1 for p in large) or records == 1:
                raise StoreError(f"a record of {place.rsplit('/', 1)[1]} is larger than a segment's {most} bytes")
            self.fs.delete(self._path(place), True)
            records = min(fewer, records - 1) if records else fewer

    def _files(self, place: str) -> dict[str, int]:
        """The data files below a place: path from there, and size."""
        if not self.fs.exists(self._path(place)):
            return {}
        found, listing = {}, self.fs.listFiles(self._path(place), True)
        head = self.fs.makeQualified(self._path(place)).toString().rstrip("/") + "/"
        while listing.hasNext():
            f = listing.next()
            name = f.getPath().toString().removeprefix(head)
            if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
                found[name] = f.getLen()
        return found

    @staticmethod
    def _sums(table: DataFrame, *by) -> DataFrame:
        """Row count, and the sum and the exclusive or of 64-bit hashes of rows: neither depends on order or files."""
        hashed = table.select(row_hash(table).alias("h"), *by)
        return hashed.groupBy(*["file" for _ in by]).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"))

    def _segments(self, table: DataFrame) -> dict[str, tuple[int, int, int]]:
        """By path from the root: rows, sum and exclusive or. As many rows as files come to the driver."""
        return {r.file: (r.n, int(r.s), r.x & MASK) for r in self._sums(table, own_path().alias("file")).collect()}

    def _described(self, table: DataFrame, place: str) -> dict:
        """What a manifest says of a table whose files lie below ``place``."""
        sums = self._segments(table)
        segments = [{"path": f"{place}/{name}", "bytes": size, "sums": sums.get(f"{place}/{name}", (0, 0, 0))} for name, size in sorted(self._files(f"{self.root}/{place}").items())]
        return self._total(segments, table.schema)

    @staticmethod
    def _total(segments: list[dict], schema: StructType) -> dict:
        rows, sum_, xor = 0, 0, 0
        for x in segments:
            n, s, h = x["sums"]
            rows, sum_, xor = rows + n, sum_ + s, xor ^ h
        return {"rows": rows, "checksum": f"{sum_}:{xor:016x}", "columns": sorted(schema.names), "schema": schema.json(), "segments": segments}

    def _summary(self, table: DataFrame) -> dict:
        """Rows, checksum and columns of any table."""
        r = self._sums(table).first()
        return {"rows": r.n, "checksum": f"{int(r.s)}:{r.x & MASK:016x}", "columns": sorted(table.columns)}

    def _table(self, described: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(described["schema"]))
        paths = [f"{self.root}/{x['path']}" for x in described["segments"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def manifest(self, number: int) -> dict:
        text = self._read(f"manifest-{number}.json")
        if text is None:
            raise StoreError(f"no manifest of generation {number}")
        return json.loads(text)

    def generation(self, number: int | None = None, gates: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> dict[str, DataFrame]:
        """All tables of a generation, read strictly: each is what was published, and no gate fails."""
        number = self.current() if number is None else number
        if number is None:
            raise StoreError("nothing is published")
        tables = {name: self.read(name, number, verify=True) for name in self.manifest(number)["tables"]}
        broken = gates(tables).where("violations > 0").collect() if gates else []
        if broken:
            raise StoreError(f"gates failed: {sorted(r.gate for r in broken)}")
        return tables

    def read(self, name: str, number: int | None = None, verify: bool = False) -> DataFrame:
        """A table of a generation, the current one by default. The number is pinned when this is called."""
        number = self.current() if number is None else number
        if number is None:
            raise StoreError("nothing is published")
        described = self.manifest(number)["tables"][name]
        table = self._table(described)
        if verify and self._summary(table) != {k: described[k] for k in ("rows", "checksum", "columns")}:
            raise StoreError(f"{name} of generation {number} is not what was published")
        return table

    def damaged(self, number: int) -> list[str]:
        """Paths of a generation's segments that aren't what was published, or gone, and of files in its place that no manifest names.

        Damage in one file doesn't hide what is wrong with others.
        """
        wrong = []
        for described in self.manifest(number)["tables"].values():
            there = [x for x in described["segments"] if self._length(x["path"]) == x["bytes"]]
            wrong += [x["path"] for x in described["segments"] if x not in there]
            if not there:
                continue
            schema = StructType.fromJson(json.loads(described["schema"]))
            table = self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*[f"{self.root}/{x['path']}" for x in there])
            now = self._segments(table)
            wrong += [x["path"] for x in there if now.get(x["path"], (0, 0, 0)) != tuple(x["sums"])]
        named = self._named()
        return wrong + [p for p in (f"gen={number}/{f}" for f in self._files(f"{self.root}/gen={number}")) if p not in named]

    def _length(self, path: str) -> int | None:
        place = self._path(f"{self.root}/{path}")
        return self.fs.getFileStatus(place).getLen() if self.fs.exists(place) else None

    def _named(self, but: int | None = None) -> set[str]:
        """All files that published manifests name."""
        return {x["path"] for n in self.history() if n != but for t in self.manifest(n)["tables"].values() for x in t["segments"]}

    def verified(self, number: int) -> bool:
        try:
            return not self.damaged(number)
        except (StoreError, ValueError, KeyError):  # a manifest that can't be read
            return False

    def recover(self) -> int | None:
        """Make the newest generation that verifies in full the current one.

        Of a broken one only the damaged segments are set aside; those that are sound may be named
        by others, and are reclaimed if not.
        """
        for number in self.history():
            try:
                wrong = self.damaged(number)
            except (StoreError, ValueError, KeyError):
                wrong = None
            if wrong == []:
                return number
            self.quarantine(number, wrong)
        return None

    def quarantine(self, number: int, paths: list[str] | None = None) -> None:
        """Take a generation back: its manifest goes first, so that no reader begins on it; then the paths, or all its own files, are set aside."""
        self.fs.delete(self._path(f"{self.root}/manifest-{number}.json"), False)
        own = [f"gen={number}/{f}" for f in self._files(f"{self.root}/gen={number}")]
        named = set() if paths else self._named()
        for path in own if paths is None else paths:
            source, target = self._path(f"{self.root}/{path}"), self._path(f"{self.root}/quarantine={number}/{path.replace('/', '__')}")
            if path not in named and self.fs.exists(source):
                self.fs.mkdirs(target.getParent())
                self.fs.rename(source, target)

    def _unnamed(self, folder: str, named: set[str]) -> bool:
        """Delete what no manifest names below a generation's folder; whether anything was deleted."""
        files = [f"{folder}/{f}" for f in self._files(f"{self.root}/{folder}")]
        stale = [f for f in files if f not in named]
        if len(stale) == len(files):
            return self.fs.delete(self._path(f"{self.root}/{folder}"), True)
        for f in stale:
            self.fs.delete(self._path(f"{self.root}/{f}"), False)
        return bool(stale)

    def reclaim(self, quarantine_share: float = 0.25) -> list[str]:
        """Delete staged data without a manifest, and the oldest quarantined data beyond its share of all bytes."""
        kept, named = {f"gen={n}" for n in self.history()}, self._named()
        gone = [n for n in self._names() if n.startswith("gen=") and n not in kept and self._unnamed(n, named)]
        size = lambda n: self.fs.getContentSummary(self._path(f"{self.root}/{n}")).getLength()
        budget = quarantine_share * sum(size(n) for n in kept)
        for n in sorted((n for n in self._names() if n.startswith("quarantine=")), key=lambda n: -int(n.split("=")[1])):
            budget -= size(n)
            if budget < 0:
                gone.append(n)
                self.fs.delete(self._path(f"{self.root}/{n}"), True)
        return sorted(gone)

    def prune(self, depth: int = DEPTH) -> list[int]:
        """Keep the newest generations, and those with readers."""
        held = self._read_now()
        gone = [n for n in self.history()[max(1, depth) :] if n not in held]
        for n in gone:
            self.fs.delete(self._path(f"{self.root}/manifest-{n}.json"), False)
        named = self._named()
        for folder in self._names():
            if folder.startswith("gen=") and int(folder[4:]) in gone:
                self._unnamed(folder, named)
        return gone

    def bytes_used(self, number: int) -> int:
        return sum(x["bytes"] for t in self.manifest(number)["tables"].values() for x in t["segments"])

    def compact(self, batch_bytes: int = BATCH_BYTES, verbatim: tuple[str, ...] = METADATA) -> int:
        """Publish the current generation with its small segments written together.

        Segments of a table are put together in their order while they have no more than
        ``batch_bytes``; those that have more, stand alone or are of the tables ``verbatim`` are taken over as they are, and
        these tables stand last. There are never more segments than before, and each new one has
        the rows of those it is made of, or nothing is published.
        """
        number = self.current()
        if number is None:
            raise StoreError("nothing is published")
        before = self.manifest(number)["tables"]
        order = [n for n in before if n not in verbatim] + [n for n in before if n in verbatim]
        with self.lease():
            after = self._next()
            return self._staged(after, lambda place: {name: before[name] if name in verbatim else self._merged(before[name], f"gen={after}/{name}", batch_bytes) for name in order}, self.manifest(number).get("notes"))

    def _merged(self, described: dict, place: str, batch_bytes: int) -> dict:
        groups: list[list[dict]] = []
        for x in described["segments"]:
            if groups and sum(y["bytes"] for y in groups[-1]) + x["bytes"] <= batch_bytes:
                groups[-1].append(x)
            else:
                groups.append([x])
        many = [g for g in groups if len(g) > 1]
        if not many:
            return described
        schema = StructType.fromJson(json.loads(described["schema"]))
        of = self.spark.createDataFrame([(x["path"], i) for i, g in enumerate(many) for x in g], "file string, segment int")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{x['path']}" for g in many for x in g]).select("*", own_path().alias("file"))
        # One file for each group; the names of files are a small table.
        rows.join(F.broadcast(of), "file").drop("file").repartition(len(many), "segment").write.partitionBy("segment").parquet(f"{self.root}/{place}")
        files = {int(n.split("/")[0].split("=")[1]): (n, size) for n, size in self._files(f"{self.root}/{place}").items()}
        written = self._segments(self.spark.read.schema(schema).parquet(*[f"{self.root}/{place}/{n}" for n, _ in files.values()])) if files else {}
        made = []
        for g in groups:
            if len(g) == 1:
                made.append(g[0])
                continue
            expected = self._total(g, schema)
            name, size = files.get(many.index(g), (None, 0))
            new = {"path": f"{place}/{name}", "bytes": size, "sums": written.get(f"{place}/{name}", (0, 0, 0))}
            if self._total([new], schema)["checksum"] != expected["checksum"] or new["sums"][0] != expected["rows"]:
                raise StoreError(f"compaction changed the records of {place}")
            if name:
                made.append(new)
        return self._total(made, schema)
