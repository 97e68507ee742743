"""Computed results that remember what they were computed from.

A compute function is given keys, and the results that are valid now; it returns
results, and for each key the inputs and other keys it read. These are stored
beside the results with the fingerprints they had. When inputs change, the
stored dependencies are read backwards: what read a changed input is computed
again, what read a recomputed key only if that key's value changed, and
everything else is kept. Keys go through this in rounds, as many as the
dependencies are deep, each for all keys at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.store import FactStore
from factloom.storage import fixed

#: Keys (key), valid results (key, value) -> results (key, value), what was read (key, input).
Compute = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


class CycleError(Exception):
    pass


def fingerprinted(results: DataFrame) -> DataFrame:
    """Results with ``fingerprint``: which values count as the same, null among them."""
    return results.select("key", "value", F.sha2(F.coalesce(F.concat(F.lit("="), F.col("value")), F.lit("")), 256).alias("fingerprint"))


class Memo:
    """Results of one compute function in a fact store; each update publishes a generation."""

    def __init__(self, store: FactStore, compute: Compute):
        self.store, self.compute, self.spark = store, compute, store.spark

    def results(self) -> DataFrame:
        """The stored results: key, value, fingerprint, and how the last update came by them (outcome)."""
        return self._read("results", "key string, value string, fingerprint string, outcome string")

    def dependencies(self) -> DataFrame:
        """What each result was computed from: key, input, fingerprint."""
        return self._read("dependencies", "key string, input string, fingerprint string")

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if self.store.current() is None else self.store.read(table)

    def update(self, keys: DataFrame, inputs: DataFrame) -> int:
        """Bring the results of ``keys`` up to date with ``inputs`` (input, fingerprint); the new generation's number.

        Outcomes: ``computed`` (again or for the first time) and ``reused``. A key that reads a
        result which isn't valid yet returns no result and is tried again once it is. Keys that wait
        for one another are an error, and nothing is published.
        """
        keys, inputs = keys.select("key").distinct(), fixed(inputs.select("input", "fingerprint"))
        old = self.results().join(keys, "key", "left_semi").select("key", "value", "fingerprint")
        read = self.dependencies().join(keys, "key", "left_semi")
        # A dependency on a key is looked up among results, any other among inputs.
        of_keys = fixed(read.join(self.results().select(F.col("key").alias("input")), "input", "left_semi"))
        of_inputs = read.join(of_keys.select("input").distinct(), "input", "left_anti")
        now = inputs.select("input", F.col("fingerprint").alias("now"))
        touched = of_inputs.join(now, "input", "left").where(~F.col("now").eqNullSafe(F.col("fingerprint"))).select("key")
        gone = of_keys.join(keys.select(F.col("key").alias("input")), "input", "left_anti").select("key")
        new = keys.join(old, "key", "left_anti")
        dirty = fixed(touched.union(gone).union(new).distinct())
        unsure = self._dependents(dirty, of_keys)
        valid = fixed(fingerprinted(old).join(dirty.union(unsure), "key", "left_anti").withColumn("outcome", F.lit("reused")))
        reads = fixed(read.join(valid, "key", "left_semi"))
        while not (dirty.isEmpty() and unsure.isEmpty()):
            open_ = dirty.union(unsure).select(F.col("key").alias("input"))
            # What waits for an open key isn't ready; new keys have no dependencies yet and are tried.
            waiting = of_keys.join(open_, "input", "left_semi").select("key").distinct()
            ready = dirty.join(waiting, "key", "left_anti")
            results, found = self.compute(ready, valid.select("key", "value"))
            done = fixed(fingerprinted(results.join(ready, "key", "left_semi")).withColumn("outcome", F.lit("computed")))
            found = fixed(found.join(ready, "key", "left_semi").select("key", "input").distinct())
            settled = fixed(unsure.join(waiting, "key", "left_anti"))
            current = valid.unionByName(done)
            moved = of_keys.join(settled, "key", "left_semi").join(current.select(F.col("key").alias("input"), F.col("fingerprint").alias("now")), "input", "left").where(~F.col("now").eqNullSafe(F.col("fingerprint"))).select("key").distinct()
            kept = fingerprinted(old.join(settled, "key", "left_semi").join(moved, "key", "left_anti")).withColumn("outcome", F.lit("reused"))
            prints = current.select(F.col("key").alias("input"), F.col("fingerprint").alias("of_key")).join(inputs, "input", "full_outer")
            own = found.join(done.select("key"), "key", "left_semi").join(prints, "input", "left").select("key", "input", F.coalesce("of_key", "fingerprint").alias("fingerprint"))
            reads = reads.unionByName(own).unionByName(read.join(kept.select("key"), "key", "left_semi"))
            next_dirty = fixed(dirty.join(done.select("key"), "key", "left_anti").union(moved))
            # From now on an unfinished key waits for what it was seen to read.
            again = found.join(done.select("key"), "key", "left_anti").join(keys.select(F.col("key").alias("input")), "input", "left_semi").select("key", "input", F.lit(None).cast("string").alias("fingerprint"))
            of_keys = fixed(of_keys.join(again.select("key").distinct(), "key", "left_anti").select("key", "input", "fingerprint").unionByName(again))
            unsure, valid = fixed(unsure.join(settled.select("key"), "key", "left_anti")), fixed(current.unionByName(kept))
            dirty = next_dirty
            if done.isEmpty() and settled.isEmpty():
                some = [r.key for r in dirty.union(unsure).orderBy("key").limit(3).collect()]
                raise CycleError(f"keys wait for one another or for keys that aren't there: {some}")
        number = self.store.write({"results": valid, "dependencies": reads.select("key", "input", "fingerprint")})
        self.store.prune()
        return number

    def _dependents(self, changed: DataFrame, of_keys: DataFrame) -> DataFrame:
        """All keys that read a changed key, directly or not, and aren't changed themselves."""
        found, edge = changed.limit(0), changed
        while True:
            edge = fixed(of_keys.join(edge.select(F.col("key").alias("input")), "input", "left_semi").select("key").distinct().join(changed, "key", "left_anti").join(found, "key", "left_anti"))
            if edge.isEmpty():
                return fixed(found)
            found = found.union(edge)
