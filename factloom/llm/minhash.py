"""MinHash near-duplicates by a multi-index Hamming join (operator 8).

A document's signature has SYMBOLS symbols of 32 bits, each the low bits of a
minimum of hashed shingles. Two sets of similarity t differ in a symbol with
probability 1 - t, so the number of differing symbols has a binomial bound r.
The signature is split into r // 2 + 1 chunks: of two signatures at distance r
or less, some chunk differs in one symbol at most. Each chunk is therefore
emitted once for every symbol that may be in error, without that symbol. All
pairs within the distance meet under a key, and are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import binary_parts, checkpointed, make_room, mix64, release, small_batches, stored
from factloom.llm.graph import components

#: Symbols of a signature, and the chance that a pair at the very threshold is further apart than the bound.
SYMBOLS, MISS = 48, 1e-6
#: Sets, and shingles in them, that are held at once on either side when strays are compared with members.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
MULTIPLIERS = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def distance_bound(percent: int, symbols: int = SYMBOLS, miss: float = MISS) -> int:
    """The least r with P(more than r of the symbols differ) < miss at similarity percent / 100."""
    p, tail = 1 - percent / 100, 0.0
    for r in range(symbols, -1, -1):
        tail += comb(symbols, r) * p**r * (1 - p) ** (symbols - r)
        if tail >= miss:
            return r
    return 0


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; bytes.lower() changes A-Z alone."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    code = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    out = np.full(len(parts) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + code[k : len(parts) - n + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray, symbols: int = SYMBOLS) -> bytes:
    low = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, i : i + 4096] * MULTIPLIERS[:symbols, None]).min(1))
    return mix64(low).astype("<u4").tobytes()


def set_digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, a digest of the whole set, and the signature (null for empty sets)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        make_room("minhash")
        for batch in batches:
            data, at = binary_parts(batch.column(1))
            n, digests, signatures = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                s = shingle_set(bytes(data[a:b]), words)
                n.append(len(s))
                digests.append(set_digest(s))
                signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["id", "n_shingles", "digest", "signature"])
            release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_shingles bigint, digest binary, signature binary")


def key_columns(bound: int, symbols: int = SYMBOLS) -> list:
    """The hashed keys of a signature: chunk by chunk, without one symbol each."""
    chunks = bound // 2 + 1
    edges = [symbols * i // chunks for i in range(chunks + 1)]
    keys = []
    for a, b in zip(edges, edges[1:]):
        for skip in range(a, b):
            parts = [F.substring("signature", 4 * i + 1, 4 * (j - i)) for i, j in ((a, skip), (skip + 1, b)) if j > i]
            keys.append(F.xxhash64(F.lit(skip), *parts))
    return keys


def near(pairs: DataFrame, bound: int) -> DataFrame:
    """The pairs (a, b) of rows (a, b, sa, sb) whose signatures sa and sb are within the bound."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(batch.num_rows, -1) for k in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= bound))

    return pairs.select("a", "b", "sa", "sb").dropDuplicates(["a", "b"]).mapInArrow(run, pairs.select("a", "b").schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("xa"), batch.column("xb")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
    return full.select("a", "b", "xa", "xb").mapInArrow(run, pairs.select("a", "b").schema)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """The whole shingle sets of the nodes in ``wanted`` (digest, id, node), as (id: the node, shingles)."""

    def run(batches):
        make_room("minhash")
        for batch in batches:
            data, at = binary_parts(batch.column("text"))
            sets = [shingle_set(bytes(data[a:b]), words) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            # An id may stand beside other texts too.
            own = pa.array([set_digest(x) == d for x, d in zip(sets, batch.column("digest").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["id", "shingles"]).filter(own)
            release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(wanted, "id").select("node", "digest", "text")
    return rows.mapInArrow(run, "id bigint, shingles array<bigint>").dropDuplicates(["id"])


def own_shingles(sets: DataFrame) -> DataFrame:
    """For each set: its size, and how many of its shingles no other of the sets has."""
    each = sets.select("id", F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    own = alone.groupBy("id").agg(F.count("*").alias("own"))
    return sets.select("id", F.size("shingles").cast("long").alias("size")).join(own, "id", "left").select("id", "size", F.coalesce("own", F.lit(0)).alias("own"))


def may_link(a_size, a_own, b_size, b_own, percent: int):
    """Whether two sets can have the similarity, by their sizes and their shingles that no other has.

    These are in the union and not in the intersection.
    """
    a, b = a_size - a_own, b_size - b_own
    return 100 * F.least(a, b) >= percent * (F.greatest(a, b) + a_own + b_own)


def strays_against_members(rows: DataFrame, sets: DataFrame, bound: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) that join nodes (main, node, c, size, signature) of different components c under one main.

    Strays, the nodes outside the main component, are queries against all nodes of their main, in
    blocks of both, bounded by sets and by shingles. What is compared never leaves the task: of its links it gives those that join
    what wasn't joined, so at most as many as it has strays.
    """
    stray = F.col("c") != F.col("main")
    blocks = lambda of: F.greatest(F.lit(1), F.ceil(F.count_if(of) / block), F.ceil(F.sum(F.when(of, F.col("size"))) / BLOCK_SHINGLES))
    counts = rows.groupBy("main").agg(blocks(F.lit(True)).alias("bs"), blocks(stray).alias("qs"))
    full = rows.join(sets.withColumnRenamed("id", "node"), "node").join(counts, "main")
    draw = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["main", "node", "c", "signature", "shingles"]
    members = full.select(*fields, draw("bs").alias("b"), every("qs").alias("q"), F.lit(False).alias("query"))
    queries = full.where(stray).select(*fields, every("bs").alias("b"), draw("qs").alias("q"), F.lit(True).alias("query"))
    kind = rows.schema["node"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        node, comp = table.column("node").to_pylist(), table.column("c").to_pylist()
        query = table.column("query").to_numpy()
        sign = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(len(node), -1)
        lists = table.column("shingles").combine_chunks()
        _, token = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        size = np.diff(at)
        parent: dict = {c: c for c in comp}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        there = np.flatnonzero(~query)
        flag = np.zeros(int(token.max()) + 1 if len(token) else 1, bool)
        a, b = [], []
        for i in np.flatnonzero(query).tolist():
            able = there[(100 * np.minimum(size[there], size[i]) >= percent * np.maximum(size[there], size[i])) & ((sign[there] != sign[i]).sum(1) <= bound)]
            own = token[at[i] : at[i + 1]]
            flag[own] = True
            for j in able.tolist():
                x, y = find(comp[i]), find(comp[j])
                if x == y:
                    continue
                shared = int(np.count_nonzero(flag[token[at[j] : at[j + 1]]]))
                if 100 * shared >= percent * (int(size[i] + size[j]) - shared):
                    parent[x] = y
                    a.append(node[i]), b.append(node[j])
            flag[own] = False
        release()
        kinds = table.schema.field("node").type
        return pa.table([pa.array(a, kinds), pa.array(b, kinds)], ["a", "b"])

    return members.unionByName(queries).groupBy("main", "b", "q").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer words than
    a shingle has one shingle. Null, empty and blank texts have none and are linked with nothing;
    long texts are read whole; an empty table gives an empty result, and columns of any name may
    stand beside id and text. Texts with one set are one node, so copies are never paired. Within a
    key, all are compared with one hub first, but for those that their sizes and their own shingles
    rule out; members that stay in other components than most of their key are then compared with
    all of it, in blocks. A component is named by its smallest id; rows that repeat an id are nodes
    by their own texts; rows without id are kept and linked with nothing. No pair, group or table is
    collected on the driver.
    """
    bound = distance_bound(percent)
    with small_batches(docs.sparkSession):
        table = stored(sketches(docs, words, id_col, text_col), "sketches")
    members = table.where("id IS NOT NULL AND digest IS NOT NULL")
    # A number for each distinct set; it is fixed because the table is stored.
    distinct = members.groupBy("digest").agg(F.min("id").alias("id"), F.any_value("signature").alias("signature"))
    nodes = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", F.explode(F.array(*key_columns(bound))).alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub < other").select("key", "hub")
    shared = stored(keyed.join(hubs, "key"), "shared-keys")
    wanted = nodes.select("digest", "id", "node").join(shared.select("node").distinct(), "node", "left_semi")
    with small_batches(docs.sparkSession):
        sets = stored(full_sets(docs, wanted, words, id_col, text_col), "sets")
    facts = own_shingles(sets).withColumnRenamed("id", "node").join(nodes.select("node", "signature"), "node")

    # A member that can't have the similarity with any set as large as the smallest of its key drops out.
    rows = shared.select("key", "node").join(facts, "node")
    common = F.col("size") - F.col("own")
    rows = rows.join(rows.groupBy("key").agg(F.min("size").alias("least")), "key")
    rows = stored(rows.where(100 * common >= percent * (F.col("size") + F.greatest(F.col("least") - common, F.lit(0)))).drop("least"), "rows")
    # The hub of a key is the member with the fewest shingles of its own.
    hub = rows.groupBy("key").agg(F.min(F.struct("own", "node", "size", "signature")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    met = rows.join(hub, "key").where("node <> hub.node")
    able = may_link(F.col("size"), F.col("own"), F.col("hub.size"), F.col("hub.own"), percent)
    pairs = met.where(able).select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("signature").alias("sa"), F.col("hub.signature").alias("sb"))
    with small_batches(docs.sparkSession):
        links = checkpointed(confirmed(near(pairs, bound), sets, percent))
    labels = components(links)

    # Members of a key that are in other components than most of it may still have links.
    now = met.drop("hub").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    sizes = now.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("most.c").alias("main"))
    rest = now.join(main, "key").groupBy("main", "node").agg(F.min("c").alias("c"), F.min("size").alias("size"), F.any_value("signature").alias("signature"))
    rest = checkpointed(rest)
    if not rest.isEmpty():
        more = checkpointed(strays_against_members(rest, sets, bound, percent, block))
        labels = components(links.union(more))

    named = nodes.select("digest", "id", "node").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    least = named.groupBy("c").agg(F.min("id").alias("component"))
    # Stored, so that both sides of the join are plain exchanges and Spark can split a common text's rows.
    verdicts = stored(named.join(least, "c").select("digest", "component"), "components")
    out = table.join(verdicts, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id")))


#: Exact pairs by a join on shared shingles, for small tables: it has a row for every pair that shares one.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], chr(10)) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
