"""Near-duplicate lines by what two lines have unchanged (operator 2), in DataFrame functions only.

Two lines are near when the shorter has 16 characters or more and one edit of a
character makes them equal, or when it has 32 or more and two edits do. Lines meet
under hashed keys, the edit distance is verified, and the earliest line is kept.

* Of two lines within two edits the first third, the last third or the middle is found
  unchanged in both, up to one place aside. Lines that share none by classes of length drop
  out first; the text of the others alone is fetched, and they meet by thirds at their exact lengths.
* Where few lines are under a key, each is held against the others (``FEW`` comparisons a line at most).
* Lines under a key of many meet again under all but two of six parts, in the same way.
* Lines that many still share a key with meet by deletion variants.

Two near lines become equal when each loses a few characters: a changed one is lost on both
sides, a further one on one side. All such variants are emitted as hashed keys, but only where
a line can have a partner, which loses nothing:

* A line is cut into four parts by the length of the shorter line. Both edits lie in one
  part, or one in each of two. Lines meet under hashes of all the rest.
* Where one part is left open, it is cut into four again, until it has few characters;
  then all variants of it are made.
* Where two parts are left open, there is one edit in each: variants of the first are made,
  and variants of the second only for those of the first that another line has as well.

What an edit is and where it lies goes into the key, so that all lines that meet under a key
are near one another and each is only held against the earliest: groups are never paired.
Lines of less than 32 characters take the same way for one edit, with sixteen parts.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, stored

#: Code points of a line from which one edit, and from which two, count as the same line; shorter ones must be equal.
LEAST_CHARS, TWO_EDITS_FROM = 16, 32
#: Parts of a line in one of which a single edit lies; parts of an open stretch for two edits, and its greatest length that isn't cut again.
SEGMENTS, PARTS, LEAF = 16, 4, 24
#: Lines under a key up to which each is held against the others; parts of a line of which two are left open for more.
FEW, FRAMES = 16, 6
#: Bits of the filter by a shared key, and the least and most of them: with more keys more lines pass it, none is lost.
BITS, LEAST_BITS, MOST_BITS = 128, 1 << 20, 1 << 29

#: What two edits in two open parts are: the change of place after the first and after both, and
#: what the shorter line (or the one whose second part is longer) and the other lose on the left
#: and on the right: ``P`` a character at a named place, ``D`` any one character, ``W`` nothing.
KINDS = {"changed, changed": (0, 0, "PP", "PP"), "more, changed": (1, 1, "WP", "DP"), "changed, more": (0, 1, "PW", "PD"), "more, more": (1, 2, "WW", "DD"), "more, less": (1, 0, "WD", "DW")}


def third_keys(lines: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``lines`` of ``least`` characters with ``key``: hashes of the thirds by classes of length; lines within two edits share one.

    Classes are quarters of powers of two, and a line is also in those of lines one or two shorter.
    With ``base`` the least length of a class, an edit in the first and one in the last third leave
    the middle whole, at most one place aside.
    """
    own, line, c, third, base = lines.columns, F.col("line"), F.col("class"), F.col("third"), F.col("base")
    # Lengths and classes are columns of their own, so that they are found once a line.
    n = lines.select("*", F.length(line).alias("n")).where(F.col("n") >= least)
    of = lambda m: F.floor(4 * F.log2(F.greatest(m, F.lit(least)) / F.lit(float(least)))).cast("int")
    n = n.select("*", *[of(F.col("n") - e).alias(f"c{e}") for e in (0, 1, 2)])
    others = [F.when(F.col("c1") < F.col("c0"), F.col("c1")), F.when(F.col("c2") < F.col("c1"), F.col("c2"))]
    n = n.select(*own, F.explode(F.array("c0", *others)).alias("class")).where(c.isNotNull())
    n = n.select("*", F.floor(F.lit(float(least)) * F.pow(F.lit(2.0), c / 4)).cast("int").alias("base"))
    n = n.select("*", F.floor(base / 3).cast("int").alias("third"))
    middle = lambda s: F.substr(line, third + 1 + s, base - 2 * third - 1)
    hashed = [F.xxhash64(F.lit("first"), c, F.substr(line, F.lit(1), third)), F.xxhash64(F.lit("last"), c, F.right(line, third)), *[F.xxhash64(F.lit("middle"), c, middle(s)) for s in (0, 1)]]
    return n.select(*own, F.explode(F.array(*hashed)).alias("key"))


def cut(s: Column, lo: Column, hi: Column) -> Column:
    """The characters from ``lo`` up to ``hi``, from 0."""
    return F.substr(s, lo + 1, hi - lo)


def without(s: Column, *places: Column) -> Column:
    """``s`` without the characters at ascending places, from 0."""
    ends = [*places, F.length(s)]
    starts = [F.lit(0), *[p + 1 for p in places]]
    return F.concat(*[cut(s, a, b) for a, b in zip(starts, ends)])


def _open(lines: DataFrame, least: int) -> DataFrame:
    """Every line as one of its length and as one with one or two characters more: id, first, ctx, e, c."""
    rows = lines.select("id", "first", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("e"), F.col("line").alias("c"))
    return rows.where(F.length("c") - F.col("e") >= least).withColumn("ctx", F.xxhash64(F.lit("frame"), F.length("c") - F.col("e")))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From open stretches: those with one part open, and those with two, where another line agrees on the rest."""
    c, e = F.col("c"), F.col("e")
    f = F.length("c") - e
    bound = lambda i: F.floor(f * i / PARTS).cast("int")
    place = lambda i, j: i * PARTS + j

    # Each stretch is hashed once; a key is put together from them. Of two open parts, the hashes
    # of what they hold go along: where an edit changes a character in place, lines must differ there.
    pieces = [
        F.array(*[F.xxhash64(cut(c, F.lit(0), bound(i))) for i in range(PARTS)]).alias("before"),
        F.array(*[F.xxhash64(cut(c, bound(j + 1) + e, F.length(c))) for j in range(PARTS)]).alias("after"),
        F.array(*[F.xxhash64(cut(c, bound(i) + s, bound(i + 1) + t)) for i in range(PARTS) for s, t in ((0, 0), (0, 1), (1, 1))]).alias("part"),
        F.array(*[F.xxhash64(cut(c, bound(i + 1) + s, bound(j) + s)) if i + 1 < j else F.lit(0).cast("long") for s in (0, 1) for i in range(PARTS) for j in range(PARTS)]).alias("middle"),
    ]
    at = lambda name, k: F.element_at(name, (k + 1).cast("int"))
    # What can be open, as literals: parts, changes of place, kind. One part only: both edits in it.
    spots = [(i, i, 0, more, "one", 0) for i in range(PARTS) for more in (0, 1, 2)]
    spots += [(i, j, v[0], v[1], k, 1) for k, v in KINDS.items() for i, j in combinations(range(PARTS), 2)]
    spots = F.from_json(F.lit(json.dumps([dict(zip("ijsmkt", x)) for x in spots])), "array<struct<i:int,j:int,s:int,m:int,k:string,t:int>>")

    def key(o: Column) -> Column:
        i, j, s = o["i"], o["j"], o["s"]
        hashed = F.xxhash64("ctx", i, j, at("before", i), at("middle", s * PARTS * PARTS + place(i, j)), at("after", j))
        # Only read where nothing has moved yet: the left part of "changed, ..", the right one of ".., changed".
        left, right = at("part", 3 * i), at("part", 3 * j + 2 * s)
        return F.struct(i.alias("i"), j.alias("j"), s.alias("s"), o["k"].alias("kind"), hashed.alias("key"), left.alias("hl"), right.alias("hr"))

    hashes = rows.select("id", "ctx", "e", *pieces)
    met = hashes.select("id", "ctx", "e", F.explode(F.transform(F.filter(spots, lambda o: o["m"] == e), key)).alias("o")).select("id", "ctx", "e", "o.*")
    own = lambda kind: F.col("kind") == kind
    still = own("changed, changed")
    apart = lambda name, kinds: F.min(F.when(F.col("kind").isin(kinds), F.col(name))) != F.max(F.when(F.col("kind").isin(kinds), F.col(name)))
    both = lambda kind: F.bool_or(own(kind))
    live = {
        "changed, changed": apart("hl", ["changed, changed"]) & apart("hr", ["changed, changed"]),
        "more, changed": both("more, changed") & apart("hr", ["changed, changed", "more, changed"]),
        "changed, more": both("changed, more") & apart("hl", ["changed, changed", "changed, more"]),
        "more, more": both("more, more"),
        "more, less": both("more, less"),
    }
    kinds = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in live.items()]))
    # A line can meet itself where the middle is empty, so there must be two lines under a key.
    shared = met.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("q"), F.bool_or((e == 0) & (own("one") | still)).alias("based"), both("one").alias("single"), kinds.alias("kinds"))
    shared = shared.where("p <> q AND based AND (single OR size(kinds) > 0)").select("key", "kinds")
    back = met.drop("hl", "hr").join(shared, "key").where(F.col("kind").isin("one", "changed, changed") | F.array_contains("kinds", F.col("kind")))
    back = back.join(rows, ["id", "ctx", "e"])
    lo, mid, hi = bound(F.col("i")), bound(F.col("i") + 1), bound(F.col("j"))
    one = F.col("kind") == "one"
    # The open parts alone are kept: of one, the whole of it stands on the left.
    left = F.when(one, cut(c, lo, mid + e)).otherwise(cut(c, lo, mid + F.col("s")))
    right = F.when(~one, cut(c, hi + F.col("s"), bound(F.col("j") + 1) + e))
    back = stored(back.select("id", "first", "key", "e", "kind", "kinds", left.alias("l"), right.alias("r")), "open-parts")
    return back.where("kind = 'one'").select("id", "first", F.col("key").alias("ctx"), "e", F.col("l").alias("c")), back.where("kind <> 'one'").select("id", "first", "key", "kind", "kinds", "l", "r")


def _lost(s: Column, mode: Column) -> Column:
    """What is left of ``s`` by mode: structs of a place (-1: any) and a hash."""
    at = lambda place, text: F.struct(place.cast("int").alias("x"), F.xxhash64(text).alias("h"))
    each = F.sequence(F.lit(0), F.length(s) - 1)
    named = F.transform(each, lambda x: at(x, without(s, x)))
    some = F.array_distinct(F.transform(each, lambda x: at(F.lit(-1), without(s, x))))
    return F.when(mode == "W", F.array(at(F.lit(-1), s))).when(F.length(s) == 0, F.array().cast("array<struct<x:int,h:bigint>>")).when(mode == "P", named).otherwise(some)


def _two_parts(rows: DataFrame) -> DataFrame:
    """Variants with an edit in each of two open parts: id, first, side, and the columns of their key."""
    sides = [F.struct(F.lit(k).alias("t"), F.lit(0).alias("side"), F.lit(v[2][0]).alias("ml"), F.lit(v[2][1]).alias("mr")) for k, v in KINDS.items()]
    other = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(1).alias("side"), F.lit(v[3][0]).alias("ml"), F.lit(v[3][1]).alias("mr")) for k, v in KINDS.items()])
    live = F.filter(F.array(*sides), lambda r: F.array_contains("kinds", r["t"]))
    roles = F.when(F.col("kind") == "changed, changed", live).otherwise(F.filter(other, lambda r: r["t"] == F.col("kind")))
    rows = rows.select("id", "first", "key", "l", "r", F.explode(roles).alias("o")).select("id", "first", "key", "l", "r", "o.*")
    # A variant and kind must have both sides; where a place is named on the left, lines must differ there.
    apart = lambda by: [F.min("id").alias("p"), F.max("id").alias("q"), F.min("side").alias("a"), F.max("side").alias("b"), F.min(by).alias("la"), F.max(by).alias("lb")]
    able = "p <> q AND (t = 'changed, changed' OR a < b) AND (t NOT LIKE 'changed,%' OR la <> lb)"
    rows = rows.withColumn("hl", F.xxhash64("l"))
    left = stored(rows.select("id", "first", "key", "t", "side", "mr", "r", "hl", F.explode(_lost(F.col("l"), F.col("ml"))).alias("v")).select("id", "first", "key", "t", "side", "mr", "r", "hl", "v.x", "v.h"), "left-variants")
    left = left.join(left.groupBy("key", "t", "x", "h").agg(*apart("hl")).where(able).select("key", "t", "x", "h"), ["key", "t", "x", "h"], "left_semi")
    right = left.select("id", "first", "key", "t", "side", F.xxhash64("x", "h").alias("h"), F.explode(_lost(F.col("r"), F.col("mr"))).alias("w"))
    return right.select("id", "first", "key", "t", "side", "h", F.col("w.x").alias("y"), F.col("w.h").alias("g"))


def _leaves(rows: DataFrame) -> DataFrame:
    """All variants of a short open stretch, in the columns of ``_two_parts``."""
    c, n = F.col("c"), F.length("c")
    make = lambda t, side, x, y, text: F.struct(F.lit(t).alias("t"), F.lit(side).alias("side"), F.xxhash64(x).alias("h"), y.cast("int").alias("y"), F.xxhash64(text).alias("g"))
    none = F.lit(-1)
    ones = F.sequence(F.lit(0), n - 1)
    twos = lambda of: F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda u: F.flatten(F.transform(F.sequence(u + 1, n - 1), lambda v: F.array(*of(u, v, without(c, u, v)))))))
    same = F.concat(
        twos(lambda u, v, text: [make("changed, changed", 0, u, v, text)]),
        F.transform(ones, lambda u: make("one each", 0, none, none, without(c, u))),
        F.transform(ones, lambda u: make("one more", 0, u, none, without(c, u))),
        F.array(make("more, more", 0, none, none, c)),
    )
    one = twos(lambda u, v, text: [make("one more", 1, u, none, text), make("one more", 1, v - 1, none, text)])
    two = twos(lambda u, v, text: [make("more, more", 1, none, none, text)])
    variants = F.when(F.col("e") == 0, same).when(F.col("e") == 1, one).otherwise(two)
    return rows.select("id", "first", F.col("ctx").alias("key"), F.explode(F.array_distinct(variants)).alias("o")).select("id", "first", "key", "o.*")


def two_edits(lines: DataFrame, least: int) -> DataFrame:
    """Pairs (id, other) of a line and the earliest that one of its variants meets, for two edits."""
    found, rows = [], checkpointed(_open(lines, least))
    while not rows.isEmpty():
        f = F.length("c") - F.col("e")
        found.append(_leaves(rows.where(f <= LEAF)))
        inner, double = _parts(rows.where(f > LEAF))
        found.append(_two_parts(double))
        rows = checkpointed(inner)
    if not found:
        return lines.select("id", F.col("id").alias("other")).limit(0)
    key = ["key", "t", "h", "y", "g"]
    met = None
    for part in found:
        met = part if met is None else met.unionByName(part)
    met = stored(met, "line-variants")
    lead = lambda side: F.min(F.when(F.col("side") == side, F.struct("first", "id")))
    leads = met.groupBy(*key).agg(lead(0).alias("a"), lead(1).alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    alike = F.col("t").isin("changed, changed", "one each")
    chosen = F.when(alike | (F.col("side") == 1), F.col("a")).otherwise(F.col("b"))
    return met.join(leads, key).withColumn("lead", chosen).where("lead.id <> id AND lead.first < first").select("id", F.col("lead.id").alias("other")).distinct()


def outer_keys(line: Column) -> Column:
    """For a line of its length and as one with a character more: hashes of all but one part, by part."""
    n = F.length(line)

    def of(t: Column, more: int) -> Column:
        bound = lambda j: F.floor(t * j / SEGMENTS).cast("int")
        key = lambda j: F.xxhash64(F.lit("outer"), t, j, F.substr(line, F.lit(1), bound(j)), F.right(line, t - bound(j + 1)))
        return F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda j: F.struct(key(j).alias("key"), F.lit(more).alias("more"), bound(j).alias("lo"), (bound(j + 1) + more).alias("hi")))

    return F.concat(of(n, 0), of(n - 1, 1))


def one_edit(lines: DataFrame) -> DataFrame:
    """Pairs (id, other) of a line and the earliest that one of its variants meets, for one edit."""
    outer = checkpointed(lines.select("id", F.explode(outer_keys(F.col("line"))).alias("o")).select("id", "o.*"))
    met = outer.join(outer.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi").select("id", "more", "lo", "hi").distinct()
    spots = lines.join(met, "id").where("hi > lo")
    without = F.transform(F.sequence(F.col("lo") + 1, F.col("hi")), lambda i: F.struct(i.alias("i"), F.xxhash64(F.concat(F.substr("line", F.lit(1), i - 1), F.substr("line", i + 1))).alias("rest")))
    variants = checkpointed(spots.select("id", "first", "more", F.length("line").alias("n"), F.explode(without).alias("v")))
    # One character changed: both lines agree without it. All lines under such a key are one edit
    # apart, so each is only held against the earliest.
    # The length and the place stand beside the hash, so only variants that could be equal share a key.
    changed = variants.where("more = 0").select("n", "v.i", "v.rest", "id", "first").distinct()
    # One character more: the variant is the other line.
    longer = variants.where("more = 1").select((F.col("n") - 1).alias("n"), "v.rest", "id", "first")
    whole = lines.select(F.length("line").alias("n"), F.xxhash64("line").alias("rest"), "id", "first")

    leader = changed.groupBy("n", "i", "rest").agg(F.min(F.struct("first", "id")).alias("lead"), F.count("*").alias("many")).where("many > 1").drop("many")
    one = changed.join(leader, ["n", "i", "rest"]).where("lead.id <> id").select("id", F.col("lead.id").alias("other"))
    both = longer.distinct().join(whole.select("n", "rest", F.col("id").alias("w"), F.col("first").alias("wf")), ["n", "rest"])
    two = both.select(F.when(F.col("wf") < F.col("first"), F.col("id")).otherwise(F.col("w")).alias("id"), F.when(F.col("wf") < F.col("first"), F.col("w")).otherwise(F.col("id")).alias("other"))

    return one.union(two).distinct()


def exact_thirds(lines: DataFrame, least: int) -> DataFrame:
    """Lines under the thirds of the shorter of two, by its exact length: id, first, key, base (of its own length)."""
    c, e = F.col("c"), F.col("e")
    t = F.length(c) - e
    third = F.floor(t / 3).cast("int")
    hashed = [F.xxhash64(F.lit("first"), t, F.substr(c, F.lit(1), third)), F.xxhash64(F.lit("last"), t, F.right(c, third)), *[F.xxhash64(F.lit("middle"), t, F.substr(c, third + 1 + s, t - 2 * third - 1)) for s in (0, 1)]]
    return _open(lines, least).select("id", "first", (e == 0).alias("base"), F.explode(F.array_distinct(F.array(*hashed))).alias("key"))


def frames(lines: DataFrame, least: int) -> DataFrame:
    """Lines under all but two of their parts, cut by the length of the shorter of two, as ``exact_thirds`` gives them.

    What lies between the open parts is at its place or, in the other line, one further on.
    """
    c, e = F.col("c"), F.col("e")
    t = F.length(c) - e
    bound = lambda i: F.floor(t * i / FRAMES).cast("int")
    spots = [(i, j, s) for i, j in combinations(range(FRAMES), 2) for s in (0, 1) if s == 0 or i + 1 < j]
    pieces = [
        F.array(*[F.xxhash64(cut(c, F.lit(0), bound(i))) for i in range(FRAMES)]).alias("before"),
        F.array(*[F.xxhash64(cut(c, bound(j + 1) + e, F.length(c))) for j in range(FRAMES)]).alias("after"),
        F.array(*[F.xxhash64(cut(c, bound(i + 1) + s, bound(j) + s)) if i + 1 < j else F.lit(0).cast("long") for i, j, s in spots]).alias("middle"),
    ]
    spots = F.from_json(F.lit(json.dumps([{"i": i, "j": j, "s": s, "at": at, "next": i + 1 == j} for at, (i, j, s) in enumerate(spots)])), "array<struct<i:int,j:int,s:int,at:int,next:boolean>>")
    at = lambda name, k: F.element_at(name, k + 1)
    # With two characters more, what lies between open parts is one further on.
    able = F.filter(spots, lambda o: o["next"] | (e < 2) | (o["s"] == 1))
    keys = F.transform(able, lambda o: F.struct(((e == 0) & (o["s"] == 0)).alias("base"), F.xxhash64("ctx", o["i"], o["j"], at("before", o["i"]), at("middle", o["at"]), at("after", o["j"])).alias("key")))
    return _open(lines, least).select("id", "first", "ctx", "e", *pieces).select("id", "first", F.explode(keys).alias("o")).select("id", "first", "o.*")


def held_against(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of lines under keys: pairs (id, other) of a line and an earlier one for keys of few; the ids under keys of many.

    Of two lines one is under the key by its own length, so it is these that are counted.
    """
    rows = stored(rows, "line-rows")
    counts = [F.count_if("base").alias("n"), *[f(f"id.{h}").alias(f"{name}{h}") for h in ("h1", "h2") for name, f in (("p", F.min), ("q", F.max))]]
    shared = stored(rows.groupBy("key").agg(*counts).where("n > 0 AND (ph1 <> qh1 OR ph2 <> qh2)").select("key", "n"), "line-keys")
    own = rows.where("base").join(shared.where(F.col("n") <= FEW), "key").select("key", F.col("id").alias("id2"), F.col("first").alias("first2"))
    met = own.join(rows.select("key", "id", "first"), "key")
    later = F.col("first2") < F.col("first")
    pairs = met.where(later | (F.col("first") < F.col("first2"))).select(F.when(later, F.col("id")).otherwise(F.col("id2")).alias("id"), F.when(later, F.col("id2")).otherwise(F.col("id")).alias("other"))
    return stored(pairs.distinct(), "line-pairs"), rows.join(shared.where(F.col("n") > FEW), "key", "left_semi").select("id").distinct()


def candidates(lines: DataFrame, least_chars: int, two_edits_from: int | None) -> DataFrame:
    """Pairs (id, other) of a line and an earlier one, among which is each line's earliest near one."""
    found = []
    for keys in (exact_thirds, frames):
        pairs, many = held_against(keys(lines, least_chars))
        found.append(pairs)
        lines = stored(lines.join(many, "id", "left_semi"), "lines-of-many")
        if lines.isEmpty():
            break
    else:
        if two_edits_from is None:
            found.append(one_edit(lines))
        else:
            found += [one_edit(lines.where(F.length("line") <= two_edits_from)), two_edits(lines.where(F.length("line") >= two_edits_from), two_edits_from)]
    return reduce(DataFrame.union, found).distinct()


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines with a word, where they are, and a hash of 128 bits of each."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    at = F.struct(F.col("id").isNull().alias("no_id"), "id", "line_no")
    return lines.select(at.alias("at"), "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def with_partners(occ: DataFrame, least_chars: int) -> DataFrame:
    """Id, first place and text of the lines that share a third with another line, and of a few that don't.

    Shared thirds are few against all, so they go to every task as bits, and only what passes is shuffled.
    """
    keyed = third_keys(occ, least_chars)
    shared = stored(keyed.groupBy("key").agg(F.min("h1").alias("p"), F.max("h1").alias("q")).where("p <> q").select("key"), "shared-thirds")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * shared.count()).bit_length()))
    spot = F.pmod("key", F.lit(bits)) + 1
    bucket, place = F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).cast("int").alias("place")
    # Dealt out by bucket first, as each task would send all bitmaps otherwise.
    filters = shared.select(bucket, place).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("place") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    passed = keyed.select("*", bucket, place).join(F.broadcast(filters), "bucket").where(F.getbit(byte, F.col("place") % 8) == 1)
    # Copies meet inside each task first, so that a common line is sent once a task.
    lines = passed.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.min("line").alias("line"))
    return stored(lines.select(F.struct("h1", "h2").alias("id"), "first", "line"), "lines")


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, two_edits_from: int | None = TWO_EDITS_FROM) -> DataFrame:
    """One row per line with a word: id, line_no (from 0), kept, keep_id and keep_line_no.

    Lines are split at line feeds and compared as they are, over all documents. The order is by
    id, nulls last, then line; what a line points to is the earliest line near it, itself if there
    is none. Near: equal; or one edit apart (a character put in, left out or changed) and the
    shorter has ``least_chars``; or two and it has ``two_edits_from`` (null: never). The relation isn't
    transitive: a dropped line can still be another's earliest. Null and empty texts have no
    lines, an empty table has no rows; other columns of ``docs`` aren't read. Rows that repeat an id and
    text share their verdicts. A very long line costs what its length does, but for lines near it.
    """
    if not 3 <= least_chars <= (two_edits_from or least_chars) or (two_edits_from or LEAF) < LEAF:
        raise ValueError(f"least_chars must be 3 or more and two_edits_from no less than it and {LEAF}")
    occ = occurrences(docs, id_col, text_col)
    lines = with_partners(occ, least_chars)
    pairs = candidates(lines, least_chars, two_edits_from)
    pairs = pairs.join(lines.select("id", F.col("line").alias("a")), "id").join(lines.select(F.col("id").alias("other"), F.col("line").alias("b"), F.col("first").alias("of")), "other")
    most = F.when(F.least(F.length("a"), F.length("b")) >= F.lit(two_edits_from), 2).otherwise(1)
    near = pairs.withColumn("edits", F.levenshtein("a", "b", 2)).where((F.col("edits") >= 0) & (F.col("edits") <= most)).groupBy("id").agg(F.min("of").alias("near"))
    near = checkpointed(near.select("id.h1", "id.h2", "near"))

    distinct = occ.groupBy("h1", "h2").agg(F.min("at").alias("first"))
    target = distinct.join(near, ["h1", "h2"], "left").select("h1", "h2", F.least("first", F.coalesce("near", "first")).alias("keep"))
    # Stored, so that both sides of the join are plain exchanges and Spark can split a common line's rows.
    out = occ.select("h1", "h2", "at").join(stored(target, "line-targets"), ["h1", "h2"])
    return out.select(F.col("at.id").alias(id_col), F.col("at.line_no").cast("long").alias("line_no"), (F.col("at") == F.col("keep")).alias("kept"), F.col("keep.id").alias("keep_id"), F.col("keep.line_no").cast("long").alias("keep_line_no"))


def drop_lines(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines gone that the verdicts don't keep; blank lines and other columns stay."""
    gone = verdicts.where(~F.col("kept")).groupBy(F.col(id_col).alias("id of lines")).agg(F.collect_set("line_no").alias("lines gone"))
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("lines gone", i.cast("long"))), "\n")
    out = docs.join(gone, F.col(id_col).eqNullSafe(F.col("id of lines")), "left")
    return out.withColumn(text_col, F.when(F.col("lines gone").isNull(), F.col(text_col)).otherwise(left)).drop("id of lines", "lines gone")


_PLACE = "coalesce(list_position([a[i] <> b[i] for i in range(1, least(length(a), length(b)) + 1)], true), least(length(a), length(b)) + 1)"
#: Two strings without what they share at the start, after each of the edits that can be next.
_NEXT = "unnest([{'a': substr(a, p + 1), 'b': substr(b, p + 1)}, {'a': substr(a, p), 'b': substr(b, p + 1)}, {'a': substr(a, p + 1), 'b': substr(b, p)}]) AS s"

ORACLE_SQL = rf"""
WITH occ AS (
  SELECT doc_id, line_no - 1 AS line_no, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), d AS (
  SELECT row_number() OVER () AS id, line, length(line) AS n, first FROM (SELECT line, min({{'d': doc_id, 'l': line_no}}) AS first FROM occ GROUP BY line)
), f AS (
  SELECT *, n - e AS t, (n - e) // 3 AS k FROM (SELECT *, unnest([0, 1, 2]) AS e FROM d WHERE n >= {LEAST_CHARS}) WHERE n - e >= {LEAST_CHARS}
), keys AS (
  SELECT id, e, t, unnest([{{'j': 0, 's': left(line, k)}}, {{'j': 1, 's': right(line, k)}}, {{'j': 2, 's': substr(line, k + 1, t - 2 * k - 1)}}, {{'j': 2, 's': substr(line, k + 2, t - 2 * k - 1)}}]) AS key FROM f
), near AS (
  SELECT DISTINCT x.id AS i, y.id AS j FROM keys x JOIN keys y ON x.t = y.t AND x.key = y.key AND x.e = 0 AND x.id <> y.id
), c AS (
  SELECT i, j, a.line AS a, b.line AS b, a.n >= {TWO_EDITS_FROM} AS two FROM near JOIN d a ON a.id = i JOIN d b ON b.id = j
), e1 AS (
  SELECT i, j, two, s.a AS a, s.b AS b FROM (SELECT i, j, two, {_NEXT} FROM (SELECT *, {_PLACE} AS p FROM c))
), e2 AS (
  SELECT i, j, s.a AS a, s.b AS b FROM (SELECT i, j, {_NEXT} FROM (SELECT *, {_PLACE} AS p FROM e1 WHERE two))
), p AS (
  SELECT i, j FROM e1 WHERE a = b UNION SELECT i, j FROM e2 WHERE a = b
), k AS (
  SELECT line, min(first) AS keep FROM (SELECT line, first FROM d
    UNION ALL SELECT x.line, y.first FROM p JOIN d x ON x.id = i JOIN d y ON y.id = j
    UNION ALL SELECT y.line, x.first FROM p JOIN d x ON x.id = i JOIN d y ON y.id = j) GROUP BY line
)
SELECT doc_id, line_no, {{'d': doc_id, 'l': line_no}} = keep AS kept, keep.d AS keep_id, keep.l AS keep_line_no
FROM occ JOIN k USING (line)
"""
