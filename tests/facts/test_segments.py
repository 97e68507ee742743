"""Segments: bounds, compaction that carries over, damage of one file, and files that several generations name."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from factloom.plans.store import FactStore, StoreError


def rows(table):
    return sorted(map(str, table.collect()))


def segments(store, number, name="t"):
    return store.manifest(number)["tables"][name]["segments"]


def local(store, path):
    return f"{store.root}/{path}".removeprefix("file:")


def test_segments_are_bounded(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    draw = random.Random(1)
    table = spark.createDataFrame([(i, "".join(chr(draw.randrange(33, 1000)) for _ in range(300))) for i in range(400)], "id long, text string").coalesce(1)
    number = store.write({"t": table}, segment_bytes=60_000)
    sizes = [x["bytes"] for x in segments(store, number)]
    assert len(sizes) > 3 and max(sizes) <= 60_000 and rows(store.read("t", verify=True)) == rows(table)
    assert sum(x["sums"][0] for x in segments(store, number)) == 400
    with pytest.raises(StoreError, match="larger than a segment"):
        store.write({"t": table}, segment_bytes=300)
    assert store.history() == [number]


def test_compaction(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    data = {"scopes": spark.range(3).repartition(3), "t": spark.range(1000).withColumn("x", F.col("id") * 7).repartition(8), "one": spark.range(5).coalesce(1), "none": spark.range(0)}
    first = store.write(data)
    size = max(x["bytes"] for x in segments(store, first))
    assert segments(store, store.compact(batch_bytes=1)) == segments(store, first)  # nothing fits together: all is carried over
    second = store.compact(batch_bytes=3 * size)
    before, after = store.manifest(first)["tables"], store.manifest(second)["tables"]
    assert list(after) == ["t", "one", "none", "scopes"] and after["scopes"] == before["scopes"] and after["one"] == before["one"]
    assert 2 <= len(after["t"]["segments"]) <= 4 and all(x["bytes"] <= 3 * size for x in after["t"]["segments"])
    for name in data:
        assert rows(store.read(name, second, verify=True)) == rows(data[name])
        assert {k: v for k, v in before[name].items() if k != "segments"} == {k: v for k, v in after[name].items() if k != "segments"}
    # The first generation goes, but not the files that the last one still names.
    assert store.prune(1) == [2, first] and rows(store.read("one", second)) == rows(data["one"]) and store.verified(second)
    assert {os.path.basename(p) for p in glob.glob(f"{tmp_path}/gen={first}/*")} >= {"one", "scopes"}
    assert not glob.glob(f"{tmp_path}/gen={first}/t/*.parquet")


@pytest.mark.parametrize("harm", ["delete", "cut", "flip", "swap"])
def test_a_damaged_segment_is_set_aside_alone(spark, tmp_path, harm):
    store = FactStore(spark, str(tmp_path))
    first = store.write({"t": spark.range(100).repartition(3), "u": spark.range(9)})
    second = store.write({"t": spark.range(200).repartition(4), "u": spark.range(9)})
    victim = segments(store, second)[1]["path"]
    path = local(store, victim)
    data = open(path, "rb").read()
    for crc in glob.glob(os.path.dirname(path) + "/.*.crc"):
        os.remove(crc)
    if harm == "delete":
        os.remove(path)
    elif harm == "cut":
        open(path, "wb").write(data[: len(data) // 2])
    elif harm == "flip":
        open(path, "wb").write(data[:10] + bytes([data[10] ^ 255, data[11] ^ 255]) + data[12:])
    else:  # a sound file with other rows
        other = segments(store, second)[0]["path"]
        open(path, "wb").write(open(local(store, other), "rb").read())
    assert store.damaged(second) == [victim] and not store.verified(second)
    assert store.recover() == first and store.history() == [first]
    aside = [os.path.basename(p) for p in glob.glob(f"{tmp_path}/quarantine={second}/*.parquet")]
    assert aside == ([] if harm == "delete" else [victim.replace("/", "__")])
    assert f"gen={second}" in store.reclaim() and not glob.glob(f"{tmp_path}/gen={second}")
    assert rows(store.read("t", verify=True)) == rows(spark.range(100))


def test_a_shared_segment_breaks_every_generation_that_names_it(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    zero = store.write({"t": spark.range(5)})
    first = store.write({"t": spark.range(50).repartition(3), "u": spark.range(9).coalesce(1)})
    second = store.compact()
    assert segments(store, second, "u") == segments(store, first, "u")
    os.remove(local(store, segments(store, first, "u")[0]["path"]))
    assert store.recover() == zero
