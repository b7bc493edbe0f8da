"""Sealing, packing, bounds and reads on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runstore.functions.bounds import Bound, overlaps
from runstore.operators import layout, mutations, read, runs
from runstore.schema import MUTATION

IN, EX, FREE = Bound.included, Bound.excluded, Bound.unbounded()


def log(spark, *ops):
    """(key, value) puts; a value of None is a delete."""
    rows = [(i, "delete" if v is None else "put", k.encode(), (v or "").encode()) for i, (k, v) in enumerate(ops)]
    return spark.createDataFrame(rows, MUTATION)


def pairs(df):
    return [(bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in df.collect()]


def test_get_put_delete(spark):
    ops = log(spark, ("hello", "world"), ("a", "1"), ("hello", None), ("b", ""))
    assert pairs(read.get(ops, "a")) == [("a", "1")]
    assert pairs(read.get(ops, "hello")) == pairs(read.get(ops, "b")) == pairs(read.get(ops, "none")) == []


def test_checked_deletes(spark):
    ops = log(spark, ("x", None), ("x", "1"), ("x", None), ("x", None), ("x", ""), ("x", None))
    judged = mutations.judged(ops).orderBy("seq").collect()
    assert [r["accepted"] for r in judged] == [False, True, True, False, True, False]


@pytest.mark.parametrize("ops, limit, expected", [
    ((("hello", "world"), ("another", "entry")), 9, [0, 1]),
    ((("a", "12"), ("b", "12"), ("c", "12"), ("d", "12345678"), ("e", "")), 6, [0, 0, 1, 2, 3]),
    ((("a", "1"), ("a", "2"), ("a", "3")), 4, [0, 0, 1]),
])
def test_seal(spark, ops, limit, expected):
    assert [r["run_id"] for r in runs.seal(log(spark, *ops), limit).orderBy("seq").collect()] == expected


def test_seal_in_pieces_equals_one_by_one():
    rng = random.Random(9)
    for _ in range(300):
        sizes, limit = [rng.choice([0, 1, 2, 3, 9]) for _ in range(rng.randint(0, 30))], rng.randint(1, 12)
        expected, held, ordinal = [], 0, 0
        for size in sizes:
            if held > 0 and held + size > limit:
                held, ordinal = 0, ordinal + 1
            held += size
            expected.append(ordinal)
        got, held, ordinal, cut = [], 0, 0, rng.randint(0, len(sizes))
        for part in (sizes[:cut], sizes[cut:]):
            out, held, ordinal = runs._ordinals(np.array(part, dtype=np.int64), limit, held, ordinal)
            got += out.tolist()
        assert got == expected


def one_by_one(sizes, limit):
    out, held, ordinal = [], 0, 0
    for size in sizes:
        if held > 0 and held + size > limit:
            held, ordinal = 0, ordinal + 1
        held += size
        out.append(ordinal)
    return out, held, ordinal


def test_courses_of_slices_equal_one_by_one():
    rng = random.Random(12)
    for _ in range(400):
        sizes, limit = [rng.choice([0, 0, 1, 2, 3, 9, 30]) for _ in range(rng.randint(3, 60))], rng.randint(1, 14)
        edges = [0, *sorted(rng.sample(range(1, len(sizes)), rng.randint(1, min(4, len(sizes) - 1)))), len(sizes)]
        held, ordinal = 0, 0
        for a, b in zip(edges, edges[1:]):
            held, ordinal = runs._left(runs._course(np.array(sizes[a:b], dtype=np.int64), limit), limit, held, ordinal)
            assert (held, ordinal) == one_by_one(sizes[:b], limit)[1:]


@pytest.mark.parametrize("shards", [1, 3])
def test_sealing_in_slices_leaves_no_trace_and_no_task_with_all_rows(spark, shards):
    ops = spark.range(6000).selectExpr("id * 7 as seq", "'put' as op", "cast(concat('k', id % 97) as binary) as key", "cast(repeat('v', cast(pmod(hash(id), 9) as int)) as binary) as value").repartition(5)
    whole, cut = runs.seal(ops, 100, shards, []), runs.seal(ops, 100, shards, [700, 6_999, 7_000, 30_000])
    show = lambda df: [tuple(r) for r in df.select("seq", "run_id", "op", "key", "value").orderBy("seq").collect()]
    assert show(whole) == show(cut) and whole.count() == 6000
    if shards == 1:
        rows = [(len(r["key"]) + len(r["value"])) for r in ops.orderBy("seq").collect()]
        assert [r["run_id"] for r in cut.orderBy("seq").collect()] == one_by_one(rows, 100)[0]
    most = cut.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 3286  # the longest slice


def test_cuts_grow_with_the_log(spark, monkeypatch):
    ops = spark.range(4000).selectExpr("id as seq", "'put' as op", "cast('k' as binary) as key", "cast('v' as binary) as value")
    assert runs.cuts(ops) == [] == runs.cuts(ops.limit(0))
    monkeypatch.setattr(runs, "SLICE_BYTES", 40 * 66 * 10)
    found = runs.cuts(ops)
    assert len(found) == 9 and all(330 <= b - a <= 470 for a, b in zip([0, *found], found))


def test_multi_get_keeps_repeated_and_missing_keys(spark):
    ops = log(spark, ("a", "1"), ("b", "2"), ("b", None), ("a", "3"))
    asked = spark.createDataFrame([(b"a",), (b"a",), (b"b",), (b"c",)], "key binary")
    got = sorted((bytes(r["key"]), r["value"] and bytes(r["value"])) for r in read.multi_get(ops, asked).collect())
    assert got == [(b"a", b"3"), (b"a", b"3"), (b"b", None), (b"c", None)]


def test_versions_and_latest_disagree_where_they_should(spark):
    rows = spark.createDataFrame([(0, b"a", b"9", 0), (0, b"b", b"1", 1), (1, b"a", b"1", 2), (2, b"b", b"", 3)], "run_id long, key binary, value binary, seq long")
    assert pairs(read.scan_versions(rows)) == [("a", "1"), ("a", "9"), ("b", ""), ("b", "1")]
    assert pairs(read.scan(rows)) == [("a", "1")]


def test_bounds_and_byte_order(spark):
    rows = log(spark, *((k, "v") for k in "acekmp"))
    keys = lambda lo, hi: "".join(k for k, _ in pairs(read.scan(rows, lo, hi)))
    assert keys(FREE, IN("k")) == "acek" and keys(IN("p"), FREE) == "p"
    assert keys(IN("g"), FREE) == keys(EX("g"), FREE) == "kmp" and keys(EX("a"), EX("p")) == "cekm"
    assert keys(IN("k"), IN("c")) == ""
    raw = spark.createDataFrame([(i, "put", k, b"v") for i, k in enumerate((b"\x80", b"\x7f", b"\x7f\x00", b""))], MUTATION)
    assert [bytes(r["key"]) for r in read.scan(raw).collect()] == [b"", b"\x7f", b"\x7f\x00", b"\x80"]


@pytest.mark.parametrize("a, b, lower, upper, expected", [
    ("k1", "k3", IN("k0"), IN("k2"), True), ("k0", "k1", IN("k2"), IN("k3"), False),
    ("k0", "k1", IN("k1"), IN("k2"), True), ("k0", "k1", EX("k1"), IN("k2"), False), ("k1", "k2", IN("k0"), EX("k1"), False),
])
def test_overlap(spark, a, b, lower, upper, expected):
    zone = spark.createDataFrame([(a.encode(), b.encode())], "a binary, b binary")
    assert zone.where(overlaps(F.col("a"), F.col("b"), lower, upper)).count() == int(expected)


def test_blocks(spark):
    rows = spark.createDataFrame([(0, k, v) for k, v in ((b"k1", b"v1"), (b"k2", b"v2"), (b"k3", b"v3"))], "run_id long, key binary, value binary")
    packed = layout.pack_blocks(rows, 25).orderBy("key").collect()
    assert [(r["block_ix"], r["overlap"], r["entry_bytes"]) for r in packed] == [(0, 0, 8), (0, 1, 9), (1, 0, 8)]
    zones = layout.block_zones(layout.pack_blocks(rows, 25)).orderBy("block_ix").collect()
    assert [z["encoded_bytes"] for z in zones] == [23, 12]
    assert [r["prefix"] for r in layout.overlap_with_first(layout.pack_blocks(rows, 25)).orderBy("key").collect()] == [2, 1, 2]


def test_bloom(spark):
    rows = spark.createDataFrame([(0, b"hello"), (0, b"world")], "run_id long, key binary")
    bloom = layout.bloom_bits(rows)
    assert {(r["bits"], r["hashes"]) for r in bloom.collect()} == {(24, 8)}
    assert all(r["maybe"] for r in layout.might_contain(bloom, rows).collect())
    many = spark.range(4000).selectExpr("id % 3 as run_id", "cast(cast(id as string) as binary) as key")
    bloom = layout.bloom_bits(many)
    assert layout.might_contain(bloom, many).where("maybe").count() == 4000
    other = spark.range(4000, 8000).selectExpr("id % 3 as run_id", "cast(cast(id as string) as binary) as key")
    assert layout.might_contain(bloom, other).where("maybe").count() < 120  # 1 % are meant to be


def test_locate_block(spark):
    zones = spark.createDataFrame([(r, i, k) for r in (0, 1) for i, k in enumerate((b"c", b"f", b"k"))], "run_id long, block_ix int, first_key binary")
    asked = spark.createDataFrame([(k,) for k in (b"a", b"c", b"d", b"k", b"z", b"d")], "key binary")
    got = {(r["run_id"], bytes(r["asked"])): r["block_ix"] for r in layout.locate_block(zones, asked).collect()}
    assert got == {(r, k): i for r in (0, 1) for k, i in ((b"c", 0), (b"d", 0), (b"k", 2), (b"z", 2))}


def test_tiers_and_flush(spark):
    tiers = runs.tiers(spark.range(6).select(F.col("id").alias("run_id")), 3)
    show = lambda df: [r["tier"] for r in df.orderBy(F.desc("run_id")).collect()]
    assert show(tiers) == ["mutable", "frozen", "frozen", "l0", "l0", "l0"]
    assert show(runs.flush_oldest(tiers)) == ["mutable", "frozen", "l0", "l0", "l0", "l0"]


def test_fill(spark):
    rows = pairs(read.scan(mutations.fill(spark, 1, 11)))
    assert [k for k, _ in rows] == sorted(map(str, range(1, 12))) and dict(rows)["7"] == "value@7"
    assert mutations.fill(spark, 5, 4).count() == 0


def test_random_logs_equal_a_dict(spark):
    rng = random.Random(5)
    for limit in (20, 10_000):
        ops = [(rng.choice("abcdef"), rng.choice([None, "", "1", "22"])) for _ in range(60)]
        live: dict[str, str] = {}
        for k, v in ops:
            live[k] = v or ""
        expected = sorted((k, v) for k, v in live.items() if v)
        rows = runs.collapse(runs.seal(mutations.accept(log(spark, *ops)).repartition(3), limit))
        assert pairs(read.scan(rows)) == expected
        assert set(expected) <= set(pairs(read.scan_versions(rows)))


def test_registered_merges_cover_all_runs(spark):
    from runstore.plans import catalogue

    d = "/root/testdata/sf0.001"
    rows = sorted((bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in catalogue.event_runs(spark, d).collect())
    for name in ("merge_disjoint", "merge_overlapping"):
        assert [(r["key"], r["value"]) for r in catalogue.queries()[name](spark, d).orderBy("pos").collect()] == rows


def test_places_are_found_range_by_range(spark):
    from runstore.plans import catalogue

    rows = spark.range(5000).selectExpr("cast(cast(pmod(hash(id), 900) as string) as binary) as key", "cast(cast(id % 3 as string) as binary) as value", "id").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalogue.shown(rows.select("key", "value"), "key", "value")
        assert "row_number" not in got._jdf.queryExecution().toString()  # which would be one task for all rows
        assert [(r["key"].encode(), r["value"].encode()) for r in got.orderBy("pos").collect()] == sorted((bytes(r["key"]), bytes(r["value"])) for r in rows.collect())
        assert sorted(r["pos"] for r in got.collect()) == list(range(1, 5001)) and got.columns == ["key", "value", "pos"] and dict(got.dtypes)["pos"] == "int"
        kept = read.numbered(rows, "key")
        assert sorted(r["id"] for r in kept.collect()) == list(range(5000)) and kept.columns == ["key", "value", "id", "pos"]
        assert catalogue.shown(rows.where("false"), "key").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pages_of_one_url_are_in_order_of_their_id(spark, tmp_path):
    from runstore.plans import catalogue

    ids = [30, 4, 100, 7, 9, 2]
    spark.createDataFrame([(i, f"https://a/{u}") for u in "yxz" for i in ids] + [(1, "http://a/x")], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.queries()["scan_prefix_pages"](spark, str(tmp_path)).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(f"https://a/{u}", str(i), k * 6 + j + 1) for k, u in enumerate("xyz") for j, i in enumerate(sorted(ids))]
