"""Layout reports of sorted files: blocks, prefix compression, zone maps, Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runstore.functions.codec import prefix_length
from runstore.schema import BLOOM_FPP


def _packed(limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ix, first, data, n = None, 0, b"", 0, 0
        for batch in batches:
            out: list[tuple] = []
            for run_id, key, size in zip(*(batch.column(c).to_pylist() for c in ("run_id", "key", "value_bytes"))):
                if run_id != now:
                    now, ix, data, n = run_id, 0, 0, 0
                if n and data + 2 * n + 2 + 4 + len(key) + 2 + size + 2 >= limit:
                    ix, data, n = ix + 1, 0, 0
                if not n:
                    first, shared, header = key, 0, 2
                else:
                    shared = next((i for i, (a, b) in enumerate(zip(first, key)) if a != b), min(len(first), len(key)))
                    header = 4
                data += header + len(key) - shared + 2 + size
                n += 1
                out.append((run_id, ix, key, first, shared, header + len(key) - shared + 2 + size))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()])], names=["run_id", "block_ix", "key", "block_first", "overlap", "entry_bytes"])

    return run


def pack_blocks(run_rows: DataFrame, limit: int) -> DataFrame:
    """The block of each pair, packed greedily by ascending key within a run.

    A block closes before the pair that would bring its estimated size to ``limit``; the estimate
    takes the pair's whole key. Runs are packed side by side, each as a stream.
    """
    rows = run_rows.select("run_id", "key", F.octet_length("value").cast("long").alias("value_bytes"))
    rows = rows.repartition("run_id").sortWithinPartitions("run_id", "key")
    return rows.mapInArrow(_packed(limit), "run_id long, block_ix int, key binary, block_first binary, overlap int, entry_bytes int")


def block_zones(packed: DataFrame) -> DataFrame:
    """First and last key, entries and encoded bytes (data, offsets, end mark) of each block."""
    encoded = (F.sum("entry_bytes") + 2 * F.count("*") + 2).cast("long")
    return packed.groupBy("run_id", "block_ix").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_entries"), encoded.alias("encoded_bytes"))


def overlap_with_first(packed: DataFrame) -> DataFrame:
    """Prefix that each key shares with its block's first key, by built-in functions."""
    return packed.withColumn("prefix", prefix_length("key", "block_first"))


def locate_block(zones: DataFrame, keys: DataFrame) -> DataFrame:
    """The last block of each run whose first key is at most the asked key (key): ``run_id, asked, block_ix``.

    An as-of join: blocks and asked keys of a run lie in one order, in which every key takes the last
    block before it. A key that is asked twice has one row.
    """
    runs = zones.select("run_id").distinct()
    asked = keys.select(F.col("key").alias("asked")).distinct().crossJoin(runs).select("run_id", F.col("asked").alias("at"), F.lit(None).cast("int").alias("block"))
    both = zones.select("run_id", F.col("first_key").alias("at"), F.col("block_ix").alias("block")).unionByName(asked)
    last = F.last("block", True).over(Window.partitionBy("run_id").orderBy("at", F.isnull("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("block_ix", last).where("block is null and block_ix is not null").select("run_id", F.col("at").alias("asked"), "block_ix")


def bloom_size(n: Column) -> tuple[Column, Column]:
    """Bits (whole bytes) and hash functions of a Bloom filter for n keys."""
    raw = F.ceil(-n * math.log(BLOOM_FPP) / math.log(2) ** 2)
    bits = (F.ceil(raw / 8) * 8).cast("long")
    return bits, F.round(bits / n * math.log(2)).cast("int")


def _positions(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """The bits of each hash (rows): two halves, the lower stepped by the number of the function."""
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    steps = np.arange(hashes, dtype=np.uint64)
    return ((high[:, None] + steps * low[:, None]) & np.uint64(0xFFFFFFFF)) % np.uint64(bits)


def _by_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each run within a batch; runs lie together, in batches or across them."""
    for batch in batches:
        if batch.num_rows:
            run_id = batch.column("run_id").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(run_id)) + 1).tolist(), len(run_id)]
            for begin, end in zip(edge, edge[1:]):
                yield int(run_id[begin]), batch.slice(begin, end - begin)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, []

    def filled() -> pa.RecordBatch:
        h = np.concatenate(held)
        bits = math.ceil(math.ceil(-len(h) * math.log(BLOOM_FPP) / math.log(2) ** 2) / 8) * 8
        hashes = math.floor(bits / len(h) * math.log(2) + 0.5)
        one = np.zeros(bits, dtype=np.uint8)
        one[_positions(h, bits, hashes).ravel()] = 1
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits]), pa.array([hashes], pa.int32()), pa.array([np.packbits(one, bitorder="little").tobytes()], pa.binary())], names=["run_id", "bits", "hashes", "bitmap"])

    for run_id, part in _by_run(batches):
        if run_id != now:
            if held:
                yield filled()
            now, held = run_id, []
        held.append(part.column("h").to_numpy().view(np.uint64))
    if held:
        yield filled()


def bloom_bits(run_rows: DataFrame) -> DataFrame:
    """Each run's Bloom filter: ``run_id, bits, hashes, bitmap``; a run, bounded in size, is one task's."""
    keyed = run_rows.select("run_id", F.xxhash64("key").alias("h")).repartition("run_id").sortWithinPartitions("run_id")
    return keyed.mapInArrow(_bitmaps, "run_id long, bits long, hashes int, bitmap binary")


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, have, hashes = None, None, 0
    for run_id, part in _by_run(batches):
        if run_id != now:
            now, have = run_id, None
        if part.column("bitmap")[0].is_valid:
            have = np.unpackbits(np.frombuffer(part.column("bitmap")[0].as_buffer(), dtype=np.uint8), bitorder="little").astype(bool)
            hashes, part = part.column("hashes")[0].as_py(), part.slice(1)
        if have is not None and part.num_rows:
            maybe = have[_positions(part.column("h").to_numpy().view(np.uint64), len(have), hashes)].all(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("run_id"), part.column("key"), pa.array(maybe)], names=["run_id", "key", "maybe"])


def might_contain(bloom: DataFrame, keys: DataFrame) -> DataFrame:
    """``run_id, key, maybe`` for each key of ``keys`` (run_id, key): false means surely absent.

    A run's filter comes before its keys in one order; keys of runs without a filter have no row.
    """
    asked = keys.selectExpr("run_id", "1 as kind", "key", "xxhash64(key) as h", "cast(null as int) as hashes", "cast(null as binary) as bitmap")
    both = bloom.selectExpr("run_id", "0 as kind", "cast(null as binary) as key", "0L as h", "hashes", "bitmap").unionByName(asked)
    return both.repartition("run_id").sortWithinPartitions("run_id", "kind").mapInArrow(_probed, "run_id long, key binary, maybe boolean")
