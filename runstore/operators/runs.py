"""Sealing the log into size-bounded runs, and the tiers of runs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runstore.schema import MAX_SLICES, ROW_BYTES, SLICE_BYTES


def _ordinals(sizes: np.ndarray, limit: int, held: int, ordinal: int) -> tuple[np.ndarray, int, int]:
    """The run of each of one shard's next mutations; ``held`` bytes lie in the open run ``ordinal``.

    One step for each run: running sums tell how many mutations still fit.
    """
    out, total, i = np.empty(len(sizes), dtype=np.int64), np.cumsum(sizes), 0
    while i < len(sizes):
        before = int(total[i - 1]) if i else 0
        j = int(np.searchsorted(total, before + limit - held, side="right")) if held <= limit else i
        j = max(i, j)
        held += int(total[j - 1]) - before if j > i else 0
        if j < len(sizes) and held == 0:  # the first pair of a run may be larger than the limit
            held, j = int(sizes[j]), j + 1
        out[i:j] = ordinal
        if j < len(sizes) and held + int(sizes[j]) > limit:
            held, ordinal = 0, ordinal + 1
        i = j
    return out, held, ordinal


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The cell of a task and its batches."""
    now = None
    for batch in batches:
        if batch.num_rows:
            cell = batch.column("cell").to_numpy()
            now = int(cell[0]) if now is None else now
            if (cell != now).any():
                raise RuntimeError("a task has mutations of two cells")
            yield now, batch


def _segments(limit: int, shards: int, slices: int) -> Callable:
    """Fold a cell in order; the row before its mutations, where there is one, has the state that it begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ordinal = 0, 0
        for cell, batch in _own(batches):
            if batch.column("begin")[0].is_valid:
                held, ordinal, batch = batch.column("size")[0].as_py(), batch.column("begin")[0].as_py(), batch.slice(1)
            own, held, ordinal = _ordinals(batch.column("size").to_numpy(), limit, held, ordinal)
            yield pa.RecordBatch.from_arrays([pa.array(own * shards + cell // slices), *(batch.column(c) for c in ("seq", "op", "key", "value"))], names=["run_id", "seq", "op", "key", "value"])

    return run


def _course(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a slice of one shard's mutations goes on from any run that is open before it.

    For each mutation that can be the first to begin a run: the bytes up to and with it, the runs
    closed after that in the slice, and the bytes then held. The last bytes are those of the slice.
    """
    total = np.cumsum(sizes)
    before = total - sizes
    last = np.arange(max(1, int(np.searchsorted(before, limit))))
    closed = np.zeros(len(last), dtype=np.int64)
    while True:  # all courses a run further; the first pair of a run may be larger than the limit
        after = np.maximum(np.searchsorted(total, before[last] + limit, side="right"), np.searchsorted(total, before[last], side="right") + 1)
        on = after < len(total)
        if not on.any():
            break
        last[on] = after[on]
        closed += on
    return np.append(total[: len(last)], total[-1]), closed, total[-1] - before[last]


def _left(course: tuple[np.ndarray, np.ndarray, np.ndarray], limit: int, held: int, ordinal: int) -> tuple[int, int]:
    """The state behind a slice that begins with ``held`` bytes in the open run ``ordinal``."""
    total, closed, holds = course
    if held and held + int(total[-1]) <= limit:
        return held + int(total[-1]), ordinal
    at = int(np.searchsorted(total[:-1], limit - held, side="right")) if held else 0
    return int(holds[at]), ordinal + int(closed[at]) + bool(held)


def _courses(limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sizes = None, []
        for cell, batch in _own(batches):
            sizes.append(batch.column("size").to_numpy().copy())
        if sizes:
            parts = _course(np.concatenate(sizes), limit)
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in parts)], names=["cell", "total", "closed", "holds"])

    return run


def _entries(limit: int, slices: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ordinal = None, 0, 0
        for batch in batches:
            cells, out = batch.column("cell").to_pylist(), []
            for i, cell in enumerate(cells):
                if cell // slices != shard:
                    shard, held, ordinal = cell // slices, 0, 0
                out.append((held, ordinal))
                course = tuple(np.frombuffer(batch.column(c)[i].as_buffer(), dtype="<i8") for c in ("total", "closed", "holds"))
                held, ordinal = _left(course, limit, held, ordinal)
            yield pa.RecordBatch.from_arrays([batch.column("cell"), *(pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))], names=["cell", "held", "ordinal"])

    return run


def cuts(log: DataFrame, shards: int = 1) -> list[int]:
    """Values of seq that part a log of ``shards`` shards into slices of about ``SLICE_BYTES`` each; none for a small log."""
    size = F.sum(F.octet_length("key") + F.octet_length("value") + ROW_BYTES)
    grid = [i / MAX_SLICES for i in range(1, MAX_SLICES)]
    total, at = log.agg(size, F.percentile_approx("seq", grid)).first()
    slices = min(MAX_SLICES, -(-(total or 0) // (SLICE_BYTES * shards)))
    return sorted({at[i * MAX_SLICES // slices - 1] for i in range(1, slices)})


def seal(mutations: DataFrame, limit: int, shards: int = 1, cut: list[int] | None = None) -> DataFrame:
    """``run_id`` for each mutation: a run is closed before the mutation that would overflow it.

    The sizes of overwritten values count on. ``shards`` splits the keys by hash into logs that are
    sealed side by side; with 1 the run boundaries are those of one writer. Where a run ends depends
    on where it began, so a shard is cut at the seqs ``cut`` (by its size: ``cuts``) into slices that
    one task folds each. First each slice tells how it would go on from any state; from that, one
    short pass over the slices finds the state with which each begins. The result has no trace of the cuts.
    """
    cut = cuts(mutations, shards) if cut is None else cut
    slices = len(cut) + 1
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)
    size = (F.octet_length("key") + F.octet_length("value")).cast("long")
    if cut:  # floating point keeps the order, and equal values fall into one slice
        splits = [-math.inf, *sorted({float(x) for x in cut}), math.inf]
        slices = len(splits) - 1
        within = Bucketizer(splits=splits, inputCol="_at", outputCol="_slice")
        mutations = within.transform(mutations.withColumn("_at", F.col("seq").cast("double")))
        shard = shard * slices + F.col("_slice").cast("int")
    sized = mutations.select(shard.alias("cell"), F.lit(None).cast("long").alias("begin"), size.alias("size"), "seq", "op", "key", "value")
    if cut:
        courses = _dealt(sized.select("cell", "size", "seq"), shards * slices).mapInArrow(_courses(limit), "cell int, total binary, closed binary, holds binary")
        entries = courses.repartition(1).sortWithinPartitions("cell").mapInArrow(_entries(limit, slices), "cell int, held long, ordinal long")
        sized = sized.unionByName(entries.selectExpr("cell", "ordinal as begin", "held as size", f"{-(1 << 63)} as seq"), allowMissingColumns=True)
    return _dealt(sized, shards * slices).mapInArrow(_segments(limit, shards, slices), "run_id long, seq long, op string, key binary, value binary")


def _dealt(sized: DataFrame, cells: int) -> DataFrame:
    """Each cell in a task of its own, by seq."""
    return sized.repartitionById(cells, F.col("cell")).sortWithinPartitions("seq")


def collapse(sealed: DataFrame) -> DataFrame:
    """One version of each key for each run: the last written."""
    return sealed.groupBy("run_id", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def zones(run_rows: DataFrame) -> DataFrame:
    """First and last key, entries and bytes of each run."""
    size = F.sum(F.octet_length("key") + F.octet_length("value")).cast("long")
    return run_rows.groupBy("run_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_entries"), size.alias("size_bytes"))


def tiers(runs: DataFrame, sealed_limit: int) -> DataFrame:
    """``tier`` of each run at rest: the newest is mutable, up to limit - 1 are frozen, others l0."""
    rank = F.row_number().over(Window.orderBy(F.desc("run_id")))
    tier = F.when(rank == 1, "mutable").when(rank <= sealed_limit, "frozen").otherwise("l0")
    return runs.select("run_id").distinct().withColumn("tier", tier)


def flush_oldest(tiered: DataFrame) -> DataFrame:
    """The tiers after the oldest frozen run goes to l0."""
    oldest = tiered.where("tier = 'frozen'").agg(F.min("run_id").alias("oldest"))
    moved = F.when(F.col("run_id") == F.col("oldest"), "l0").otherwise(F.col("tier"))
    return tiered.join(F.broadcast(oldest)).select("run_id", moved.alias("tier"))
