"""Schemas and options of the store."""

from __future__ import annotations

from dataclasses import dataclass

#: op is put or delete; an empty value is a delete marker; seq is the order of writing, unique.
MUTATION = "seq long, op string, key binary, value binary"
RUN_ROW = "run_id long, key binary, value binary, seq long"

SHARD_RUNS = 16  # runs that one task seals, where the number of shards goes by the log's size
SLICE_BYTES = 32 << 20  # of a log that one task folds, a mutation counted with ROW_BYTES more
ROW_BYTES = 64
MAX_SLICES = 1024  # of a shard; beyond that slices grow
# Default options and format limits.
RUN_BYTES = 2 << 20
BLOCK_BYTES = 4096
BLOCK_CACHE = 1 << 20
SEALED_RUNS = 3
BLOOM_FPP = 0.01
PAIR_LIMIT = 65_531  # key and value bytes of one pair in strict mode


@dataclass(frozen=True)
class StoreOptions:
    path: str = "runs.db"
    run_bytes: int = RUN_BYTES
    block_bytes: int = BLOCK_BYTES  # page size of the runs' files
    sealed_runs: int = SEALED_RUNS  # runs in memory, the mutable one included, before the oldest is flushed
    strict_limits: bool = False
    shards: int | None = None  # parts of a bulk log that are sealed side by side; None: by the log's size
