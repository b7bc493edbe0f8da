"""Runs as sorted Parquet files under one folder, and the manifest that lists them.

A run is written to a folder of its own, sorted by key and with a Bloom filter on it; a long run has
several files, one for each range of keys. Then a new manifest, with the next number, makes it visible. Readers take the highest manifest, so a failed
write leaves nothing that they see; ``vacuum`` removes what no manifest names. All paths go through
Hadoop's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runstore.functions.bounds import Bound, in_range
from runstore.schema import BLOCK_BYTES, BLOOM_FPP, RUN_BYTES, RUN_ROW

ROW_GROUP = 8 << 20
PAIR_BYTES = 48  # of a pair, by which a run's Bloom filter is sized
FILE_BYTES = 64 << 20  # of the pairs that one task sorts and writes, each with PAIR_BYTES more


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the runs' zones, in constant memory: aggregates by binary keys would sort all rows."""
    for batch in batches:
        if batch.num_rows:
            run_id = batch.column("run_id").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(run_id)) + 1).tolist(), len(run_id)]
            parts = [(int(run_id[a]), *(pc.min_max(batch.column("key").slice(a, b - a))[x].as_py() for x in ("min", "max")), b - a, pc.max(batch.column("seq").slice(a, b - a)).as_py()) for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["run_id", "first", "last", "n", "seq"])


class RunFolder:
    def __init__(self, spark: SparkSession, path: str, page_bytes: int = BLOCK_BYTES, row_group: int = ROW_GROUP):
        self.spark, self.path, self.page_bytes, self.row_group = spark, path.rstrip("/"), page_bytes, row_group

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/manifest")
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def manifest(self) -> list[dict]:
        """The runs, oldest first, with their keys as hex."""
        numbers = self._numbers()
        if not numbers:
            return []
        fs, at = self._fs(f"{self.path}/manifest/{numbers[-1]:08d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, runs: list[dict]) -> None:
        number = (self._numbers() or [-1])[-1] + 1
        fs, tmp = self._fs(f"{self.path}/manifest/.{number:08d}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        if not fs.rename(tmp, self._fs(f"{self.path}/manifest/{number:08d}.json")[1]):
            raise RuntimeError("another writer published this manifest")

    def _written(self, run_rows: DataFrame, base: int, run_bytes: int, total: int = 0) -> list[dict]:
        """Write each run of ``run_rows`` (run_id, key, value, seq) in a folder that no run has yet.

        Of ``total`` bytes, where runs may be long, a task gets a range of runs and keys.
        """
        batch = f"{self.path}/runs/{base:08d}"
        rows, tasks = run_rows.withColumn("run_id", F.col("run_id") + base), -(-total // FILE_BYTES)
        rows = (rows.repartitionByRange(tasks, "run_id", "key") if tasks > 1 else rows.repartition("run_id")).sortWithinPartitions("run_id", "key")
        writer = rows.withColumn("run", F.col("run_id")).write.mode("overwrite").partitionBy("run").option("parquet.block.size", self.row_group).option("parquet.page.size", self.page_bytes)
        entries = max(64, max(run_bytes, min(total, FILE_BYTES)) // PAIR_BYTES)
        writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(entries)).option("parquet.bloom.filter.fpp#key", str(BLOOM_FPP)).parquet(batch)
        parts = self.spark.read.schema(RUN_ROW).parquet(batch).select("run_id", "key", "seq").mapInArrow(_zones, "run_id long, first binary, last binary, n long, seq long")
        zones = parts.groupBy("run_id").agg(F.hex(F.min("first")).alias("first_key"), F.hex(F.max("last")).alias("last_key"), F.sum("n").alias("n_entries"), F.max("seq").alias("last_seq"))
        out = [r.asDict() | {"path": f"{batch}/run={r['run_id']}"} for r in zones.orderBy("run_id").collect()]
        return [r | {"n_bytes": self.n_bytes(r)} for r in out]

    def n_bytes(self, run: dict) -> int:
        """Bytes of a run's files."""
        fs, at = self._fs(run["path"])
        return fs.getContentSummary(at).getLength()

    def append(self, run_rows: DataFrame, run_bytes: int = RUN_BYTES, sealed: bool = False) -> None:
        """Add the runs of ``run_rows``, newest last; empty runs vanish.

        ``sealed`` tells that no run holds more than ``run_bytes``, so that a task can write a run whole.
        """
        known, total = self.manifest(), 0
        if not sealed or run_bytes > FILE_BYTES:
            total = run_rows.agg(F.sum(F.octet_length("key") + F.octet_length("value") + PAIR_BYTES)).first()[0] or 0
        new = self._written(run_rows, self._next(known), run_bytes, total)
        if new:
            self._publish(known + new)

    def _next(self, known: list[dict]) -> int:
        """A run number above all that were ever written, so that no folder is used twice."""
        fs, at = self._fs(f"{self.path}/runs")
        named = [int(x.getPath().getName()) for x in fs.listStatus(at)] if fs.exists(at) else []
        return max([-1, *named, *(r["run_id"] for r in known)]) + 1

    def read(self, lower: Bound = Bound.unbounded(), upper: Bound = Bound.unbounded()) -> DataFrame:
        """The rows of all runs that can hold keys within the bounds, filtered by them."""
        paths = [r["path"] for r in self.manifest() if self._meets(r, lower, upper)]
        if not paths:
            return self.spark.createDataFrame([], RUN_ROW)
        return self.spark.read.schema(RUN_ROW).parquet(*paths).where(in_range(F.col("key"), lower, upper))

    @staticmethod
    def _meets(run: dict, lower: Bound, upper: Bound) -> bool:
        first, last = bytes.fromhex(run["first_key"]), bytes.fromhex(run["last_key"])
        low, high = (b.key.encode() if isinstance(b.key, str) else b.key for b in (lower, upper))
        if lower.kind != "unbounded" and (last < low or (last == low and lower.kind == "excluded")):
            return False
        return not (upper.kind != "unbounded" and (first > high or (first == high and upper.kind == "excluded")))

    def merge(self, runs: list[dict]) -> None:
        """Replace ``runs`` by one run with each key's newest version; old files stay until ``vacuum``.

        Delete markers go only where no other run could hold an older version.
        """
        known = self.manifest()
        chosen = {r["run_id"] for r in runs}
        rest = [r for r in known if r["run_id"] not in chosen]
        if not chosen:
            return
        rows = self.spark.read.schema(RUN_ROW).parquet(*[r["path"] for r in known if r["run_id"] in chosen])
        newest = rows.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
        if not rest:
            newest = newest.where("octet_length(value) > 0")
        total = sum(r["n_entries"] * PAIR_BYTES + r["n_bytes"] for r in known if r["run_id"] in chosen)
        new = self._written(newest.select(F.lit(0).cast("long").alias("run_id"), "key", "value", "seq"), self._next(known), RUN_BYTES, total)
        self._publish(rest + new)

    def vacuum(self) -> int:
        """Remove run folders that the newest manifest does not name, and older manifests; their number.

        No reader may still use an older manifest.
        """
        named = {r["path"] for r in self.manifest()}
        fs, at = self._fs(f"{self.path}/runs")
        gone = 0
        for batch in fs.listStatus(at) if fs.exists(at) else []:
            own = [x.getPath() for x in fs.listStatus(batch.getPath()) if x.isDirectory()]
            kept = [x for x in own if f"{self.path}/runs/{batch.getPath().getName()}/{x.getName()}" in named]
            for x in own:
                if x not in kept:
                    gone += bool(fs.delete(x, True))
            if not kept:
                fs.delete(batch.getPath(), True)
        for number in self._numbers()[:-1]:
            fs.delete(self._fs(f"{self.path}/manifest/{number:08d}.json")[1], False)
        return gone
