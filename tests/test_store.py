"""The store on disk, its shell, and a stream into it."""

import io

import pytest

from runstore.cli import Shell
from runstore.functions.bounds import Bound
from runstore.operators import mutations, read
from runstore.schema import MUTATION, StoreOptions
from runstore.sources.storage import RunFolder
from runstore.store import KeyNotFound, KVStore
from runstore.streaming.ingest import ingest


def test_lifecycle(spark, tmp_path):
    options = StoreOptions(path=f"file://{tmp_path}/kv", run_bytes=10)
    with KVStore.open(spark, options) as store:
        assert list(store.items()) == []
        store.put("hello", "world")
        store.put("another", "entry")
        store.put("", "empty key")
        assert store.get("hello") == b"world" and store.get("nothing") is None
        with pytest.raises(KeyNotFound):
            store.delete("nothing")
        store.delete("hello")
        assert store.get("hello") is None
    again = KVStore.open(spark, options)
    assert list(again.items()) == [(b"", b"empty key"), (b"another", b"entry")]
    assert list(again.items(Bound.excluded(""))) == [(b"another", b"entry")]
    again.compact()
    assert len(again.folder.manifest()) == 1 and again.get("another") == b"entry" and again.get("hello") is None
    again.put("hello", "again")
    assert again.get("hello") == b"again"


def test_strict_limits(spark, tmp_path):
    store = KVStore.open(spark, StoreOptions(path=f"file://{tmp_path}/kv", strict_limits=True))
    store.put("k", "x" * 65_530)
    with pytest.raises(ValueError):
        store.put("k", "x" * 65_531)


    bulk = spark.createDataFrame([(0, "put", b"a", b"1"), (1, "put", b"b", b"x" * 70_000)], MUTATION)
    with pytest.raises(ValueError):
        store.put_all(bulk)
    assert store.get("a") is None


def test_deletes_across_batches(spark, tmp_path):
    store = KVStore.open(spark, StoreOptions(path=f"file://{tmp_path}/kv"))
    batch = lambda *ops: spark.createDataFrame([(i, op, k.encode(), v.encode()) for i, (op, k, v) in enumerate(ops)], MUTATION)
    store.put_all(batch(("put", "x", "1"), ("put", "y", "1"), ("delete", "z", "")))
    store.put_all(batch(("delete", "x", ""), ("delete", "z", ""), ("put", "z", "2")))
    assert list(store.items()) == [(b"y", b"1"), (b"z", b"2")]
    store.put("w", "3")
    store.put_all(batch(("delete", "w", ""), ("delete", "x", ""), ("delete", "z", ""), ("delete", "z", "")))
    assert list(store.items()) == [(b"y", b"1")]
    assert store.scan_versions().where("octet_length(value) = 0").count() == 3  # refused deletes leave nothing


def test_sealed_runs_wait_in_memory(spark, tmp_path):
    store = KVStore.open(spark, StoreOptions(path=f"file://{tmp_path}/kv", run_bytes=4))
    for k in "abc":
        store.put(k, "123")
    assert len(store.runs) == 3 and not store.folder.manifest()
    store.put("d", "123")
    assert len(store.runs) == 3 and len(store.folder.manifest()) == 1
    store.delete("b")
    assert store.get("a") == b"123" and store.get("b") is None and [k for k, _ in store.items()] == [b"a", b"c", b"d"]
    store.close()
    assert len(store.folder.manifest()) == 5 and all(r["n_bytes"] > 0 for r in store.folder.manifest())
    assert store.compact_tiers(4) == 1 and len(store.folder.manifest()) == 1
    assert store.folder.vacuum() == 5 and [k for k, _ in store.items()] == [b"a", b"c", b"d"]


def test_closed_empty_store_scans_nothing(spark, tmp_path):
    store = KVStore.open(spark, StoreOptions(path=f"file://{tmp_path}/kv"))
    store.close()
    assert list(store.items()) == [] and store.folder.manifest() == []
    store.put_all(spark.createDataFrame([], MUTATION))
    assert list(store.items()) == []


def test_scan_crosses_row_groups(spark, tmp_path):
    folder = RunFolder(spark, f"file://{tmp_path}/kv", page_bytes=256, row_group=1024)
    n = 60_000
    folder.append(spark.range(n).selectExpr("0L as run_id", "cast(lpad(cast(id as string), 8, '0') as binary) as key", "cast(md5(cast(id as string)) as binary) as value", "id as seq"))
    import pyarrow.parquet as pq

    (file,) = (tmp_path / "kv/runs").glob("*/*/*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 1
    assert read.scan_versions(folder.read()).count() == n
    assert [bytes(r["key"]) for r in folder.read(Bound.included("00029999"), Bound.excluded("00030002")).orderBy("key").collect()] == [b"00029999", b"00030000", b"00030001"]


def test_long_runs_are_written_by_ranges(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from runstore.sources import storage

    monkeypatch.setattr(storage, "FILE_BYTES", 20_000 * 88 // 5)
    folder = RunFolder(spark, f"file://{tmp_path}/kv")
    rows = spark.range(20_000).selectExpr("id % 2 as run_id", "cast(lpad(cast(id as string), 8, '0') as binary) as key", "cast(md5(cast(id as string)) as binary) as value", "id as seq")

    def spans(run):
        found = [pq.read_table(f, columns=["key"])["key"].to_pylist() for f in (tmp_path / f"kv/runs/{run['run_id'] if run['run_id'] > 1 else 0:08d}/run={run['run_id']}").glob("*.parquet")]
        assert all(keys == sorted(keys) for keys in found) and sum(map(len, found)) == run["n_entries"]
        return sorted((keys[0], keys[-1]) for keys in found)

    folder.append(rows)
    runs = folder.manifest()
    assert [(r["run_id"], r["n_entries"], r["last_seq"], bytes.fromhex(r["first_key"]), bytes.fromhex(r["last_key"])) for r in runs] == [(0, 10_000, 19_998, b"00000000", b"00019998"), (1, 10_000, 19_999, b"00000001", b"00019999")]
    for run in runs:
        own = spans(run)
        assert len(own) > 1 and all(a < b for (_, a), (b, _) in zip(own, own[1:]))
    folder.merge(runs)
    (run,) = folder.manifest()
    own = spans(run)
    assert len(own) > 2 and all(a < b for (_, a), (b, _) in zip(own, own[1:]))
    assert [bytes(r["key"]) for r in read.scan(folder.read(Bound.included("00009998"), Bound.excluded("00010001"))).collect()] == [b"00009998", b"00009999", b"00010000"]
    assert folder.read().count() == 20_000


def test_shell(spark, tmp_path):
    out = io.StringIO()
    shell = Shell(KVStore.open(spark, StoreOptions(path=f"file://{tmp_path}/kv")), stdout=out, stdin=io.StringIO())
    for line in ("put a 1", "get a", "delete b", "fill 1 3", "scan 1 2", "scan a --versions", "bad", "quit"):
        done = shell.onecmd(line)
    assert done and out.getvalue().splitlines()[:1] == ["a=1"]
    assert "does not exist" in out.getvalue() and "1=value@1\n2=value@2" in out.getvalue()


def test_stream(spark, tmp_path):
    mutations.fill(spark, 1, 20).write.parquet(f"{tmp_path}/in")
    store = KVStore.open(spark, StoreOptions(path=f"file://{tmp_path}/kv"))
    stream = spark.readStream.schema("seq long, op string, key binary, value binary").parquet(f"{tmp_path}/in")
    query = ingest(stream, store, f"file://{tmp_path}/check", available_now=True)
    query.awaitTermination()
    assert len(list(store.items())) == 20
    spark.createDataFrame([(0, "delete", b"7", b""), (1, "delete", b"none", b"")], MUTATION).write.mode("append").parquet(f"{tmp_path}/in")
    ingest(stream, store, f"file://{tmp_path}/check", available_now=True).awaitTermination()
    assert len(list(store.items())) == 19 and store.get("7") is None
