"""The registered queries over the driver's tables, each with its DuckDB SQL beside it.

``events`` is read as a log: event_id is the sequence, user_id the key, event_type the value, and
the type ``error`` a delete. Small run and block limits bring the sealing and packing into play.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runstore.functions import codec
from runstore.functions.bounds import Bound, overlaps
from runstore.operators import layout, mutations, read, runs
from runstore.sources.storage import RunFolder

RUN_LIMIT, BLOCK_LIMIT, SEALED = 2048, 512, 3
LOW, HIGH = "12", "57"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name], _sql[name] = f, sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return mutations.log(table(spark, d, "events"), F.col("event_id"), codec.text(F.col("user_id")), codec.text(F.col("event_type")), F.col("event_type") == "error")


def event_seals(spark: SparkSession, d: str) -> DataFrame:
    log = events(spark, d)
    return runs.seal(mutations.accept(log), RUN_LIMIT, cut=runs.cuts(log))


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse(event_seals(spark, d))


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.lit(0).cast("long").alias("run_id"), codec.text(F.col("url")).alias("key"), codec.text(F.col("page_id")).alias("value"))
    return layout.pack_blocks(pages, BLOCK_LIMIT)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else a temporary one, in local mode alone, removed at the end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="runs-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def shown(df: DataFrame, *order: str) -> DataFrame:
    """Keys and values as text, and the place of each row in the given order."""
    if order:
        df = read.numbered(df, *order)
    return df.select(*[codec.decode(F.col(c)).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


EV = """ev AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, event_type = 'error' AS del,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS value FROM events)"""
LATEST = f"{EV}, latest AS (SELECT key, arg_max(value, seq) AS value FROM ev GROUP BY key HAVING arg_max(value, seq) <> '')"
ACC = f"""{EV}, judged AS (SELECT *, NOT (del AND coalesce(lag(value) OVER (PARTITION BY key ORDER BY seq), '') = '') AS accepted FROM ev),
acc AS (SELECT seq, key, value, strlen(key) + strlen(value) AS sz, row_number() OVER (ORDER BY seq) AS rn,
  sum(strlen(key) + strlen(value)) OVER (ORDER BY seq) AS cum FROM judged WHERE accepted)"""
RUNS = f"""{ACC}, starts(rn) AS (
  SELECT min(rn) FROM acc
  UNION ALL
  SELECT min(a.rn) FROM starts s JOIN acc b ON b.rn = s.rn JOIN acc a ON a.rn > s.rn AND a.cum - b.cum + b.sz > {RUN_LIMIT}
  GROUP BY s.rn),
spans AS (SELECT rn, row_number() OVER (ORDER BY rn) - 1 AS run_id, lead(rn) OVER (ORDER BY rn) AS next FROM starts),
sealed AS (SELECT p.run_id, a.* FROM acc a JOIN spans p ON a.rn >= p.rn AND (p.next IS NULL OR a.rn < p.next)),
rows_ AS (SELECT run_id, key, arg_max(value, seq) AS value, max(seq) AS seq FROM sealed GROUP BY run_id, key),
tier AS (SELECT run_id, CASE WHEN r = 1 THEN 'mutable' WHEN r <= {SEALED} THEN 'frozen' ELSE 'l0' END AS tier
  FROM (SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS r FROM (SELECT DISTINCT run_id FROM rows_)))"""
BLOCKS = f"""kv AS (SELECT url AS key, strlen(CAST(page_id AS VARCHAR)) AS vlen, row_number() OVER (ORDER BY encode(url)) AS rn FROM pages),
pack(rn, ix, first, n, data, key, shared, entry) AS (
  SELECT rn, 0, key, 1, 2 + strlen(key) + 2 + vlen, key, 0, 2 + strlen(key) + 2 + vlen FROM kv WHERE rn = 1
  UNION ALL
  SELECT k.rn, CASE WHEN full_ THEN ix + 1 ELSE ix END, CASE WHEN full_ THEN k.key ELSE first END,
    CASE WHEN full_ THEN 1 ELSE n + 1 END,
    CASE WHEN full_ THEN 4 + klen + vlen ELSE data + 6 + klen - lcp + vlen END, k.key,
    CASE WHEN full_ THEN 0 ELSE lcp END, CASE WHEN full_ THEN 4 + klen + vlen ELSE 6 + klen - lcp + vlen END
  FROM (SELECT p.ix, p.first, p.n, p.data, k.rn, k.key, k.vlen, strlen(k.key) AS klen,
      p.data + 2 * p.n + 2 + 4 + strlen(k.key) + 2 + k.vlen + 2 >= {BLOCK_LIMIT} AS full_,
      len(list_filter(range(1, 1 + least(len(k.key), len(p.first))), lambda i: k.key[1:i] = p.first[1:i])) AS lcp
    FROM pack p JOIN kv k ON k.rn = p.rn + 1) k),
zone AS (SELECT ix AS block_ix, min(key) AS first_key, max(key) AS last_key, count(*) AS n_entries, sum(entry) + 2 * count(*) + 2 AS encoded_bytes FROM pack GROUP BY ix)"""
POS = "CAST(row_number() OVER (ORDER BY {}) AS INTEGER) AS pos"


def _get(name: str, key: str) -> None:
    @register(name, f"WITH {LATEST} SELECT key, value FROM latest WHERE key = '{key}'")
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shown(read.get(events(spark, d), key))


_get("point_get_hit", "7")
_get("point_get_missing", "no such key")


@register("point_get_deleted", f"WITH {EV}, dead AS (SELECT min(key) AS key FROM (SELECT key FROM ev GROUP BY key HAVING arg_max(value, seq) = '')) SELECT d.key, count(l.key) AS found FROM dead d LEFT JOIN (SELECT key FROM ev GROUP BY key HAVING arg_max(value, seq) <> '') l USING (key) GROUP BY d.key")
def point_get_deleted(spark: SparkSession, d: str) -> DataFrame:
    log = events(spark, d)
    dead = log.groupBy("key").agg(F.max_by("value", "seq").alias("value")).where("octet_length(value) = 0").agg(F.min("key").alias("key"))
    return shown(read.multi_get(log, dead).groupBy("key").agg(F.count("value").alias("found")))


@register("multi_get", f"WITH {LATEST}, asked AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer) SELECT key, value FROM asked LEFT JOIN latest USING (key)")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    return shown(read.multi_get(events(spark, d), table(spark, d, "customer").select(codec.text(F.col("c_custkey")).alias("key")).distinct()))


def _scan(name: str, lower: Bound, upper: Bound) -> None:
    sign = {"included": "=", "excluded": ""}
    where = " AND ".join(f"key {side}{sign[b.kind]} '{b.key}'" for side, b in ((">", lower), ("<", upper)) if b.kind in sign) or "true"

    @register(name, f"WITH {LATEST} SELECT key, value, {POS.format('encode(key)')} FROM latest WHERE {where}")
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shown(read.latest(events(spark, d), lower, upper), "key")


IN, EX, FREE = Bound.included, Bound.excluded, Bound.unbounded()
for _name, _lower, _upper in (
    ("scan_latest_full", FREE, FREE),
    ("scan_incl_incl", IN(LOW), IN(HIGH)),
    ("scan_incl_excl", IN(LOW), EX(HIGH)),
    ("scan_excl_incl", EX(LOW), IN(HIGH)),
    ("scan_excl_excl", EX(LOW), EX(HIGH)),
    ("scan_lower_only", IN(LOW), FREE),
    ("scan_upper_only", FREE, EX(HIGH)),
    ("scan_inverted_empty", IN(HIGH), IN(LOW)),
):
    _scan(_name, _lower, _upper)


@register("scan_prefix_pages", f"SELECT url AS key, CAST(page_id AS VARCHAR) AS value, {POS.format('encode(url)')} FROM pages WHERE starts_with(url, 'https://')")
def scan_prefix_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where(F.col("url").startswith("https://"))
    keyed = pages.select(codec.text(F.col("url")).alias("key"), codec.text(F.col("page_id")).alias("value"), "page_id")
    return shown(keyed, "key", "page_id").drop("page_id")  # the SQL leaves the order of a repeated url open


@register("scan_limit", f"WITH {LATEST} SELECT key, value FROM latest ORDER BY encode(key) LIMIT 10")
def scan_limit(spark: SparkSession, d: str) -> DataFrame:
    return shown(read.scan(events(spark, d)).limit(10))


def _versions(name: str, lower: Bound, upper: Bound, where: str) -> None:
    @register(name, f"WITH RECURSIVE {RUNS} SELECT key, value, {POS.format('encode(key), encode(value)')} FROM rows_ WHERE {where}")
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shown(read.scan_versions(event_runs(spark, d), lower, upper), "key", "value")


_versions("scan_versions_full", FREE, FREE, "true")
_versions("scan_versions_range", IN(LOW), EX(HIGH), f"key >= '{LOW}' AND key < '{HIGH}'")


def _merge(name: str, picks: tuple[str, ...]) -> None:
    union = " UNION ALL ".join(f"SELECT key, value FROM rows_ WHERE {p}" for p in picks)

    @register(name, f"WITH RECURSIVE {RUNS}, m AS ({union}) SELECT key, value, {POS.format('encode(key), encode(value)')} FROM m")
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = event_runs(spark, d).withColumn("user", codec.decode(F.col("key")).cast("int"))
        return shown(read.merge(*[rows.where(p.replace("CAST(key AS INTEGER)", "user")) for p in picks]), "key", "value")


# Every run of the table: disjoint key ranges of its rows, and overlapping inputs by tier.
_merge("merge_disjoint", ("CAST(key AS INTEGER) < 100", "CAST(key AS INTEGER) >= 100 AND CAST(key AS INTEGER) < 1000", "CAST(key AS INTEGER) >= 1000"))


@register("merge_overlapping", f"WITH RECURSIVE {RUNS}, m AS (SELECT key, value FROM rows_) SELECT key, value, {POS.format('encode(key), encode(value)')} FROM m")
def merge_overlapping(spark: SparkSession, d: str) -> DataFrame:
    rows = event_runs(spark, d)
    tiered = rows.join(runs.tiers(rows, SEALED), "run_id")
    return shown(read.merge(*[tiered.where(F.col("tier") == x) for x in ("mutable", "frozen", "l0")]), "key", "value")


@register("merge_two_way", f"WITH RECURSIVE {RUNS}, m AS (SELECT key, value FROM rows_ JOIN tier USING (run_id) WHERE tier <> 'frozen') SELECT key, value, {POS.format('encode(key), encode(value)')} FROM m")
def merge_two_way(spark: SparkSession, d: str) -> DataFrame:
    rows = event_runs(spark, d)
    tiered = rows.join(runs.tiers(rows, SEALED), "run_id")
    return shown(read.merge(tiered.where("tier = 'mutable'"), tiered.where("tier = 'l0'")), "key", "value")


@register("put_overwrite", f"WITH RECURSIVE {RUNS}, c AS (SELECT run_id, key, count(*) AS puts FROM sealed GROUP BY ALL HAVING count(*) > 1) SELECT run_id, key, value, puts FROM c JOIN rows_ USING (run_id, key)")
def put_overwrite(spark: SparkSession, d: str) -> DataFrame:
    sealed = event_seals(spark, d)
    return shown(sealed.groupBy("run_id", "key").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("puts")).where("puts > 1"))


@register("delete_rejected", f"WITH {ACC} SELECT seq, key FROM judged WHERE NOT accepted")
def delete_rejected(spark: SparkSession, d: str) -> DataFrame:
    return shown(mutations.judged(events(spark, d)).where("not accepted").select("seq", "key"))


@register("delete_accepted", f"WITH {ACC} SELECT seq, key FROM judged WHERE del AND accepted")
def delete_accepted(spark: SparkSession, d: str) -> DataFrame:
    return shown(mutations.accept(events(spark, d)).where("op = 'delete'").select("seq", "key"))


@register("delete_across_batches", f"WITH {ACC}, s AS (SELECT max(seq) // 2 AS s FROM ev) SELECT seq, key, accepted FROM judged, s WHERE del AND seq > s.s")
def delete_across_batches(spark: SparkSession, d: str) -> DataFrame:
    """The log in two batches: deletes of the second meet what the first one stored."""
    log = events(spark, d)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    stored = mutations.accept(log.where(F.col("seq") <= half)).select("seq", "key", "value")
    return shown(mutations.judged(log.where(F.col("seq") > half), stored).where("op = 'delete'").select("seq", "key", "accepted"))


@register("fill_range", f"SELECT CAST(i AS VARCHAR) AS key, 'value@' || i AS value, {POS.format('encode(CAST(i AS VARCHAR))')} FROM range(1, 1001) t(i)")
def fill_range(spark: SparkSession, d: str) -> DataFrame:
    return shown(mutations.fill(spark, 1, 1000).select("key", "value"), "key")


@register("mutation_sizes", f"WITH {EV} SELECT key, count(*) AS n, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes FROM ev GROUP BY key")
def mutation_sizes(spark: SparkSession, d: str) -> DataFrame:
    return shown(mutations.sizes(events(spark, d)).groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))


@register("run_seal", f"WITH RECURSIVE {RUNS} SELECT run_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, CAST(sum(sz) AS BIGINT) AS bytes FROM sealed GROUP BY run_id")
def run_seal(spark: SparkSession, d: str) -> DataFrame:
    sealed = mutations.sizes(event_seals(spark, d))
    return sealed.groupBy("run_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), F.sum("size").alias("bytes"))


@register("run_collapse_stats", f"WITH RECURSIVE {RUNS} SELECT run_id, count(*) AS n_keys, count(*) FILTER (value = '') AS n_deleted FROM rows_ GROUP BY run_id")
def run_collapse_stats(spark: SparkSession, d: str) -> DataFrame:
    dead = F.count(F.when(F.octet_length("value") == 0, 1))
    return event_runs(spark, d).groupBy("run_id").agg(F.count("*").alias("n_keys"), dead.alias("n_deleted"))


@register("run_tiers", f"WITH RECURSIVE {RUNS} SELECT run_id, tier FROM tier")
def run_tiers(spark: SparkSession, d: str) -> DataFrame:
    return runs.tiers(event_runs(spark, d), SEALED)


@register("flush_oldest_run", f"WITH RECURSIVE {RUNS} SELECT run_id, CASE WHEN run_id = (SELECT min(run_id) FROM tier WHERE tier = 'frozen') THEN 'l0' ELSE tier END AS tier FROM tier")
def flush_oldest_run(spark: SparkSession, d: str) -> DataFrame:
    return runs.flush_oldest(runs.tiers(event_runs(spark, d), SEALED))


@register("block_pack_pages", f"WITH RECURSIVE {BLOCKS} SELECT key, ix AS block_ix, shared AS overlap, entry AS entry_bytes FROM pack")
def block_pack_pages(spark: SparkSession, d: str) -> DataFrame:
    return shown(page_blocks(spark, d).select("key", "block_ix", "overlap", "entry_bytes"))


@register("block_zone_map", f"WITH RECURSIVE {BLOCKS} SELECT block_ix, first_key, last_key, n_entries, CAST(encoded_bytes AS BIGINT) AS encoded_bytes FROM zone")
def block_zone_map(spark: SparkSession, d: str) -> DataFrame:
    return shown(layout.block_zones(page_blocks(spark, d)).drop("run_id"))


@register("prefix_overlap", f"WITH RECURSIVE {BLOCKS} SELECT ix AS block_ix, key, len(list_filter(range(1, 1 + least(len(key), len(first))), lambda i: key[1:i] = first[1:i])) AS prefix FROM pack")
def prefix_overlap(spark: SparkSession, d: str) -> DataFrame:
    return shown(layout.overlap_with_first(page_blocks(spark, d)).select("block_ix", "key", "prefix"))


@register("run_zone_map", f"WITH RECURSIVE {RUNS} SELECT run_id, min(key) AS first_key, max(key) AS last_key, count(*) AS n_entries, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS size_bytes FROM rows_ GROUP BY run_id")
def run_zone_map(spark: SparkSession, d: str) -> DataFrame:
    return shown(runs.zones(event_runs(spark, d)))


@register("bloom_params", f"WITH RECURSIVE {RUNS}, n AS (SELECT run_id, count(*) AS n FROM rows_ GROUP BY run_id), m AS (SELECT *, ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS raw FROM n) SELECT run_id, n, CAST(ceil(raw / 8) * 8 AS BIGINT) AS bits, CAST(round(ceil(raw / 8) * 8 / n * ln(2)) AS INTEGER) AS hashes FROM m")
def bloom_params(spark: SparkSession, d: str) -> DataFrame:
    n = event_runs(spark, d).groupBy("run_id").agg(F.count("*").alias("n"))
    bits, hashes = layout.bloom_size(F.col("n"))
    return n.select("run_id", "n", bits.alias("bits"), hashes.alias("hashes"))


@register("bloom_no_false_negative", f"WITH RECURSIVE {RUNS} SELECT run_id, count(*) AS n_keys, 0::BIGINT AS misses FROM rows_ GROUP BY run_id")
def bloom_no_false_negative(spark: SparkSession, d: str) -> DataFrame:
    rows = event_runs(spark, d)
    found = layout.might_contain(layout.bloom_bits(rows), rows.select("run_id", "key"))
    return found.groupBy("run_id").agg(F.count("*").alias("n_keys"), F.count(F.when(~F.col("maybe"), 1)).alias("misses"))


@register("range_overlap_runs", f"WITH RECURSIVE {RUNS}, z AS (SELECT run_id, min(key) AS a, max(key) AS b FROM rows_ GROUP BY run_id) SELECT run_id FROM z WHERE b >= '{HIGH}' AND a < '{HIGH}5'")
def range_overlap_runs(spark: SparkSession, d: str) -> DataFrame:
    zones = runs.zones(event_runs(spark, d))
    return zones.where(overlaps(F.col("first_key"), F.col("last_key"), IN(HIGH), EX(f"{HIGH}5"))).select("run_id")


@register("block_locate", f"WITH RECURSIVE {BLOCKS} SELECT k.url AS asked, max(z.block_ix) AS block_ix FROM pages k JOIN zone z ON encode(z.first_key) <= encode(k.url) GROUP BY k.url")
def block_locate(spark: SparkSession, d: str) -> DataFrame:
    zones = layout.block_zones(page_blocks(spark, d))
    keys = table(spark, d, "pages").select(codec.text(F.col("url")).alias("key"))
    return shown(layout.locate_block(zones, keys).drop("run_id"))


@register("as_of_snapshot", f"WITH {EV}, s AS (SELECT max(seq) // 2 AS s FROM ev) SELECT key, arg_max(value, seq) AS value FROM ev, s WHERE seq <= s.s GROUP BY key HAVING arg_max(value, seq) <> ''")
def as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    log = events(spark, d)
    last = log.agg(F.max("seq")).first()[0]
    return shown(read.as_of(log, (last or 0) // 2))


@register("orders_kv_roundtrip", "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus || '|' || o_orderpriority AS value FROM orders")
def orders_kv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.lit(0).cast("long").alias("run_id"), codec.text(F.col("o_orderkey")).alias("key"), codec.text(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("value"), F.col("o_orderkey").alias("seq"))
    folder = RunFolder(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex[:8]}")
    folder.append(orders)
    return shown(folder.read().select("key", "value"))


@register("docs_oversize", "SELECT CAST(doc_id AS VARCHAR) AS key, CAST(strlen(CAST(doc_id AS VARCHAR)) + strlen(text) AS BIGINT) AS size FROM documents WHERE strlen(CAST(doc_id AS VARCHAR)) + strlen(text) > 65531")
def docs_oversize(spark: SparkSession, d: str) -> DataFrame:
    docs = mutations.log(table(spark, d, "documents"), F.col("doc_id"), codec.text(F.col("doc_id")), codec.text(F.col("text")), F.lit(False))
    return shown(mutations.oversize(docs).select("key", "size"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The latest live event type of each user within a key range, in key order."""
    return shown(read.latest(events(spark, d), IN(LOW), EX(HIGH)), "key")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
