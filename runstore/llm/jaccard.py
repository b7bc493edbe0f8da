"""N-gram Jaccard join: a size-aware heavy-light set join, exact at every size.

A document's set holds its distinct k-word shingles. Documents with equal sets form a class;
everything below works on classes, so copies cost one aggregate.

*Light* sets (up to a boundary size) enumerate fixed-size subsets: sets of n and m elements that
link share at least c = ceil(t/(1+t) * (n+m)) elements, so both list their c-element subsets and
meet under an equal one. *Heavy* sets scan inverted lists: a partner shares one of the set's
n - ceil(t*n) + 1 rarest elements, so only these are posted. Rarity is read from a fixed-size
count sketch over all documents; it only orders the elements, so collisions cost time, never
links. The boundary is the size with the least rows emitted plus elements verified, from the
size histogram of all documents. Light sets that can link to a heavy one are posted as well.

Lists are not expanded into all pairs. First each list is checked as a star around its member
with the most room for overlap (the fewest rarer elements); groups of near copies collapse in
that step. Lists whose members still lie in different components are then checked in rounds: ``HEADS``
members with the most room against all others of the list in other components, as far as the size
and position bounds allow, after which these members are done. Verification compares whole sets.

Nulls and odd input: a null text is an empty set; an empty set links with nothing and is its own
component. Rows with a null doc_id keep a row, with null component unless their class or links
hold a document with an id. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import bounded, keep
from .textkit import distinct_grams, mix, slices, text_bytes, tidy, words_of

SKETCH_BITS = 20  # counters of the rarity sketch: 4 MB whatever the corpus
SKETCH_PARTS = 64
WANTED_BITS = 23  # bits of the filter on classes to verify: 1 MB whatever the corpus
MEETINGS = 0.25  # cost model: candidates to verify for each posting
SET_BYTES = 1 << 18  # text whose sets are made at once
HEADS = 4096  # members of a list that a round checks against the others
LARGEST_LIGHT = 40  # sizes for which the boundary is searched

_U = np.uint64


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Smallest overlap with which sets of n and m elements reach the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set of n elements lists, over all partner sizes."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({c for m in partners if (c := least_overlap(n, m, percent)) <= min(n, m)})


def boundary(histogram: dict[int, int], percent: int) -> int:
    """The light sizes end here: least cost over the histogram {set size: classes}."""

    def light(n: int) -> float:
        return sum(math.comb(n, c) for c in subset_sizes(n, percent))

    def heavy(n: int) -> float:
        return (n + percent * -n // 100 + 1) * (1 + MEETINGS * n / 3)

    def cost(x: int) -> float:
        return sum(k * ((light(n) if n <= x else 0) + (heavy(n) if 100 * n >= percent * (x + 1) else 0)) for n, k in histogram.items() if n <= LARGEST_LIGHT + 10)

    return min(range(LARGEST_LIGHT + 1), key=cost)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[range, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """rows, elements, offsets, sizes and class ids of each chunk."""
    texts = batch.column("text")
    for rows in slices(texts, SET_BYTES):
        h, off = distinct_grams(words_of(text_bytes(texts.slice(rows.start, len(rows)))), k)
        total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=_U)])
        n = np.diff(off)
        yield rows, h, off, n, mix(total[off[1:]] - total[off[:-1]] + n.astype(_U)).view(np.int64)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64)


def _profile(k: int) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        names = ["doc_id", "row_key", "n", "cid", "part", "counts"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        schema = pa.schema(list(zip(names, types)))
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("row_key")
            for rows, h, _, n, cid in _sets(batch, k):
                counts += np.bincount(_bucket(h, SKETCH_BITS), minlength=len(counts))
                none = pa.nulls(len(rows))
                yield pa.RecordBatch.from_arrays([ids.slice(rows.start, len(rows)), keys.slice(rows.start, len(rows)), pa.array(n.astype(np.int32)), pa.array(cid), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if counts.any():
            parts = np.minimum(counts, 2**32 - 1).astype(np.uint32).reshape(SKETCH_PARTS, -1)
            none = pa.nulls(SKETCH_PARTS)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([x.tobytes() for x in parts])], schema=schema)

    return run


def _sketch(profile: DataFrame) -> np.ndarray:
    """The corpus-wide counters: summed part by part on the executors, 4 MB on the driver."""

    def total(pdf):
        import pandas as pd

        out = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, dtype=np.uint64)
        for x in pdf["counts"]:
            out += np.frombuffer(x, dtype=np.uint32)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "counts": [np.minimum(out, 2**32 - 1).astype(np.uint32).tobytes()]})

    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), dtype=np.uint32)
    for row in profile.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(total, "part int, counts binary").collect():
        out[row["part"]] = np.frombuffer(row["counts"], dtype=np.uint32)
    return out.ravel()


def _postings(k: int, percent: int, light: int, sketch) -> Callable:
    """(key, class, size, room): room is the most that sets meeting under the key can share."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_by, seen = sketch.value, set()
        for batch in batches:
            for _, h, off, n, cid in _sets(batch, k):
                fresh = np.zeros(len(n), dtype=bool)
                for i in np.flatnonzero(n):
                    if (c := int(cid[i])) not in seen:
                        seen.add(c)
                        fresh[i] = True
                owner = np.repeat(np.arange(len(n)), n)
                use = fresh[owner] & (100 * n[owner] >= percent * (light + 1))
                e, o = h[use], owner[use]
                order = np.lexsort((e, order_by[_bucket(e, SKETCH_BITS)], o))
                e, o = e[order], o[order]
                rank = np.arange(len(o)) - np.searchsorted(o, o)
                use = rank < n[o] + percent * -n[o] // 100 + 1
                e, o, rank = e[use], o[use], rank[use]
                cols = [[e], [cid[o]], [n[o]], [n[o] - rank]]
                for i in np.flatnonzero(fresh & (n <= light)):
                    items = mix(h[off[i] : off[i + 1]] ^ _U(0x5BD1E995))
                    whole = items.sum(dtype=_U)
                    for c in subset_sizes(int(n[i]), percent):
                        gone = np.array(list(itertools.combinations(range(n[i]), int(n[i]) - c)), dtype=np.int64)
                        keys = mix(whole - items[gone].sum(axis=1, dtype=_U) + _U(c << 32))
                        for col, x in zip(cols, (keys, np.full(len(keys), cid[i]), np.full(len(keys), n[i]), np.full(len(keys), c))):
                            col.append(x)
                key, who, size, room = (np.concatenate(x) for x in cols)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who), pa.array(size.astype(np.int32)), pa.array(room.astype(np.int32))], names=["key", "cid", "n", "room"])

    return run


def _wanted_sets(k: int, wanted) -> Callable:
    """(cid, items) of classes that pass the bit filter; a class once per task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            for _, h, off, _, cid in _sets(batch, k):
                u = cid.view(_U)
                at = (u & _U((1 << WANTED_BITS) - 1)).astype(np.int64)
                hit = [i for i in np.flatnonzero(bits[at >> 6] >> (at & 63).astype(_U) & _U(1)) if not (int(cid[i]) in seen or seen.add(int(cid[i])))]
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array([h[off[i] : off[i + 1]].tobytes() for i in hit], pa.binary())], names=["cid", "items"])

    return run


def _linked(percent: int) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(z.as_buffer(), dtype=_U) for z in (x, y))
                both = np.concatenate([p, q])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the similarity."""
    spark = docs.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).select(F.expr(f"c & {(1 << WANTED_BITS) - 1}").alias("at"))
    bits = np.zeros(1 << (WANTED_BITS - 6), dtype=_U)
    for word, mask in ends.groupBy(F.expr("cast(at >> 6 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))"))).collect():
        bits[word] = _U(mask & (2**64 - 1))
    filled = spark.sparkContext.broadcast(bits)
    sets = docs.select("text").mapInArrow(_wanted_sets(k, filled), "cid long, items binary")
    sets = keep(sets.groupBy("cid").agg(F.first("items").alias("items")), "sets")
    filled.unpersist()
    x, y = sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), sets.select(F.col("cid").alias("b"), F.col("items").alias("y"))
    return keep(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text)."""
    return jaccard_groups(docs, F.lit(0), k, percent).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, row_key: Column, k: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, row_key, n_shingles, component_id, group_id`` for every row of ``docs`` (doc_id, text).

    ``row_key`` is any 64-bit column of ``docs``. ``group_id`` names the component whatever ids its
    rows have, even none; it is null for an empty set.
    """
    spark = docs.sparkSession
    docs = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key.cast("long").alias("row_key"), F.col("text").cast("string").alias("text")))
    profile = keep(docs.mapInArrow(_profile(k), "doc_id long, row_key long, n int, cid long, part int, counts binary"), "profile")
    docs_of = profile.where("part is null").select("doc_id", "row_key", "n", "cid")
    sketch = spark.sparkContext.broadcast(_sketch(profile))
    sizes = docs_of.where(f"n between 1 and {LARGEST_LIGHT + 10}").groupBy("n").count().collect()
    light = boundary({r["n"]: r["count"] for r in sizes}, percent)

    posts = docs.select("text").mapInArrow(_postings(k, percent, light, sketch), "key long, cid long, n int, room int")
    lists = keep(posts, "postings")
    sketch.unpersist()
    heads = lists.groupBy("key").agg(F.max_by(F.struct("cid", "n", "room"), F.struct("room", "cid")).alias("h"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("key", F.col("h.cid").alias("hc"), F.col("h.n").alias("hn"), F.col("h.room").alias("hr"))
    # Heads are written first, so that the join shuffles both sides itself and a hot key's rows can be split.
    lists = keep(lists.join(keep(heads, "heads"), "key"), "lists")  # only keys that different classes share

    fits = "least({0}, {1}) >= cast(ceil(%d * (n + {2}) / %d.0D) as int)" % (percent, 100 + percent)
    star = lists.where(F.col("cid") != F.col("hc")).where(fits.format("room", "hr", "hn"))
    star = keep(star.select(F.least("cid", "hc").alias("a"), F.greatest("cid", "hc").alias("b")).distinct(), "star")
    links = _verify(star, docs, k, percent)

    left = lists.select("key", "cid", "n", "room")
    while True:
        roots = keep(components(links, "a", "b"), "roots").withColumnRenamed("node", "cid")
        named = keep(left.join(roots, "cid", "left").select("key", "cid", "n", "room", F.coalesce("root", "cid").alias("c")), "named")
        several = keep(named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "several")
        if several.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("room"), "cid"))
        rest = keep(named.join(several, "key").withColumn("rank", rank), "open")
        other = rest.where(f"rank <= {HEADS}").select("key", *[F.col(c).alias(f"{c}_") for c in ("cid", "n", "room", "c", "rank")])
        more = rest.join(other, "key").where("rank_ < rank and c <> c_").where(fits.format("room", "room_", "n_"))
        more = keep(more.select(F.least("cid", "cid_").alias("a"), F.greatest("cid", "cid_").alias("b")).distinct().join(star, ["a", "b"], "left_anti"), "rest")
        links = keep(links.unionByName(_verify(more, docs, k, percent)), "all-links")
        left = rest.where(f"rank > {HEADS}").select("key", "cid", "n", "room")

    classes = docs_of.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc"), F.count("*").alias("k"))
    joined = classes.join(roots, "cid", "left").where("k > 1 or root is not null").select("cid", F.coalesce("root", "cid").alias("root"), "doc")
    joined = keep(joined, "classes")
    least = keep(joined.groupBy("root").agg(F.min("doc").alias("component_id")), "least")
    member = keep(joined.join(least, "root").select("cid", "component_id", "root"), "members")
    out = docs_of.withColumn("at", F.when(F.col("n") > 0, F.col("cid"))).join(member.withColumnRenamed("cid", "at"), "at", "left")
    return out.select("doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "at").alias("group_id"))
