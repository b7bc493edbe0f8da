"""Mixing sources to target weights by subset-sum budget fitting.

The documents of a source are counted by exact length. A target of T words over a source of S
words takes every document floor(T/S) times; the remaining budget is fitted by length counts:
first the same share of every length, then whole lengths from the longest, and the last words, at
least ``KNAPSACK`` and ``LONGEST`` times the longest length, up to ``TABLE`` (some 70 MB), by a
bounded-knapsack table over the lengths that are left. Where the table misses the budget, documents
already chosen are given back, longest first, as far as the table reaches, and fitted again with the
rest; so a budget of up to the table's size always gets its best sum. Of each length the planned number of documents is chosen
by a seeded hash, so reruns agree.

Choosing never gathers a length in one task: the hash is dealt into slices, whose number grows with
the rows so that one holds about ``SLICE_ROWS`` of a length at most, slices are taken whole in
order, and only rows within a slice are ranked.

Nulls and odd input: a null text has size 0 and takes nothing. A null source is a source of its
own, sorted last. Repeated rows are documents of their own; rows of one id are ranked by their text,
and it does not matter which of equal rows is taken. Rows with a null id are hashed by their text. A
very long text is one length. An empty table gives an empty result. Columns of the input may have
any names: ``mixed`` returns them as they are, and ``mix_sources`` adds its own and leaves out those
of the input that have these names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

KNAPSACK, LONGEST, TABLE = 4096, 64, 1 << 22
SLICES, SLICE_ROWS = 256, 4096
WORD = "[^\\x20\\x09-\\x0D]+"
ADDED = ("size", "source_size", "target", "copies", "taken")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: list[int], weights: list[float], fraction: float, most: float) -> list[float]:
    """Targets that share ``fraction`` of all sizes by weight, each at most ``most`` times its size."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), fraction * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not above:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in above:
            target[i] = most * float(sizes[i])
        open_ = [i for i in open_ if i not in above]
        left -= sum(target[i] for i in above)
    return target


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length give the largest sum within the budget."""
    via = np.zeros(budget + 1, dtype=np.int64)
    got = np.zeros(budget + 1, dtype=bool)
    got[0] = True
    for length, count in zip(lengths, counts):
        if got[budget]:
            break
        if not 0 < length <= budget:
            continue
        used = np.where(got, 0, count)
        for begin in range(length, budget + 1, length):
            end = min(begin + length, budget + 1)
            new = ~got[begin:end] & got[begin - length : end - length] & (used[begin - length : end - length] < count)
            used[begin:end][new] = used[begin - length : end - length][new] + 1
            got[begin:end] |= new
            via[begin:end][new] = length
    at, out = int(np.flatnonzero(got)[-1]), {}
    while at:
        out[int(via[at])] = out.get(int(via[at]), 0) + 1
        at -= int(via[at])
    return out


def fit(lengths: list[int], counts: list[int], target: float, most: int) -> tuple[int, list[int]]:
    """Whole copies for every document, and how many documents of each length get one more."""
    total = sum(a * b for a, b in zip(lengths, counts))
    copies = min(most, int(target // total)) if total else 0
    budget = int(target - copies * total) if total and copies < most else 0
    extra = [b * budget // total if a and total else 0 for a, b in zip(lengths, counts)]
    left = budget - sum(a * e for a, e in zip(lengths, extra))
    order = sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: -lengths[i])
    table = max(KNAPSACK, min(LONGEST * max(lengths, default=0), TABLE))
    for i in order:
        if left > table:
            more = min(counts[i] - extra[i], (left - table) // lengths[i] + 1, left // lengths[i])
            extra[i] += more
            left -= more * lengths[i]
    order = [i for i in order if counts[i] > extra[i]]
    last = knapsack([lengths[i] for i in order], [counts[i] - extra[i] for i in order], left)
    gap = left - sum(a * b for a, b in last.items())
    if gap and any(extra):
        freed, room = list(extra), left
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            if lengths[i]:
                back = min(freed[i], max(0, table - room) // lengths[i])
                freed[i] -= back
                room += back * lengths[i]
        order = sorted((i for i in range(len(lengths)) if lengths[i] and counts[i] > freed[i]), key=lambda i: -lengths[i])
        again = knapsack([lengths[i] for i in order], [counts[i] - freed[i] for i in order], room)
        if room - sum(a * b for a, b in again.items()) < gap:
            extra, last = freed, again
    return copies, [e + last.get(a, 0) for a, e in zip(lengths, extra)]


def _mixed(docs: DataFrame, size: Column, weights: tuple[float, ...], fraction: float, most: int, seed: int) -> DataFrame:
    """The columns of ``docs`` by position (u0, u1, ...) and ``ADDED``."""
    place = {c: f"u{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    source = F.col(place["source"]).cast("string")
    text = F.col(place["text"]).cast("string") if "text" in place else F.lit(None).cast("string")
    lot = F.xxhash64(F.lit(seed), place["doc_id"], F.when(F.col(place["doc_id"]).isNull(), text))
    docs = docs.select("*", size).toDF(*[f"u{i}" for i in range(len(docs.columns))], "size")
    slices, rows = SLICES, docs.count()
    while slices * SLICE_ROWS < rows:
        slices *= 2
    docs = docs.withColumns({"no_source": source.isNull(), "source": F.coalesce(source, F.lit("")), "lot": lot, "slice": F.pmod(lot, F.lit(slices)).cast("int")})
    kind = ["no_source", "source", "size"]
    counts = keep(docs.groupBy(*kind, "slice").agg(F.count("*").alias("n")), "lengths")
    sources = {(r["no_source"], r["source"]): r["total"] for r in counts.groupBy("no_source", "source").agg(F.sum(F.expr("size * n")).alias("total")).collect()}
    names = sorted(sources)  # by code point, null last
    goal = dict(zip(names, shares([sources[x] for x in names], [weights[i % len(weights)] for i in range(len(names))], fraction, most)))

    def plan(pdf):
        pdf = pdf.sort_values("size")
        name = (bool(pdf["no_source"].iloc[0]), pdf["source"].iloc[0])
        copies, extra = fit(pdf["size"].tolist(), pdf["n"].tolist(), goal[name], most)
        return pdf[kind].assign(source_size=sources[name], target=goal[name], whole=copies, extra=extra)

    by_length = counts.groupBy(*kind).agg(F.sum("n").alias("n"))
    plans = by_length.groupBy("no_source", "source").applyInPandas(plan, "no_source boolean, source string, size long, source_size long, target double, whole long, extra long")
    plans = keep(plans, "plans")
    before = F.sum("n").over(Window.partitionBy(*kind).orderBy("slice")) - F.col("n")
    chosen = counts.withColumn("before", before).join(plans, kind).withColumn("take", F.expr("least(greatest(extra - before, 0), n)"))
    chosen = keep(chosen.select(*kind, "slice", "source_size", "target", "whole", "take"), "slices")
    # The window's keys are the join's keys, without nulls, so that the texts are shuffled once for both.
    rank = F.row_number().over(Window.partitionBy(*kind, "slice").orderBy("lot", place["doc_id"], F.xxhash64(text)))
    copies = F.expr("whole + cast(rank <= take as int)")
    return docs.withColumn("rank", rank).join(chosen, [*kind, "slice"]).select(*[c for c in docs.columns if c.startswith("u")], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), fraction: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``.

    ``docs`` has doc_id, source and either text or a ready ``size``. One row per source reaches
    the driver; every document keeps its row, with the number of copies that the mix takes.
    """
    size = F.col("size").cast("long") if "size" in docs.columns else n_words(F.col("text").cast("string"))
    out = _mixed(docs, size, weights, fraction, most, seed)
    return out.select(*[F.col(f"u{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ADDED], *ADDED)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), fraction: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in its own columns."""
    out = _mixed(docs, n_words(F.col("text").cast("string")), weights, fraction, most, seed)
    out = out.withColumn("copies", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
    return out.select(*[F.col(f"u{i}").alias(c) for i, c in enumerate(docs.columns)])
