"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Items of like length (to a power of two) form a group, so that one long item does not change how
others are found. For each group a document is cut into overlapping passages, wide enough that each
of the group's items lies whole inside one of them; every passage is a query. The index holds the
items' impacts, divided by what the item scores against itself, so one threshold fits long and
short items. For each term it keeps the largest impact overall and in each block of ``BLOCK`` items.

A passage whose terms' largest impacts cannot reach the threshold is dropped, and then one of which no
block's maxima can, for many passages at once. The others run block-max WAND: cursors on the terms' postings stand in item order,
the pivot is the first item that the largest impacts up to it can lift over the threshold, the block
maxima then either skip to the next block or let the item be scored. All items at or above the
threshold are retrieved.

A retrieved item counts when the passage also holds enough of its question and of its answer:
the share of their word pairs found in the passage. The answer is the last sentence, or the
last quarter of the words where there is only one sentence.

Items come in parts of at most ``PART_BYTES`` of text, each a pass over the documents, so what
is broadcast stays bounded; document frequencies always cover all items.

Nulls and odd input: null or empty items and texts match nothing. Repeated items each match.
Without items no document matches. Rows with a null doc_id are searched like any other. Very long
texts are searched whole, passage by passage. Ties between passages of equal score go to the first.
Columns of the input besides doc_id and text are ignored by ``contaminated`` and kept by
``decontaminated``, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded, keep
from .textkit import Words, chunks, text_bytes, tidy, words_of

K1, B = 1.2, 0.75
BLOCK, END = 16, 1 << 62
CELLS = 1 << 20  # passages times blocks that are bounded at once
PART_BYTES = 16 << 20
_SENTENCE = re.compile(r"[.!?]\s+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64


@dataclass
class Group:
    """Items of like length: postings and block maxima by term, as offsets into parallel arrays."""

    longest: int
    peak: np.ndarray  # largest impact of each term, 0 where the group has none
    first: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray
    block: np.ndarray
    block_peak: np.ndarray


@dataclass
class Index:
    """The groups over one sorted table of terms (word hashes)."""

    ids: list[int]
    terms: np.ndarray
    groups: list[Group]
    question: list[np.ndarray]  # word pairs of each item
    answer: list[np.ndarray]


def pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; a single word stands for itself."""
    return np.unique(h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h


def split_item(text: str, n: int) -> int:
    """Words of the question, of n words in all."""
    ends = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    head = len(_WORD.findall(text[: ends[-1]])) if ends else 0
    return head if 0 < head < n else n - max(1, n // 4)


def build(rows: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_len: float) -> Index:
    words = [words_of([t.encode()]) for _, t in rows]
    all_terms = np.unique(np.concatenate([w.hashes for w in words]))
    postings: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    question, answer, longest = [], [], {}
    for i, (w, (_, text)) in enumerate(zip(words, rows)):
        terms, tf = np.unique(w.hashes, return_counts=True)
        idf = np.log(1 + (n_items - (d := np.array([df[int(t)] for t in terms.view(np.int64)])) + 0.5) / (d + 0.5))
        score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w.hashes) / mean_len))
        size = len(w.hashes).bit_length()
        longest[size] = max(longest.get(size, 0), len(w.hashes))
        postings.setdefault(size, []).append((np.searchsorted(all_terms, terms), np.full(len(terms), i), score / score.sum()))
        cut = split_item(text, len(w.hashes))
        question.append(pairs(w.hashes[:cut]))
        answer.append(pairs(w.hashes[cut:]) if cut < len(w.hashes) else question[-1])
    groups = []
    for size, own in sorted(postings.items()):
        term, item, value = (np.concatenate(x) for x in zip(*own))
        order = np.lexsort((item, term))
        term, item, value = term[order], item[order], value[order]
        every = np.arange(len(all_terms) + 1)
        peak = np.zeros(len(all_terms))
        np.maximum.at(peak, term, value)
        head = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)])
        groups.append(Group(longest[size], peak, np.searchsorted(term, every), item, value, np.searchsorted(term[head], every), item[head] // BLOCK, np.maximum.reduceat(value, head)))
    return Index([i for i, _ in rows], all_terms, groups, question, answer)


def wand(group: Group, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """The items that score at least the threshold against a passage with these terms, and their scores."""
    items, impacts, peaks, blocks, maxima, at, block_at = [], [], [], [], [], [], []
    for t in terms:
        a, b = int(group.first[t]), int(group.first[t + 1])
        if a < b:
            c, d = int(group.block_first[t]), int(group.block_first[t + 1])
            items.append([*group.item[a:b].tolist(), END])
            impacts.append(group.impact[a:b].tolist())
            blocks.append([*group.block[c:d].tolist(), END])
            maxima.append([*group.block_peak[c:d].tolist(), 0.0])
            peaks.append(float(group.peak[t]))
            at.append(0)
            block_at.append(0)
    least, found = threshold - 1e-9, []

    def move(k: int, item: int) -> None:
        own = items[k]
        at[k] = bisect_left(own, item, at[k])

    order = list(range(len(items)))
    while order:
        order.sort(key=lambda k: items[k][at[k]])
        while order and items[order[-1]][at[order[-1]]] == END:
            order.pop()
        bound, pivot = 0.0, -1
        for i, k in enumerate(order):
            bound += peaks[k]
            if bound >= least:
                pivot = i
                break
        if pivot < 0:
            break
        item = items[order[pivot]][at[order[pivot]]]
        while pivot + 1 < len(order) and items[order[pivot + 1]][at[order[pivot + 1]]] == item:
            pivot += 1
        block, bound = item // BLOCK, 0.0
        for k in order[: pivot + 1]:
            block_at[k] = bisect_left(blocks[k], block, block_at[k])
            if blocks[k][block_at[k]] == block:
                bound += maxima[k][block_at[k]]
        if bound < least:  # no item of this block before the next cursor can do
            after = (block + 1) * BLOCK
            if pivot + 1 < len(order):
                after = min(after, items[order[pivot + 1]][at[order[pivot + 1]]])
            for k in order[: pivot + 1]:
                move(k, after)
        elif items[order[0]][at[order[0]]] == item:
            score = sum(impacts[k][at[k]] for k in order[: pivot + 1])
            if score >= least:
                found.append((item, score))
            for k in order[: pivot + 1]:
                at[k] += 1
        else:
            for k in order[:pivot]:
                if items[k][at[k]] < item:
                    move(k, item)
    return found


def search(index: Index, words: Words, threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """Begin and end word of each passage that retrieves an item, the item, and its score."""
    place = np.minimum(np.searchsorted(index.terms, words.hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == words.hashes)
    if not len(known):
        return
    counts, first = words.counts, words.first[:-1]
    for group in index.groups:
        step, width = group.longest, 2 * group.longest
        # Bound by all known words of a passage, repeats included, from running sums.
        peaks = np.zeros(len(words.hashes) + 1)
        peaks[known + 1] = group.peak[place[known]]
        peaks = np.cumsum(peaks)
        n = np.maximum(1, -(-(counts - width) // step) + 1) * (counts > 0)
        owner = np.repeat(np.arange(len(counts)), n)
        begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * step
        end = np.minimum(begin + width, words.first[owner + 1])
        alive = np.flatnonzero(peaks[end] - peaks[begin] >= threshold - 1e-6)
        # Slices of passages, so that the table of block bounds below stays small however many items there are.
        blocks = int(group.block.max()) + 1 if len(group.block) else 1
        for i in range(0, len(alive), max(1, CELLS // blocks)):
            part = alive[i : i + max(1, CELLS // blocks)]
            passage, term = _promising(index, group, known, place, begin[part], end[part], blocks, threshold)
            head = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else passage
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(passage)]):
                at = part[passage[a]]
                for item, score in wand(group, term[a:b].tolist(), threshold):
                    yield int(begin[at]), int(end[at]), item, score


def _promising(index: Index, group: Group, known: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray, blocks: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Passages, with each of their terms, of which some block's maxima reach the threshold."""
    lo, n = np.searchsorted(known, begin), np.searchsorted(known, end)
    n -= lo
    passage = np.repeat(np.arange(len(begin)), n)
    at = np.arange(len(passage)) - np.repeat(np.cumsum(n) - n, n) + lo[passage]
    term = place[known[at]]
    use = group.peak[term] > 0
    both = np.unique(passage[use] * len(index.terms) + term[use])
    passage, term = both // len(index.terms), both % len(index.terms)
    use = (np.bincount(passage, group.peak[term], minlength=len(begin)) >= threshold - 1e-9)[passage]
    passage, term = passage[use], term[use]
    count = group.block_first[term + 1] - group.block_first[term]
    row = np.repeat(np.arange(len(term)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + group.block_first[term][row]
    bound = np.bincount(passage[row] * blocks + group.block[at], group.block_peak[at], minlength=len(begin) * blocks)
    use = (bound.reshape(-1, blocks) >= threshold - 1e-9).any(axis=1)[passage]
    return passage[use], term[use]


@dataclass(frozen=True)
class Rule:
    """Least share of the item's own BM25 score, and of its question's and answer's word pairs."""

    threshold: float = 0.6
    question: float = 0.6
    answer: float = 0.5


def matches(index: Index, words: Words, rule: Rule) -> dict[tuple[int, int], tuple[float, float, float, int]]:
    """(row, item place) -> score, question and answer overlap, begin word within the text."""
    out: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for b, e, item, score in search(index, words, rule.threshold):
        have = pairs(words.hashes[b:e]) if e - b > 1 else words.hashes[b:e]
        single = words.hashes[b:e]
        share = [float(np.isin(x, have if len(x) > 1 or e - b == 1 else np.concatenate([have, single])).mean()) for x in (index.question[item], index.answer[item])]
        if share[0] >= rule.question and share[1] >= rule.answer:
            row = int(np.searchsorted(words.first, b, side="right")) - 1
            key = (words.rows[row], int(item))
            if key not in out or score > out[key][0]:
                out[key] = (float(score), share[0], share[1], int(b - words.first[row]))
    return out


def indexes(benchmark: DataFrame) -> list:
    """The items' index, in broadcast parts of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(f"text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(text_bytes(batch.column("text"))):
                hashes, owner = words.hashes.view(np.int64), words.owner
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.arange(len(owner)) == words.first[owner])], names=["h", "head"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(text_bytes(batch.column("text"))):
                for a, b in zip(words.first, words.first[1:]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(words.hashes[a:b]).view(np.int64))], names=["h"])

    size = items.mapInArrow(terms, "h long, head boolean").agg(F.count("*").alias("words"), F.sum(F.col("head").cast("long")).alias("items")).first()
    if not size["items"]:
        return []
    total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = -(-total // PART_BYTES)
    numbered = items.withColumn("part", F.expr(f"pmod(xxhash64(item_id, text), {parts})"))
    frequency = keep(items.mapInArrow(distinct, "h long").groupBy("h").agg(F.count("*").alias("df")), "frequency")
    out = []
    for part in range(parts):
        own = numbered.where(F.col("part") == part)
        rows = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        if rows:
            df = frequency.join(own.mapInArrow(distinct, "h long").distinct(), "h", "left_semi")
            index = build(rows, {r["h"]: r["df"] for r in df.collect()}, size["items"], size["words"] / size["items"])
            out.append(spark.sparkContext.broadcast(index))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap, begin_word`` of every match."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, begin_word long"
    docs = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = None
    for held in indexes(benchmark):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for words in chunks(text_bytes(batch.column("text"))):
                    found = [(ids[row], index.ids[item], *x) for (row, item), x in sorted(matches(index, words, rule).items())]
                    if found:
                        cols = list(zip(*found))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64()])], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "begin_word"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    at = bounded(docs).columns.index("text")
    for held in indexes(benchmark):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for words in chunks(text_bytes(batch.column(at))):
                    for row, _ in matches(held.value, words, rule):
                        clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
