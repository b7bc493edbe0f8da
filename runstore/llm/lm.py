"""Language-model scores: a causal self-attention model over subword ids, and a unigram base.

Words are lower-cased (A-Z) runs of non-space bytes, with one end token after the last. The base
score is their smoothed unigram log-probability, from exact counts over all training documents.

The model reads the subword ids of a fixed public vocabulary. A place's row is the sum of what its
id and the id before it bring. One layer of masked single-head attention over at most ``KEYS`` rows
has a query at each ``EVERY``-th place; a target takes what the last query saw and the row of its own
place, which holds the ids since then, to a hidden layer. That feeds a softmax of two levels: over
``GROUPS`` groups, then over the ``SLOTS`` classes of the target's group. The most frequent ids
are classes of their own, and the rest share the last group's classes by frequency in equal
mass; the probability of an id in a shared class comes from subword counts over all training
documents. The weights start from a short training in numpy on the driver, on about ``train_docs``
whole documents drawn by a hash of doc_id. Then all training documents teach, with every block:
a hash of doc_id and place deals each to one of the ``ROUNDS`` (only one in ``share``, where a caller
asks for more than 1); in each, every task takes Adam steps over its own blocks, and the tasks'
weights are averaged by their numbers of targets. A task's state is the weights, whatever it reads. Scoring cuts the ids into
blocks of ``STRIDE`` targets; every block sees the ``BEFORE`` ids before it as well, so windows
overlap and each id is scored once. Blocks of all texts of a chunk are scored as one batch.

Word counts grow with the corpus and stay distributed: the at most ``HEAD`` most frequent words
are broadcast, the others are joined.

Nulls and odd input: a null text is empty and holds the end token alone. Rows with a null doc_id
are scored but not learned from. Repeated rows give repeated results. Without training text
every count is 0 and the model keeps its first weights. A very long text is scored whole, in as
many blocks as it needs. Ties in frequency go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded, keep
from .textkit import Words, chunks, mix, text_bytes, tidy, vocabulary_bytes

GROUPS, SLOTS, INPUTS, HASHED = 32, 32, 2048, 256
PART = 256  # blocks that are scored at once
ROUNDS = (0.02, 0.003)  # rate of each round over its part of the blocks
STEP = 256  # blocks of a step in a round
ROW = 8192  # blocks that are stored as one
TEXT_CHUNK = 1 << 20
CAP, TINY = np.float32(60), np.float32(1e-30)
STRIDE, BEFORE = 32, 9
WINDOW = BEFORE + STRIDE
KEYS = WINDOW - 1  # the first id of a window is only the one before its first row
EVERY = 2  # more would hide ids from some targets
DIM, HIDDEN = 16, 24  # one of the hidden values is a constant
HEAD = 1 << 18
END_WORD = int(mix(np.array([0x0E0D], dtype=np.uint64)).view(np.int64)[0])
CACHE = 400_000  # some 15 MB
HELD_OUT = 1
_U = np.uint64


def _kinds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``np.unique``: distinct values, a place of each, and which each has; by a sort that need not be stable and is faster."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


class Subwords:
    """Ids of words; each distinct word is segmented once while it stays in the cache of ``CACHE`` words."""

    def __init__(self, vocabulary: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        self.size = self.model.get_piece_size()
        self._clear()

    @classmethod
    def held(cls, vocabulary: bytes) -> Subwords:
        """The one of this process, whose cache the next task finds as this one leaves it."""
        key = (len(vocabulary), zlib.crc32(vocabulary))
        if key not in _held:
            _held.clear()
            _held[key] = cls(vocabulary)
        return _held[key]

    def _clear(self) -> None:
        self.keys, self.flat = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int32)
        self.begin, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the chunk in order, the number of each word's ids, the distinct hashes, and which of them each word has."""
        kinds, first, inverse = _kinds(words.hashes)
        if len(self.keys) > CACHE:
            self._clear()
        at = np.searchsorted(self.keys, kinds)
        missing = np.append(self.keys, _U(0))[at] != kinds
        missing |= at == len(self.keys)
        if len(new := np.flatnonzero(missing)):
            word = first[new]
            # One text of the words, which hold no space, is decoded faster than each of them.
            text = b" ".join([words.data[a:b] for a, b in zip(words.starts[word].tolist(), words.ends[word].tolist())])
            coded = self.model.encode(text.decode("utf-8", "replace").split(" "), num_threads=1)
            n = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
            if not n.all():
                coded, n = [x or [0] for x in coded], np.maximum(n, 1)
            self.keys = np.insert(self.keys, at[new], kinds[new])
            self.begin = np.insert(self.begin, at[new], len(self.flat) + np.cumsum(n) - n)
            self.n = np.insert(self.n, at[new], n)
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(coded), dtype=np.int32, count=int(n.sum()))])
            at += np.cumsum(missing) - missing  # each moves on by the new ones before it
        begin, count = self.begin[at][inverse], self.n[at][inverse]
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        return self.flat[place], count, kinds, inverse


_held: dict[tuple[int, int], Subwords] = {}


@dataclass
class Model:
    """Weights, and how ids map to inputs and classes. Id ``size`` ends (and begins) a text."""

    input_of: np.ndarray
    class_of: np.ndarray
    log_in_class: np.ndarray  # log10 of the id's share of its class
    w: dict[str, np.ndarray]


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """input_of, class_of and log10 p(id | class) from subword counts (the last is the end)."""
    n, own = len(counts), (GROUPS - 1) * SLOTS
    order = np.lexsort((np.arange(n), -counts))
    smooth = counts + 0.5
    class_of = np.empty(n, dtype=np.int64)
    class_of[order[:own]] = np.arange(min(own, n))
    rest = order[own:]
    if len(rest):
        mass = np.cumsum(smooth[rest])
        class_of[rest] = own + np.minimum((mass - smooth[rest]) / mass[-1] * SLOTS, SLOTS - 1).astype(np.int64)
    input_of = INPUTS + (mix(np.arange(n, dtype=_U)) % _U(HASHED)).astype(np.int64)
    input_of[order[:INPUTS]] = np.arange(min(INPUTS, n))
    input_of[n - 1] = INPUTS + HASHED
    total = np.bincount(class_of, smooth, minlength=GROUPS * SLOTS)
    return input_of, class_of, np.log10(smooth / total[class_of])


def blocks(ids: np.ndarray, first: np.ndarray, end_id: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text of each block, its begin in there, and its ids from ``BEFORE + 1`` before the begin on.

    ``ids`` holds each text's ids followed by ``end_id``; ``first`` their offsets. The end id also
    stands before a text's begin; -1 where there is nothing. ``some`` picks blocks, else all are made.
    """
    text, begin = starts(first)
    if some is not None:
        text, begin = text[some], begin[some]
    place = begin[:, None] + np.arange(-BEFORE - 1, STRIDE)
    out = ids[np.clip(first[text][:, None] + place, 0, max(0, len(ids) - 1))]
    out = np.where(place < 0, np.where(place == -1, end_id, -1), np.where(place < np.diff(first)[text][:, None], out, -1))
    return text, begin, out.astype("<i4")


def starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and begin of every block."""
    each = -(-np.diff(first) // STRIDE)
    text = np.repeat(np.arange(len(each)), each)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * STRIDE


def lesson(model: Model, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, which places are real, and target classes of blocks."""
    real = pieces[:, 1:] >= 0
    real[:, BEFORE - 1] &= pieces[:, BEFORE] != len(model.class_of) - 1  # the end id before a text is no place of it
    return model.input_of.take(pieces[:, :-1]), real, model.class_of.take(pieces[:, BEFORE + 1 :])


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    s = 1 / math.sqrt(DIM)
    shapes = {"e": (INPUTS + HASHED + 1, 2 * DIM), "p": (KEYS, DIM), "q": (DIM, DIM), "h": (DIM, HIDDEN), "s": (DIM, HIDDEN), "u": (HIDDEN, GROUPS), "u2": (GROUPS, HIDDEN, SLOTS)}
    w = {k: rng.normal(0, s, x).astype(np.float32) for k, x in shapes.items()}
    w["q"] *= np.float32(s)
    return w


_MASK = np.where(np.arange(KEYS)[None, :] < (np.arange(0, STRIDE, EVERY) + BEFORE)[:, None], np.float32(0), np.float32(-1e30))

_ZEROS = np.zeros(HIDDEN, dtype=np.float32)


def _cap(logits: np.ndarray) -> None:
    if logits.max(initial=0) > CAP:  # seldom so, and much faster to find than to cap
        np.minimum(logits, CAP, out=logits)


def _exp(logits: np.ndarray) -> None:
    _cap(logits)
    np.exp(logits, out=logits)


def _forward(w, inputs: np.ndarray, heads: np.ndarray):
    """The hidden rows of the targets, last, and what their gradient needs; ``heads`` are the blocks that begin a text.

    Queries after a text's end see what lies there; no target stands at them.
    """
    n = len(inputs)
    here, after = (np.ascontiguousarray(w["e"][:, i : i + DIM]) for i in (0, DIM))
    x = here.take(inputs[:, 1:], axis=0)
    x += after.take(inputs[:, :-1], axis=0)
    x += w["p"]
    late = x[:, BEFORE - 1 :].reshape(-1, DIM)
    asks = late[::EVERY]
    q = (asks @ w["q"]).reshape(n, -1, DIM)
    turned = np.ascontiguousarray(x.transpose(0, 2, 1))
    z = np.matmul(q, turned)
    z += _MASK
    z[heads, :, : BEFORE - 1] = -1e30
    _exp(z)
    total = 1 / (z.reshape(-1, KEYS) @ np.ones(KEYS, dtype=z.dtype) + TINY)
    seen = np.matmul(z, x).reshape(-1, DIM)
    seen *= total[:, None]
    top = late @ w["h"]
    several = top.reshape(-1, EVERY * HIDDEN)
    several += seen @ np.tile(w["s"], EVERY)
    np.maximum(top, _ZEROS, out=top)  # a row of zeros, since a single one is compared value by value
    top[:, -1] = 1  # brings in the classes' own weights
    return x, turned, late, asks, q, z, total, seen, top


def _attend(w, inputs: np.ndarray, real: np.ndarray):
    *parts, top = _forward(w, inputs, np.flatnonzero(~real[:, BEFORE - 1]))
    return *parts, top.reshape(len(inputs), STRIDE, HIDDEN)


def _sorted_groups(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the rows by group, and each group with its rows' begin and end in there."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))]).tolist()
    return order, [(g, edge[g], edge[g + 1]) for g in range(GROUPS) if edge[g] < edge[g + 1]]


def _logits(w, top: np.ndarray, cls: np.ndarray, at: np.ndarray | None = None):
    """Rows of ``top``, those ``at`` or all, by their classes' groups; their order; the groups' edges; logits of both levels."""
    order, edges = _sorted_groups(cls // SLOTS)
    t = top.take(order if at is None else at[order], axis=0)
    coarse, fine = t @ w["u"], np.empty((len(order), SLOTS), dtype=top.dtype)
    for g, begin, end in edges:
        np.matmul(t[begin:end], w["u2"][g], out=fine[begin:end])
    return t, order, edges, coarse, fine


def _log_target(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log-softmax at the target of each row; overwrites the logits.

    Trained logits lie within a few tens, so a cap stands in for the usual shift by the maximum.
    """
    _cap(logits)
    chosen = logits.ravel()[np.arange(len(target)) * logits.shape[1] + target]
    np.exp(logits, out=logits)
    return chosen - np.log(logits @ np.ones(logits.shape[1], dtype=logits.dtype) + TINY)


def _log_class(w, top: np.ndarray, cls: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Natural log-probability of the class of each row of ``top``, or of those ``at``."""
    _, order, _, coarse, fine = _logits(w, top, cls, at)
    ordered, out = cls[order], np.empty(len(order), dtype=top.dtype)
    out[order] = _log_target(coarse, ordered // SLOTS) + _log_target(fine, ordered % SLOTS)
    return out


def _errors(logits: np.ndarray, target: np.ndarray, n: np.float32) -> float:
    """Loss of the targets; overwrites the logits by its gradient over ``n``."""
    _exp(logits)
    logits *= (1 / (logits @ np.full(logits.shape[1], n, dtype=logits.dtype) + TINY))[:, None]
    flat, at = logits.ravel(), np.arange(len(target)) * logits.shape[1] + target
    p = flat[at]
    flat[at] = p - 1 / n
    return -float(np.log(p * n + TINY).sum())


def _sums(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A table of ``size`` rows, each the sum of the ``rows`` that lie ``at`` it."""
    at = at.astype(np.uint16)
    order = np.argsort(at, kind="stable")
    kinds = at[order]
    edge = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    out = np.zeros((size, rows.shape[1]), dtype=rows.dtype)
    twos = np.result_type(rows.dtype, np.complex64)  # adds two numbers at once
    out[kinds[edge]] = np.add.reduceat(rows.take(order, axis=0).view(twos), edge, axis=0).view(rows.dtype)
    return out


def gradients(w, inputs, real, classes) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the real targets, and its gradient."""
    x, turned, late, asks, q, z, total, seen, top = _forward(w, inputs, np.flatnonzero(~real[:, BEFORE - 1]))
    at = np.flatnonzero(real[:, BEFORE:])
    n, cls = np.float32(max(1, len(at))), classes.ravel()[at]
    t, order, edges, d, fine = _logits(w, top, cls, at)
    cls = cls[order]
    loss = _errors(d, cls // SLOTS, n) + _errors(fine, cls % SLOTS, n)
    g = {"u": t.T @ d, "u2": np.zeros((GROUPS, HIDDEN, SLOTS), dtype=top.dtype)}
    dt, more, back = np.zeros((len(t) + 1, HIDDEN), dtype=top.dtype), np.empty((len(t), HIDDEN), dtype=top.dtype), np.ascontiguousarray(w["u2"].transpose(0, 2, 1))
    for i, begin, end in edges:
        part = fine[begin:end]
        np.matmul(t[begin:end].T, part, out=g["u2"][i])
        np.matmul(part, back[i], out=more[begin:end])
    np.matmul(d, w["u"].T, out=dt[:-1])
    dt[:-1] += more
    dt[:-1] *= t > 0
    dt[:, -1] = 0
    place = np.full(len(top), len(t))  # the row of zeros, where no target is
    place[at[order]] = np.arange(len(t))
    dtop = dt.take(place, axis=0)
    g["h"], dlate = late.T @ dtop, dtop @ w["h"].T
    several = dtop.reshape(-1, EVERY * HIDDEN)
    g["s"] = (seen.T @ several).reshape(DIM, EVERY, HIDDEN).sum(axis=1)
    # By the attention's unscaled weights z: what is seen is their product with the rows x over their total.
    dseen = several @ np.tile(w["s"], EVERY).T
    dseen *= total[:, None]
    less = (dseen * seen) @ np.ones(DIM, dtype=top.dtype)
    dseen = dseen.reshape(q.shape)
    dx = np.matmul(z.transpose(0, 2, 1), dseen)
    dz = np.matmul(dseen, turned)
    dz -= less.reshape(len(inputs), -1, 1)
    dz *= z
    dx += np.matmul(dz.transpose(0, 2, 1), q)
    dq = np.matmul(dz, x).reshape(-1, DIM)
    g["q"] = asks.T @ dq
    dlate[::EVERY] += dq @ w["q"].T
    dx[:, BEFORE - 1 :] += dlate.reshape(len(inputs), STRIDE, DIM)
    dpair = np.empty((len(inputs), KEYS + 1, 2 * DIM), dtype=top.dtype)
    dpair[:, 0, :DIM] = dpair[:, -1, DIM:] = 0
    dpair[:, 1:, :DIM] = dx
    dpair[:, :-1, DIM:] = dx
    g["p"], g["e"] = dx.sum(axis=0), _sums(dpair.reshape(-1, 2 * DIM), inputs.ravel(), len(w["e"]))
    return loss / float(n), g


class Adam:
    """Steps that change the weights ``w`` in place."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.t = w, 0
        self.m, self.s = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        """One step; the gradients are overwritten."""
        self.t += 1
        late = math.sqrt(1 - 0.99**self.t)
        for k, x in g.items():
            m, s = self.m[k], self.s[k]
            change = x - m
            change *= 0.1
            m += change
            x *= x
            x -= s
            x *= 0.01
            s += x
            np.sqrt(s, out=change)
            change += 1e-8 * late
            np.divide(m, change, out=change)
            change *= rate * late / (1 - 0.9**self.t)
            self.w[k] -= change


def train(counts: np.ndarray, texts: list[np.ndarray], steps: int = 1600, batch: int = 48, seed: int = 7) -> Model:
    """A model from subword counts and the ids of the sample's texts, each with its end id."""
    rng = np.random.default_rng(seed)
    input_of, class_of, log_in_class = layout(counts)
    w = fresh(rng)
    end_id = len(counts) - 1
    share = np.bincount(class_of, counts + 0.5, minlength=GROUPS * SLOTS).reshape(GROUPS, SLOTS) + 1e-3
    w["u"][-1], w["u2"][:, -1] = np.log(share.sum(axis=1)), np.log(share)
    if texts:
        first = np.cumsum([0, *map(len, texts)])
        inputs, real, classes = lesson(Model(input_of, class_of, log_in_class, w), blocks(np.concatenate(texts), first, end_id)[2])
        adam = Adam(w)
        for t in range(1, steps + 1):
            at = rng.integers(0, len(inputs), batch)
            _, g = gradients(w, inputs[at], real[at], classes[at])
            adam.step(g, 0.02 * min(1, t / 50) * (1 - 0.9 * t / steps))
    return Model(input_of, class_of, log_in_class, w)


class Scorer:
    """Scores of texts by a model."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text, given as in ``blocks``."""
        model, n = self.model, np.diff(first)
        end_id = len(model.class_of) - 1
        each = np.empty(len(ids))
        feed = np.empty(len(ids) + BEFORE, dtype=np.int64)
        feed[:BEFORE] = model.input_of[end_id]
        feed[BEFORE + 1 :] = model.input_of[ids[:-1]]
        feed[BEFORE + first[:-1]] = model.input_of[end_id]
        cls = model.class_of[ids]
        text, begin = starts(first)
        at = begin + first[:-1][text]
        for i in range(0, len(text), PART):
            part = slice(i, i + PART)
            place = at[part][:, None] + np.arange(-BEFORE, STRIDE)
            inputs, heads = feed.take(place + BEFORE, mode="clip"), np.flatnonzero(begin[part] == 0)
            inputs[heads, :BEFORE] = model.input_of[end_id]
            top = _forward(model.w, inputs, heads)[-1]
            real = np.flatnonzero((begin[part][:, None] + np.arange(STRIDE) < n[text[part]][:, None]).ravel())
            where = place[:, BEFORE:].ravel()[real]
            each[where] = _log_class(model.w, top, cls.take(where), real)
        each /= math.log(10)
        each += model.log_in_class[ids]
        total = np.concatenate([[0], np.cumsum(each)])
        return total[first[1:]] - total[first[:-1]]


def log10_texts(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return Scorer(model)(ids, first)


def with_ends(subwords: Subwords, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's ids with the end id after each text, the texts' offsets, the distinct words' hashes, and each word's place among them."""
    ids, count, kinds, inverse = subwords.ids(words)
    total = np.concatenate([[0], np.cumsum(count)])[words.first]
    out = np.insert(ids, total[1:], subwords.size)
    return out, total + np.arange(len(total)), kinds, inverse


_GATHERED = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("round", pa.int32()), ("blocks", pa.binary())])


def _row(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _GATHERED], schema=_GATHERED)


def _packed(pieces: np.ndarray, size: int) -> bytes:
    """Blocks by two bytes an id where they hold all ids; the greatest number stands for -1."""
    return pieces.astype("<u2" if size < 65535 else "<u4").tobytes()


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    kind = np.dtype("<u2" if size < 65535 else "<u4")
    pieces = np.frombuffer(packed, dtype=kind).reshape(-1, WINDOW + 1)
    return np.where(pieces == np.iinfo(kind).max, -1, pieces.astype(np.int32))


def _gathered(vocabulary, share: int) -> Callable:
    """Word counts (h, n) of each task, its subword counts (counts), and the blocks that teach in each round."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, ends = Subwords.held(vocabulary.value), 0
        pieces = np.zeros(subwords.size + 1, dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            h, n = (np.concatenate(x) for x in zip(*held))
            kinds, inverse = np.unique(h, return_inverse=True)
            return kinds, np.bincount(inverse, n, minlength=len(kinds)).astype(np.int64)

        for batch in batches:
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for words in chunks(text_bytes(batch.column("text")), TEXT_CHUNK):
                ids, first, kinds, inverse = with_ends(subwords, words)
                pieces += np.bincount(ids, minlength=len(pieces))
                ends += len(words.rows)
                text, begin = starts(first)
                lot = mix(docs[words.rows.start + text].astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15) + begin.astype(_U)) % _U(share * len(ROUNDS))
                for i in range(len(ROUNDS)):
                    some = np.flatnonzero(lot == i)
                    for at in range(0, len(some), ROW):
                        yield _row(round=[i], blocks=[_packed(blocks(ids, first, subwords.size, some[at : at + ROW])[2], subwords.size)])
                held.append((kinds, np.bincount(inverse, minlength=len(kinds))))
                if sum(len(x) for x, _ in held) > 1_000_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 500_000:
                        kinds, n = held.pop()
                        yield _row(h=kinds.view(np.int64), n=n)
        if held:
            kinds, n = merged()
            yield _row(h=kinds.view(np.int64), n=n)
        if ends:
            yield _row(h=[END_WORD], n=[ends])
            yield _row(counts=[pieces.tobytes()])

    return run


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _learned(held, rate: float) -> Callable:
    """Each task's weights after its blocks times its number of targets (w), and that number (n)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        w = {k: x.copy() for k, x in model.w.items()}
        adam, rng, n = Adam(w), np.random.default_rng(7), 0
        left = np.zeros((0, WINDOW + 1), dtype=np.int32)

        def step(pieces: np.ndarray) -> int:
            inputs, real, classes = lesson(model, pieces)
            _, g = gradients(w, inputs, real, classes)
            adam.step(g, rate * min(1, (adam.t + 1) / 20) * len(inputs) / STEP)
            return int(np.count_nonzero(real[:, BEFORE:]))

        for batch in batches:
            new = np.concatenate([left, *(_unpacked(x.as_buffer(), len(model.class_of) - 1) for x in batch.column("blocks"))])
            new, whole = new[rng.permutation(len(new))], len(new) // STEP * STEP
            n += sum(step(new[i : i + STEP]) for i in range(0, whole, STEP))
            left = new[whole:].copy()
        n += step(left) if len(left) else 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(_flat(w).astype(np.float64) * n).tobytes()], pa.binary())], names=["n", "w"])

    return run


@tidy
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of n and w over a task's rows, one row at a time."""
    n, total = 0, None
    for batch in batches:
        for count, w in zip(batch.column("n").to_pylist(), batch.column("w")):
            one = np.frombuffer(w.as_buffer(), dtype=np.float64)
            n, total = n + count, one.copy() if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])


def refine(gathered: DataFrame, model: Model) -> Model:
    """The model after every round over the blocks of ``gathered`` (round, blocks), learned from where they lie."""
    spark = gathered.sparkSession
    for i, rate in enumerate(ROUNDS):
        held = spark.sparkContext.broadcast(model)
        learned = keep(gathered.where(F.col("round") == i).select("blocks").mapInArrow(_learned(held, rate), "n long, w binary"), "learned")
        # One row of weights per task; streamed sums over 16 partitions keep any one task and the driver small.
        parts = learned.repartition(16).mapInArrow(_added, "n long, w binary").collect()
        if parts:
            mean = np.sum([np.frombuffer(r["w"]) for r in parts], axis=0) / sum(r["n"] for r in parts)
            model = Model(model.input_of, model.class_of, model.log_in_class, _shaped(mean, model.w))
        held.unpersist()
    return model


def _total(pdf):
    import pandas as pd

    return pd.DataFrame({"counts": [np.sum([np.frombuffer(x, dtype=np.int64) for x in pdf["counts"]], axis=0).tobytes()]})


def score(docs: DataFrame, model_file: str, train_docs: int = 1000, share: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    docs = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    vocabulary = spark.sparkContext.broadcast(vocabulary_bytes(model_file))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    training = docs.where(fold != HELD_OUT)

    gathered = keep(training.mapInArrow(_gathered(vocabulary, share), "h long, n long, counts binary, round int, blocks binary"), "gathered")
    counts = keep(gathered.where("h is not null").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    spectrum = sorted((r["n"], r["count"]) for r in counts.groupBy("n").count().collect())
    n_all, n_kinds = sum(a * b for a, b in spectrum), sum(b for _, b in spectrum)
    least, held = (spectrum[-1][0] + 1 if spectrum else 1), 0
    for n, k in reversed(spectrum):
        held += k
        if held > HEAD:
            break
        least = n
    head = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(head["h"].to_numpy().view(_U))
    head_h, head_n = head["h"].to_numpy().view(_U)[order], head["n"].to_numpy()[order]

    # One row of subword counts per task; partial sums over 64 groups keep any one task small.
    pieces = gathered.where("counts is not null").select("counts", F.expr("cast(pmod(hash(counts), 64) as int)").alias("g")).groupBy("g").applyInPandas(_total, "counts binary").collect()
    subwords, texts = Subwords(vocabulary.value), []
    size = subwords.size
    pieces = sum((np.frombuffer(r["counts"], dtype=np.int64) for r in pieces), np.zeros(size + 1, dtype=np.int64))

    n_training = int(pieces[size])
    rate = min(1.0, train_docs / max(1, n_training))
    sample = training.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < rate).distinct().orderBy("doc_id", "text").collect()
    for r in sample:
        for words in chunks([(r["text"] or "").encode("utf-8", "surrogatepass")]):
            texts.append(with_ends(subwords, words)[0])
    trained = refine(gathered, train(pieces, texts))
    model = spark.sparkContext.broadcast((trained, head_h, np.log10(head_n + 0.5)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, known, value = model.value
        scorer = Scorer(trained)
        subwords, row = Subwords.held(vocabulary.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_of = batch.column("doc_id")
            for words in chunks(text_bytes(batch.column("text")), TEXT_CHUNK):
                ids, first, kinds, inverse = with_ends(subwords, words)
                place = np.minimum(np.searchsorted(known, kinds), max(len(known) - 1, 0))
                hit = (known[place] == kinds if len(known) else np.zeros(len(kinds), dtype=bool))[inverse]
                place = place[inverse]
                owner, n = words.owner, len(words.rows)
                base = np.bincount(owner[hit], value[place[hit]], minlength=n).astype(np.float64)  # of no word the sums are integers
                found = np.bincount(owner[hit], minlength=n)
                rare, counts_rare = words.hashes[~hit].view(np.int64), np.bincount(owner[~hit], minlength=n)
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts_rare)]).astype(np.int32)), pa.array(rare))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), ids_of.slice(words.rows.start, n), pa.array(words.counts + 1), pa.array(found), pa.array(base), pa.array(scorer(ids, first)), tail], names=["row", "doc_id", "n_tokens", "head_known", "head_sum", "score", "tail"])
                row += n

    scored = keep(docs.mapInArrow(run, "row long, doc_id long, n_tokens long, head_known long, head_sum double, score double, tail array<long>"), "scored")
    # The end token is a word like any other, joined or in the head.
    end_head = int(np.isin(np.array([END_WORD]).view(_U), head_h)[0])
    end_sum = float(np.log10(head_n[head_h == np.array([END_WORD]).view(_U)[0]] + 0.5)[0]) if end_head else 0.0
    rare = scored.select("row", F.explode("tail" if end_head else F.concat("tail", F.array(F.lit(END_WORD)))).alias("h"))
    rare = rare.join(counts, "h", "left").groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("s"))
    norm = math.log10(n_all + 0.5 * (n_kinds + 1))
    base = F.col("head_sum") + F.lit(end_sum) + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)
    return scored.drop("tail").join(rare, "row", "left").select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + end_head + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
