"""Vectorised tokenising and hashing of Arrow text batches, shared by the operators.

Words are the maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``, with A-Z lower-cased.
Every word gets a 64-bit hash: a polynomial over a table of mixed byte codes, finished with a
bijective mixer, so equal words have equal hashes on every executor and in every run.

A batch is handled in chunks of about ``CHUNK`` bytes of text, so the numpy temporaries stay at
a few MB whatever the batch holds; a text longer than that is a chunk of its own.
Null texts count as empty. ``tidy`` gives what a task has freed back to the system, since workers
are used again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply, three rounds)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below ``n``; kept and grown by doubling."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for base in (_BASE, _BASE_INV):
            step = np.full(size, base, dtype=_U)
            step[0] = 1
            _powers.append(np.multiply.accumulate(step))
        del _powers[:-2]
    return _powers[-2], _powers[-1]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, the body of a task, with its tables dropped and its free memory returned at the end."""

    @wraps(run)
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc alone has it
                libc.malloc_trim(0)

    return body


@dataclass
class Words:
    """The words of one chunk, in order. ``rows`` are the batch rows of the chunk's texts."""

    rows: range
    data: bytes  # the lower-cased texts, joined by one space
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # one past the last byte
    first: np.ndarray  # index of each text's first word, with the total at the end
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def vocabulary_bytes(path: str) -> bytes:
    """A vocabulary's file, which only the driver opens; executors get it as a broadcast."""
    with open(path, "rb") as file:
        return file.read()


def text_bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(column: pa.Array, size: int = CHUNK) -> Iterator[range]:
    """Rows of about ``size`` bytes of text each, one row at least, so that a batch need not be unpacked whole."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin = 0
    while begin < len(total):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + size, side="right")))
        yield range(begin, end)
        begin = end


def words_of(texts: list[bytes], first_row: int = 0) -> Words:
    data = b" ".join(texts).translate(_LOWER)
    raw = np.frombuffer(data + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum(_CODES[raw] * power[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))
    at = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return Words(range(first_row, first_row + len(texts)), data, starts, ends, np.searchsorted(starts, at), hashes)


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[Words]:
    """The batch's texts as Words of about ``size`` bytes each; an empty batch gives none."""
    begin = held = 0
    for i, x in enumerate(texts):
        if held and held + len(x) > size:
            yield words_of(texts[begin:i], begin)
            begin, held = i, 0
        held += len(x) + 1
    if begin < len(texts):
        yield words_of(texts[begin:], begin)


def grams(words: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each run of ``k`` words, in order.

    With ``short``, a text of 1 to k-1 words gives its whole sequence as one gram.
    """
    counts, first, h = words.counts, words.first[:-1], words.hashes
    n = np.maximum(counts - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    out = np.zeros(len(at), dtype=_U)
    for j in range(k):
        out += h[at + j] * _U(_odd(j))
    out = mix(out + _U(k))
    if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
        extra = np.zeros(len(few), dtype=_U)
        for j in range(k - 1):
            has = counts[few] > j
            extra[has] += h[first[few[has]] + j] * _U(_odd(j))
        extra = mix(extra + counts[few].astype(_U))
        owner, out = np.concatenate([owner, few]), np.concatenate([out, extra])
        order = np.argsort(owner, kind="stable")
        owner, out = owner[order], out[order]
    return out, owner


def _odd(j: int) -> int:
    return (_BASE * (2 * j + 3) ^ (j * 0x5851F42D4C957F2D)) & (2**64 - 1) | 1


def distinct_grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct grams: hashes ascending within a text, and offsets per text."""
    h, owner = grams(words, k, short=True)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(words.rows) + 1))
