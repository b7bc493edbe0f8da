"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary (the pieces of
a SentencePiece model, and every single byte, so any text can be segmented). The probability of
a word is the sum over all its segmentations, by a forward pass; of a text, the product over
its words. Piece probabilities are learned by expectation-maximisation with a forward-backward
pass over the words of a bounded sample of labelled texts: about ``sample_docs`` documents of
each language, drawn by a hash of doc_id. The bound is the only limit; texts enter whole.

Texts are lower-cased and split at white space. Words of one length go through the forward pass side
by side; a word longer than ``LONG`` bytes, or of a probability that floating point cannot hold, goes
through it alone and in logarithms, whole. The prediction is the language of highest probability,
and its score the posterior under equal priors.

Nulls and odd input: a null text, or one without a letter, gets ``und`` and score 0. Without any
labelled text every text gets ``und``. Labels that are null are not learned from, nor are rows
with a null doc_id. Repeated rows give repeated results. Ties go to the first language by name. A
very long text is scored whole, at a cost in proportion. An empty table gives an empty result. Input
columns named ``held_out``, ``lang_pred`` or ``score`` are replaced; all others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .scratch import bounded
from .textkit import _BASE, mix, slices, tidy, vocabulary_bytes, words_of

LONG = 160  # bytes of a word from which on it is scored alone
LEAST = 1e-280  # scaled probability under which a word is scored in logarithms
SEGMENT = 4096  # bytes of a word scored alone whose pieces are looked up at once
TEXTS = 2 << 20  # bytes of texts whose distinct words are scored together
AT_ONCE = 40_000  # bytes of the words whose sums are held at once, some 8 MB of piece numbers
SCALE = 24.0  # keeps the forward sums of long words within floating point
UNSEEN = 1e-2  # pseudo-count of each piece
_U = np.uint64
_LETTER = regex.compile(r"\p{L}")


class Pieces:
    """The vocabulary as byte strings, found by hash. A leading space marks a word's begin."""

    def __init__(self, vocabulary: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        found = {bytes([b]) for b in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                piece = sp.id_to_piece(i).replace("▁", " ").encode()
                if b" " not in piece[1:]:
                    found.add(piece)
        self.pieces = sorted(found)
        self.lengths = {len(x) for x in self.pieces}
        self.longest = max(self.lengths)
        hashes = np.array([self._hash(x) for x in self.pieces], dtype=_U)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order.astype(np.int64)
        # A table by the top bits of the mixed hash leaves a few keys to look at.
        self.bits = 17
        slot = (mix(self.keys) >> _U(64 - self.bits)).astype(np.int64)
        by_slot = np.lexsort((self.keys, slot))
        self.keys, self.ids, slot = self.keys[by_slot], self.ids[by_slot], slot[by_slot]
        self.first = np.searchsorted(slot, np.arange((1 << self.bits) + 1))
        self.deep = int(np.diff(self.first).max())

    @staticmethod
    def _hash(piece: bytes) -> int:
        out = len(piece)
        for i, b in enumerate(piece):
            out += int(textkit._CODES[b]) * pow(_BASE, i, 1 << 64)
        return out & (2**64 - 1)

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash; ``len(self)`` where there is none."""
        slot = (mix(hashes) >> _U(64 - self.bits)).astype(np.int64)
        out, at, end = np.full(len(hashes), len(self)), self.first[slot], self.first[slot + 1]
        for d in range(self.deep):
            here = np.flatnonzero(at + d < end)
            if not len(here):
                break
            match = here[self.keys[at[here] + d] == hashes[here]]
            out[match] = self.ids[at[match] + d]
        return out


def spans(pieces: Pieces, matrix: np.ndarray) -> list[list[np.ndarray | None]]:
    """For words of one length (rows of bytes): the piece ending at i with length l, [i][l-1]; None if no piece is so long."""
    m = matrix.shape[1]
    codes, base = textkit._CODES[matrix], _U(_BASE)
    out: list[list[np.ndarray | None]] = [[] for _ in range(m + 1)]
    for i in range(m):
        h = np.zeros(len(matrix), dtype=_U)
        power = 1
        for l in range(1, min(pieces.longest, m - i) + 1):
            h = h + codes[:, i + l - 1] * _U(power)
            power = power * int(base) & (2**64 - 1)
            out[i + l].append(pieces.find(h + _U(l)) if l in pieces.lengths else None)
    # piece ending at e: the lengths were appended from the farthest begin to the nearest
    return [x[::-1] for x in out]


def forward(found: list[list[np.ndarray | None]], p: np.ndarray) -> list[np.ndarray]:
    """Sums over the segmentations of each prefix, times SCALE for every byte; p: pieces x languages."""
    n = len(found[-1][0])
    alpha = [np.ones((n, p.shape[1]))]
    for end in found[1:]:
        total = np.zeros((n, p.shape[1]))
        for l, ids in enumerate(end, 1):
            if ids is not None and len(hit := np.flatnonzero(ids < len(p) - 1)):
                total[hit] += alpha[-l][hit] * (p[ids[hit]] * SCALE**l)
        alpha.append(total)
    return alpha


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index and byte matrix of the words of each length up to ``LONG``, ``AT_ONCE`` bytes at a time."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for m in np.unique(lengths[lengths <= LONG]):
        at, most = np.flatnonzero(lengths == m), max(1, AT_ONCE // max(1, int(m)))
        for i in range(0, len(at), most):
            part = at[i : i + most]
            yield part, np.frombuffer(b"".join(words[j] for j in part), dtype=np.uint8).reshape(len(part), m)


def endings(pieces: Pieces, word: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each end 1, 2, ... in a word: lengths and numbers of the pieces that end there."""
    codes = textkit._CODES[np.frombuffer(word, dtype=np.uint8)]
    for begin in range(0, len(word), SEGMENT):
        ends = np.arange(begin + 1, min(begin + SEGMENT, len(word)) + 1)
        ids = np.full((len(ends), pieces.longest), len(pieces))
        h = np.zeros(len(ends), dtype=_U)
        for l in range(1, min(pieces.longest, int(ends[-1])) + 1):
            # One more byte in front: the sum so far moves on by one power.
            use = ends >= l
            h[use] = h[use] * _U(_BASE) + codes[ends[use] - l]
            if l in pieces.lengths:
                ids[use, l - 1] = pieces.find(h[use] + _U(l))
        for row in ids:
            hit = np.flatnonzero(row < len(pieces))
            yield hit + 1, row[hit]


def alone(pieces: Pieces, log_p: np.ndarray, word: bytes) -> np.ndarray:
    """log of the sum over the segmentations of every prefix of one word, in each language."""
    out = np.zeros((len(word) + 1, log_p.shape[1]))
    for end, (lengths, ids) in enumerate(endings(pieces, word), 1):
        out[end] = np.logaddexp.reduce(out[end - lengths] + log_p[ids], axis=0)
    return out


def _expected_alone(pieces: Pieces, log_p: np.ndarray, word: bytes, count: np.ndarray, expected: np.ndarray) -> None:
    """Adds one word's expected pieces, in logarithms throughout."""
    found, alpha = list(endings(pieces, word)), alone(pieces, log_p, word)
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0
    for end in range(len(word), 0, -1):
        lengths, ids = found[end - 1]
        step = log_p[ids] + beta[end]
        np.add.at(expected, ids, np.exp(alpha[end - lengths] + step - alpha[-1]) * count)
        beta[end - lengths] = np.logaddexp(beta[end - lengths], step)


def learn(pieces: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Piece probabilities of each language (pieces + 1 x languages) from word counts."""
    size, langs = len(pieces), counts.shape[1]
    p = np.full((size + 1, langs), 1.0 / size)
    p[size] = 0
    for _ in range(rounds):
        expected = np.zeros((size + 1, langs))
        log_p = np.log(p[:size])
        hard = [i for i, w in enumerate(words) if len(w) > LONG]
        for at, matrix in by_length(words):
            found = spans(pieces, matrix)
            alpha, m = forward(found, p), matrix.shape[1]
            beta = [np.zeros_like(alpha[0]) for _ in range(m)] + [np.ones_like(alpha[0])]
            fits = (alpha[m] >= LEAST).all(axis=1)
            hard += at[~fits].tolist()
            weight = np.where(fits[:, None], counts[at] / np.maximum(alpha[m], LEAST), 0)
            for e in range(m, 0, -1):
                for l, ids in enumerate(found[e], 1):
                    if ids is not None and len(hit := np.flatnonzero(ids < size)):
                        step = p[ids[hit]] * SCALE**l * beta[e][hit]
                        beta[e - l][hit] += step
                        gain = alpha[e - l][hit] * step * weight[hit]
                        for k in range(langs):
                            expected[:, k] += np.bincount(ids[hit], gain[:, k], minlength=size + 1)
        for i in hard:
            _expected_alone(pieces, log_p, words[i], counts[i], expected)
        p = expected + UNSEEN
        p[size] = 0
        p /= p.sum(axis=0)
    return p


def _prepared(texts: list[str | None]) -> list[bytes]:
    return [b"" if x is None else x.lower().encode("utf-8", "surrogatepass") for x in texts]


def _marked(words, i: int) -> bytes:
    return b" " + words.word(i)


def score_texts(pieces: Pieces, p: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Log-probability of each text in each language."""
    out = np.zeros((len(texts), p.shape[1]))
    with np.errstate(divide="ignore"):
        log_p = np.log(p[:-1])
    prepared = _prepared(texts)
    begin = held = 0
    for end in range(len(texts) + 1):
        if end == len(texts) or held > TEXTS:
            if begin < end:
                held_words = list(textkit.chunks(prepared[begin:end], textkit.CHUNK))
                ends = np.cumsum([0, *(len(x.hashes) for x in held_words)])
                bounds = np.concatenate([*(x.first[:-1] + e for x, e in zip(held_words, ends)), ends[-1:]])
                _, first, inverse = np.unique(np.concatenate([x.hashes for x in held_words]), return_index=True, return_inverse=True)
                kinds = [_marked(held_words[j], i - ends[j]) for i, j in zip(first, np.searchsorted(ends, first, side="right") - 1)]
                log = np.zeros((len(first), p.shape[1]))
                hard = [i for i, w in enumerate(kinds) if len(w) > LONG]
                for at, matrix in by_length(kinds):
                    last = forward(spans(pieces, matrix), p)[-1]
                    hard += at[(last < LEAST).any(axis=1)].tolist()
                    log[at] = np.log(np.maximum(last, LEAST)) - matrix.shape[1] * math.log(SCALE)
                for i in hard:
                    log[i] = alone(pieces, log_p, kinds[i])[-1]
                total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(log[inverse], axis=0)])
                out[begin:end] = total[bounds[1:]] - total[bounds[:-1]]
            begin, held = end, 0
        if end < len(texts):
            held += len(prepared[end])
    return out


def _learning(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and text is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")


def train(docs: DataFrame, vocabulary: str, sample_docs: int = 1000) -> tuple[list[str], np.ndarray] | None:
    """Languages and piece probabilities, learned from a bounded hash sample of each language.

    About ``sample_docs`` documents of each language reach the driver as word counts.
    """
    rows = _learning(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    rate = F.element_at(F.create_map(*[F.lit(y) for x in langs for y in (x, min(1.0, sample_docs / sizes[x]))]), F.col("lang"))
    sample = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < rate)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds: dict[tuple[str, bytes], int] = {}
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                words = words_of(_prepared([text.as_py()]))
                for i in range(len(words.starts)):
                    word = _marked(words, i)
                    kinds[lang, word] = kinds.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kinds], pa.string()), pa.array([k[1] for k in kinds], pa.binary()), pa.array(list(kinds.values()), pa.int64())], names=["lang", "word", "n"])

    table = sample.select("text", "lang").mapInArrow(count, "lang string, word binary, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).toArrow()
    index: dict[bytes, int] = {}
    at = np.array([index.setdefault(w, len(index)) for w in table["word"].to_pylist()], dtype=np.int64)
    counts = np.zeros((len(index), len(langs)))
    counts[at, np.searchsorted(np.array(langs, dtype=object), table["lang"].to_pylist())] = table["n"].to_numpy()
    # In the order of the words, so that the sums do not depend on the order of arrival.
    order = sorted(range(len(index)), key=list(index).__getitem__)
    words = list(index)
    return langs, learn(Pieces(vocabulary_bytes(vocabulary)), [words[i] for i in order], counts[order])


def _predictor(langs: list[str], model):
    held: list[Pieces] = []

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not held:
            held.append(Pieces(model.value[0]))
        log = score_texts(held[0], model.value[1], texts)
        best = log.argmax(axis=1)
        score = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
        letters = [x is not None and _LETTER.search(x) is not None for x in texts]
        return [langs[b] if ok else "und" for b, ok in zip(best, letters)], [float(s) if ok else 0.0 for s, ok in zip(score, letters)]

    return predict


def identify(docs: DataFrame, vocabulary: str, sample_docs: int = 1000) -> DataFrame:
    """``docs`` with ``held_out, lang_pred, score``, which replace columns of these names."""
    docs = bounded(docs.drop("held_out", "lang_pred", "score"))
    trained = train(docs, vocabulary, sample_docs)
    held_out = F.coalesce(F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"), F.lit(False))
    if trained is None:
        return docs.withColumn("held_out", held_out).withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    langs, p = trained
    model = docs.sparkSession.sparkContext.broadcast((vocabulary_bytes(vocabulary), p))
    docs = docs.withColumn("held_out", held_out)
    text_at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(langs, model)
        for batch in batches:
            texts = batch.column(text_at).cast(pa.string())
            for rows in slices(texts, TEXTS):
                lang, score = predict(texts.slice(rows.start, len(rows)).to_pylist())
                part = batch.slice(rows.start, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)
