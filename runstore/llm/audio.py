"""Telephony audio columns: companded and ADPCM media, stored, read back, decoded, resampled.

A payload is stored losslessly as the 8-bit units of a telephony format inside a RIFF/WAVE file:
mu-law (tag 7) or A-law (tag 6) samples, or IMA ADPCM blocks of 64 bytes (tag 17). Reading
parses the chunks again. mu-law and A-law expand by tables of 256 entries that their rule
builds; ADPCM steps through the nibbles of all blocks of a batch side by side in numpy. Decoded
PCM is brought from 8 to 16 kHz by an integer half-band filter.

Nulls and odd input: a null text is empty, and an empty payload is one block of zeros. Text is
taken whole, as UTF-8. The format follows from the payload, so equal texts give equal media.
Rows with a null doc_id and repeated rows keep their place, there are no ties; other columns are
ignored. A media value that is null or no known WAVE file decodes to null PCM. A very long text costs
memory in proportion, a few bytes for each of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded
from .textkit import tidy

BLOCK = 64
RATE = 8000
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
NAMES = {v: k for k, v in TAGS.items()}
BATCH_BYTES = 1 << 20
PIECE = 1 << 16  # samples that features are made of at once


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment = code >> 4 & 7
    size = np.where(segment == 0, ((code & 0x0F) << 4) + 8, ((code & 0x0F) << 4) + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
# Fixed values of the IMA ADPCM format: change of the step index, and the step sizes.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)


def adpcm(data: bytes) -> np.ndarray:
    """Samples of consecutive 64-byte IMA ADPCM blocks: the header's, then two for each byte."""
    blocks = np.frombuffer(data, dtype=np.uint8).reshape(-1, BLOCK)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (BLOCK - 4), len(blocks)), dtype=np.int16)
    out[0] = value
    nibbles = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(2 * (BLOCK - 4)):
        code = nibbles[i >> 1] >> 4 * (i & 1) & 15
        step = STEPS[index]
        low = code & 7
        change = (step >> 3) + (step >> 2) * (low & 1) + (step >> 1) * (low >> 1 & 1) + step * (low >> 2)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[low], 0, 88)
        out[i + 1] = value
    return out.T.ravel()


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def format_of(payload: bytes) -> str:
    return sorted(TAGS)[zlib.crc32(payload) % len(TAGS)]


def wave(payload: bytes, name: str) -> bytes:
    """The payload as the data chunk of a mono WAVE file at 8 kHz."""
    if name == "ima_adpcm":
        per = 1 + 2 * (BLOCK - 4)
        fmt = struct.pack("<HHIIHHHH", TAGS[name], 1, RATE, RATE * BLOCK // per, BLOCK, 4, 2, per)
        samples = len(payload) // BLOCK * per
    else:
        fmt = struct.pack("<HHIIHHH", TAGS[name], 1, RATE, RATE, 1, 8, 0)
        samples = len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes | None) -> tuple[str, bytes] | None:
    """Format and data chunk of a WAVE file of a known format, else None."""
    if media is None or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, name = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            name = NAMES.get(struct.unpack_from("<H", media, at + 8)[0])
        elif kind == b"data":
            return (name, media[at + 8 : at + 8 + size]) if name else None
        at += 8 + size + (size & 1)
    return None


def decode(read: list[tuple[str, bytes] | None]) -> list[np.ndarray | None]:
    """PCM at 8 kHz of each; the ADPCM blocks of all of them are decoded together."""
    blocks = [x[1] for x in read if x and x[0] == "ima_adpcm"]
    joined, at, out = adpcm(b"".join(blocks)) if blocks else None, 0, []
    for x in read:
        if x is None:
            out.append(None)
        elif x[0] == "ima_adpcm":
            n = len(x[1]) // BLOCK * (1 + 2 * (BLOCK - 4))
            out.append(joined[at : at + n])
            at += n
        else:
            out.append((MULAW if x[0] == "mulaw" else ALAW)[np.frombuffer(x[1], dtype=np.uint8)])
    return out


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples, and between them the half-band filter (-1 9 9 -1) / 16."""
    x = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8 >> 4, -32768, 32767)
    return out


def feature(name: str, pcm: np.ndarray) -> str:
    """Format, samples, root mean square, peak, sign changes and CRC of the PCM at twice the rate.

    It is resampled and summed up piece by piece, so that a long text is never widened whole.
    """
    n = power = peak = changes = crc = 0
    last = None
    for begin in range(0, len(pcm), PIECE):
        part = resample(pcm[max(0, begin - 1) : begin + PIECE + 2])
        part = part[2 * (begin > 0) :][: 2 * min(PIECE, len(pcm) - begin)]
        wide = part.astype(np.int64)
        n, power, peak = n + len(part), power + int(np.dot(wide, wide)), max(peak, int(np.abs(wide).max()))
        below = part < 0
        changes += int(np.count_nonzero(below[1:] != below[:-1])) + int(last is not None and last != below[0])
        last, crc = below[-1], zlib.crc32(part.astype("<i2").tobytes(), crc)
    return f"{name};n={n};rms={math.isqrt(power // max(1, n))};peak={peak};zc={changes};crc={crc:08x}"


def _parts(sizes: list[int]) -> Iterator[range]:
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH_BYTES:
            yield range(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield range(begin, len(sizes))


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text of ``docs`` (doc_id, text) as a WAVE file."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _parts([len(x or "") for x in texts]):
                sizes, media = [], []
                for i in part:
                    n, payload = payload_of(texts[i])
                    sizes.append(n)
                    media.append(wave(payload, format_of(payload)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, len(part)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm(stored: DataFrame) -> DataFrame:
    """``doc_id, sample_rate, pcm``: the media of ``stored`` as 16-bit little-endian PCM at 16 kHz."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column("media").to_pylist()
            for part in _parts([len(x or b"") for x in media]):
                sound = [None if x is None else resample(x).astype("<i2").tobytes() for x in decode([read_wave(media[i]) for i in part])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, len(part)), pa.array([2 * RATE] * len(part), pa.int32()), pa.array(sound, pa.binary())], names=["doc_id", "sample_rate", "pcm"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, sample_rate int, pcm binary")


def describe(stored: DataFrame) -> DataFrame:
    """Digests of stored media, from the bytes read back, and features of the decoded sound."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column("media").to_pylist()
            for part in _parts([len(x or b"") for x in media]):
                read = [read_wave(media[i]) for i in part]
                cols = [[], [], [], [], [], []]
                for i, x, sound in zip(part, read, decode(read)):
                    row = (None,) * 6 if x is None else (len(x[1]), hashlib.sha256(x[1]).hexdigest(), zlib.crc32(x[1][-BLOCK:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), feature(x[0], sound))
                    for c, v in zip(cols, row):
                        c.append(v)
                own = [batch.column(c).slice(part.start, len(part)) for c in ("doc_id", "n_bytes")]
                yield pa.RecordBatch.from_arrays(own + [pa.array(c, t) for c, t in zip(cols, types[2:])], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
