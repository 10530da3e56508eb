"""Media columns for telephony audio.

A payload is stored losslessly as the code bytes of a WAV file: one byte a sample for mu-law
and A-law, whole blocks for IMA ADPCM. Reading expands the codes: mu-law and A-law through
256-entry lookup tables, ADPCM with numpy across blocks (the loop runs over positions inside a
block, every step handles all blocks). The files are a written table of their own, which is read back for all
that follows; the 16-bit PCM is resampled, and comes as a WAV file beside the stored one.

By default the codec of a text follows from the checksum of its payload, so a table holds all
three, and equal texts have equal forms.

Defined results: a null text is an empty payload; an empty payload is padded to one unit; equal
texts give equal values; a null doc_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, bounded_batches, tidied

UNIT = 64
RATE, RATE_OUT = 8000, 16000
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 0x11}
CODECS = ("mulaw", "alaw", "ima_adpcm")

# Fixed values of the IMA ADPCM format: the step sizes and the index moves of a 3-bit magnitude.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    seg, low = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(seg > 0, (low + 0x100) << np.maximum(seg - 1, 0), low)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_decode(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """IMA ADPCM, mono: a block holds a 16-bit first sample, an index byte, a spare byte and
    then two codes a byte, low one first. Returns one row of samples a block."""
    rows = data.reshape(-1, block)
    value = rows[:, 0].astype(np.int32) | (rows[:, 1].astype(np.int32) << 8)
    value = np.where(value >= 32768, value - 65536, value).astype(np.int32)
    index = np.minimum(rows[:, 2], 88).astype(np.int32)
    codes = np.ascontiguousarray(rows[:, 4:].T)
    out = np.empty((2 * (block - 4) + 1, len(rows)), np.int16)
    out[0] = value
    at = 1
    for pair in codes:
        for code in (pair & 15, pair >> 4):
            size = (code & 7).astype(np.int32)
            step = STEPS[index]
            # step/8 + the parts of step that the three magnitude bits name
            move = (step >> 3) + ((size >> 2) & 1) * step + ((size >> 1) & 1) * (step >> 1) + (size & 1) * (step >> 2)
            value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
            index = np.clip(index + MOVES[size], 0, 88)
            out[at] = value
            at += 1
    return out.T


def wav(tag: int, rate: int, bits: int, align: int, per_block: int, data: bytes) -> bytes:
    """A WAV file; formats other than PCM carry an extension and a sample count."""
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align // per_block, align, bits)
    extra = b""
    if tag != 1:
        ext = struct.pack("<H", per_block) if tag == 0x11 else b""
        fmt += struct.pack("<H", len(ext)) + ext
        extra = b"fact" + struct.pack("<II", 4, len(data) // align * per_block)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(stored: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and the data bytes."""
    at, tag, rate, data = 12, 0, 0, b""
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            data = stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return tag, rate, data


def store(codec: str, payload: bytes) -> bytes:
    if codec == "ima_adpcm":
        return wav(TAGS[codec], RATE, 4, UNIT, 2 * (UNIT - 4) + 1, payload)
    return wav(TAGS[codec], RATE, 8, 1, 1, payload)


def expand(tag: int, data: bytes) -> np.ndarray:
    """PCM of mu-law or A-law codes, by their tables."""
    return (_MULAW if tag == TAGS["mulaw"] else _ALAW)[np.frombuffer(data, np.uint8)]


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: midpoints by linear interpolation, the last sample held."""
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


_MULAW, _ALAW = mulaw_table(), alaw_table()


def features(pcm: np.ndarray) -> str:
    """Peak, mean square (integer) and sign changes."""
    wide = pcm.astype(np.int64)
    return f"{int(np.abs(wide).max())}:{int((wide * wide).sum() // len(wide))}:{int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))}"


def codec_of(payload: bytes) -> str:
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def _stored(codec: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
                payloads = [x + bytes(-len(x) % UNIT or (0 if x else UNIT)) for x in raw]
                used = [codec or codec_of(x) for x in payloads]
                media = [store(c, x) for c, x in zip(used, payloads, strict=True)]
                cols = [b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(used), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "codec", "media"])

    return run


def stored(docs: DataFrame, codec: str | None = None) -> DataFrame:
    """doc_id, n_bytes (of the text), codec, media (the file). codec: one for all texts, or None."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_stored(codec)), "doc_id long, n_bytes long, codec string, media binary")


def _played(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                media = b.column("media").to_pylist()
                back = [read_wav(m) for m in media]
                # the ADPCM files of the batch are decoded in one go, across all their blocks
                blocks = adpcm_decode(np.frombuffer(b"".join(d for tag, _, d in back if tag == TAGS["ima_adpcm"]), np.uint8))
                rows, start = [], 0
                for c, m, (tag, rate, d) in zip(b.column("codec").to_pylist(), media, back, strict=True):
                    if tag == TAGS["ima_adpcm"]:
                        n = len(d) // UNIT
                        pcm, start = blocks[start : start + n].reshape(-1), start + n
                    else:
                        pcm = expand(tag, d)
                    sound = wav(1, RATE_OUT, 16, 2, 1, resample(pcm).tobytes())
                    row = [len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), f"{c}@{rate} {features(pcm)}"]
                    rows.append([*row, c, len(sound), zlib.crc32(sound)] + [m, sound] * keep)
                cols = [pa.array(c) for c in zip(*rows, strict=True)]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "pcm_bytes", "pcm_crc32"]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], names=["doc_id", "n_bytes", *names, *["media", "pcm"] * keep])

    return run


def played(media: DataFrame, keep: bool = True) -> DataFrame:
    """What the files of ``stored`` hold: digests and features of each file and of its resampled 16-bit WAV; with
    ``keep`` both files too (``media``, ``pcm``)."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm_bytes long, pcm_crc32 long"
    rows = bounded_batches(media).select("doc_id", "n_bytes", "codec", "media")
    return rows.mapInArrow(tidied(_played(keep)), schema + (", media binary, pcm binary" if keep else ""))


def media_columns(docs: DataFrame, codec: str | None = None, keep: bool = True) -> DataFrame:
    """``played`` over the files of all texts, which are written to the shared folder and read back from there."""
    return played(Scratch(docs.sparkSession).save(stored(docs, codec)), keep)
