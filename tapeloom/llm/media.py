"""Telephony audio columns: mu-law, A-law and ADPCM samples in WAVE containers, decoded with numpy.

mu-law and A-law expand by lookup tables.  IMA ADPCM blocks are independent, so all blocks of all texts of a batch are
decoded together, one nibble position at a time.  Decoded PCM is resampled by linear interpolation and stored as a WAVE
file of 16-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RATE, BLOCK = 8000, 64
#: WAVE format tags.
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")


def mulaw_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    mag = (((u & 0x0F) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -mag, mag).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exp, man = (a >> 4) & 7, a & 0x0F
    mag = np.where(exp == 0, (man << 4) + 8, ((man << 4) + 0x108) << np.maximum(exp - 1, 0))
    return np.where(a & 0x80, mag, -mag).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
# fixed values: the step sizes and index moves of IMA ADPCM
_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
_CODE = np.arange(16)
#: Signed step multiples by step index and code: ((2 * magnitude + 1) * step) >> 3, summed as the format sums its shifts.
_DELTA = (_STEPS[:, None] >> 3) + np.where(_CODE & 4, _STEPS[:, None], 0) + np.where(_CODE & 2, _STEPS[:, None] >> 1, 0) + np.where(_CODE & 1, _STEPS[:, None] >> 2, 0)
_DELTA = np.where(_CODE & 8, -_DELTA, _DELTA).astype(np.int32).ravel()
_NEXT = (np.clip(np.arange(len(_STEPS))[:, None] + _MOVES[_CODE & 7], 0, len(_STEPS) - 1) * 16).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM mono blocks (rows of bytes: 16-bit first sample, step index, reserved, nibbles) to 16-bit samples."""
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], len(_STEPS) - 1).astype(np.int32) * 16
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.int32)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for i, c in enumerate(codes):
        at = index + c
        value += _DELTA[at]
        np.clip(value, -32768, 32767, out=value)
        index = _NEXT[at]
        out[i + 1] = value
    return out.T


def wave(codec: str, data: bytes, sample_rate: int = RATE) -> bytes:
    """A mono WAVE file that stores the given code bytes (16-bit samples for pcm) unchanged."""
    per = 2 * (BLOCK - 4) + 1
    align, bits, samples = {"adpcm": (BLOCK, 4, len(data) // BLOCK * per), "pcm": (2, 16, len(data) // 2)}.get(codec, (1, 8, len(data)))
    rate = sample_rate * BLOCK // per if codec == "adpcm" else sample_rate * align
    more = struct.pack("<HH", 2, per) if codec == "adpcm" else b"" if codec == "pcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, sample_rate, rate, align, bits) + more
    fact = b"" if codec == "pcm" else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, bytes]:
    """Codec and code bytes of a WAVE file of one of the telephony formats."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag = int.from_bytes(media[at + 8 : at + 10], "little")
            codec = next((k for k, v in FORMATS.items() if v == tag), None)
            if codec is None:
                raise ValueError(f"format {tag} is not supported")
        elif name == b"data":
            if codec is None:
                raise ValueError("no format before the data")
            return codec, media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data")


def decode(media: list[bytes]) -> list[np.ndarray]:
    """16-bit PCM samples of stored files; the ADPCM blocks of all of them are decoded at once."""
    read = [read_wave(m) for m in media]
    out: list = [None] * len(read)
    blocks = [i for i, (codec, _) in enumerate(read) if codec == "adpcm"]
    if blocks:
        pcm = decode_adpcm(np.frombuffer(b"".join(read[i][1] for i in blocks), np.uint8).reshape(-1, BLOCK))
        cuts = np.cumsum([len(read[i][1]) // BLOCK for i in blocks])[:-1]
        for i, part in zip(blocks, np.split(pcm, cuts)):
            out[i] = part.ravel()
    for i, (codec, data) in enumerate(read):
        if codec == "pcm":
            out[i] = np.frombuffer(data, "<i2")
        elif codec != "adpcm":
            out[i] = (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(data, np.uint8)]
    return out


def resample(pcm: np.ndarray, source: int = RATE, target: int = 2 * RATE) -> np.ndarray:
    """Linear interpolation to another rate; twice the rate in integer arithmetic."""
    if not len(pcm) or source == target:
        return pcm
    if target == 2 * source:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        wide = pcm.astype(np.int32)
        out[1::2] = np.concatenate(((wide[:-1] + wide[1:]) >> 1, wide[-1:]))
        return out
    x = np.arange(len(pcm) * target // source) * (source / target)
    return np.rint(np.interp(x, np.arange(len(pcm)), pcm)).astype(np.int16)


def features(pcm: np.ndarray) -> str:
    """Samples, peak, mean square (rounded down) and sign changes."""
    wide = pcm.astype(np.int64)
    signs = np.signbit(pcm)
    return f"n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};ms={int((wide * wide).sum() // max(1, len(pcm)))};zc={int((signs[1:] != signs[:-1]).sum())}"


def payload(text: bytes) -> bytes:
    """The text's bytes, filled with 0 up to a positive multiple of the block."""
    return text + b"\0" * (-len(text) % BLOCK if text else BLOCK)


_FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm_bytes", pa.int64()), ("pcm_sha256", pa.string())]
_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


def _store(codecs: tuple[str, ...], with_media: bool):
    files = [(f"{x}_{c}", pa.binary()) for c in codecs for x in ("media", "pcm")] if with_media else []
    fields = _FIELDS + files

    def one(text: bytes, media: list[bytes], decoded: list[np.ndarray]) -> tuple:
        back = [read_wave(m)[1] for m in media]
        stored = [wave("pcm", resample(x).astype("<i2").tobytes(), 2 * RATE) for x in decoded]
        whole, pcm = hashlib.sha256(), hashlib.sha256()
        for m, p in zip(media, stored):
            whole.update(m)
            pcm.update(p)
        described = ",".join(f"{c}:{features(x)}" for c, x in zip(codecs, decoded))
        row = (len(text), len(back[0]), hashlib.sha256(back[0]).hexdigest(), zlib.crc32(back[0][-BLOCK:]), sum(map(len, media)), whole.hexdigest(), described, sum(map(len, stored)), pcm.hexdigest())
        return row + (tuple(x for pair in zip(media, stored) for x in pair) if with_media else ())

    def store(batches):
        for batch in batches:
            ids, texts = batch.column(0), C.encoded(batch.column(1).to_pylist())
            for a, b in C.in_batches(texts, 1 << 20):
                media = [[wave(c, payload(t)) for t in texts[a:b]] for c in codecs]
                decoded = [decode(m) for m in media]
                rows = zip(*(one(t, [m[i] for m in media], [d[i] for d in decoded]) for i, t in enumerate(texts[a:b])))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(c, k) for c, (_, k) in zip(rows, fields[1:]))], names=[n for n, _ in fields])

    return store


def as_media(docs: DataFrame, codecs: tuple[str, ...] = CODECS, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """One row for each row of docs: the text's bytes stored as telephony samples, read back, decoded and described.

    Returns id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm_bytes and
    pcm_sha256.  ``codecs``: any of mulaw, alaw and adpcm (blocks of 64 bytes); the payload is read back from the first
    one's file, the lengths and hashes of files (media_*, and pcm_* of the resampled 16-bit files) are of all codecs' files
    in their order, and feature describes each.  With ``with_media`` the files themselves follow, as media_CODEC and
    pcm_CODEC.  Null text counts as empty, whose payload is 64 zero bytes.  Rows are independent, ids may be null or
    repeat, and other columns of docs are ignored.
    """
    if not codecs or not set(codecs) <= set(CODECS):
        raise ValueError(f"unknown codec among {codecs!r}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = _SQL + "".join(f", media_{c} binary, pcm_{c} binary" for c in codecs if with_media)
    return rows.mapInArrow(_store(tuple(codecs), with_media), schema).withColumnRenamed("doc_id", id_col)
