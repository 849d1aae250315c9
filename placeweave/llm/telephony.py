"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM blocks decoded with
numpy across blocks, resampled to PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, spare, with_key

PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
#: Payload unit of the query, in bytes; also the size of an ADPCM block.
UNIT = 576
RATE = 8000
#: Rows whose blocks are decoded side by side, by their bytes.
BATCH_BYTES = 4 << 20


def _mu_law_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _a_law_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    part, exponent = (a & 0x0F) << 4, (a & 0x70) >> 4
    size = np.where(exponent == 0, part + 8, part + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MU_LAW_TABLE, A_LAW_TABLE = _mu_law_table(), _a_law_table()
#: Fixed values of the IMA ADPCM format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks, one row of bytes each: samples are stepped through in order,
    all blocks at once. A step index beyond the table is held at its end."""
    head = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value = head
    for k, code in enumerate(codes, 1):
        step = STEPS[index]
        size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - size, value + size), -32768, 32767)
        index = np.clip(index + INDEX_SHIFT[code], 0, len(STEPS) - 1)
        out[k] = value
    return out.T


def wrap(data: bytes, form: int = MU_LAW, rate: int = RATE, block: int = 1) -> bytes:
    """A WAV file around stored samples or blocks; the bytes are kept as they are."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(form, 8)
    fmt = struct.pack("<HHIIHHH", form, 1, rate, rate * bits // 8, block, bits, 0)
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def unwrap(wav: bytes) -> tuple[int, int, int, bytes]:
    """Form, rate, block size and the stored data of a WAV file; a broken one gives no data."""
    if len(wav) < 12 or wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        return 0, 0, 0, b""
    at, form, rate, block = 12, 0, 0, 1
    while at + 8 <= len(wav):
        kind, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if kind == b"fmt " and size >= 16:
            form, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", wav, at + 8)
        elif kind == b"data":
            return form, rate, block, wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return form, rate, block, b""


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample and the floored mean of it and the next (the last is held)."""
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = (wide + np.append(wide[1:], wide[-1:])) >> 1
    return out


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """PCM at twice the stored rate; ADPCM blocks of all files with one block size step together."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(files)
    waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, wav in enumerate(files):
        form, _, block, data = unwrap(wav)
        raw = np.frombuffer(data, np.uint8)
        if form in (MU_LAW, A_LAW):
            out[k] = resample_double((MU_LAW_TABLE if form == MU_LAW else A_LAW_TABLE)[raw])
        elif form == PCM:
            out[k] = resample_double(np.frombuffer(data[: len(data) // 2 * 2], "<i2"))
        elif form == IMA_ADPCM and block > 4 and len(raw) >= block:
            waiting.setdefault(block, []).append((k, raw[: len(raw) // block * block].reshape(-1, block)))
    for own in waiting.values():
        pcm, at = decode_adpcm(np.concatenate([b for _, b in own])), 0
        for k, b in own:
            out[k] = resample_double(pcm[at : at + len(b)].reshape(-1))
            at += len(b)
    return out


def _groups(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[slice]:
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def decode_audio(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``pcm`` (binary, little-endian 16 bit) and ``pcm_rate``: the WAV bytes in ``media``
    decoded and resampled to twice their rate. Null, empty and broken files give empty PCM and rate 0. Columns of these two
    names are replaced; other columns come back as they are, ids beside nulls too; repeated rows stay, an empty table gives no rows."""
    names = [c for c in df.columns if c.lower() not in ("pcm", "pcm_rate")]
    (heard,) = spare(df.columns, "heard")

    @F.pandas_udf("pcm binary, pcm_rate int")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for own in batches:
            files = [bytes(x) if x is not None else b"" for x in own]
            pcm, rate = [], []
            for part in _groups([len(x) for x in files]):
                pcm += [x.astype("<i2").tobytes() for x in decode_many(files[part])]
                rate += [2 * unwrap(x)[1] for x in files[part]]
            yield pd.DataFrame({"pcm": pd.Series(pcm, dtype=object), "pcm_rate": pd.Series(rate, dtype="int32")})

    return df.withColumn(heard, decoded(F.col(f"`{media}`"))).select(*[F.col(f"`{c}`") for c in names], F.col(f"{heard}.pcm").alias("pcm"), F.col(f"{heard}.pcm_rate").alias("pcm_rate"))


def features(pcm: np.ndarray) -> str:
    """Peak, integer mean square and sign changes."""
    if not len(pcm):
        return "0:0:0"
    wide, below = pcm.astype(np.int32), pcm < 0
    power = int((wide * wide).sum(dtype=np.int64)) // len(pcm)
    return f"{max(int(pcm.max()), -int(pcm.min()))}:{power}:{int(np.count_nonzero(below[1:] != below[:-1]))}"


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text's bytes stored as the samples of a mu-law WAV file, read back, and decoded three ways:
    the samples by the mu-law and A-law tables, and the same bytes as ADPCM blocks of 576. The resampled PCM of the mu-law
    samples is stored as a WAV file of its own (``pcm_bytes``, ``pcm_sha256``) and read back. Returns digests
    and ``feature`` (peak, mean square and sign changes of each). Null and empty texts are one unit of padding;
    repeated rows stay; equal texts give equal values whatever rows surround them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t.encode("utf-8", "replace") for t in pdf["text"]]
            for part in _groups([len(t) for t in texts]):
                own = texts[part]
                media = [wrap(padded(t), MU_LAW) for t in own]
                back = [unwrap(m)[3] for m in media]
                heard = [decode_many([f(b) for b in back]) for f in (lambda b: wrap(b, MU_LAW), lambda b: wrap(b, A_LAW), lambda b: wrap(b, IMA_ADPCM, block=UNIT))]
                stored = [wrap(x.astype("<i2").tobytes(), PCM, rate=2 * RATE) for x in heard[0]]
                heard[0] = [np.frombuffer(unwrap(m)[3], "<i2") for m in stored]
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[part],
                    "n_bytes": [len(t) for t in own],
                    "payload_bytes": [len(b) for b in back],
                    "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                    "tail_crc32": [zlib.crc32(b[-32:]) for b in back],
                    "media_bytes": [len(m) for m in media],
                    "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                    "feature": ["|".join(map(features, x)) for x in zip(*heard)],
                    "pcm_bytes": [len(m) for m in stored],
                    "pcm_sha256": [hashlib.sha256(m).hexdigest() for m in stored],
                })

    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return with_key(keyed_texts(docs).mapInPandas(run, schema), docs)


def op8_telephony(spark, sf_dir: str) -> DataFrame:
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
