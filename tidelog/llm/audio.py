"""Telephony audio columns: WAV files with mu-law, A-law or IMA ADPCM samples, and resampled PCM.

Companded samples are expanded by 256-entry tables made from the G.711 rules.
ADPCM is sequential within a block and independent between blocks, so it is
decoded one sample position at a time for all blocks of a file at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import batches_of

#: WAV format codes.
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}
#: The IMA ADPCM step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
#: Bits a sample that can be read.
BITS = {"pcm": (8, 16), "alaw": (8,), "mulaw": (8,), "ima_adpcm": (4,)}
#: Higher rates are taken for damaged headers.
MOST_RATE = 1_000_000
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
#: Rows are handled in groups of about so many bytes, so that memory doesn't follow the batch size.
GROUP_BYTES = 2_000_000


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def decode_ima(data: np.ndarray, block: int, channels: int = 1) -> np.ndarray:
    """IMA ADPCM blocks of ``block`` bytes to 16-bit samples, a column for each channel; a last, shorter block counts as far as it goes."""
    head = 4 * channels
    if channels < 1 or block <= head:
        raise ValueError("blocks too short for their header")
    unit = 1 if channels == 1 else head  # the channels take turns by four bytes
    size = (block - head) // unit * unit
    used = len(data) - len(data) % block
    last = max(0, min(size, (len(data) - used - head) // unit * unit))  # of the last block's bytes
    short = len(data) - used >= head
    if short:
        data = np.concatenate([data[: used + head + last], np.zeros(block - head - last, np.uint8)])
    blocks = data[: len(data) // block * block].reshape(-1, block)
    first = blocks[:, :head].reshape(len(blocks), channels, 4)
    body = blocks[:, head : head + size]
    if channels > 1:
        body = body.reshape(len(blocks), size // head, channels, 4).transpose(0, 2, 1, 3).reshape(len(blocks) * channels, size // channels)
    value = first[:, :, :2].copy().view("<i2")[:, :, 0].reshape(-1).astype(np.int64)
    index = np.minimum(first[:, :, 2].reshape(-1).astype(np.int64), 88)
    out = np.empty((1 + 2 * body.shape[1], len(body)), np.int16)
    out[0] = value
    for k in range(2 * body.shape[1]):
        code = (body[:, k // 2] >> (4 * (k % 2)) & 15).astype(np.int64)
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, 88)
        out[k + 1] = value
    pcm = out.reshape(len(out), len(blocks), channels).transpose(1, 0, 2).reshape(len(blocks) * len(out), channels)
    return pcm[: len(pcm) - 2 * (size - last) // channels] if short else pcm


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation between samples; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left = at // to
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return (wide[left] + (wide[right] - wide[left]) * (at - left * to) // to).astype(np.int16)


def write_wav(samples: bytes, codec: str, rate: int, block: int = 1, channels: int = 1) -> bytes:
    """A WAV file around samples that are coded already."""
    bits = {"pcm": 16, "ima_adpcm": 4}.get(codec, 8)
    extra = struct.pack("<H", 1 + 2 * (block - 4 * channels) // channels) if codec == "ima_adpcm" else b""
    form = struct.pack("<HHIIHHH", FORMATS[codec], channels, rate, rate * channels * bits // 8, block, bits, len(extra)) + extra
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


@dataclass(frozen=True)
class Wav:
    codec: str
    rate: int
    block: int
    channels: int
    bits: int
    data: bytes


def read_wav(media: bytes) -> Wav:
    """What a WAV file says and holds; ValueError if it isn't one that can be decoded."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("no format or no samples")
    codec = next((k for k, v in FORMATS.items() if v == form[0]), None)
    out = Wav(codec, form[2], form[4], form[1], form[5], data)
    if codec is None or form[5] not in BITS[codec]:
        raise ValueError(f"format {form[0]} with {form[5]} bits is not known")
    if not 0 < out.rate <= MOST_RATE or not 0 < out.channels <= 64 or codec == "ima_adpcm" and out.block <= 4 * out.channels:
        raise ValueError("bad rate, channels or block size")
    return out


def to_pcm(wav: Wav) -> np.ndarray:
    """16-bit samples with a column for each channel."""
    raw = np.frombuffer(wav.data, np.uint8)
    if wav.codec == "ima_adpcm":
        return decode_ima(raw, wav.block, wav.channels)
    if wav.codec == "mulaw":
        flat = MULAW[raw]
    elif wav.codec == "alaw":
        flat = ALAW[raw]
    elif wav.bits == 8:
        flat = (raw.astype(np.int16) - 128) * 256
    else:
        flat = raw[: len(raw) // 2 * 2].view("<i2")
    return flat[: len(flat) // wav.channels * wav.channels].reshape(-1, wav.channels)


def to_mono(pcm: np.ndarray) -> np.ndarray:
    """The mean of the channels."""
    return pcm[:, 0] if pcm.shape[1] == 1 else (pcm.astype(np.int64).sum(axis=1) // pcm.shape[1]).astype(np.int16)


def decode_all(wavs: list[Wav]) -> list[np.ndarray]:
    """Mono samples of each file; ADPCM blocks of one size are decoded together, whatever file they are from."""
    out: list[np.ndarray | None] = [None] * len(wavs)
    alike: dict[int, list[int]] = {}
    for i, w in enumerate(wavs):
        if w.codec == "ima_adpcm" and w.channels == 1 and len(w.data) % w.block == 0:
            alike.setdefault(w.block, []).append(i)
        else:
            out[i] = to_mono(to_pcm(w))
    for block, own in alike.items():
        pcm = decode_ima(np.frombuffer(b"".join(wavs[i].data for i in own), np.uint8), block)[:, 0]
        cut = np.cumsum([0] + [len(wavs[i].data) // block for i in own]) * (1 + 2 * (block - 4))
        for i, a, b in zip(own, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[i] = pcm[a:b]
    return out


def feature(pcm: np.ndarray, resampled: np.ndarray) -> str:
    """Loudness, peak, zero crossings and a checksum of the resampled samples."""
    if not len(pcm):
        return "samples=0"
    wide = pcm.astype(np.float64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"samples={len(pcm)};rms={np.sqrt(np.mean(wide * wide)):.3f};peak={int(np.abs(pcm.astype(np.int32)).max())};crossings={crossings};pcm_crc32={zlib.crc32(resampled.tobytes())}"


def store_audio(rows: DataFrame, samples: str, codec: str | Column = "mulaw", rate: int = 8000, block: int = 36, media: str = "media") -> DataFrame:
    """Replaces the binary column ``samples`` (coded samples, stored as they are) by ``media``, WAV files.

    codec is a name or a column of names; block is that of ADPCM. Null samples
    have null media; a column that is called like media is replaced. Repeated rows
    stay, an empty table gives an empty result.
    """
    rest = [c for c in rows.columns if c not in (samples, media)]
    schema = rows.select(*rest, F.lit(None).cast("binary").alias(media)).schema
    kind = (F.lit(codec) if isinstance(codec, str) else codec).alias("_codec")

    def one(data: bytes | None, name: str) -> bytes | None:
        return None if data is None else write_wav(data, name, rate, block if name == "ima_adpcm" else 2 if name == "pcm" else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "_samples", GROUP_BYTES):
                files = list(map(one, part["_samples"].to_pylist(), part["_codec"].to_pylist()))
                yield pa.RecordBatch.from_arrays([part[c] for c in rest] + [pa.array(files, pa.binary())], names=[*rest, media])

    return rows.select(*rest, F.col(samples).alias("_samples"), kind).mapInArrow(run, schema)


def decode_audio(rows: DataFrame, media: str = "media", to_rate: int = 16000) -> DataFrame:
    """Adds codec, rate, samples (as coded), pcm (16-bit little-endian mono at to_rate), feature and audio_error to rows.

    Media that is null or can't be read (no WAV file, an unknown format, a rate,
    channels, bits or block size that make no sense) has nulls and an audio_error;
    it never stops the job. Channels are averaged. Files without samples have empty
    samples and pcm. Columns of rows that have one of the new names are replaced;
    repeated rows stay, an empty table gives an empty result.
    """
    new = {"codec": "string", "rate": "int", "samples": "binary", "pcm": "binary", "feature": "string", "audio_error": "string"}
    rest = [c for c in rows.columns if c not in new]
    schema = rows.select(*rest, *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]

    def read(x: bytes | None) -> Wav | str:
        try:
            return "no media" if x is None else read_wav(x)
        except (ValueError, struct.error) as e:
            return str(e)

    def told(wav: Wav, pcm: np.ndarray) -> tuple:
        out = resample(pcm, wav.rate, to_rate)
        return (wav.codec, wav.rate, wav.data, out.astype("<i2").tobytes(), feature(pcm, out), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, media, GROUP_BYTES):
                found = [read(x) for x in part[media].to_pylist()]
                decoded = iter(decode_all([w for w in found if isinstance(w, Wav)]))
                made = zip(*[told(w, next(decoded)) if isinstance(w, Wav) else (None,) * 5 + (w,) for w in found], strict=True)
                yield pa.RecordBatch.from_arrays([part[c] for c in rest] + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=[*rest, *new])

    return rows.select(*rest).mapInArrow(run, schema)
