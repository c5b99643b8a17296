"""PCM helpers: decoding, mixing down, resampling, levels. Numpy inside tasks, columns where SQL suffices."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 16000
MOST_SECONDS, MOST_BYTES = 60, 32 << 20
SILENCE = 3e-5
# fixed values: the extensible format's tag, and its identifier of plain PCM
EXTENSIBLE, PCM_GUID = 0xFFFE, bytes.fromhex("0100000000001000800000aa00389b71")


def n_samples(pcm: Column) -> Column:
    return F.floor(F.octet_length(pcm) / 2).cast("long")


def duration_s(samples: Column, rate: int) -> Column:
    return samples / rate if rate > 0 else F.lit(0.0)


def rms(samples: Column) -> Column:
    """Root mean square of an array of samples."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def dbfs(level: Column) -> Column:
    return 20 * F.log10(level + 1e-12)


def loud_enough(samples: Column, least: float = SILENCE) -> Column:
    return rms(samples) + 1e-12 >= least


def decode(pcm: bytes, width: int = 2, channels: int = 1) -> np.ndarray:
    """Samples in [-1, 1), channels averaged: 8 bit is unsigned, wider ones signed little endian."""
    octets = np.frombuffer(pcm, np.uint8).reshape(-1, width)
    wide = np.zeros((len(octets), 4), np.uint8)  # every width as the high bytes of 32 bits
    wide[:, 4 - width :] = octets if width > 1 else octets + np.uint8(128)
    x = (wide.view("<i4").astype(np.float64) / 2.0**31).astype(np.float32)
    return x.reshape(-1, channels).mean(1)


def encode(samples: np.ndarray, scale: int = 32767) -> bytes:
    return np.clip(samples * scale, -32768, 32767).astype("<i2").tobytes()


def resample(samples: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """Linear interpolation on a grid without the end point; a length of one or less gives nothing."""
    n = round(len(samples) * target / rate)
    if n <= 1 or not len(samples):
        return np.zeros(0, np.float32)
    if rate == target:
        return samples.astype(np.float32)
    at = np.arange(n) * (len(samples) / n)
    return np.interp(at, np.arange(len(samples)), samples).astype(np.float32)


def downmix(stereo: np.ndarray, block: int) -> np.ndarray:
    """Per block: the louder channel if the two hardly correlate, else 0.7 of both."""
    out = []
    for i in range(0, len(stereo), block):
        left, right = stereo[i : i + block, 0], stereo[i : i + block, 1]
        spread = left.std() * right.std()
        alike = float(((left - left.mean()) * (right - right.mean())).mean() / spread) if spread > 0 else 1.0
        louder = left if (left**2).sum() >= (right**2).sum() else right
        out.append(louder if alike < 0.2 else 0.7 * left + 0.7 * right)
    return np.concatenate(out) if out else np.zeros(0)


def wav_fields(data: bytes) -> dict:
    """Format fields and payload of a RIFF file, or the reason why it is none."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return {"reason": "not-wav"}
    if struct.unpack_from("<I", data, 4)[0] + 8 != len(data):
        return {"reason": "wrong-length"}
    at, found = 12, {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            return {"reason": "wrong-length"}
        if name == b"fmt " and size >= 16:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if kind == EXTENSIBLE and body[24:40] == PCM_GUID:
                kind = 1
            found |= {"format": kind, "channels": channels, "rate": rate, "width": bits // 8}
        elif name == b"data":
            found["pcm"] = body
        at += 8 + size + size % 2
    if "rate" not in found or "pcm" not in found:
        return {"reason": "incomplete"}
    return found


def acceptable(fields: dict, size: int, recording: bool = False) -> str | None:
    """The first reason against a file: enrollment samples by default, or finished recordings (mono, 16 kHz)."""
    if "reason" in fields:
        return fields["reason"]
    if fields["format"] != 1 or fields["width"] not in (1, 2, 3, 4):
        return "compressed"
    frame = fields["width"] * fields["channels"]
    if recording:
        return None if (fields["channels"], fields["rate"], fields["width"]) == (1, RATE, 2) else "not-16k-mono"
    if fields["channels"] not in (1, 2):
        return "channels"
    if not 8000 <= fields["rate"] <= 192_000:
        return "rate"
    if size > MOST_BYTES:
        return "too-large"
    if not fields["pcm"] or len(fields["pcm"]) % frame:
        return "frames"
    return "too-long" if len(fields["pcm"]) // frame > MOST_SECONDS * fields["rate"] else None


def riff(pcm: bytes, rate: int = RATE, width: int = 2, channels: int = 1) -> bytes:
    """PCM as a RIFF file."""
    return riff_head(len(pcm), rate, width, channels) + pcm


def riff_head(n_bytes: int, rate: int = RATE, width: int = 2, channels: int = 1) -> bytes:
    """What stands before so many bytes of PCM in a RIFF file."""
    frame = width * channels
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n_bytes, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * frame, frame, 8 * width, b"data", n_bytes)


def riff_column(pcm: Column, rate: int = RATE) -> Column:
    """Mono 16-bit PCM bytes as the bytes of a RIFF file; null stays null."""
    little = lambda n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, s).bitwiseAND(F.lit(255))), 2, "0") for s in (0, 8, 16, 24)]))
    size = F.octet_length(pcm).cast("long")
    fixed = struct.pack("<4s4sIHHIIHH4s", b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data")
    return F.concat(F.lit(b"RIFF"), little(size + 36), F.lit(fixed), little(size), pcm)
