"""Audio features of 8-bit sound columns.

Sound is kept as WAV bytes (8 bits, one channel). Features are computed from the stored bytes: the samples are resampled
by a polyphase filter, cut into overlapping frames, and turned into log-mel energies. These are stored as an Arrow
stream of fixed-shape tensors, each with its span of time; the last tensor is filled with silence. Segments of sound are
found with hysteresis: one opens when the energy rises above the upper threshold and closes when it falls below the
lower one.

Rows are independent and work through frames in blocks, so memory follows the largest sound only by its samples and
result. Batches are cut to a few MB on the way back to Spark.

Defined results: NULL texts are empty; an empty payload is one stretch of padding; equal bytes give equal results;
an empty table gives an empty result; columns named in ``keep`` are carried along, others are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.tokens import batches

RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, FFT, MELS, TENSOR_FRAMES = 200, 80, 256, 40, 64
_FLOOR = 1e-10
_BLOCK = 4096  # frames


def payload(text: str | None, multiple: int = 192) -> tuple[bytes, int]:
    """UTF-8 bytes filled with spaces to a positive multiple, and their number before that."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // multiple)) * multiple), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(samples) + len(pad), b"WAVE") + head + samples + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


@lru_cache
def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """Kaiser-windowed sinc that keeps what both rates can hold; ``half`` zero crossings on each side."""
    wide = max(up, down)
    t = np.arange(-half * wide, half * wide + 1)
    return (up / wide * np.sinc(t / wide) * np.kaiser(len(t), 8.0)).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: output n sums the filter's phase n * down % up over the input around n * down / up."""
    h = low_pass(up, down)
    middle = len(h) // 2
    n = -(-len(x) * up // down)
    taps = -(-len(h) // up)
    padded = np.concatenate([np.zeros(taps, np.float32), x, np.zeros(taps + down, np.float32)])
    y = np.zeros(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        shift = first * down + middle
        count, origin = len(range(first, n, up)), shift // up
        part = np.zeros(count, np.float32)
        for k, tap in enumerate(h[shift % up :: up]):
            a = taps + origin - k
            part += tap * padded[a : a + (count - 1) * down + 1 : down]
        y[first::up] = part
    return y


@lru_cache
def mel_bank(rate: float, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters at equal distances in mel, as a matrix of (fft / 2 + 1, mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1)[:, None] * rate / fft
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(np.minimum(rise, fall), 0).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames, mels) and the frames' energy in dB."""
    n = max(1, 1 + -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + FRAME - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate)
    mel, power = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, _BLOCK):
        f = frames[a : a + _BLOCK]
        power[a : a + _BLOCK] = np.einsum("ij,ij->i", f, f) / FRAME
        spectrum = np.fft.rfft(f * window, FFT)
        mel[a : a + _BLOCK] = np.log(np.maximum((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank, _FLOOR))
    return mel, 10 * np.log10(np.maximum(power, _FLOOR))


def segments(energy: np.ndarray, above: float = 1.0, below: float = -1.0) -> list[tuple[int, int]]:
    """Runs of frames that open at ``above`` dB over the median energy and close at ``below``."""
    level = energy - np.median(energy)
    mark = np.where(level >= above, 1, np.where(level < below, -1, 0))
    known = np.flatnonzero(mark)
    if not len(known):
        return []
    on = mark[known[np.maximum(np.searchsorted(known, np.arange(len(mark)), "right") - 1, 0)]] > 0
    on[: known[0]] = False
    edges = np.flatnonzero(np.diff(on.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
_STREAM = pa.schema([("log_mel", _TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def tensor_stream(mel: np.ndarray, seconds: float) -> bytes:
    """An Arrow stream of fixed-shape tensors with the span of time that each covers."""
    n = -(-len(mel) // TENSOR_FRAMES)
    filled = np.full((n * TENSOR_FRAMES, MELS), np.float32(np.log(_FLOOR)))
    filled[: len(mel)] = mel
    step = seconds * HOP
    starts = np.arange(n) * TENSOR_FRAMES * step
    ends = np.minimum((np.arange(n) + 1) * TENSOR_FRAMES, len(mel)) * step
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STREAM) as out:
        tensors = pa.ExtensionArray.from_storage(_TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), TENSOR_FRAMES * MELS))
        out.write_batch(pa.RecordBatch.from_arrays([tensors, pa.array(starts), pa.array(ends)], schema=_STREAM))
    return sink.getvalue().to_pybytes()


def describe(media: bytes) -> dict:
    """Everything that is known of one stored sound."""
    stored, rate = from_wav(media)
    samples = np.frombuffer(stored, np.uint8)
    y = resample((samples.astype(np.float32) - 128) / 128)
    mel, energy = log_mel(y, rate * UP / DOWN)
    step = DOWN / (rate * UP)
    spans = [{"start_s": a * HOP * step, "end_s": b * HOP * step} for a, b in segments(energy)]
    return {
        "payload_bytes": len(stored), "payload_sha256": hashlib.sha256(stored).hexdigest(), "tail_crc32": crc32(stored[-16:]),
        "seconds": len(stored) / rate, "frames": len(mel), "tensors": tensor_stream(mel, step), "segments": spans,
    }


def store(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep, n_bytes, media): the text of each row as the samples of a WAV file."""
    def of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            texts = b.column(b.num_columns - 1).to_pylist()
            for s in batches([t or "" for t in texts]):
                filled = [payload(t) for t in texts[s]]
                carried = [b.column(i)[s] for i in range(len(keep))]
                made = [pa.array([n for _, n in filled], pa.int64()), pa.array([to_wav(p) for p, _ in filled], pa.binary())]
                yield pa.RecordBatch.from_arrays(carried + made, [*keep, "n_bytes", "media"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(of, ", ".join([*kinds, "n_bytes long, media binary"]))


_FEATURES = pa.schema([
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("seconds", pa.float64()), ("frames", pa.int64()),
    ("tensors", pa.binary()), ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
])


def features(sounds: DataFrame, batch_bytes: int = 2_000_000) -> DataFrame:
    """Adds what ``describe`` finds to rows with ``media``."""
    def of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            media, at = b.column(b.schema.get_field_index("media")), 0
            while at < b.num_rows:
                rows, size, begun = [], 0, at
                while at < b.num_rows and size < batch_bytes:
                    rows.append(describe(media[at].as_py()))
                    size += len(rows[-1]["tensors"])
                    at += 1
                found = pa.RecordBatch.from_pylist(rows, _FEATURES)
                yield pa.RecordBatch.from_arrays([*b.slice(begun, at - begun).columns, *found.columns], [*b.schema.names, *_FEATURES.names])

    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, seconds double, frames long, tensors binary, segments array<struct<start_s:double,end_s:double>>"
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in sounds.schema]
    return sounds.mapInArrow(of, ", ".join([*kinds, added]))
