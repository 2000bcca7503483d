"""Audio features: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segments as fixed-shape tensors."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 16
OUT_RATE = RATE * UP // DOWN
WINDOW, HOP, FFT, MELS = 300, 120, 512, 32
#: Frames of one tensor; the last tensor of a clip is padded with zeros.
FRAMES = 64
#: Input groups (of DOWN samples) and frames that are worked on at a time; beside them a clip needs its samples, resampled samples and tensors, some 10 bytes for each byte of its payload.
GROUPS, STEP = 1 << 15, 16 * FRAMES


def _filter() -> np.ndarray:
    """Column p holds the taps of output phase p over the inputs around the start of a group of DOWN samples."""
    width = TAPS + DOWN
    at = np.arange(width) - TAPS // 2
    out = np.zeros((width, UP))
    for p in range(UP):
        x = at - p * DOWN / UP  # distance in input samples from the output's place
        cut = min(1.0, UP / DOWN) * 0.92
        out[:, p] = cut * np.sinc(cut * x) * np.where(np.abs(x) < TAPS / 2, np.cos(np.pi * x / TAPS) ** 2, 0)
    return (out / out.sum(0)).astype(np.float32)


def _mel_filters() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * OUT_RATE / FFT
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f[:, None] - low) / (mid - low), (high - f[:, None]) / (high - mid))).astype(np.float32)


_H, _M, _W = _filter(), _mel_filters(), np.hanning(WINDOW).astype(np.float32)


def store(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit samples of a mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are expected")
        return w.readframes(w.getnframes())


def resample(x: np.ndarray) -> np.ndarray:
    """UP outputs for each DOWN inputs, each output a dot product with the taps of its phase; zeros lie beyond the ends."""
    groups = -(-len(x) // DOWN)
    padded = np.zeros(groups * DOWN + TAPS + DOWN, np.float32)
    padded[TAPS // 2 : TAPS // 2 + len(x)] = x
    rows = np.lib.stride_tricks.sliding_window_view(padded, TAPS + DOWN)[::DOWN]
    return np.concatenate([np.ascontiguousarray(rows[i : min(i + GROUPS, groups)]) @ _H for i in range(0, groups, GROUPS)]).ravel()


@dataclass
class Features:
    tensors: np.ndarray  # (n, FRAMES, MELS) float32
    spans: list[tuple[float, float]]  # seconds that each tensor covers
    segments: list[tuple[float, float]]  # seconds in which the energy is high


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel energies, log energy) of each frame; a clip shorter than a window is one padded frame."""
    frames = 1 + max(0, -(-(len(y) - WINDOW) // HOP))
    padded = np.zeros((frames - 1) * HOP + WINDOW, np.float32)
    padded[: len(y)] = y[: len(padded)]
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    mels, energy = [], []
    for i in range(0, frames, STEP):
        spectrum = np.fft.rfft(rows[i : i + STEP] * _W, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log(power @ _M + 1e-6))
        energy.append(np.log(power.sum(1) + 1e-6))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, high: float = 0.5, low: float = 0.0) -> list[tuple[int, int]]:
    """Frame ranges that open where the energy reaches mean + high * deviation and close where it falls below mean + low * deviation."""
    mean, dev = float(energy.mean(dtype=np.float64)), float(energy.std(dtype=np.float64))
    if dev < 1e-6:
        return []
    state = np.where(energy >= mean + high * dev, 1, np.where(energy < mean + low * dev, 0, -1))
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(at >= 0, state[np.maximum(at, 0)], 0)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def features(payload: bytes) -> Features:
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x))
    n = -(-len(mels) // FRAMES)
    tensors = np.zeros((n * FRAMES, MELS), np.float32)
    tensors[: len(mels)] = mels
    seconds = lambda a, b: (a * HOP / OUT_RATE, ((b - 1) * HOP + WINDOW) / OUT_RATE)
    spans = [seconds(k * FRAMES, min((k + 1) * FRAMES, len(mels))) for k in range(n)]
    return Features(tensors.reshape(n, FRAMES, MELS), spans, [seconds(a, b) for a, b in segments(energy)])


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
_SCHEMA = pa.schema([("tensor", _TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def to_arrow(f: Features) -> bytes:
    """An Arrow IPC stream with a fixed-shape tensor and its time span in each row."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(f.tensors.ravel()), FRAMES * MELS)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(_TENSOR, flat), pa.array([s for s, _ in f.spans], pa.float64()), pa.array([e for _, e in f.spans], pa.float64())], schema=_SCHEMA)
    out = io.BytesIO()
    with pa.ipc.new_stream(out, _SCHEMA) as w:
        w.write_batch(batch)
    return out.getvalue()


def from_arrow(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pad(text: bytes) -> bytes:
    """text followed by bytes 32 up to a positive multiple of 192."""
    return text + b" " * (max(1, -(-len(text) // 192)) * 192 - len(text))


_ROW = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, tensors binary, digest string, segments array<struct<start_s:double,end_s:double>>"


def text_media(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): what was read back from the stored WAV file, the file, its tensors and its segments.

    A null text is an empty one, padded to 192 spaces. Each clip is worked on alone and in steps of fixed size, so
    equal texts give equal values. A clip's tensors are held at once and leave as one value, so a clip whose tensors
    reach 2 GB (a payload of about as many bytes) can't be stored; clips share a batch up to 8 MB. ``digest`` is of the
    tensors in steps of 1/8, so that the last bits of a processor's arithmetic hardly ever show. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "tensors", "digest", "segments"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
        for b in batches:
            rows, held = [], 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                data = (text.as_py() or "").encode()
                media = store(pad(data))
                back = load(media)
                f = features(back)
                rows.append((doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), media, to_arrow(f), hashlib.sha256(np.rint(f.tensors * 8).astype("<i2").tobytes()).hexdigest(), [{"start_s": s, "end_s": e} for s, e in f.segments]))
                held += len(media) + f.tensors.nbytes
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (digests of the tensors, in steps of 1/8, and of the segments)."""
    text = F.concat_ws(":", "digest", F.size("segments").cast("string"), F.sha2(F.to_json("segments").cast("binary"), 256))
    return text_media(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), text.alias("feature"))
