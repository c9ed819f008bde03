"""Audio columns and their features.

Samples are kept as 8-bit mono PCM in a WAV container, one binary value per row. Features come from
the stored bytes: a polyphase resampler, overlapping log-mel filterbanks, and an energy
segmentation with hysteresis. Filterbanks of any duration are averaged into a fixed number of time
bins, so a column of them is a fixed-shape Arrow tensor; spans of sound have their times.
"""

from __future__ import annotations

import functools
import hashlib
import io
import math
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.shared import small_batches, table

RATE, UP, DOWN, TAPS = 8000, 4, 5, 16
FRAME, HOP, MELS, BINS = 256, 128, 24, 16
#: Hysteresis: a span of sound begins above the first and lasts while above the second share of the loudest frame's energy.
HIGH, LOW = 0.5, 0.25
#: Samples whose features are computed at a time.
BLOCK = 1 << 19
FEATURES = "media binary, tensor array<float>, spans array<struct<start:double,stop:double>>"


def stored(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> tuple[bytes, int]:
    """The samples of a WAV file, and their rate."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@functools.cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """One low-pass filter of taps values for each phase, each of sum 1."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * np.hanning(n + 2)[1:-1]
    phases = h.reshape(taps, up).T[:, ::-1]
    return np.ascontiguousarray(phases / phases.sum(1, keepdims=True), np.float32)


def resampled(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """x at up / down times its rate: output m is phase m * down mod up of the filter at x[m * down // up]."""
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(1, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):
        at = np.arange(first, n, up) * down // up
        out[first::up] = views[at] @ _phases(up, down, taps)[first * down % up]
    return out


@functools.cache
def _mel(rate: float) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * math.log10(1 + rate / 2 / 700), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel filterbanks of all frames, and their energies; the last frame is filled up with silence."""
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros(FRAME + (frames - 1) * HOP - len(x), np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bands, energy = [], []
    for at in range(0, frames, BLOCK // FRAME):  # bounded memory for long recordings
        part = views[at : at + BLOCK // FRAME]
        spectrum = np.fft.rfft(part * _HANN)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        bands.append(np.log(power @ _mel(rate) + 1e-6))
        energy.append((part * part).sum(1))
    return np.concatenate(bands), np.concatenate(energy)


def segmented(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> np.ndarray:
    """(first, last + 1) of runs of frames above low of the loudest that have one above high."""
    loud = energy.max(initial=0)
    if loud <= 0:
        return np.zeros((0, 2), np.int64)
    edge = np.diff(np.concatenate(([0], (energy > low * loud).view(np.int8), [0])))
    spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)
    above = np.concatenate(([0], np.cumsum(energy > high * loud)))
    return spans[above[spans[:, 1]] > above[spans[:, 0]]]


def features(media: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """BINS x MELS mean log-mel bands, and spans of sound in seconds."""
    samples, rate = read_back(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    out_rate = rate * UP / DOWN
    bands, energy = log_mel(resampled(x), out_rate)
    edges = np.arange(BINS + 1) * len(bands) // BINS
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(bands, 0, dtype=np.float64)])
    low = np.minimum(edges[:-1], len(bands) - 1)
    high = np.maximum(edges[1:], low + 1)
    tensor = ((sums[high] - sums[low]) / (high - low)[:, None]).astype(np.float32)
    seconds = len(samples) / rate
    return tensor, [(a * HOP / out_rate, min(seconds, ((b - 1) * HOP + FRAME) / out_rate)) for a, b in segmented(energy).tolist()]


def tensor_array(flat: pa.Array) -> pa.Array:
    """A column of tensors (lists of BINS * MELS floats) as a fixed-shape Arrow tensor array."""
    values = flat.flatten().cast(pa.float32())
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (BINS, MELS), dim_names=("time", "mel")), pa.FixedSizeListArray.from_arrays(values, BINS * MELS))


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text (null: empty), filled up with 0 to a positive multiple of 64."""
    body = (text or "").encode()
    return body + bytes(64 - len(body) % 64 if len(body) % 64 or not body else 0)


def audio_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text and FEATURES of docs: the stored audio of each whole text and what was computed from it.

    Null and empty texts are 64 samples of 0; equal texts have equal values, also in repeated rows.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                media, tensors, spans = [], [], []
                for text in rows["text"]:
                    media.append(stored(payload_of(text.as_py())))
                    tensor, found = features(media[-1])
                    tensors.append(tensor.ravel())
                    spans.append([{"start": a, "stop": b} for a, b in found])
                fixed = tensor_array(pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(tensors)), BINS * MELS))
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["text"], pa.array(media, pa.binary()), fixed.storage.cast(pa.list_(pa.float32())), pa.array(spans, span)], ["doc_id", "text", "media", "tensor", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(columns, f"doc_id long, text string, {FEATURES}")


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored audio of all documents and its features. See audio_columns() for every edge case; long texts are computed in blocks, an empty table gives an empty result."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            tensors = batch["tensor"]
            for i in range(len(batch)):
                media = batch["media"][i].as_py()
                samples, _ = read_back(media)
                tensor = tensors[i].values.to_numpy().reshape(BINS, MELS)
                means = ",".join(f"{v:.3f}" for v in tensor.mean(0))
                spans = batch["spans"][i].as_py()
                sound = sum(s["stop"] - s["start"] for s in spans)
                feature = f"{BINS}x{MELS}:{hashlib.md5(np.round(tensor, 2).tobytes()).hexdigest()};mel={means};spans={len(spans)};sound={sound:.3f}"
                n_bytes = len((batch["text"][i].as_py() or "").encode())
                out.append((n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return audio_columns(table(spark, sf_dir, "documents")).mapInArrow(digest, schema)
