"""Audio features of 8-bit samples: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segments.

A payload is stored losslessly as the samples of a mono 8-bit WAV, read back from these stored bytes and turned into
log-mel tensors of fixed shape (``TILE`` frames x ``MELS`` bands; the last one is padded) with the time span of each
tensor and of each segment louder than its surroundings. They are stored as an Arrow IPC stream, whose tensor column has Arrow's fixed-shape
tensor type (a Spark column can only hold such tensors as lists, so the stream is one binary value), and digests are taken of what is
read back from it.

Cases: null and empty texts are 64 zero bytes; payloads of any length are worked on in blocks; equal payloads give
equal features; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chainloom.llm.common import arrow_map, batch, doc_table, read

RATE, UP, DOWN = 16000, 1, 2
FRAME, HOP, MELS, TILE = 200, 80, 24, 32
#: Segment thresholds over the quiet level, in log10 energy: above the first it begins, below the second it ends.
RISE, FALL = 0.3, 0.15
UNIT = 64
#: Frames transformed at a time.
BLOCK = 4096

FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tensors_sha256", pa.string())]
ARROW = pa.schema(FIELDS)
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors_sha256 string"


def payload(data: bytes) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(data: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(data)
    return out.getvalue()


def from_wav(stored: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@cache
def taps(up: int, down: int, half: int = 8) -> np.ndarray:
    """A Hann-windowed sinc low-pass at the lower of both rates, dealt into ``up`` phases."""
    width = half * max(up, down)
    n = np.arange(-width, width + 1)
    h = np.sinc(n / max(up, down)) * np.hanning(len(n) + 2)[1:-1]
    h *= up / h.sum()
    h = np.concatenate([h, np.zeros(-len(h) % up)])
    return h.reshape(-1, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase: output m takes phase (m * down) mod up of the filter, so no zero is ever multiplied."""
    bank = taps(up, down)
    delay = (bank.size - 1) // 2
    n_out = -(-len(x) * up // down)
    if not n_out:
        return np.zeros(0, np.float32)
    k = bank.shape[1]
    padded = np.concatenate([np.zeros(k, np.float32), x.astype(np.float32), np.zeros(k + 1, np.float32)])
    at = np.arange(n_out) * down + delay
    out = np.empty(n_out, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, k)
    for phase in range(up):
        pick = np.nonzero(at % up == phase)[0]
        if len(pick):
            newest = at[pick] // up + k
            rows = np.minimum(newest - k + 1, len(windows) - 1)
            step = rows[1] - rows[0] if len(rows) > 1 else 1
            view = windows[rows[0] : rows[-1] + 1 : step] if step > 0 and len(rows) == len(range(rows[0], rows[-1] + 1, step)) else windows[rows]
            out[pick] = view @ bank[phase][::-1]
    return out


@cache
def mel_bank(rate: int, n_fft: int, mels: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames of ``FRAME`` samples every ``HOP``; the end is padded with silence so that every sample is in a frame."""
    n = max(1, 1 + -(-max(0, len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros(FRAME + (n - 1) * HOP - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    n_fft = 1 << (FRAME - 1).bit_length()
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate, n_fft, MELS)
    out = np.empty((n, MELS), np.float32)
    for i in range(0, n, BLOCK):
        spectrum = np.fft.rfft(frames[i : i + BLOCK] * window, n_fft)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[i : i + BLOCK] = np.log10(power @ bank + np.float32(1e-6))
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [from, to) that rise over the high threshold and last until the energy falls under the low one."""
    if not len(energy):
        return []
    quiet = float(np.percentile(energy, 20))
    high, low = energy > quiet + RISE, energy > quiet + FALL
    edges = np.flatnonzero(np.diff(np.concatenate([[0], low.view(np.int8), [0]])))
    loud = np.concatenate([[0], np.cumsum(high)])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if loud[b] > loud[a]]


def features(samples: bytes, rate: int = RATE) -> dict:
    """mel: float32 (frames, MELS); segments: seconds; of unsigned 8-bit samples."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    new_rate = rate * UP // DOWN
    mel = log_mel(resample(x, UP, DOWN), new_rate)
    second = lambda frame: frame * HOP / new_rate
    return {"rate": new_rate, "mel": mel, "segments": [(second(a), second(b)) for a, b in segments(mel.mean(axis=1))]}


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), [TILE, MELS])


@cache
def tensor_schema() -> pa.Schema:
    """A tile, its time span in seconds, the frames it holds (the others are padding), and the spans of segments that begin in it."""
    return pa.schema([("mel", tensor_type()), ("from_s", pa.float64()), ("to_s", pa.float64()), ("frames", pa.int32()), ("segments", pa.list_(pa.list_(pa.float64(), 2)))])


def tiles(f: dict) -> pa.RecordBatch:
    """The log-mel frames as rows of ``tensor_schema``."""
    mel, second = f["mel"], HOP / f["rate"]
    n = -(-len(mel) // TILE)
    full = np.full((n * TILE, MELS), -6, np.float32)
    full[: len(mel)] = mel
    column = pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), TILE * MELS))
    start = np.arange(n) * TILE
    stop = np.minimum(start + TILE, len(mel))
    begun: list[list] = [[] for _ in range(n)]
    for a, b in f["segments"]:
        begun[min(n - 1, int(a / second + 0.5) // TILE)].append([a, b])
    return pa.RecordBatch.from_arrays([column, pa.array(start * second), pa.array(stop * second), pa.array((stop - start).astype(np.int32)), pa.array(begun, tensor_schema().types[4])], schema=tensor_schema())


def to_stream(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_batch(rows)
    return sink.getvalue().to_pybytes()


def from_stream(stored: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(stored) as r:
        return r.read_next_batch()


def digest(rows: pa.RecordBatch) -> str:
    """Of stored tensors: frames, band means, spread and peak, the time they span, and the segments."""
    mel = rows.column(0).to_numpy_ndarray().reshape(-1, MELS)[: sum(rows.column(3).to_pylist())]
    found = [s for row in rows.column(4).to_pylist() for s in row]
    stats = ",".join(f"{v:.2f}" for v in (*mel.mean(axis=0)[::6], mel.std(), mel.max()))
    return f"frames={len(mel)};tiles={len(rows)};mel={stats};seconds={rows.column(2)[-1].as_py():.3f};segments={len(found)};loud={sum(b - a for a, b in found):.2f}"


def tensors_of(text: str | None) -> tuple[bytes, bytes, bytes]:
    """The payload's bytes, the stored WAV, and the stored tensors of what is read back from it."""
    data = (text or "").encode("utf-8", "surrogatepass")
    stored = to_wav(payload(data))
    samples, rate = from_wav(stored)
    return data, stored, to_stream(tiles(features(samples, rate)))


def audio_tensors(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary, tensors binary): the stored WAV of each document and its tensors, for ``from_stream``."""
    arrow = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("tensors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, media, tensors = tensors_of(text)
                yield batch(arrow, [[doc_id], [media], [tensors]])

    return arrow_map(doc_table(docs), run, "doc_id long, media binary, tensors binary")


def audio_digests(docs: DataFrame) -> DataFrame:
    """One row per document with digests of what was stored and read back, and of its tensors, which are read back too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, stored, tensors = tensors_of(text)
                samples, _ = from_wav(stored)
                rows.append((doc_id, len(data), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), digest(from_stream(tensors)), hashlib.sha256(tensors).hexdigest()))
            if rows:
                yield batch(ARROW, list(zip(*rows, strict=True)))

    return arrow_map(doc_table(docs), run, SCHEMA)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digests(read(spark, sf_dir, "documents"))
