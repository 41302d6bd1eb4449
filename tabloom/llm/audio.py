"""Audio features of media columns: polyphase resampling, overlapped log-mel frames, hysteresis energy segmentation.

A clip is PCM (or a WAV file of PCM) in a binary column.  It is resampled by a windowed-sinc filter in polyphase
form: ``up`` outputs depend on the same stretch of inputs, so all phases are one matrix product over strided frames.
Frames of 25 ms every 10 ms get log-mel energies.  Sound begins where a frame's level reaches ``HIGH`` and lasts
until it falls under ``LOW``; between the two the state holds.  Each stretch of sound is cut into tensors of one
shape, [FRAMES, MELS], the last filled up with zeros, each with its time span and number of real frames.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 16_000
WINDOW, HOP, FFT, MELS, FRAMES = 400, 160, 512, 64, 16
HIGH, LOW = -30.0, -42.0  # dB of full scale
LEAST_FRAMES = 1
TAPS = 24  # zero crossings of the sinc on either side
#: Frames that are worked on at once; what is open at the end of a strip is carried over to the next.
STRIP = 1024


@lru_cache(maxsize=16)
def _filter(up: int, down: int) -> tuple[np.ndarray, int]:
    """[window, up] matrix whose product with input windows, one every ``down`` samples, gives ``up`` outputs; the lead."""
    half = TAPS * max(up, down) // up + 1
    r = np.arange(up)
    base = r * down // up
    width = int(base[-1]) + 2 * half + 1
    at = np.arange(width)[:, None] - half  # input index relative to the window's anchor
    x = at - (r * down / up)[None, :]
    cut = min(1.0, up / down)
    t = np.clip(x / (half + 1), -1, 1)
    taps = cut * np.sinc(cut * x) * (0.5 + 0.5 * np.cos(np.pi * t))
    return (taps / taps.sum(axis=0)).astype(np.float32), half


def resampled_length(n: int, rate: int, to: int = RATE) -> int:
    return -(-n * to // rate)


def resampled(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """``x`` at the rate ``to``; ceil(len * to / rate) samples, zeros assumed outside."""
    return resampled_part(lambda b, e: x[b:e], len(x), rate, 0, resampled_length(len(x), rate, to), to)


def resampled_part(read: Callable[[int, int], np.ndarray], length: int, rate: int, begin: int, end: int, to: int = RATE) -> np.ndarray:
    """Samples ``begin`` to ``end`` of the resampled signal, of which ``read(b, e)`` gives ``length`` samples in parts."""
    if begin >= end:
        return np.zeros(0, np.float32)
    if rate == to:
        return read(begin, end).astype(np.float32)
    g = gcd(rate, to)
    up, down = to // g, rate // g
    taps, half = _filter(up, down)
    first, last = begin // up, -(-end // up)
    at, size = first * down - half, (last - first - 1) * down + len(taps)
    padded = np.zeros(size, np.float32)
    b, e = max(0, at), min(length, at + size)
    if b < e:
        padded[b - at : e - at] = read(b, e)
    frames = np.lib.stride_tricks.sliding_window_view(padded, len(taps))[::down]
    return (frames @ taps).reshape(-1)[begin - first * up : end - first * up]


@lru_cache(maxsize=4)
def mel_filters(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """[fft // 2 + 1, mels] triangles, equally wide on the mel scale."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def framed(x: np.ndarray) -> np.ndarray:
    """[frames, WINDOW]; as many as touch every sample, the last filled up with zeros."""
    n = max(1, -(-(len(x) - WINDOW) // HOP) + 1) if len(x) else 0
    padded = np.zeros((n - 1) * HOP + WINDOW if n else 0, np.float32)
    padded[: len(x)] = x[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP] if n else np.zeros((0, WINDOW), np.float32)


def log_mel(frames: np.ndarray) -> np.ndarray:
    spectrum = np.fft.rfft(frames * np.hanning(WINDOW + 1)[:-1].astype(np.float32), FFT)
    return np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ mel_filters() + np.float32(1e-6))


def levels(frames: np.ndarray) -> np.ndarray:
    """Mean power of each frame, its mean taken off, in dB of full scale."""
    f = frames.astype(np.float64)
    return 10 * np.log10(np.maximum((f * f).mean(axis=1) - f.mean(axis=1) ** 2, 1e-12))


def active(level: np.ndarray, before: bool = False, high: float = HIGH, low: float = LOW) -> np.ndarray:
    """Whether sound is on in each frame: on from ``high`` until below ``low``, as ``before`` until a frame decides."""
    decided = np.where(level >= high, 1, np.where(level < low, 0, -1))
    last = np.maximum.accumulate(np.where(decided >= 0, np.arange(len(level)), -1)) if len(level) else np.zeros(0, int)
    return np.where(last >= 0, decided[last], int(before)) == 1


def sounding(level: np.ndarray, high: float = HIGH, low: float = LOW, least: int = LEAST_FRAMES) -> list[tuple[int, int]]:
    """Frame ranges [begin, end): on from ``high`` until below ``low``."""
    edge = np.flatnonzero(np.diff(np.r_[False, active(level, False, high, low), False].astype(np.int8)))
    return [(int(b), int(e)) for b, e in edge.reshape(-1, 2) if e - b >= least]


class Pcm:
    """Mono samples in [-1, 1), read in parts, and their rate.  A RIFF file says its own; other bytes are PCM of ``width`` bytes."""

    def __init__(self, clip: bytes, rate: int | None, width: int) -> None:
        self.channels = 1
        if clip[:4] == b"RIFF" and clip[8:12] == b"WAVE":
            with wave.open(io.BytesIO(clip)) as w:
                rate, width, self.channels, clip = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
            if rate <= 0 or width not in WIDTHS:
                raise wave.Error(f"{width} bytes a sample at a rate of {rate}")
        elif rate is None and clip:
            raise ValueError("a clip that is no WAV file needs a rate")
        self.clip, self.rate, self.width = clip, rate, width
        self.length = len(clip) // (width * self.channels)

    def read(self, begin: int, end: int) -> np.ndarray:
        size = self.width * self.channels
        part = self.clip[begin * size : end * size]
        if self.width == 1:
            x = (np.frombuffer(part, np.uint8).astype(np.float32) - 128) / 128
        elif self.width == 3:
            wide = np.zeros((len(part) // 3, 4), np.uint8)
            wide[:, 1:] = np.frombuffer(part, np.uint8).reshape(-1, 3)
            x = (wide.reshape(-1).view("<i4") / 2**31).astype(np.float32)
        else:
            x = (np.frombuffer(part, f"<i{self.width}") / 2.0 ** (8 * self.width - 1)).astype(np.float32)
        return x.reshape(-1, self.channels).mean(axis=1) if self.channels > 1 else x


WIDTHS = (1, 2, 3, 4)
SHAPE = json.dumps({"shape": [FRAMES, MELS], "dim_names": ["time", "mel"]})
TENSOR = T.StructField("tensor", T.ArrayType(T.FloatType(), False), True, {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": SHAPE})


def schema(key: T.DataType) -> T.StructType:
    kinds = {"doc_id": key, "segment": T.IntegerType(), "chunk": T.IntegerType(), "start_s": T.DoubleType(), "end_s": T.DoubleType(), "frames": T.IntegerType()}
    return T.StructType([*[T.StructField(n, k) for n, k in kinds.items()], TENSOR])


def clip_features(clip: bytes, rate: int | None, width: int, strip: int = STRIP) -> Iterator[tuple[int, int, float, float, int, np.ndarray]]:
    """(segment, chunk, start, end, real frames, [FRAMES, MELS]) of one clip; none for silence.

    The clip is worked on in strips of frames: besides its own bytes no memory grows with its length.
    """
    pcm = Pcm(clip, rate, width)
    total = resampled_length(pcm.length, pcm.rate) if clip else 0
    count = max(1, -(-(total - WINDOW) // HOP) + 1) if total else 0
    segment, chunk, on, held, at = -1, 0, False, np.zeros((0, MELS), np.float32), 0

    def tensor(mel: np.ndarray) -> tuple[int, int, float, float, int, np.ndarray]:
        n = len(mel)
        full = np.zeros((FRAMES, MELS), np.float32)
        full[:n] = mel
        return segment, chunk, at * HOP / RATE, min(total, (at + n - 1) * HOP + WINDOW) / RATE, n, full

    for f in range(0, count, strip):
        n = min(strip, count - f)
        x = np.zeros((n - 1) * HOP + WINDOW, np.float32)
        end = min(total, f * HOP + len(x))
        x[: end - f * HOP] = resampled_part(pcm.read, pcm.length, pcm.rate, f * HOP, end)
        frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
        sound = active(levels(frames), on)
        edge = np.flatnonzero(np.diff(np.r_[False, sound, False].astype(np.int8))).reshape(-1, 2)
        if on and not sound[0] and len(held):
            yield tensor(held)
        if not (on and sound[0]):
            held = held[:0]
        mel = log_mel(frames[sound]) if len(edge) else held
        done = 0
        for k, (b, e) in enumerate(edge.tolist()):
            if not (k == 0 and b == 0 and on):
                segment, chunk, held, at = segment + 1, 0, held[:0], f + b
            held = np.concatenate([held, mel[done : done + e - b]])
            done += e - b
            while len(held) >= FRAMES:
                yield tensor(held[:FRAMES])
                held, at, chunk = held[FRAMES:], at + FRAMES, chunk + 1
            if len(held) and (e < n or f + n == count):
                yield tensor(held)
                held = held[:0]
        on = bool(sound[-1])


def features(df: DataFrame, id_col: str = "doc_id", clip_col: str = "clip", rate: int | None = None, width: int = 1) -> DataFrame:
    """One row per tensor: doc_id, segment, chunk, start_s, end_s, frames, tensor (FRAMES x MELS floats, row by row).

    Clips are treated one by one, whole, and however long in strips; repeated rows give their tensors again and null ids
    stay, ids may be of any type.  Null, empty and silent clips, and WAV files that are broken or hold no PCM of 1 to 4
    bytes, give no rows.  Clips that are no WAV files are PCM of ``width`` bytes at ``rate``; without a rate they are an
    error, as is another width.  Other columns are not looked at.  An empty table gives no rows.
    """
    if width not in WIDTHS or (rate is not None and rate <= 0):
        raise ValueError(f"PCM of {width} bytes at a rate of {rate}")
    out = schema(df.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, clip in enumerate(batch.column(1)):
                if not clip.is_valid:
                    continue
                try:
                    for r in clip_features(clip.as_py(), rate, width):
                        rows.append((i, *r))
                        if len(rows) >= 2048:
                            yield _batch(batch.column(0), rows, out.names)
                            rows = []
                except (wave.Error, EOFError):
                    continue
            if rows:
                yield _batch(batch.column(0), rows, out.names)

    return df.select(F.col(id_col).alias("id"), F.col(clip_col).cast("binary").alias("clip")).mapInArrow(run, out)


def _batch(keys: pa.Array, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    i, seg, chunk, start, end, n, tensors = zip(*rows, strict=True)
    flat = pa.array(np.concatenate([t.reshape(-1) for t in tensors]))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (FRAMES * MELS)), flat)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(i)), pa.array(seg, pa.int32()), pa.array(chunk, pa.int32()), pa.array(start), pa.array(end), pa.array(n, pa.int32()), lists], names=names)


def as_tensors(table: pa.Table) -> pa.Table:
    """``table`` with its tensor column in Arrow's fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS], dim_names=["time", "mel"])
    column = table.column("tensor").combine_chunks()
    flat = (column.flatten() if len(column) else pa.array([], pa.float32())).cast(pa.float32())
    tensors = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, FRAMES * MELS))
    return table.set_column(table.schema.get_field_index("tensor"), "tensor", tensors)


def store(df: DataFrame, folder: str) -> DataFrame:
    """Write ``features`` rows as Parquet files whose column is of Arrow's fixed-shape tensor type; returns (file, rows).

    Each task writes a file of its own under a name that no other attempt has; the files that the returned rows
    name are the result, so one that a lost task left behind is no part of it.  ``folder`` must be shared.  An empty
    table writes no file and gives no rows; null ids are written as such.
    """

    if "://" in folder:
        raise ValueError("the folder must be a path that every executor has mounted")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, n = None, os.path.join(folder, f"part-{uuid.uuid4().hex}.parquet"), 0
        for batch in batches:
            table = as_tensors(pa.Table.from_batches([batch]))
            if writer is None:
                os.makedirs(folder, exist_ok=True)
                writer = pq.ParquetWriter(name, table.schema)
            writer.write_table(table)
            n += table.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "rows"])

    return df.mapInArrow(write, "file string, rows long")
