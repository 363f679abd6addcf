"""Media columns: audio fingerprints of WAV values in a binary column.

The wave module reads each value; channels are averaged. A short-time Fourier transform (Hann windows of ``FRAME`` samples every ``HOP``)
gives the spectrogram. Peaks are cells that are the highest of their neighbourhood and within ``RANGE_DB`` of the loudest cell. Each peak
is paired with the next ``fan`` peaks, in order of time and frequency, that lie ``REACH`` frames ahead at most, and a pair's fingerprint
codes both frequency bins and the distance in time. They are stored as two arrays of equal length, ordered by time: ``times``, the frame of
the earlier peak, and ``codes``. An excerpt of a recording has its codes, at times that differ by a constant.

Defined cases: null values have status 'null', values that the wave module can't read 'invalid', and recordings without a sample, or of
silence, 'ok' with empty arrays; null and invalid ones have null arrays. The last frame is padded with zeros. Recordings of any length are worked on in
blocks of frames. Samples may have any number of whole bytes. Repeated rows are treated alike; a null id stays null, and one that is no integer becomes null. Empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._spark import mapped

FRAME, HOP, RANGE_DB, REACH = 512, 256, 50.0, 31
NEAR_TIME, NEAR_BINS, BLOCK = 2, 6, 4096
RATE, NOTE, STEPS = 8000, 160, 24
PRINTS = "{id} bigint, status string, sample_rate bigint, n_samples bigint, times array<int>, codes array<int>"
_HANN = np.hanning(FRAME + 1)[:-1]


def read_wav(value: bytes) -> tuple[int, int, int, bytes]:
    """Sample rate, channels, bytes of a sample, and the whole frames' bytes. Raises wave.Error or EOFError."""
    with wave.open(io.BytesIO(value)) as w:
        channels, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = w.readframes(w.getnframes())
    return rate, channels, width, raw[: len(raw) // (channels * width) * channels * width]


def samples(raw: bytes, channels: int, width: int) -> np.ndarray:
    """Samples in [-1, 1], channels averaged. Of samples of over four bytes the lower bytes don't count."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
    elif width > 4:
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, width)[:, -4:]).view("<i4").ravel() / 2.0**31
    else:
        x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1)


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def frames_of(n: int) -> int:
    """Frames that hold n samples, the last one padded with zeros."""
    return 1 + max(0, -(-(n - FRAME) // HOP))


def spectrogram(samples: np.ndarray) -> np.ndarray:
    """Decibels by frame and frequency bin."""
    count = frames_of(len(samples))
    padded = np.zeros((count - 1) * HOP + FRAME)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    return 20 * np.log10(np.abs(np.fft.rfft(frames * _HANN, axis=1)) + 1e-9)


def _highest(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """The maximum over a neighbourhood along an axis."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (reach, reach)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, constant_values=-np.inf), 2 * reach + 1, axis=axis)
    return view.max(axis=-1)


def peaks(raw: bytes, channels: int, width: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, by time, then frequency. Silence has none; equal neighbours are peaks alike.

    So many frames are worked on at once, so that only the recording's bytes and its peaks are held.
    """
    size = channels * width
    n = len(raw) // size
    count = frames_of(n) if n else 0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    loudest = -np.inf
    for start in range(0, count, block):
        end = min(start + block, count)
        low, high = max(0, start - NEAR_TIME), min(count, end + NEAR_TIME)
        level = spectrogram(samples(raw[low * HOP * size : min(n, (high - 1) * HOP + FRAME) * size], channels, width))[: high - low]
        top = _highest(_highest(level, NEAR_TIME, 0), NEAR_BINS, 1)
        own = slice(start - low, end - low)
        time, bins = np.nonzero(level[own] == top[own])
        found.append((time + start, bins, level[own][time, bins]))
        loudest = max(loudest, float(level[own].max()))
    if loudest <= -150:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    time, bins, level = (np.concatenate(x) for x in zip(*found, strict=True))
    loud = level >= loudest - RANGE_DB
    return time[loud], bins[loud]


def pairs(time: np.ndarray, bins: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs: code = (first bin << 9 | second bin) << 5 | distance in time."""
    times, codes = [], []
    later = np.searchsorted(time, time, side="right")  # pairs join peaks of different frames
    for k in range(fan):
        at = np.flatnonzero(later + k < len(time))
        other = later[at] + k
        gap = time[other] - time[at]
        ok = gap <= REACH
        at, other, gap = at[ok], other[ok], gap[ok]
        times.append(time[at])
        codes.append((bins[at] << 9 | bins[other]) << 5 | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def fingerprint(value: bytes | None, fan: int) -> tuple:
    """(status, rate, samples, times, codes)."""
    if value is None:
        return "null", None, None, None, None
    try:
        rate, channels, width, raw = read_wav(value)
    except (wave.Error, EOFError, ValueError, RuntimeError):
        return "invalid", None, None, None, None
    return "ok", rate, len(raw) // (channels * width), *pairs(*peaks(raw, channels, width), fan)


def fingerprints(media: DataFrame, id_column: str, wav_column: str, fan: int = 5) -> DataFrame:
    """(id, status, sample_rate, n_samples, times, codes) of each row's WAV value."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [fingerprint(v.as_py(), fan) for v in batch.column("wav")]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column("ident"), *columns], names=[id_column, "status", "sample_rate", "n_samples", "times", "codes"])

    some = media.select(F.col(f"`{id_column}`").try_cast("bigint").alias("ident"), F.col(f"`{wav_column}`").alias("wav"))
    return mapped(some, "wav", work, PRINTS.format(id=f"`{id_column}`"))


def melody(vector: np.ndarray) -> np.ndarray:
    """Samples that sound a vector: a note for each component, its pitch in steps of the component's value."""
    step = np.clip(np.rint((vector / (3 / np.sqrt(max(len(vector), 1))) + 1) / 2 * STEPS), 0, STEPS)
    pitch = np.repeat(300 * 2 ** (step / STEPS * 3), NOTE)
    return 0.8 * np.sin(2 * np.pi * np.cumsum(pitch) / RATE)


def sound(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, wav): each vector sounded as a WAV value; null for a null vector, null components sound as zero."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        wav = [None if v is None else write_wav(melody(np.nan_to_num(np.array(v, dtype=np.float64)))) for v in batch.column("vector").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("ident"), pa.array(wav, pa.binary())], names=[id_column, "wav"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield work(batch.slice(at, 256))

    some = vectors.select(F.col(f"`{id_column}`").try_cast("bigint").alias("ident"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    return some.mapInArrow(run, f"`{id_column}` bigint, wav binary")
