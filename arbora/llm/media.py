"""Media columns: 8-bit mono WAV bytes, short-time Fourier transforms, spectral-peak pair fingerprints.

``encode`` and ``decode`` go through the ``wave`` module, so what is analysed is what was stored. A fingerprint joins two
peaks of one spectrogram: ``time`` is the frame of the first, ``code`` packs its bin, the other's bin and the frames between.
Texts are taken whole: null counts as empty, an empty text is one unit of padding, a long one is analysed in blocks of frames.
Equal payloads have equal media and fingerprints, whatever batch they come in.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship

#: Payloads are padded to a multiple of so many bytes.
UNIT = 576
RATE = 8000
#: Samples of an analysis frame, and from one to the next; the shortest payload has five frames.
FRAME = 192
HOP = FRAME // 2
PEAKS = 3
FAN_OUT = 6
REACH = 32
_BLOCK = 2048
#: Magnitudes up to here are rounding, not peaks.
NOISE = 0.01
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str | None) -> bytes:
    """The text's UTF-8 bytes, and bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def encode(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("only 8-bit mono media is held")
        return w.readframes(w.getnframes())


def count(samples: bytes) -> int:
    """Number of frames."""
    return max(1, -(-len(samples) // HOP))


def spectrogram(samples: bytes) -> Iterator[np.ndarray]:
    """Magnitudes of Hann-windowed frames, half a frame apart, block by block; half a frame of silence comes before the samples, and the last hop is filled with it."""
    x = np.frombuffer(b"\x80" * HOP + samples, np.uint8)
    frames = count(samples)
    need = (frames - 1) * HOP + FRAME
    for first in range(0, frames, _BLOCK):
        last = min(frames, first + _BLOCK)
        part = x[first * HOP : (last - 1) * HOP + FRAME].astype(np.float32)
        if last == frames and len(part) < (last - first - 1) * HOP + FRAME:
            part = np.concatenate((part, np.full(need - first * HOP - len(part), 128, np.float32)))
        part -= 128
        views = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        yield np.abs(np.fft.rfft(views * _WINDOW, axis=1))


def peaks(samples: bytes, per_frame: int = PEAKS) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the strongest local maxima along frequency, at most ``per_frame`` in a frame, by frame and then bin."""
    times, bins, base = [], [], 0
    for m in spectrogram(samples):
        inner = m[:, 1:-1]
        top = np.where((inner > m[:, :-2]) & (inner >= m[:, 2:]), inner, 0)
        rows = np.arange(len(m))
        found = []
        for _ in range(per_frame):
            best = top.argmax(axis=1)
            found.append(np.where(top[rows, best] > NOISE, best + 1, 0))
            top[rows, best] = 0
        b = np.sort(np.stack(found, axis=1), axis=1)
        t = np.broadcast_to((base + rows)[:, None], b.shape)
        times.append(t[b > 0])
        bins.append(b[b > 0])
        base += len(m)
    return np.concatenate(times), np.concatenate(bins)


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time and code of each pair: a peak and each of the next ``FAN_OUT`` peaks of later frames, by time and then bin, that are at most ``REACH`` frames away."""
    t, b = peaks(samples)
    times, codes = [], []
    later = np.searchsorted(t, t, "right")
    for k in range(FAN_OUT):
        i = np.flatnonzero(later + k < len(t))
        j = later[i] + k
        gap = t[j] - t[i]
        i, j, gap = i[gap <= REACH], j[gap <= REACH], gap[gap <= REACH]
        times.append(t[i])
        codes.append((b[i] << 16) | (b[j] << 8) | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, times array<int>, codes array<int>, feature string"


def _analyse(batches: Iterator[pa.RecordBatch], keep_media: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1):
            rows = []
            for text in part.column(1).to_pylist():
                n = len((text or "").encode())
                media = encode(payload(text))
                back = decode(media)
                t, c = fingerprints(back)
                digest = hashlib.sha256(t.tobytes() + c.tobytes()).hexdigest()
                n_frames = count(back)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), n_frames, t, c, f"{n_frames}:{len(t)}:{digest}") + ((media,) if keep_media else ()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.binary()]
            arrays = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)]
            names = [x.split()[0] for x in (_OUT + ", media binary" * keep_media).split(", ")]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=names)


def media_features(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """One row per document with its stored media's facts and its time-coded fingerprints (``times`` and ``codes``, side by side).

    ``feature`` is ``frames:pairs:sha256`` of the fingerprints. ``keep_media`` adds the WAV bytes. Other columns are dropped;
    an empty table gives an empty one, and repeated rows stay repeated. No shuffle.
    """
    ship(docs.sparkSession)
    schema = _OUT + ", media binary" * keep_media
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: _analyse(it, keep_media), schema)
