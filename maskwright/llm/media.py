"""Media columns: audio features over 8-bit samples.

Media are WAV files (mono, unsigned 8-bit PCM) in a binary column. Features come from the stored
bytes: polyphase resampling, overlapped log-mel filterbanks, and energy segmentation with
hysteresis. A segment's frames are cut into tensors of one fixed shape, ``SHAPE`` (frames x bands),
which are stored as Arrow fixed-shape tensors with their time spans. The resampler goes from 11,025 to
8,000 samples a second by 320 phases. Every step works on runs of frames, so a long recording needs
bounded memory beyond its own bytes and one row of bands a frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import in_arrow, texts, written

#: Samples a second, as stored and as analysed.
STORED_RATE, RATE = 11_025, 8_000
#: Samples of a frame and between frames at the analysed rate, points of its transform, mel bands.
FRAME, HOP, POINTS, BANDS = 200, 100, 256, 32
#: Filter taps for each phase of the resampler.
TAPS = 16
#: Decibels above the median frame at which a segment begins, and below which it ends.
RISE, FALL = 1.0, -1.0
#: Frames and bands of a tensor.
SHAPE = (16, BANDS)
#: Least logarithm of a band's power in a tensor, and steps to a unit.
FLOOR, STEPS = -14.0, 8
#: Frames handled at a time.
RUN = 1 << 11
#: A payload's unit: it is padded with zero bytes to a positive multiple.
UNIT = 64


def payload(text: str) -> bytes:
    """A text's UTF-8 bytes, padded with zeros."""
    raw = text.encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def to_wav(samples: bytes, rate: int = STORED_RATE) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + bytes(pad)


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of such a file; anything else raises ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@cache
def phases(up: int, down: int) -> np.ndarray:
    """The resampler's windowed-sinc filter, a row for each phase."""
    n = TAPS * up
    t = (np.arange(n) - n // 2) / max(up, down)
    taps = np.sinc(t) * np.hanning(n + 1)[:-1]
    taps *= up / taps.sum()
    return np.ascontiguousarray(taps.reshape(TAPS, up).T[:, ::-1]).astype(np.float32)


def resampled(x: np.ndarray, rate: int, to: int, start: int, stop: int) -> np.ndarray:
    """Samples start to stop of ``x`` at another rate; outside of x is silence.

    Output n lies in phase n * down % up and reads TAPS inputs around n * down // up.
    """
    if rate == to:
        out = x[start:stop]
        return np.concatenate((out, np.zeros(stop - start - len(out), dtype=x.dtype)))
    g = gcd(rate, to)
    up, down = to // g, rate // g
    rows = phases(up, down)
    low, high = start * down // up - TAPS // 2 + 1, (stop - 1) * down // up + TAPS // 2 + 1
    part = x[max(0, low) : max(0, high)]
    part = np.concatenate((np.zeros(max(0, -low), x.dtype), part, np.zeros(max(0, high - max(low, 0) - len(part)), x.dtype)))
    windows = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    n = np.arange(start, stop) * down
    return np.einsum("ij,ij->i", windows[n // up - TAPS // 2 + 1 - low], rows[n % up])


@cache
def filterbank() -> np.ndarray:
    """Triangular mel filters: POINTS // 2 + 1 bins x BANDS."""
    mel = np.linspace(0, 2595 * np.log10(1 + RATE / 2 / 700), BANDS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.arange(POINTS // 2 + 1)[:, None] * RATE / POINTS
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@cache
def window() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1].astype(np.float32)


def frames(samples: bytes, rate: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Log-mel rows and energies in decibels of the overlapped frames, some at a time."""
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    length = -(-len(x) * RATE // rate)
    count = max(1, -(-(length - FRAME) // HOP) + 1)
    for at in range(0, count, RUN):
        n = min(RUN, count - at)
        y = resampled(x, rate, RATE, at * HOP, (at + n - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        cut = (cut - cut.mean(axis=1, keepdims=True)) * window()
        spectrum = np.fft.rfft(cut, POINTS, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        yield np.log(power @ filterbank() + 1e-6).astype(np.float32), 10 * np.log10((cut * cut).mean(axis=1) + 1e-9)


def segments(energy: np.ndarray) -> np.ndarray:
    """First frame and end of each segment: begun at the upper threshold, ended under the lower."""
    level = energy - np.median(energy)
    state = np.where(level >= RISE, 1, np.where(level < FALL, 0, -1))
    known = np.where(state >= 0, np.arange(len(state)), 0)
    np.maximum.accumulate(known, out=known)
    on = np.concatenate(([0], state[known] == 1, [0]))
    return np.stack((np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)), axis=1)


def tensors(mel: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments cut into tensors of SHAPE, the last of each filled up with zeros; segment, first frame and end of each.

    A tensor holds log-mel values in steps of 1 / STEPS from FLOOR, as unsigned bytes.
    """
    cuts = [(i, a, min(a + SHAPE[0], end)) for i, (begin, end) in enumerate(spans.tolist()) for a in range(begin, end, SHAPE[0])]
    small = np.clip(np.round((mel - FLOOR) * STEPS), 0, 255).astype(np.uint8)
    out = np.zeros((len(cuts), *SHAPE), dtype=np.uint8)
    for i, (_, a, b) in enumerate(cuts):
        out[i, : b - a] = small[a:b]
    return out, np.array(cuts, dtype=np.int64).reshape(-1, 3)


def analysed(media: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-mel rows, energies and segments of a stored file."""
    rate, samples = from_wav(media)
    runs = list(frames(samples, rate))
    mel, energy = (np.concatenate([r[i] for r in runs]) for i in (0, 1))
    return mel, energy, segments(energy)


#: Fixed-shape Arrow tensors with their time spans; a file's are one record batch of this schema.
TENSORS = pa.schema({"segment": pa.int32(), "start_s": pa.float64(), "end_s": pa.float64(), "mel": pa.fixed_shape_tensor(pa.uint8(), SHAPE)})


def to_tensors(mel: np.ndarray, spans: np.ndarray) -> bytes:
    """The tensors of a file's segments as an Arrow record batch."""
    cubes, cuts = tensors(mel, spans)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(cubes.ravel()), SHAPE[0] * SHAPE[1])
    columns = [pa.array(cuts[:, 0].astype(np.int32)), pa.array(cuts[:, 1] * HOP / RATE), pa.array(((cuts[:, 2] - 1) * HOP + FRAME) / RATE), pa.ExtensionArray.from_storage(TENSORS.field("mel").type, flat)]
    return pa.RecordBatch.from_arrays(columns, schema=TENSORS).serialize().to_pybytes()


def from_tensors(stored: bytes) -> pa.RecordBatch:
    """The record batch of a file's tensors."""
    return pa.ipc.read_record_batch(pa.py_buffer(stored), TENSORS)


def media_column(docs: DataFrame, into: str = "media") -> DataFrame:
    """doc_id, n_bytes and ``into``: each whole text's payload as a stored WAV file. Null counts as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = texts(batch.column("text"))
        sizes = pa.array([len(t.encode()) for t in raw], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array([to_wav(payload(t)) for t in raw], pa.binary())], names=["doc_id", "n_bytes", into])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(own, work, f"doc_id long, n_bytes long, {into} binary", rows=256)


def tensor_table(stored: DataFrame) -> DataFrame:
    """What is known of each file of ``stored`` (doc_id, n_bytes, media), from its bytes: sizes, digests, frames,
    level, and ``tensors``, the record batch of its segments' tensors with their time spans."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for wav in batch.column("media").to_pylist():
            _, samples = from_wav(wav)
            mel, energy, spans = analysed(wav)
            out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), len(energy), float(np.median(energy)), to_tensors(mel, spans)))
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.binary())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "level", "tensors"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, level double, tensors binary"
    return in_arrow(stored.select("doc_id", "n_bytes", "media"), work, schema, rows=128)


def described(count: int, level: float, found: pa.RecordBatch) -> str:
    """What the stored tensors of a file say in short; the checksum is over all of them."""
    cubes = found.column("mel").to_numpy_ndarray() if found.num_rows else np.zeros((0, *SHAPE), dtype=np.uint8)
    begin, end = (found.column(c).to_numpy() for c in ("start_s", "end_s"))
    heard = (end - begin - (FRAME - HOP) / RATE).sum()
    bands = cubes.reshape(-1, 4, BANDS // 4).mean(axis=(0, 2)) if len(cubes) else np.zeros(4)
    parts = len(found.column("segment").unique())
    return f"frames={count};segments={parts};tensors={len(cubes)};heard={heard:.3f};level={level:.2f};bands={','.join(f'{b:.2f}' for b in bands)};crc={zlib.crc32(cubes.tobytes()):08x}"


def features(docs: DataFrame) -> DataFrame:
    """Stores every whole text as media, the media's features as tensors, and describes each file from what is read back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. The
    sizes and digests come from the media read back, the feature from the tensors read back. Equal texts
    give equal values, as a file's features depend on nothing else. A null text is an empty one; repeated
    rows stay; further columns go; an empty table gives none.
    """
    stored = written(media_column(docs), "media")
    found = written(tensor_table(stored), "media-tensors")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        said = [described(n, level, from_tensors(t)) for n, level, t in zip(*(batch.column(c).to_pylist() for c in ("frames", "level", "tensors")), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(said, pa.string())], names=[*batch.schema.names[:-3], "feature"])

    return in_arrow(found, work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
