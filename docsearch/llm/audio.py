"""Audio columns: texts stored as 8-bit sound files, read back, and turned into log-mel tensors with time spans.

A stored sound is a mono PCM WAV file of unsigned 8-bit samples. Reading it back gives the samples exactly. Features: the samples
are brought from SOURCE_RATE to RATE by a polyphase filter, cut into overlapping frames, and each frame's power spectrum is summed
by a mel filterbank; the logarithms are stored as Arrow tensors of one fixed shape (TENSOR_FRAMES x MELS; the last is filled with
the floor value), each with its time span. Segments are runs of frames by energy with hysteresis: one begins above the median by
ENTER_DB and ends below it by LEAVE_DB. Long sounds are worked on in blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.llm.common import buffer_of, ready, slices, text_or_empty

UNIT = 192
SOURCE_RATE, RATE = 24_000, 16_000
FRAME, HOP, FFT, MELS = 400, 160, 512, 32
TENSOR_FRAMES = 16
FLOOR = -10.0
ENTER_DB, LEAVE_DB = 1.0, -1.0
BLOCK = 1 << 15


def wav(samples: bytes, rate: int = SOURCE_RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    odd = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def read_wav(data: bytes) -> tuple[bytes, int]:
    """The samples and the rate of such a file; other chunks are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif kind == b"data":
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def low_pass(up: int, down: int, half: int = 10) -> np.ndarray:
    """A windowed-sinc filter for a change of rate by up / down."""
    n = half * max(up, down)
    t = np.arange(-n, n + 1)
    h = np.sinc(t / max(up, down)) * np.kaiser(2 * n + 1, 5.0)
    return (up * h / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up / down times its rate: each output is one phase of the filter on its neighbourhood."""
    h = low_pass(up, down)
    half = len(h) // 2
    n_out = -(-len(x) * up // down)
    out = np.empty(n_out, np.float32)
    reach = -(-len(h) // up)
    padded = np.concatenate([np.zeros(reach, np.float32), x, np.zeros(2 * reach + down, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, reach)
    for r in range(min(up, n_out)):
        t = r * down + half
        taps = h[t % up :: up]
        taps = np.concatenate([taps, np.zeros(reach - len(taps), np.float32)])[::-1]
        count = len(range(r, n_out, up))
        first = t // up + 1  # the window that ends at sample t // up
        for a in range(0, count, BLOCK):
            b = min(count, a + BLOCK)
            out[r + a * up : r + (b - 1) * up + 1 : up] = windows[first + a * down : first + (b - 1) * down + 1 : down] @ taps
    return out


def mel_filters(n: int = MELS, fft: int = FFT, rate: int = RATE) -> np.ndarray:
    """Triangles that are even on the mel scale, one a column."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), n + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_MEL = mel_filters()
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and energies (dB) of the frames of x; the last frame is filled with zeros, one frame at least."""
    n = max(1, 1 + -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + FRAME - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, 2048):
        f = frames[a : a + 2048]
        f = f - f.mean(1, keepdims=True)
        energy[a : a + 2048] = 10 * np.log10((f * f).mean(1) + 1e-10)
        power = np.abs(np.fft.rfft(f * _WINDOW, FFT)) ** 2
        mel[a : a + 2048] = np.log10(np.maximum(power.astype(np.float32) @ _MEL, 10.0**FLOOR))
    return mel, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """(first frame, frame after the last) of the runs that hysteresis finds."""
    mid = np.median(energy)
    mark = np.where(energy > mid + ENTER_DB, 1, np.where(energy < mid + LEAVE_DB, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[np.maximum(at, 0)], -1) > 0
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
TENSORS = pa.schema([("tensor", TENSOR), ("start", pa.float64()), ("end", pa.float64())])


def tensors(mel: np.ndarray) -> bytes:
    """Arrow stream of the tensors of log-mel rows, with spans in seconds."""
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), FLOOR, np.float32)
    full[: len(mel)] = mel
    first = np.arange(n) * TENSOR_FRAMES
    last = np.minimum(first + TENSOR_FRAMES, len(mel)) - 1
    values = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, TENSOR_FRAMES, MELS))
    batch = pa.RecordBatch.from_arrays([values, pa.array(first * HOP / RATE), pa.array((last * HOP + FRAME) / RATE)], schema=TENSORS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSORS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    """The table (tensor, start, end) of one stored value."""
    return pa.ipc.open_stream(data).read_all()


def analyse(media: bytes) -> tuple[bytes, bytes, list[dict[str, float]], str]:
    """Of a stored sound: its samples, tensors, segments (seconds) and a summary."""
    samples, rate = read_wav(media)
    up, down = RATE // np.gcd(RATE, rate), rate // np.gcd(RATE, rate)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x, int(up), int(down)))
    found = segments(energy)
    spans = [{"start": float(a * HOP / RATE), "end": float(((b - 1) * HOP + FRAME) / RATE)} for a, b in found]
    means = " ".join(f"{v:.1f}" for v in mel.mean(0, dtype=np.float64))
    return samples, tensors(mel), spans, f"frames={len(mel)};segments={len(found)};active={int((found[:, 1] - found[:, 0]).sum())};energy={energy.mean(dtype=np.float64):.1f};mel={means}"


SCHEMA = "doc_id long, n_bytes long, media binary, samples binary, tensors binary, segments array<struct<start:double,end:double>>, feature string"


def audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text), media (the WAV file of the text filled up with spaces to a positive multiple of UNIT
    bytes), samples (read back from media), tensors (Arrow stream, see ``read_tensors``), segments and feature for every row of
    ``docs`` (doc_id, text; others are ignored). Null counts as empty. Equal texts have equal values: sounds are analysed one by
    one. One pass without a shuffle."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffer_of(b.column(1))
            for i, j in slices(offs, 1 << 20):
                raw = buf[offs[i] : offs[j]].tobytes()
                n = np.diff(offs[i : j + 1])
                media = [wav(raw[p : p + k].ljust(max(UNIT, -(-k // UNIT) * UNIT), b" ")) for p, k in zip((offs[i:j] - offs[i]).tolist(), n.tolist(), strict=True)]
                samples, stored, spans, feature = zip(*map(analyse, media), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n), pa.array(media, pa.binary()), pa.array(samples, pa.binary()), pa.array(stored, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))), pa.array(feature)],
                    ["doc_id", "n_bytes", "media", "samples", "tensors", "segments", "feature"],
                )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_t")).mapInArrow(run, SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of ``audio``."""
    length = lambda c: F.octet_length(c).cast("long")
    return audio(docs).select(
        "doc_id",
        "n_bytes",
        length("samples").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        length("media").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("segments").cast("long").alias("n_segments"),
    )
