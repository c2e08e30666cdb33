"""Media columns: audio kept as WAV bytes, and log-mel features kept as fixed-shape Arrow tensors with time spans.

``to_wav`` stores 8-bit samples losslessly. ``audio_features`` reads a stored file back, resamples it by a polyphase
filter bank, takes overlapped log-mel frames, marks active spans by energy with hysteresis, and cuts the frames into
patches of one shape: an Arrow IPC stream per file holds the tensors and the start and end second of each. The active
spans are kept with their start and end seconds too.

Samples go through blocks of a fixed number of frames; beside a file's bytes, only its frames are held whole. Files go
through a task one by one, in groups of a bounded size. Equal bytes give equal values. A null text is an empty one, whose
payload is 64 zero bytes. Extra columns stay; those with the name of a result are replaced. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialize, others
from tideline.llm.hashing import blocks

RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, MELS, PATCH = 256, 128, 32, 32
_BLOCK = 1 << 16
_FRAMES, _FILES = 4096, 4 << 20
FIELDS = ("payload_bytes long", "payload_sha256 string", "tail_crc32 long", "frames int", "segments int", "spans array<struct<start_s:double,end_s:double>>", "active double", "feature string", "tensor binary")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples, which are the payload."""
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes()), w.getframerate()


@cache
def filter_bank(up: int, down: int, half: int = 8) -> np.ndarray:
    """(up, taps): the phases of a Hann-windowed sinc low-pass."""
    n = np.arange(-half * max(up, down), half * max(up, down) + 1)
    cut = 1 / max(up, down)
    h = np.sinc(n * cut) * cut * (0.5 + 0.5 * np.cos(np.pi * n / (n[-1] + 1))) * up
    h = np.pad(h, (0, -len(h) % up))
    return h.reshape(-1, up).T


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: each output sample uses one phase of the filter bank on the input around it."""
    bank = filter_bank(up, down)
    taps = bank.shape[1]
    n_out = -(-len(x) * up // down)
    out = np.empty(n_out, dtype=np.float32)
    padded = np.pad(x, (taps - 1 - taps // 2, taps))
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for phase in range(up):
        which = np.flatnonzero((np.arange(min(n_out, up)) * down) % up == phase)
        if len(which):
            index = np.arange(which[0], n_out, up)
            for i in range(0, len(index), _BLOCK):
                part = index[i : i + _BLOCK]
                out[part] = windows[part * down // up] @ bank[phase][::-1].astype(np.float32)
    return out


@cache
def mel_bank(rate: int) -> np.ndarray:
    """(FRAME / 2 + 1, MELS): triangles that are even on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, MELS); the last frame is filled up with zeros."""
    n = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x))) if len(x) < (n - 1) * HOP + FRAME else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate)
    out = np.empty((n, MELS), dtype=np.float32)
    for i in range(0, n, 512):
        spectrum = np.fft.rfft(frames[i : i + 512] * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[i : i + 512] = np.log(power @ bank + np.float32(1e-6))
    return out


def active_spans(energy: np.ndarray, high: float = 0.5, low: float = 0.2) -> np.ndarray:
    """(n, 2) frame spans: one begins where the energy is over its high mark and ends where it falls under the low one."""
    least, most = float(energy.min()), float(energy.max())
    on, off = least + high * (most - least), least + low * (most - least)
    mark = np.where(energy > on, 1, np.where(energy <= off, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    state = np.concatenate([[0], np.where(last >= 0, mark[last], -1) == 1, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(state))
    return edges.reshape(-1, 2)


def tensors(mel: np.ndarray, rate: int) -> bytes:
    """Arrow IPC stream of (tensor fixed_shape_tensor[PATCH, MELS], start_s, end_s)."""
    n = -(-len(mel) // PATCH)
    patches = np.full((n * PATCH, MELS), np.log(np.float32(1e-6)), dtype=np.float32)
    patches[: len(mel)] = mel
    start = np.arange(n) * PATCH * HOP / rate
    end = np.minimum(np.arange(1, n + 1) * PATCH, len(mel)) * HOP / rate
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(patches.reshape(n, PATCH, MELS))
    batch = pa.record_batch([tensor, pa.array(start), pa.array(end)], names=["tensor", "start_s", "end_s"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue()


def read_tensors(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def mel_frames(payload: bytes, rate: int) -> np.ndarray:
    """The log-mel frames of the resampled samples, block by block; the blocks' ends are those of the whole."""
    n_in = len(payload)
    n_out = -(-n_in * UP // DOWN)
    n = max(1, -(-max(n_out - FRAME, 0) // HOP) + 1)
    out, margin = [], 32 * DOWN
    for f in range(0, n, _FRAMES):
        last = min(f + _FRAMES, n)
        low, high = f * HOP, min((last - 1) * HOP + FRAME, n_out)
        a, b = max(0, low * DOWN // UP - margin), min(n_in, -(-high * DOWN // UP) + margin)
        samples = (np.frombuffer(payload, dtype=np.uint8, count=b - a, offset=a).astype(np.float32) - 128) / 128
        part = resample(samples)[low - a * UP // DOWN : high - a * UP // DOWN]
        out.append(log_mel(part, rate * UP // DOWN))
    return np.concatenate(out)


def features_of(media: bytes, with_tensors: bool) -> dict:
    payload, rate = from_wav(media)
    mel = mel_frames(payload, rate)
    spans = active_spans(mel.mean(axis=1))
    step = HOP / (rate * UP // DOWN)
    active = int((spans[:, 1] - spans[:, 0]).sum()) / len(mel)
    bands = mel.mean(axis=0, dtype=np.float64).reshape(8, -1).mean(axis=1)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]),
        "frames": len(mel),
        "segments": len(spans),
        "spans": [{"start_s": a * step, "end_s": b * step} for a, b in spans.tolist()],
        "active": active,
        "feature": f"{len(mel)} frames, {len(spans)} spans, {active:.3f} active, bands " + " ".join(f"{b:.2f}" for b in bands),
        "tensor": tensors(mel, rate * UP // DOWN) if with_tensors else None,
    }


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes and media: the text's UTF-8 bytes, filled up to a multiple of 64, as WAV."""

    @F.arrow_udf("binary")
    def wav(texts: pa.Array) -> pa.Array:
        def one(t):
            b = t.as_py() or b""
            return to_wav(b + bytes(-len(b) % 64 if b else 64))

        return pa.array([one(t) for t in texts.cast(pa.large_binary())], pa.binary())

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return docs.select(*others(docs, text, "n_bytes", "media"), size.alias("n_bytes"), wav(F.col(text)).alias("media"))


def audio_features(media: DataFrame, with_tensors: bool = True) -> DataFrame:
    """media with the fields of FIELDS, from its column of stored files."""
    names = [f.split()[0] for f in FIELDS]
    kept = media.select(*others(media, *names))
    at = kept.columns.index("media")
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = dict(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), spans, pa.float64(), pa.string(), pa.binary()), strict=True))

    def run(batches):
        for b in batches:
            files = b.column(at)
            size = np.cumsum([0, *pc.fill_null(pc.binary_length(files), 0).to_numpy(zero_copy_only=False).tolist()])
            for i, j in blocks(size, _FILES):
                made = [features_of(f.as_py() or to_wav(bytes(64)), with_tensors) for f in files.slice(i, j - i)]
                columns = [pa.array([m[n] for m in made], k) for n, k in kinds.items()]
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, *columns], names=[*b.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *FIELDS])
    return kept.mapInArrow(run, schema)


def op6(spark, sf_dir):
    from tideline.llm.common import table

    stored = materialize(store_media(table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    out = audio_features(stored)
    return out.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "spans",
        "tensor",
    )
