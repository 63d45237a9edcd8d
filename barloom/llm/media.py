"""Audio features of a media column.

``store_media`` writes each payload losslessly as a mono 8-bit PCM WAV to a table in the shared
folder. Sizes, digests and features come from the rows that are read back from there: polyphase
resampling by ``UP`` / ``DOWN``, overlapped log-mel filterbanks and hysteresis energy segmentation.
Features have one fixed shape whatever the length (``SLOTS`` x ``MELS``: every frame is averaged into
its slot). ``store`` writes them as Arrow record batches of about ``ROWS`` documents, in which a column
of fixed-shape tensors stands beside the voiced time spans, as rows of a second table; ``load`` reads
them back.

Defined cases: a null or empty text is 64 zero bytes (silence: no span); long texts are
worked through in blocks of ``BLOCK`` frames, all of them; equal texts give equal bytes and
equal features wherever they stand, since each is computed alone; repeated rows and null
ids pass through; an empty table gives an empty result; other columns are ignored.
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

from barloom.llm.common import saved

RATE, UP, DOWN, TAPS = 8000, 4, 5, 16
FRAME, HOP, MELS, SLOTS, BLOCK, ROWS = 256, 128, 16, 8, 1024, 256
#: Hysteresis in mean log energy over the utterance: a span opens above HIGH and ends below LOW.
HIGH, LOW = 0.25, -0.25

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, mel array<float>, spans array<struct<start_s:double,end_s:double>>"
)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _filter() -> np.ndarray:
    n = np.arange(TAPS * DOWN + 1) - TAPS * DOWN / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(len(n))
    return (UP * h / h.sum()).astype(np.float32)


_TAPS = _filter()


def resample(x: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Outputs ``start`` (a multiple of UP) to ``stop`` of ``x`` at UP / DOWN of its rate.

    Output i lies at i * DOWN on the input's grid times UP. The outputs of one phase, UP apart,
    use the same taps of the filter, those that meet inputs there.
    """
    n = -(-len(x) * UP // DOWN)
    stop = n if stop is None else min(stop, n)
    m, half, base = stop - start, len(_TAPS) // 2, start // UP * DOWN
    reach = half // UP + 1
    lo, hi = base - reach, base - (-m * DOWN // UP) + reach + DOWN
    a, b = max(lo, 0), min(hi, len(x))
    padded = np.zeros(hi - lo, np.float32)
    padded[a - lo : b - lo] = x[a:b]
    out = np.zeros(m, np.float32)
    for phase in range(UP):
        k_out, at = len(range(phase, m, UP)), phase * DOWN
        for k in range(-(-(at - half) // UP), (at + half) // UP + 1):
            out[phase::UP] += _TAPS[half + at - k * UP] * padded[reach + k : reach + k + k_out * DOWN : DOWN][:k_out]
    return out


def mel_bank(rate: float) -> np.ndarray:
    """Triangles evenly spaced in mel = 2595 log10(1 + f / 700)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_RATE = RATE * UP / DOWN
_BANK, _WINDOW = mel_bank(_RATE).T, np.hanning(FRAME).astype(np.float32)


def features(samples: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(SLOTS x MELS log-mel means, voiced spans in seconds) of unsigned 8-bit samples, ``BLOCK`` frames at once."""
    n = -(-len(samples) * UP // DOWN)
    frames = max(1, -(-max(0, n - FRAME) // HOP) + 1)
    sums, counts, energy = np.zeros((SLOTS, MELS)), np.zeros(SLOTS), np.empty(frames)
    for a in range(0, frames, BLOCK):
        b = min(a + BLOCK, frames)
        start, stop = a * HOP, (b - 1) * HOP + FRAME
        first, last = max(0, start * DOWN // UP - 2 * len(_TAPS)), stop * DOWN // UP + 2 * len(_TAPS)
        first -= first % DOWN  # a whole number of phases, so that outputs keep their places
        part = (samples[first:last].astype(np.float32) - 128) / 128
        begin = first // DOWN * UP
        x = resample(part, start - begin, min(stop, n) - begin)
        x = np.concatenate([x, np.zeros(stop - start - len(x), np.float32)])
        view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(view * _WINDOW, axis=1)) ** 2
        logs = np.log(power @ _BANK + 1e-6)
        slot = (np.arange(a, b) * SLOTS) // frames
        for s in range(slot[0], slot[-1] + 1):
            sums[s] += logs[slot == s].sum(0)
        counts += np.bincount(slot, minlength=SLOTS)
        energy[a:b] = np.log((view**2).mean(1) + 1e-9)
    mel = np.zeros((SLOTS, MELS))
    mel[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    last = np.maximum.accumulate(np.where(counts > 0, np.arange(SLOTS), 0))
    return mel[last].astype(np.float32), _segments(energy - energy.mean())


def _segments(level: np.ndarray) -> list[tuple[float, float]]:
    state = np.where(level > HIGH, 1, np.where(level < LOW, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[np.maximum(known, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return [(a * HOP / _RATE, ((b - 1) * HOP + FRAME) / _RATE) for a, b in zip(edge[::2], edge[1::2], strict=True)]


_FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("mel", pa.list_(pa.float32())), ("spans", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
])
TENSOR = pa.fixed_shape_tensor(pa.float32(), (SLOTS, MELS))


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n_bytes, media), a few megabytes at once."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "media"])

    for batch in batches:
        rows, size = [], 0
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
            rows.append((doc.as_py(), len(raw), to_wav(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))))
            size += len(raw)
            if size > 4_000_000:
                yield out(rows)
                rows, size = [], 0
        yield out(rows)


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every document, written and read back."""
    return saved(docs.select("doc_id", "text").mapInArrow(_payloads, "doc_id long, n_bytes long, media binary"), "zstd")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored (doc_id, n_bytes, media) -> sizes, digests and features of what the media hold."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = []
            for doc, n, stored in zip(*(batch.column(i)[at : at + ROWS] for i in range(3)), strict=True):
                media = stored.as_buffer().to_pybytes()
                payload = from_wav(media)
                mel, spans = features(np.frombuffer(payload, np.uint8))
                rows.append({
                    "doc_id": doc.as_py(), "n_bytes": n.as_py(), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                    "mel": mel.ravel(), "spans": [{"start_s": a, "end_s": b} for a, b in spans],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


def audio_features(media: DataFrame) -> DataFrame:
    """One row per stored medium: sizes and digests of payload and medium, ``mel`` and ``spans``.

    A map over partitions: no shuffle, memory bounded by the longest text and ``ROWS`` rows.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, SCHEMA)


def to_tensors(mel: pa.Array) -> pa.Array:
    """A ``mel`` column as an Arrow array of fixed-shape tensors."""
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(mel.flatten(), SLOTS * MELS))


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = _FIELDS.get_field_index("mel")
    for batch in batches:
        block = pa.RecordBatch.from_arrays([*batch.columns[:at], to_tensors(batch.column(at)), *batch.columns[at + 1 :]], names=_FIELDS.names)
        out = io.BytesIO()
        with pa.ipc.new_stream(out, block.schema) as stream:
            stream.write_batch(block)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([out.getvalue()], pa.binary())], names=["documents", "data"])


def store(media: DataFrame) -> DataFrame:
    """The features of stored media written as blocks (documents, data): each an Arrow IPC stream with the
    columns of ``audio_features``, ``mel`` as fixed-shape tensors."""
    work = lambda batches: _to_blocks(_features(batches))
    return saved(media.select("doc_id", "n_bytes", "media").mapInArrow(work, "documents long, data binary"))


def load(blocks: DataFrame) -> DataFrame:
    """The rows of stored blocks, as ``audio_features`` returns them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for block in pa.ipc.open_stream(data.as_buffer()):
                    mel = block.column("mel").to_numpy_ndarray().reshape(block.num_rows, SLOTS * MELS)
                    offsets = pa.array(np.arange(block.num_rows + 1, dtype=np.int32) * (SLOTS * MELS))
                    columns = [pa.ListArray.from_arrays(offsets, pa.array(mel.ravel())) if name == "mel" else block.column(name) for name in _FIELDS.names]
                    yield pa.RecordBatch.from_arrays(columns, schema=_FIELDS)

    return blocks.select("data").mapInArrow(work, SCHEMA)


def digests(features_: DataFrame) -> DataFrame:
    """The contract's columns; ``feature`` names the tensor (hundredths) and the number of spans."""
    rounded = F.array_join(F.transform("mel", lambda v: F.round(v.cast("double") * 100).cast("long").cast("string")), ",")
    voiced = F.aggregate("spans", F.lit(0.0), lambda acc, s: acc + s["end_s"] - s["start_s"])
    return features_.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", F.lit(f"mel{SLOTS}x{MELS}"), F.md5(rounded), F.size("spans").cast("string")).alias("feature"),
        voiced.alias("voiced_s"),
    )
