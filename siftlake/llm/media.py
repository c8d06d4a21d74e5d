"""Media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

encode_wav stores a payload losslessly as 8-bit mono samples; decode_wav reads it back through the
wave module. The fingerprint takes the magnitude spectrum of overlapping Hann windows, keeps the
strongest local maxima of each frame, and pairs each peak with the next ones in time: a code of
(frequency, later frequency, frames between) at the frame of the first peak. Codes and times are
two arrays of equal length, so they can be stored, exploded and joined as columns.

Frames are transformed in blocks, so memory beside the media itself is bounded. One pass over the
input, no shuffle; equal payloads give equal bytes and codes.

Defined results: null and empty texts are a payload of padding alone; a very long text is one payload,
whose spectrum is taken block by block; rows with equal or null
doc_id are stored as rows of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siftlake.llm import common

FRAME = 192
HOP = 96
BLOCK_FRAMES = 8192
MAX_GAP = 32
#: Characters of text whose media are made at a time; a longer text by itself.
PART_CHARS = 4 << 20

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("media", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("peak_times", T.ArrayType(T.IntegerType())),
        T.StructField("peak_codes", T.ArrayType(T.IntegerType())),
    ]
)


def pad(data: bytes, multiple: int = FRAME) -> bytes:
    """Append spaces up to a positive multiple."""
    return data + b" " * (max(1, -(-len(data) // multiple)) * multiple - len(data))


def encode_wav(payload: bytes, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(1)
        sound.setframerate(rate)
        sound.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as sound:
        return sound.readframes(sound.getnframes())


def spectral_peaks(samples: np.ndarray, per_frame: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of the strongest local maxima, in order of time."""
    n_frames = 1 + (len(samples) - FRAME) // HOP
    window = np.hanning(FRAME).astype(np.float32)
    times, bins = [], []
    for begin in range(0, n_frames, BLOCK_FRAMES):
        count = min(BLOCK_FRAMES, n_frames - begin)
        block = samples[begin * HOP : (begin + count - 1) * HOP + FRAME].astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(block, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * window, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        maxima = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        top = np.sort(np.argpartition(maxima, -per_frame, axis=1)[:, -per_frame:], axis=1)
        kept = np.take_along_axis(maxima, top, axis=1) > 1.0
        frame, place = np.nonzero(kept)
        times.append(frame + begin)
        bins.append(top[frame, place] + 1)
    return np.concatenate(times), np.concatenate(bins)


def pair_codes(times: np.ndarray, bins: np.ndarray, fan: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Time and code of each pair of a peak with one of the next `fan` peaks."""
    all_times, codes = [], []
    for step in range(1, fan + 1):
        gap = times[step:] - times[:-step]
        near = gap <= MAX_GAP
        all_times.append(times[:-step][near])
        codes.append((bins[:-step][near] << 14) | (bins[step:][near] << 7) | gap[near])
    when, code = np.concatenate(all_times), np.concatenate(codes)
    order = np.lexsort((code, when))
    return when[order].astype("<i4"), code[order].astype("<i4")


def to_media(docs: DataFrame) -> DataFrame:
    """Each text as WAV bytes with figures of the payload read back and its time-coded peak pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, stop in common.parts(batch["text"].str.len().to_numpy(), PART_CHARS, 256):  # the media of a few rows at a time
                rows = []
                for doc_id, text in zip(batch["doc_id"][begin:stop], batch["text"][begin:stop], strict=True):
                    data = text.encode()
                    media = encode_wav(pad(data))
                    payload = decode_wav(media)
                    when, code = pair_codes(*spectral_peaks(np.frombuffer(payload, dtype=np.uint8)))
                    rows.append((doc_id, len(data), media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), when, code))
                frame = pd.DataFrame(rows, columns=SCHEMA.names)
                yield frame.astype({"doc_id": "Int64", "n_bytes": "int64", "payload_bytes": "int64", "tail_crc32": "int64"})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text")).mapInPandas(run, SCHEMA)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = to_media(common.documents(spark, sf_dir))
    return media.selectExpr(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "cast(length(media) as long) AS media_bytes",
        "sha2(media, 256) AS media_sha256",
        "concat(size(peak_codes), ':', md5(concat(array_join(peak_times, ','), ';', array_join(peak_codes, ',')))) AS feature",
        "cast(size(peak_codes) as long) AS n_peak_pairs",
        "peak_times",
        "peak_codes",
    )
