"""Waveform files: headers, samples of all usual widths, resampling, and a data source that reads what is asked for.

``spark.read.format("wavfiles").schema(...).load(path)`` gives one row per file with the columns that the
schema names. Without ``samples`` among them only the headers are read, whatever the files' length; the
files are dealt to tasks by their number and, with samples, by their size. ``df.write.format("wavfiles")``
writes a row's samples as one file under its ``file`` name; a task that runs again writes the same files
again. Paths may be of any store that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import io
import math
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FILE = "audio_stem string, audio_path string, samples array<float>, duration double, sample_rate int, channels int, bit_depth int, file_size long"
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
FILES_A_TASK, BYTES_A_TASK = 256, 64 << 20


@dataclass(frozen=True)
class Header:
    """What a file says of its samples, and where they stand."""

    kind: int
    channels: int
    rate: int
    bits: int
    offset: int
    size: int

    @property
    def frames(self) -> int:
        return self.size // (self.channels * self.bits // 8)

    @property
    def duration(self) -> float:
        return self.frames / self.rate


def read_header(file: BinaryIO) -> Header:
    """The header of a waveform file; seeks over chunks and reads no samples.

    A data chunk that claims more than the file holds, as of a recording that was cut off, ends with the file.
    """
    if (start := file.read(12))[:4] != b"RIFF" or start[8:] != b"WAVE":
        raise ValueError("not a waveform file")
    found = None
    at = 12
    while True:
        file.seek(at)
        head = file.read(8)
        if len(head) < 8:
            raise ValueError("a waveform file without samples")
        name, size = struct.unpack("<4sI", head)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", (body := file.read(min(size, 40)))[:16])
            if kind == EXTENSIBLE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
            found = kind, channels, rate, bits
        elif name == b"data":
            if found is None:
                raise ValueError("a waveform file without a format")
            end = file.seek(0, 2)
            return Header(*found, at + 8, min(size, end - at - 8))
        at += 8 + size + size % 2


def read_samples(file: BinaryIO, header: Header) -> np.ndarray:
    """Mono samples from -1 to 1: 8-, 16-, 24- or 32-bit integers, or floats of 32 or 64 bits."""
    file.seek(header.offset)
    raw = file.read(header.frames * header.channels * header.bits // 8)
    width = header.bits // 8
    if header.kind == FLOAT and width in (4, 8):
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif header.kind == PCM and width == 1:
        x = (np.frombuffer(raw, "u1").astype(np.float32) - 128.0) / 128.0
    elif header.kind == PCM and width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2.0 ** (header.bits - 1)
    elif header.kind == PCM and width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)  # the upper three bytes of a 32-bit integer
        x = wide.reshape(-1).view("<i4").astype(np.float32) / 2.0**31
    else:
        raise ValueError(f"samples of kind {header.kind} with {header.bits} bits")
    return x.reshape(-1, header.channels).mean(axis=1) if header.channels > 1 else x


def decode_wav(content: bytes) -> tuple[np.ndarray, int, int, int]:
    """(mono samples from -1 to 1, rate, channels, bits) of a whole file."""
    file = io.BytesIO(content)
    header = read_header(file)
    return read_samples(file, header), header.rate, header.channels, header.bits


def wav_bytes(x: np.ndarray, rate: int = 16_000) -> bytes:
    """A 16-bit mono file."""
    pcm = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(pcm))
    return head + pcm


def _phases(up: int, down: int, zeros: int, roll_off: float, beta: float) -> np.ndarray:
    """The taps of every phase of a windowed sinc between two rates; each phase sums to one."""
    wide = max(up, down)
    half = zeros * wide
    t = np.arange(-half, half + 1) / wide
    h = np.sinc(roll_off * t) * np.kaiser(2 * half + 1, beta)
    taps = 2 * half // up + 1
    out = np.zeros((up, taps))
    for phase in range(up):
        first = -(-(phase - half) // up)  # the first sample in reach
        at = phase - (first + np.arange(taps)) * up + half
        ok = (at >= 0) & (at <= 2 * half)
        out[phase, ok] = h[at[ok]]
    return out / out.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, rate: int, target: int = 16_000, zeros: int = 32, roll_off: float = 0.92, beta: float = 8.0) -> np.ndarray:
    """Samples at another rate, by a polyphase windowed-sinc filter below both Nyquist frequencies.

    Every output is one sum over the taps of its phase, so the work is linear in the samples; the taps are
    as many as ``zeros`` zero crossings to each side take.
    """
    if rate == target or not len(x):
        return x
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    taps = _phases(up, down, zeros, roll_off, beta)
    n = round(len(x) * target / rate)
    half = zeros * max(up, down)
    reach = half // up + 2
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + taps.shape[1])])
    out = np.empty(n, np.float32)
    for at in range(0, n, 1 << 16):
        q = np.arange(at, min(n, at + (1 << 16))) * down
        phase = q % up
        first = -(-(phase - half) // up) + q // up + reach
        y = np.zeros(len(q))
        for k in range(taps.shape[1]):
            y += padded[first + k] * taps[phase, k]
        out[at : at + len(q)] = y
    return out


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")  # as the warehouse folder is written
    return fs.FileSystem.from_uri(path)


class WavReader(DataSourceReader):
    """One row per file, with the columns of the schema."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = schema.fieldNames()
        self.path, self.target = options["path"], int(options.get("target", 16_000))

    def partitions(self) -> list[Files]:
        store, base = _opened(self.path)
        known = store.get_file_info(base)
        found = [known] if known.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(".wav"))
        parts, now, size = [], [], 0
        for path, n in files:
            n = n if "samples" in self.columns else 0
            if now and (len(now) == FILES_A_TASK or size + n > BYTES_A_TASK):
                parts.append(Files(now))
                now, size = [], 0
            now.append((path, n))
            size += n
        return [*parts, Files(now)] if now else parts

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        for path, _ in partition.paths:
            with store.open_input_file(path) as file:
                yield tuple(self.row(path, file))

    def row(self, path: str, file: BinaryIO) -> list:
        h = read_header(file)
        known = {
            "audio_stem": lambda: posixpath.splitext(posixpath.basename(path))[0],
            "audio_path": lambda: path,
            "samples": lambda: resample(read_samples(file, h), h.rate, self.target).tolist(),
            "duration": lambda: h.duration,
            "sample_rate": lambda: h.rate,
            "channels": lambda: h.channels,
            "bit_depth": lambda: h.bits,
            "file_size": lambda: file.seek(0, 2),
        }
        return [known[c]() for c in self.columns]


class WavWriter(DataSourceWriter):
    """Every row's ``samples`` as 16-bit mono file ``file``."""

    def __init__(self, options: dict) -> None:
        self.path, self.rate = options["path"], int(options.get("rate", 16_000))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, base = _opened(self.path)
        store.create_dir(base, recursive=True)
        for row in rows:
            if row["samples"]:
                with store.open_output_stream(f"{base}/{row['file']}") as out:
                    out.write(wav_bytes(np.asarray(row["samples"], np.float32), self.rate))
        return WriterCommitMessage()


class WavFiles(DataSource):
    """Waveform files; options: ``path``, ``target`` (rate that samples are read at), ``rate`` (that they are written at)."""

    @classmethod
    def name(cls) -> str:
        return "wavfiles"

    def schema(self) -> str:
        return FILE

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``wavfiles`` known to a session."""
    spark.dataSource.register(WavFiles)
