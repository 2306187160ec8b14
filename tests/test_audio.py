"""Waveform files of all widths, band-limited resampling, headers alone, and energies of frames."""

from __future__ import annotations

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechmart.operators import vad
from speechmart.sources import audio


def riff(body, kind, channels, rate, bits, extra=b"", extensible=False, cut=0):
    frame = channels * bits // 8
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * frame, frame, bits)
    if extensible:
        head += struct.pack("<HHIH", 22, bits, 0, kind) + b"\x00" * 14
    chunks = b"".join(struct.pack("<4sI", n, len(b)) + b + b"\x00" * (len(b) % 2) for n, b in ((b"fmt ", head), (b"LIST", extra)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) + 8 + len(body)) + b"WAVE" + chunks + struct.pack("<4sI", b"data", len(body) + cut) + body


WAVE = np.sin(np.arange(500) / 7).astype(np.float64) * 0.8


@pytest.mark.parametrize(
    ("kind", "bits", "raw"),
    [
        (audio.PCM, 8, ((WAVE * 127) + 128).round().astype("u1").tobytes()),
        (audio.PCM, 16, (WAVE * 32767).round().astype("<i2").tobytes()),
        (audio.PCM, 24, b"".join(int(v).to_bytes(3, "little", signed=True) for v in (WAVE * (2**23 - 1)).round())),
        (audio.PCM, 32, (WAVE * (2**31 - 1)).round().astype("<i4").tobytes()),
        (audio.FLOAT, 32, WAVE.astype("<f4").tobytes()),
        (audio.FLOAT, 64, WAVE.astype("<f8").tobytes()),
    ],
)
@pytest.mark.parametrize("extensible", [False, True])
def test_widths(kind, bits, raw, extensible):
    x, rate, channels, depth = audio.decode_wav(riff(raw, kind, 1, 8000, bits, b"odd", extensible))
    assert (rate, channels, depth) == (8000, 1, bits) and np.abs(x - WAVE).max() < 0.01
    stereo = np.repeat(np.frombuffer(raw, np.uint8).reshape(-1, bits // 8), 2, axis=0).tobytes()
    assert np.abs(audio.decode_wav(riff(stereo, kind, 2, 8000, bits))[0] - WAVE).max() < 0.01


def test_odd_files():
    body = (WAVE * 32767).astype("<i2").tobytes()
    assert len(audio.decode_wav(riff(body, 1, 1, 8000, 16, cut=1000))[0]) == 500  # cut off while it was recorded
    assert len(audio.decode_wav(riff(b"", 1, 1, 8000, 16))[0]) == 0
    for bad in (b"", b"RIFF0000WAVE", b"no sound at all", riff(body, 7, 1, 8000, 16)):
        with pytest.raises(ValueError):
            audio.decode_wav(bad)


def level(x):
    return 20 * np.log10(max(1e-12, np.sqrt((x[400:-400] ** 2).mean()) / np.sqrt(0.5)))


def tone(rate, hertz, seconds=0.5):
    return np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("rate", [48_000, 44_100, 32_000, 22_050])
def test_tones_above_nyquist_are_damped(rate):
    for hertz in (8_050, 9_000, min(11_000, rate * 0.49)):
        assert level(audio.resample(tone(rate, hertz), rate)) < -60
    for hertz in (50, 1_000, 6_500):
        y = audio.resample(tone(rate, hertz), rate)
        assert abs(level(y)) < 0.1 and len(y) == 8000
        assert np.abs(y - tone(16_000, hertz))[400:-400].max() < 5e-3


def test_upsampling_keeps_the_wave():
    y = audio.resample(tone(8_000, 1_000), 8_000)
    assert len(y) == 8_000 and np.abs(y - tone(16_000, 1_000))[400:-400].max() < 5e-3
    assert audio.resample(np.zeros(0), 8_000).size == 0 and (audio.resample(WAVE, 16_000) == WAVE).all()


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def test_headers_alone_are_read():
    file = Counted(riff(b"\x00" * 2_000_000, 1, 1, 16_000, 16, b"x" * 50_000))
    assert audio.read_header(file).duration == 62.5 and file.read_bytes < 200


def test_files_are_written_and_read(spark, tmp_path):
    audio.register(spark)
    rows = [(f"c{k}.wav", [0.5, -0.25, 0.0] * (k + 1)) for k in range(9)] + [("none.wav", []), ("null.wav", None)]
    df = spark.createDataFrame(rows, "file string, samples array<float>").repartition(3)
    df.write.format("wavfiles").mode("append").save(str(tmp_path / "w"))
    heads = spark.read.format("wavfiles").schema("audio_stem string, duration double").load(str(tmp_path / "w"))
    assert {r["audio_stem"]: r["duration"] for r in heads.collect()} == {f"c{k}": 3 * (k + 1) / 16_000 for k in range(9)}
    full = spark.read.format("wavfiles").load(str(tmp_path / "w")).filter("audio_stem = 'c1'").first()
    assert full["samples"] == pytest.approx([0.5, -0.25, 0.0] * 2, abs=1e-4) and full["file_size"] == 44 + 12 and full["bit_depth"] == 16
    reader = audio.WavReader(heads.schema, {"path": str(tmp_path / "w")})
    assert [len(p.paths) for p in reader.partitions()] == [9]
    one = spark.read.format("wavfiles").schema("duration double").load(str(tmp_path / "w" / "c0.wav"))
    assert one.count() == 1


def test_frame_energies_equal_the_definition(spark):
    rng = np.random.default_rng(1)
    waves = {"a": rng.normal(size=1000), "short": rng.normal(size=9), "quiet": np.concatenate([1e4 * rng.normal(size=500), 1e-3 * rng.normal(size=500)]), "exact": rng.normal(size=10)}
    df = spark.createDataFrame([(k, v.astype(np.float32).tolist()) for k, v in waves.items()] + [("null", None)], "audio_path string, samples array<float>")
    got = {(r["audio_path"], r["frame"]): r["energy"] for r in vad.frame_energies(df, rate=400).collect()}
    want = {(k, n): float(np.mean(np.square(v.astype(np.float32).astype(float)[4 * n : 4 * n + 10]))) for k, v in waves.items() for n in range((len(v) - 10) // 4 + 1) if len(v) >= 10}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert vad.frame_energies(df.filter(F.lit(False)), rate=400).count() == 0
