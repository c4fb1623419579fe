"""Log-mel spectrograms: one row holds a clip as samples (array<float>, mono, 16 kHz)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from tessel.runtime import ship_package

#: Samples a second, in a window, between windows and in a chunk; bands.
RATE, WINDOW, HOP, CHUNK, BANDS = 16_000, 400, 160, 480_000, 80


def pad_or_trim(samples: np.ndarray, length: int = CHUNK) -> np.ndarray:
    return np.pad(samples[:length], (0, max(length - len(samples), 0)))


def hann(n: int) -> np.ndarray:
    """The periodic window."""
    return np.sin(np.pi * np.arange(n) / n) ** 2


@cache
def mel_filters(bands: int = BANDS, window: int = WINDOW, rate: int = RATE) -> np.ndarray:
    """Triangles of equal area [band, frequency] on Slaney's scale: linear up to 1000 Hz, then 27 steps for each 6.4-fold."""
    step, knee = 200 / 3, 15.0
    growth = np.log(6.4) / 27
    top = knee + np.log(rate / 2 / 1000) / growth
    mel = np.linspace(0, top, bands + 2)
    hz = np.where(mel < knee, mel * step, 1000 * np.exp(growth * (mel - knee)))
    f = np.arange(window // 2 + 1) * rate / window
    up = (f - hz[:-2, None]) / np.diff(hz)[:-1, None]
    down = (hz[2:, None] - f) / np.diff(hz)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (hz[2:] - hz[:-2]))[:, None]


def spectrogram(samples: np.ndarray) -> np.ndarray:
    """[band, frame]: log10 of mel energies of windows centred every HOP samples (the last is left out), held to 8 below
    the greatest, plus 4, over 4. Beyond the ends samples are mirrored; an empty clip is silence."""
    x = np.asarray(samples, dtype=np.float64)
    half = WINDOW // 2
    x = np.zeros(WINDOW) if not len(x) else np.pad(x, half, mode="reflect" if len(x) > half else "symmetric")
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    frames = frames[: max(len(frames) - 1, 1)]
    power = np.abs(np.fft.rfft(frames * hann(WINDOW), axis=1)) ** 2
    mel = np.log10(np.maximum(mel_filters() @ power.T, 1e-10))
    return (np.maximum(mel, mel.max() - 8) + 4) / 4


def log_mel(clips: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """(key, bands, frames, data: array<float>, band by band) of each clip, padded or trimmed to 30 seconds unless whole.
    Null samples are silence."""
    ship_package(clips.sparkSession)
    kind = dict(clips.dtypes)[key]

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            rows = []
            for k, s in zip(pdf[key], pdf["samples"], strict=True):
                x = np.zeros(0) if s is None else np.asarray(s)
                mel = spectrogram(x if whole else pad_or_trim(x))
                rows.append((k, *mel.shape, mel.reshape(-1).astype(np.float32)))
            yield pd.DataFrame(rows, columns=[key, "bands", "frames", "data"])

    return clips.select(key, "samples").mapInPandas(run, f"`{key}` {kind}, bands int, frames int, data array<float>")
