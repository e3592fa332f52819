"""Pluggable models: anything that turns texts or signals into unit vectors, or signals into captions."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Encoder(Protocol):
    name: str
    width: int
    scale: float

    def texts(self, texts: list[str]) -> np.ndarray: ...

    def signals(self, signals: list[np.ndarray]) -> np.ndarray: ...


@functools.lru_cache(maxsize=1 << 15)
def _direction(key: str, width: int) -> np.ndarray:
    """A seeded direction; those of frequent words are kept."""
    out = np.random.default_rng(int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "little")).standard_normal(width)
    out.flags.writeable = False
    return out


class HashingEncoder:
    """A stand-in that needs no model: seeded directions of words, or of coarse spectra."""

    name, scale = "hashing", 20.0

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def _direction(self, key: str) -> np.ndarray:
        return _direction(key, self.width)

    def _unit(self, v: np.ndarray) -> np.ndarray:
        return v / (np.linalg.norm(v) or 1.0)

    def texts(self, texts: list[str]) -> np.ndarray:
        return np.array([self._unit(sum((self._direction(w) for w in t.lower().split()), np.zeros(self.width))) for t in texts])

    def signals(self, signals: list[np.ndarray]) -> np.ndarray:
        out = []
        for y in signals:
            spectrum = np.abs(np.fft.rfft(y, 4096))[:2048].reshape(64, 32).sum(axis=1)
            out.append(self._unit(sum((s * self._direction(f"band{i}") for i, s in enumerate(spectrum)), np.zeros(self.width))))
        return np.array(out)


def embedded_texts(df: DataFrame, make: Callable[[], Encoder], key: str, text: str) -> DataFrame:
    """(key, vector): the encoder is made once by worker and called by batch; texts are dealt over tasks, as those of many lie in one file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for b in batches:
            yield pd.DataFrame({key: b[key], "vector": list(encoder.texts(b[text].fillna("").tolist()).astype("float32")) if len(b) else []})

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(key, text).repartition(tasks).mapInPandas(run, f"{key} long, vector array<float>")


def captioned(df: DataFrame, make: Callable[[], Callable[[bytes], str]], key: str, content: str) -> DataFrame:
    """(key, caption, error): a model that can't be made fails the run once; a row that fails is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caption = make()
        for b in batches:
            out = []
            for k, c in zip(b[key], b[content], strict=True):
                try:
                    out.append((k, caption(c), None))
                except Exception as e:
                    out.append((k, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=[key, "caption", "error"])

    return df.select(key, content).mapInPandas(run, f"{key} long, caption string, error string")
