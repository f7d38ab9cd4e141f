"""Places for models: encoding in batches, matching, expansion. No model is part of this package."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivaq.functions.text import fold_word
from rivaq.session import shipped

#: Vector width, texts in a batch, words whose hashes are kept.
WIDTH, BATCH, WORDS = 64, 64, 100_000


def hashing_encoder(width: int = WIDTH) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a sentence model: signed hashes of folded words, unit length. It knows no meaning."""

    @lru_cache(WORDS)
    def place(word: str) -> tuple[int, int]:
        h = zlib.crc32(fold_word(word).encode())
        return h % width, 1 if h & 0x10000 else -1

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in t.split():
                at, sign = place(w)
                out[i, at] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode


def windows(text: str, longest: int | None) -> list[str]:
    """The whole text in consecutive parts of at most `longest` characters, cut at blanks where there are any."""
    parts = []
    while longest and len(text) > longest:
        at = text.rfind(" ", 1, longest + 1)
        at = at if at > 0 else longest
        parts.append(text[:at])
        text = text[at:]
    return [*parts, text]


def _whole(encode: Callable[[list[str]], np.ndarray], texts: list[str], longest: int | None) -> np.ndarray:
    """A vector for each text: of its windows, the mean by their lengths, at unit length again; of a text of one window its own."""
    parts = [windows(t, longest) for t in texts]
    flat = [w for p in parts for w in p]
    v = np.concatenate([np.asarray(encode(flat[a : a + BATCH])) for a in range(0, len(flat), BATCH)])
    if len(flat) == len(texts):
        return v
    starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
    mean = np.add.reduceat(v * np.array([[len(w)] for w in flat]), starts, axis=0)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    mean /= np.where(norm == 0, 1, norm)
    one = np.array([len(p) == 1 for p in parts])
    mean[one] = v[starts[one]]
    return mean


def encoded(df: DataFrame, key: str | list[str], text: Column, make: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, longest: int | None = None) -> DataFrame:
    """The key columns and v: vectors of the whole texts; the encoder is made once for each task and called with batches. For a model that takes no more than `longest` characters, the vectors of a text's windows are averaged."""
    shipped(df.sparkSession)
    keys = [key] if isinstance(key, str) else key
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for batch in batches:
            for a in range(0, len(batch), BATCH):
                part = batch.iloc[a : a + BATCH]
                yield part[names].assign(v=list(_whole(encode, part.t.tolist(), longest).astype(np.float32)))

    rows = df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(keys, names, strict=True)], F.coalesce(text, F.lit("")).alias("t"))
    return rows.mapInPandas(run, ", ".join(f"{n} string" for n in names) + ", v array<float>").toDF(*keys, "v")
