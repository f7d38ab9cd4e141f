"""Sizes of texts in tokens of a public tokenizer, and ranks and running sums that no single task computes."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivaq.session import shipped, spread

#: Folder of the vocabulary files, and the one used: byte-level BPE for many languages, 50,256 ranks.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer cuts a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, once for each worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def sized(documents: DataFrame, keep: list[str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns named in keep and n, the tokens of text; without null and empty texts."""
    path = os.path.join(folder, vocabulary)
    shipped(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            encode = encoding(path).encode_ordinary
            yield batch[keep].assign(n=[len(encode(t)) for t in batch.text])

    rows = spread(documents.select(*keep, "text").where("text IS NOT NULL AND text <> ''"))
    schema = rows.select(*keep).schema.add("n", "long")
    return rows.mapInPandas(run, schema)


def bits_for(rows: int, each: int = 50_000) -> int:
    """Bits of the ranges into which so many rows of one group are cut, so that a range holds about `each`; at least 16 ranges."""
    return max(4, (max(rows, 1) // each).bit_length())


def running(rows: DataFrame, by: list[str], order: Column, tie: str, value: Column, name: str, bits: int = 8) -> DataFrame:
    """rows with the sum of value over the earlier rows of the same `by`, earlier by order (a 64-bit hash, then tie).

    A group may hold a third of all rows: it is cut into 2**bits ranges of the hash, summed within each, and shifted by the sums of the ranges before.
    """
    rows = rows.withColumn("_h", order).withColumn("_r", F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(2**63))), 64 - bits)).withColumn("_v", value)
    sums = rows.groupBy(*by, "_r").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_r", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    inner = Window.partitionBy(*by, "_r").orderBy("_h", tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_w", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return rows.join(sums, [*by, "_r"]).withColumn(name, F.col("_b") + F.col("_w")).drop("_h", "_r", "_v", "_w", "_b")
