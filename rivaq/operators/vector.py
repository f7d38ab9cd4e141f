"""Exact dense-vector search: blocks of queries against blocks of vectors, multiplied in NumPy, best k kept at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivaq.operators.ranks import dense_numbers, top_k
from rivaq.session import shipped, spread

#: Vectors in a block, and queries in a block: one product is at most 4096 x 512. Numbers of query vectors that go to every task at once.
ROWS, ASKED, HELD = 4096, 512, 8_000_000


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def _best(ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and score of the k best of each row of scores; ties to the smaller id."""
    n = min(k, len(ids))
    least = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
    row, at = np.nonzero(s >= least[:, None])  # the best and all that tie with the last of them
    return _first(row, ids[at], s[row, at], k)


def _first(row: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -s, row))
    row, ids, s = row[order], ids[order], s[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], s[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", predicate: Column | None = None) -> DataFrame:
    """qid, sira, id, skor: the k vectors of largest dot product for each query (qid, v).

    The query set, in slices of at most HELD numbers, goes to all tasks; each multiplies it with its vectors block by block
    and keeps the k best of each query. Null vectors take no part.
    """
    shipped(vectors.sparkSession)
    rows = vectors.where(predicate) if predicate is not None else vectors
    rows = spread(rows.select(F.col(key).cast("long").alias("k"), F.col(column).alias("v")).where("v IS NOT NULL"))
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "v").where("v IS NOT NULL")
    numbers = asked.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).head()[0]
    slices = -(-numbers // HELD)
    parts = [_against(rows, asked.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == i), k) for i in range(slices)]
    part = reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], "qid long, id long, skor double")
    return top_k(part, ["qid"], [F.desc("skor"), F.asc("id")], k, "sira").select("qid", "sira", "id", F.round("skor", 6).alias("skor"))


def _against(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    own = asked.toPandas()
    blocks = [(own.qid.to_numpy(np.int64)[a : a + ASKED], _matrix(own.v.iloc[a : a + ASKED])) for a in range(0, len(own), ASKED)]
    held = rows.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple | None] = [None] * len(held.value)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                ids, m = batch.k.to_numpy(np.int64)[a : a + ROWS], _matrix(batch.v.iloc[a : a + ROWS])
                for n, (_, q) in enumerate(held.value):
                    new = _best(ids, np.round(q @ m.T, 9), k)
                    best[n] = new if best[n] is None else _first(*(np.r_[x, y] for x, y in zip(best[n], new, strict=True)), k)
        for (qids, _), rest in zip(held.value, best, strict=True):
            if rest is not None:
                yield pd.DataFrame({"qid": qids[rest[0]], "id": rest[1], "skor": rest[2]})

    return rows.mapInPandas(run, "qid long, id long, skor double")


def aligned(rows: DataFrame, key: str, vectors: DataFrame, pos: str, column: str, strict: bool = True) -> DataFrame:
    """rows with the vector (v) at their place in the order of key, counted from 0. A set of vectors of another length belongs to other rows: that is an error, or, if not strict, rows and vectors without a partner drop out."""
    if strict and (a := rows.count()) != (b := vectors.count()):
        raise ValueError(f"{a} rows but {b} vectors")
    return dense_numbers(rows, [F.col(key)], "_n").join(vectors.select(F.col(pos).cast("long").alias("_n"), F.col(column).alias("v")), "_n").drop("_n")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in index order, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
