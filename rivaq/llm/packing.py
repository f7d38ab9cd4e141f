"""Fixed-capacity containers filled with texts of varying length: large-item matching, then best fit.

Sizes are whole tokens, so packing needs only how many texts have each size, which is at most capacity + 1 numbers. Those
are packed on the driver into patterns with multiplicities: items above a third of the capacity are matched, the largest
with the largest that still fits, at most two to a container; smaller ones go, in falling size, into the smallest gap
that holds them. Then each text takes the place of its rank among the texts of its size.

A text above the capacity fills containers of its own, its rest is an item. Null and empty texts have no tokens and are
in no container. Containers without a positive capacity, and repeated containers, are left out. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivaq.llm import tokens as K
from rivaq.session import saved, shipped


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns that pack counts (items by size, each at most capacity): how many containers, and items by size in each."""
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    third = capacity / 3
    large = sorted(s for s in left if s > third)
    bins: list[tuple[int, dict[int, int]]] = []
    while large:
        s = large[-1]
        i = bisect_left(large, capacity - s + 1) - 1
        if i < 0:
            bins.append((left[s], {s: 1}))
            left[s] = 0
        elif (t := large[i]) != s:
            m = min(left[s], left[t])
            bins.append((m, {s: 1, t: 1}))
            left[s] -= m
            left[t] -= m
            if not left[t]:
                large.pop(i)
        else:
            if left[s] > 1:
                bins.append((left[s] // 2, {s: 2}))
            left[s] %= 2
            if left[s]:  # the last one: with the largest other that fits
                if i > 0:
                    t = large[i - 1]
                    bins.append((1, {s: 1, t: 1}))
                    left[t] -= 1
                    if not left[t]:
                        large.pop(i - 1)
                else:
                    bins.append((1, {s: 1}))
                left[s] = 0
        if not left[s]:
            large.pop(bisect_left(large, s))
    done: list[tuple[int, dict[int, int]]] = []
    gaps: list[int] = []
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def keep(m: int, content: dict[int, int]) -> None:
        gap = capacity - sum(s * n for s, n in content.items())
        if gap == 0:
            done.append((m, content))
        else:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((m, content))

    for m, content in bins:
        keep(m, content)
    for s in sorted((s for s in left if s <= third), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(gaps, s)
            gap = gaps[i] if i < len(gaps) else capacity
            if i < len(gaps):
                m, content = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(i)
            else:
                m, content = -(-n // (capacity // s)), {}
            each = gap // s
            full = min(m, n // each)
            if full:
                keep(full, {**content, s: each})
                n -= full * each
            if full < m and n:
                keep(1, {**content, s: n})
                n, full = 0, full + 1
            if full < m and content:
                keep(m - full, content)
    return done + [x for v in open_.values() for x in v]


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first ranks, first containers and items per container of the runs its items take."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for m, content in patterns:
        for s, each in content.items():
            runs.setdefault(s, []).append((used.get(s, 0), base, each))
            used[s] = used.get(s, 0) + m * each
        base += m
    return {s: tuple(np.array(v, np.int64).T) for s, v in runs.items()}


def packed(documents: DataFrame, containers: DataFrame, folder: str = K.FOLDER, vocabulary: str = K.VOCABULARY) -> DataFrame:
    """container, kutu (number of the container, from 0), doc_id, bas (first token), adet (tokens): where each text, or piece of an oversized one, lies."""
    spark = shipped(documents.sparkSession)
    kinds = sorted({(r.container, int(r.capacity_tokens)) for r in containers.select("container", "capacity_tokens").where("container IS NOT NULL AND capacity_tokens > 0").distinct().collect()})
    sizes = saved(K.sized(documents, ["doc_id"], folder, vocabulary), "sizes")
    bits = K.bits_for(sizes.count())
    each = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(k).cast("long").alias("kapasite")) for c, k in kinds]) if kinds else F.expr("array_repeat(named_struct('container', '', 'kapasite', 1L), 0)")
    items = sizes.select("doc_id", "n", F.explode(each).alias("k")).select("doc_id", "n", "k.*")
    items = items.withColumn("boy", F.col("n") % F.col("kapasite")).withColumn("dolu", F.col("n").cast("long") - F.col("boy"))
    rests = items.where("boy > 0")
    counts: dict[str, dict[int, int]] = {c: {} for c, _ in kinds}
    for r in rests.groupBy("container", "boy").agg(F.count("*").alias("m")).collect():  # at most capacity rows for each container
        counts[r.container][r.boy] = r.m
    plans = {c: plan(counts[c], k) for c, k in kinds}
    held = spark.sparkContext.broadcast({c: (places(p), sum(m for m, _ in p)) for c, p in plans.items()})
    ranked = K.running(rests.select("container", "boy", "doc_id", "dolu"), ["container", "boy"], F.xxhash64("doc_id"), "doc_id", F.lit(1), "sira", bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.zeros(len(batch), np.int64)
            for (c, s), rows in batch.reset_index(drop=True).groupby(["container", "boy"]).indices.items():
                first, base, each = held.value[c][0][int(s)]
                rank = batch.sira.to_numpy()[rows]
                i = np.searchsorted(first, rank, side="right") - 1
                at[rows] = base[i] + (rank - first[i]) // each[i]
            yield pd.DataFrame({"container": batch.container, "kutu": at, "doc_id": batch.doc_id, "bas": batch.dolu, "adet": batch.boy})

    small = ranked.select("container", "boy", "doc_id", "dolu", "sira").mapInPandas(run, "container string, kutu long, doc_id long, bas long, adet long")
    over = items.where("dolu > 0").select("container", "doc_id", "kapasite", (F.col("dolu") / F.col("kapasite")).cast("long").alias("tam"))
    over = K.running(over, ["container"], F.xxhash64("doc_id"), "doc_id", F.col("tam"), "once", bits)
    start = F.element_at(F.create_map(*[x for c, p in plans.items() for x in (F.lit(c), F.lit(sum(m for m, _ in p)).cast("long"))]), F.col("container")) if plans else F.lit(0).cast("long")
    full = over.select("container", "doc_id", "kapasite", (start + F.col("once")).alias("ilk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tam") - 1)).alias("i"))
    return small.unionByName(full.select("container", (F.col("ilk") + F.col("i")).alias("kutu"), "doc_id", (F.col("i") * F.col("kapasite")).alias("bas"), F.col("kapasite").alias("adet")))


def usage(assigned: DataFrame, containers: DataFrame) -> DataFrame:
    """container, kutular, belirtec (tokens), doluluk (share of the capacity used), en_az (containers that any packing needs for the tokens), en_dolu (tokens of the fullest)."""
    bins = assigned.groupBy("container", "kutu").agg(F.sum("adet").alias("dolu"))
    kinds = containers.select("container", F.col("capacity_tokens").cast("long").alias("kapasite")).distinct()
    total = bins.groupBy("container").agg(F.count("*").alias("kutular"), F.sum("dolu").alias("belirtec"), F.max("dolu").alias("en_dolu"))
    return total.join(kinds, "container").select("container", "kutular", "belirtec", (F.col("belirtec") / (F.col("kutular") * F.col("kapasite"))).alias("doluluk"), F.ceil(F.col("belirtec") / F.col("kapasite")).alias("en_az"), "en_dolu")
