"""Windows per caller: the anchored fixed window, and counters per day.

An anchored window begins with a caller's first call and holds all calls up to its length, that end included; the first
call after it begins the next. Where a window begins depends on all before it, and one caller may make a third of all
calls (calls without an address are one caller). So each caller's ranges of time are folded in parallel into small tables
(where the range's first window may begin, and where its last one then begins), those are chained per caller, and then
all ranges place their calls in parallel. Calls are numbered by minutes, shifted by the counts of the minutes before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivaq.session import saved, shipped

SECOND = 1_000_000
#: Windows' lengths in a range that is folded by one task, and microseconds in which calls are numbered together.
RANGE, MINUTE = 4, 60 * SECOND


def windows(t: np.ndarray, first: int, length: int) -> list[int]:
    """Positions in sorted times at which windows begin, the first one at position first."""
    out, i = [], first
    while i < len(t):
        out.append(i)
        i = int(np.searchsorted(t, t[i] + length, side="right"))
    return out


def _range(t: np.ndarray, length: int, begin: int) -> tuple[list[int], list[int], int]:
    """Of a range's sorted times: ranges of the earlier window's end, the beginning of the range's last window for each, and the last time."""
    near = min(int(np.searchsorted(t, begin + length, side="right")), len(t) - 1) + 1
    nxt = np.searchsorted(t, t + length, side="right")
    last = np.where(nxt < len(t), nxt, np.arange(len(t)))
    while True:  # each step doubles the windows leapt over
        far = last[last]
        if np.array_equal(far, last):
            break
        last = far
    lasts = t[last[:near]]
    # A window that ends before the i-th call makes it the first of the next; neighbours with one last window are one row.
    final = np.flatnonzero(np.r_[lasts[1:] != lasts[:-1], True])
    return (t[final] - 1).tolist(), lasts[final].tolist(), int(t[-1])


def _each(keys: list[str], f: Callable[[dict[str, np.ndarray]], dict[str, list]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over rows sorted by keys: f of each group's columns, whole groups at a time; a group that spans batches is put together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []

        def whole(parts: list[dict[str, np.ndarray]]) -> dict[str, list]:
            return f(parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

        for batch in batches:
            if not len(batch):
                continue
            cols = {c: batch[c].to_numpy() for c in batch.columns}
            change = np.zeros(len(batch), bool)
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            edges, out = [0, *np.flatnonzero(change).tolist(), len(batch)], []
            for a, b in zip(edges, edges[1:], strict=False):
                part = {c: v[a:b] for c, v in cols.items()}
                if held and any(held[-1][k][-1] != part[k][0] for k in keys):
                    out.append(whole(held))
                    held = []
                held.append(part)
            if out:
                yield pd.DataFrame({c: [x for o in out for x in o[c]] for c in out[0]})
        if held:
            yield pd.DataFrame(whole(held))

    return run


def anchored(calls: DataFrame, key: str, ts: str, order: str, length_s: int = 3600, limit: int = 120) -> DataFrame:
    """calls (key, ts as timestamp, order as tie-break) with bas (beginning of the window, microseconds), sayi (the call's number in it) and asildi (whether it exceeds the limit)."""
    shipped(calls.sparkSession)
    length = length_s * SECOND
    rows = calls.where(F.col(ts).isNotNull()).select(F.coalesce(F.col(key), F.lit("x")).alias("anahtar"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("sira"))
    span = RANGE * length
    rows = rows.withColumn("gun", F.floor(F.col("t") / span))
    rows = saved(rows, "calls")
    # Only the times matter for windows: equal ones are taken once.
    times = rows.groupBy("anahtar", "gun", "t").agg(F.lit(1).alias("b")).drop("b")

    times = times.repartition("anahtar", "gun").sortWithinPartitions("anahtar", "gun", "t")

    def fold(x: dict[str, np.ndarray]) -> dict[str, list]:
        ends, lasts, most = _range(x["t"], length, int(x["gun"][0]) * span)
        return {"anahtar": [x["anahtar"][0]], "gun": [x["gun"][0]], "ends": [ends], "lasts": [lasts], "max_t": [most]}

    tables = times.mapInPandas(_each(["anahtar", "gun"], fold), "anahtar string, gun long, ends array<long>, lasts array<long>, max_t long")
    tables = tables.repartition("anahtar").sortWithinPartitions("anahtar", "gun")

    def chain(x: dict[str, np.ndarray]) -> dict[str, list]:
        end, ins = -(2**62), []
        for ends, lasts, most in zip(x["ends"], x["lasts"], x["max_t"], strict=True):
            ins.append(end)
            if end < most:  # else all calls of the range lie in the earlier window
                end = int(lasts[min(int(np.searchsorted(ends, end, side="left")), len(lasts) - 1)]) + length
        return {"anahtar": x["anahtar"].tolist(), "gun": x["gun"].tolist(), "gelen": ins}

    entry = tables.mapInPandas(_each(["anahtar"], chain), "anahtar string, gun long, gelen long")

    def placed(x: dict[str, np.ndarray]) -> dict[str, list]:
        t, end = x["t"], int(x["gelen"][0])
        at = windows(t, int(np.searchsorted(t, end, side="right")), length)
        begin = np.full(len(t), end - length, np.int64)
        for a, b in zip(at, [*at, len(t)][1:], strict=True):
            begin[a:b] = t[a]
        return {"anahtar": x["anahtar"].tolist(), "gun": x["gun"].tolist(), "t": t.tolist(), "bas": begin.tolist()}

    both = times.join(entry, ["anahtar", "gun"]).repartition("anahtar", "gun").sortWithinPartitions("anahtar", "gun", "t")
    marked = both.mapInPandas(_each(["anahtar", "gun"], placed), "anahtar string, gun long, t long, bas long")
    full = rows.join(marked, ["anahtar", "gun", "t"])
    full = numbered(full.select("anahtar", "t", "sira", "bas"), ["anahtar", "bas"], "t", ["t", "sira"], "sayi")
    return full.select("anahtar", "t", "sira", "bas", "sayi").withColumn("asildi", F.col("sayi") > limit)


def numbered(rows: DataFrame, by: list[str], micros: str, order: list[str], name: str) -> DataFrame:
    """rows with their number, from 1, within `by`: numbered within each minute, and shifted by the counts of the minutes before."""
    rows = rows.withColumn("_m", F.floor(F.col(micros) / MINUTE))
    counts = rows.groupBy(*by, "_m").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_m", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    within = F.row_number().over(Window.partitionBy(*by, "_m").orderBy(*order))
    rows = rows.withColumn("_w", within).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_m"]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    keep = [F.col(f"r.{c}").alias(c) for c in rows.columns if c not in ("_m", "_w")]
    return rows.join(counts.alias("c"), on).select(*keep, (F.col("c._b") + F.col("r._w")).cast("int").alias(name))


def daily_numbers(calls: DataFrame, key: str, ts: str, order: str, limit: int = 5) -> DataFrame:
    """calls with gun (UTC date), sayi (the call's number among the key's of that day) and kalan (what remains of the limit after it)."""
    rows = calls.withColumn("gun", F.to_date(F.col(ts).cast("timestamp")))
    rows = numbered(rows.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))), [key, "gun"], "_t", ["_t", order], "sayi")
    return rows.drop("_t").withColumn("kalan", F.greatest(F.lit(0), F.lit(limit) - F.col("sayi")))
