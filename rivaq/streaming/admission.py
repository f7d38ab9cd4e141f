"""Streaming twins of the windows per caller, and windowed counts of late calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rivaq.operators.admission import SECOND, windows
from rivaq.session import shipped


def anchored(calls: DataFrame, key: str, ts: str, order: str, length_s: int = 3600, limit: int = 120, delay: str = "7 days") -> DataFrame:
    """anahtar, sira, bas, sayi, asildi of each call, in order of arrival (ts); a caller's state ends when the watermark passes its window.

    Calls are counted in the order in which micro-batches bring them, sorted by ts within each.
    """
    shipped(calls.sparkSession)
    length = length_s * SECOND

    def count(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin, n = state.get if state.exists else (None, 0)
        t, sira = _sorted(batches)
        old = int(np.searchsorted(t, begin + length, side="right")) if begin is not None else 0
        begins, numbers = np.full(len(t), begin or 0, np.int64), n + 1 + np.arange(len(t))
        starts = windows(t, old, length)
        for a, b in zip(starts, [*starts, len(t)][1:], strict=True):
            begins[a:b], numbers[a:b] = t[a], 1 + np.arange(b - a)
        state.update((int(begins[-1]), int(numbers[-1])))
        state.setTimeoutTimestamp(max((int(begins[-1]) + length) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"anahtar": key_[0], "sira": sira, "bas": begins, "sayi": numbers, "asildi": numbers > limit})

    rows = calls.select(F.coalesce(F.col(key), F.lit("x")).alias("anahtar"), F.col(ts).cast("timestamp").alias("_ts"), F.col(order).alias("sira")).where("_ts IS NOT NULL")
    rows = rows.withWatermark("_ts", delay).withColumn("t", F.unix_micros("_ts"))
    return rows.groupBy("anahtar").applyInPandasWithState(count, "anahtar string, sira long, bas long, sayi long, asildi boolean", "bas long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def _sorted(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Times and numbers of a caller's calls of a micro-batch in their order; 16 bytes a call are held."""
    parts = [(b.t.to_numpy(np.int64), b.sira.to_numpy(np.int64)) for b in batches]
    t, sira = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((sira, t))
    return t[order], sira[order]


def daily_numbers(calls: DataFrame, key: str, ts: str, order: str, limit: int = 5, delay: str = "2 days") -> DataFrame:
    """anahtar, gun, sira, sayi, kalan: each call's number among the key's of its UTC day, and what remains of the limit after it; a day's count ends when the watermark passes its end.

    Calls are counted in the order in which micro-batches bring them, sorted by ts within each. Null keys are one key, "anon".
    """
    shipped(calls.sparkSession)

    def count(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (n,) = state.get if state.exists else (0,)
        t, sira = _sorted(batches)
        numbers = n + 1 + np.arange(len(t))
        state.update((int(numbers[-1]),))
        end = int((pd.Timestamp(key_[1]) + pd.Timedelta(days=1)).value // 1_000_000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"anahtar": key_[0], "gun": key_[1], "sira": sira, "sayi": numbers, "kalan": np.maximum(0, limit - numbers)})

    rows = calls.select(F.coalesce(F.col(key), F.lit("anon")).alias("anahtar"), F.col(ts).cast("timestamp").alias("_ts"), F.col(order).cast("long").alias("sira")).where("_ts IS NOT NULL")
    rows = rows.withWatermark("_ts", delay).withColumn("t", F.unix_micros("_ts")).withColumn("gun", F.to_date("_ts"))
    return rows.groupBy("anahtar", "gun").applyInPandasWithState(count, "anahtar string, gun date, sira long, sayi long, kalan long", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def hourly_calls(calls: DataFrame, ts: str, by: str, order: str, delay: str = "2 days", width: str = "1 hour") -> DataFrame:
    """Calls per window of their own time and `by`, each delivered call (a value of order) once; later ones than `delay` are not waited for."""
    rows = calls.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark([order])
    return rows.groupBy(F.window("_ts", width).alias("pencere"), by).agg(F.count("*").alias("n")).select(F.col("pencere.start").alias("bas"), by, "n")
