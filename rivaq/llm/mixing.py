"""Sources mixed to target weights: a low-discrepancy schedule of source slots, joined with shuffled equal-token blocks.

Slot i takes the point i times the golden ratio, modulo 1; the source whose interval of the cumulative weights holds the
point fills the slot. The texts of a source, shuffled anew for each repetition, form one stream of tokens, cut into equal
blocks; the r-th slot of a source takes its r-th block. Documents are neither dropped nor sampled within a stream: a
source that is used once or more contributes all its texts before any is repeated.

The total is the largest, counted in slots, at which no source with texts is asked for more than its max_repeat (a smaller one may be
asked for; a larger one gives what max_repeat allows, and the report shows what is missing). Sources without texts
contribute nothing, and the shares of the others keep their proportions. Rows without source, positive share or positive
max_repeat, and documents of other sources, take no part. Repeated targets of a source count once, the largest.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivaq.llm import tokens as K
from rivaq.session import saved

GOLDEN = (math.sqrt(5) - 1) / 2
#: Usual block, in tokens; slots wanted before blocks reach it, and beyond which they grow; slots in which ranks are counted together; slots counted at once for the total.
BLOCK, SLOTS, MOST, CHUNK, COUNTED = 256, 1024, 1 << 24, 4096, 1 << 18


def _sizes(documents: DataFrame, targets: DataFrame, folder: str, vocabulary: str) -> tuple[DataFrame, list]:
    goals = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeat > 0").groupBy("source").agg(F.max("target_share").alias("pay"), F.max("max_repeat").alias("tekrar"))
    wanted = goals.collect()  # a row for each source that the mixture names
    sizes = saved(K.sized(documents.where(F.col("source").isin(*[r.source for r in wanted]) if wanted else F.lit(False)), ["doc_id", "source"], folder, vocabulary).where("n > 0"), "sizes")
    have = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    return sizes, [(r.source, r.pay, r.tekrar, have.get(r.source, 0)) for r in sorted(wanted, key=lambda r: r.source)]


def _slots(goals: list, total: int | None) -> tuple[int, int, list[tuple[str, float, int, int]]]:
    """Block size, number of slots, and (source, weight, tokens, blocks it may give) of each source with texts."""
    have = [g for g in goals if g[3] > 0]
    share = sum(g[1] for g in have)
    if not have:
        return 1, 0, []
    most = min(g[3] * g[2] * share / g[1] for g in have)
    block = int(max(1, min(BLOCK, most // SLOTS), most // MOST))
    n = _reached(have, share, block)
    if total is not None:
        n = total // block
    return block, n, [(g[0], g[1] / share, g[3], g[3] * g[2] // block) for g in have]


def _reached(have: list, share: float, block: int) -> int:
    """The largest number of slots of which no source gets more than the blocks it has, by counting the slots each gets."""
    edges = np.cumsum([g[1] / share for g in have])[:-1]
    limit = np.array([g[3] * g[2] // block for g in have])
    used, n = np.zeros(len(have), dtype=np.int64), 0
    while True:
        at = np.arange(n, n + COUNTED, dtype=np.float64) * GOLDEN
        source = np.searchsorted(edges, at - np.floor(at), side="right")
        over = COUNTED
        for i in np.flatnonzero(used + np.bincount(source, minlength=len(have)) > limit):
            over = min(over, int(np.flatnonzero(source == i)[limit[i] - used[i]]))
        if over < COUNTED:
            return n + over
        used += np.bincount(source, minlength=len(have))
        n += COUNTED


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, folder: str = K.FOLDER, vocabulary: str = K.VOCABULARY) -> DataFrame:
    """yer (slot), source, tekrar (from 0), doc_id, bas (first token of the text), adet (tokens): the mixture, in order of yer."""
    sizes, goals = _sizes(documents, targets, folder, vocabulary)
    return _mixed(sizes, goals, total)


def _mixed(sizes: DataFrame, goals: list, total: int | None) -> DataFrame:
    spark = sizes.sparkSession
    block, n, have = _slots(goals, total)
    if not n:
        return spark.createDataFrame([], "yer long, source string, tekrar int, doc_id long, bas long, adet long")
    point = F.expr(f"yer * {GOLDEN!r}D - floor(yer * {GOLDEN!r}D)")
    pick, edge = None, 0.0
    for s, w, _, _ in have[:-1]:
        edge += w
        pick = F.when(point < edge, F.lit(s)) if pick is None else pick.when(point < edge, F.lit(s))
    pick = F.lit(have[-1][0]) if pick is None else pick.otherwise(F.lit(have[-1][0]))
    slots = spark.range(n).select(F.col("id").alias("yer")).withColumn("source", pick)
    slots = _ranked(slots)
    limit = F.element_at(F.create_map(*[x for s, _, _, b in have for x in (F.lit(s), F.lit(b).cast("long"))]), F.col("source"))
    slots = slots.where(F.col("blok") < limit)
    used = {r.source: r.m for r in slots.groupBy("source").agg(F.max("blok").alias("m")).collect()}  # a row for each source
    turns = {s: ((used[s] + 1) * block - 1) // t for s, _, t, _ in have if s in used}
    if not turns:
        return spark.createDataFrame([], "yer long, source string, tekrar int, doc_id long, bas long, adet long")
    last = F.element_at(F.create_map(*[x for s, v in turns.items() for x in (F.lit(s), F.lit(v))]), F.col("source"))
    size = F.element_at(F.create_map(*[x for s, _, t, _ in have for x in (F.lit(s), F.lit(t).cast("long"))]), F.col("source"))
    texts = sizes.where(F.col("source").isin(*turns)).withColumn("tekrar", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    texts = K.running(texts, ["source", "tekrar"], F.xxhash64("doc_id", "tekrar"), "doc_id", F.col("n"), "once", K.bits_for(sizes.count())).withColumn("once", F.col("once") + F.col("tekrar") * size)
    parts = texts.withColumn("blok", F.explode(F.sequence((F.col("once") / block).cast("long"), ((F.col("once") + F.col("n") - 1) / block).cast("long"))))
    a, b = F.greatest("once", F.col("blok") * block), F.least(F.col("once") + F.col("n"), (F.col("blok") + 1) * block)
    parts = parts.select("source", "blok", "tekrar", "doc_id", (a - F.col("once")).alias("bas"), (b - a).alias("adet"))
    return slots.join(parts, ["source", "blok"]).select("yer", "source", "tekrar", "doc_id", "bas", "adet")


def _ranked(slots: DataFrame) -> DataFrame:
    """slots with blok, the number of earlier slots of the same source: counted in chunks, then shifted by the chunks before."""
    slots = slots.withColumn("_c", (F.col("yer") / CHUNK).cast("long"))
    sums = slots.groupBy("source", "_c").agg(F.count("*").alias("_s"))
    before = Window.partitionBy("source").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_c", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    slots = slots.withColumn("_w", F.row_number().over(Window.partitionBy("source", "_c").orderBy("yer")) - 1)
    return slots.join(sums, ["source", "_c"]).select("yer", "source", (F.col("_b") + F.col("_w")).alias("blok"))


def report(documents: DataFrame, targets: DataFrame, total: int | None = None, folder: str = K.FOLDER, vocabulary: str = K.VOCABULARY) -> DataFrame:
    """source, hedef (target share), ulasilan (share reached), belirtec (tokens in the mixture), mevcut (tokens the source has), kullanim (times used), max_repeat."""
    sizes, goals = _sizes(documents, targets, folder, vocabulary)
    got = _mixed(sizes, goals, total).groupBy("source").agg(F.sum("adet").alias("belirtec"))
    rows = sizes.sparkSession.createDataFrame([(s, float(p), int(r), int(h)) for s, p, r, h in goals], "source string, hedef double, max_repeat int, mevcut long")
    rows = rows.join(got, "source", "left").withColumn("belirtec", F.coalesce("belirtec", F.lit(0).cast("long")))
    rows = rows.withColumn("hepsi", rows.agg(F.sum("belirtec")).scalar())
    return rows.select("source", "hedef", F.when(F.col("hepsi") > 0, F.col("belirtec") / F.col("hepsi")).alias("ulasilan"), "belirtec", "mevcut", F.when(F.col("mevcut") > 0, F.col("belirtec") / F.col("mevcut")).alias("kullanim"), "max_repeat")
