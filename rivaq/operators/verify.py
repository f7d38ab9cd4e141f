"""Verification of pasted passages: lexical candidates, then a matcher on the few that remain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivaq.operators import lexical
from rivaq.session import saved

CANDIDATES, SIMILAR, SURE = 8, 3, 0.45
#: A candidate's score must exceed MATCH; it is taken over FULL as the confidence.
MATCH, FULL = 12.0, 40.0


def score_matcher(candidates: DataFrame) -> DataFrame:
    """qid, id, guven: the first candidate where its score is high enough. Stands in for a model that compares texts."""
    top = candidates.where(F.col("sira") == 1)
    return top.where(F.col("skor") > MATCH).select("qid", "id", F.least(F.lit(1.0), F.col("skor") / FULL).alias("guven"))


def verify(index: lexical.Index, docs: DataFrame, passages: DataFrame, matcher: Callable[[DataFrame], DataFrame] = score_matcher, **search) -> DataFrame:
    """qid, bulundu, id, guven, benzerler (ids of up to SIMILAR other candidates) of each passage (qid, text) with candidates; an id that is no candidate is not found."""
    found = saved(lexical.search(index, docs, passages, CANDIDATES, **search), "candidates")
    match = matcher(found).where(F.col("guven") >= SURE).join(found.select("qid", "id"), ["qid", "id"], "left_semi")
    rows = found.join(match.select("qid", F.col("id").alias("es"), "guven"), "qid", "left")
    lists = rows.groupBy("qid").agg(F.first("es").alias("id"), F.first("guven").alias("guven"), F.array_sort(F.collect_list(F.struct("sira", F.col("id").alias("aday")))).alias("v"))
    near = F.slice(F.transform(F.filter("v", lambda x: x["aday"] != F.col("id")), lambda x: x["aday"]), 1, SIMILAR)
    return lists.select("qid", F.col("id").isNotNull().alias("bulundu"), "id", "guven", F.when(F.col("id").isNotNull(), near).alias("benzerler"))
