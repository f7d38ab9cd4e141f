"""Picks that depend on the date alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivaq.functions import text as X
from rivaq.operators.ranks import dense_numbers

# Chapter and verse of the verses that take turns.
VERSES = ((2, 286), (94, 5), (13, 28), (2, 152), (65, 3), (39, 53), (2, 153), (16, 128), (14, 7), (29, 69), (3, 139), (10, 57), (2, 45), (3, 159), (93, 4), (2, 255), (8, 46), (64, 11), (3, 173), (57, 4))
STEP, SHORTEST, LONGEST = 7, 40, 340


def picks(days: DataFrame, verses: DataFrame, corpus: DataFrame) -> DataFrame:
    """gun, ayet_id, hadis_id for each date (gun): the verse whose turn it is, and a sound saying of middling length from the pool in the order of ids; null where there is none."""
    pool = corpus.where((F.col("derece") == "sahih") & (F.length("tr") > SHORTEST) & (F.length("tr") < LONGEST)).select("id").distinct()
    pool = dense_numbers(pool, [F.col("id")], "_n")
    size = pool.agg(F.count("*")).scalar()
    seed = F.dayofyear("gun")
    turn = F.get(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(a).alias("a")) for s, a in VERSES]), F.pmod(seed, F.lit(len(VERSES))))
    days = days.withColumn("_t", turn).withColumn("_c", size).withColumn("_k", F.when(F.col("_c") > 0, F.pmod(seed.cast("long") * STEP, F.col("_c"))))
    first = verses.groupBy("sure", "ayet").agg(F.min("id").alias("ayet_id"))
    days = days.join(first, (F.col("_t.s") == first.sure) & (F.col("_t.a") == first.ayet), "left").join(pool.withColumnRenamed("id", "hadis_id"), F.col("_k") == F.col("_n"), "left")
    return days.select("gun", "ayet_id", "hadis_id")


def view(days: DataFrame, verses: DataFrame, corpus: DataFrame, lang: str = "tr") -> DataFrame:
    """gun, ayet (kaynak, ar, okunus, tr) and hadis (kaynak, tr, ar, dereceEtiket) in the language, each null where there is none. verses and corpus hold each id once."""
    en = lang == "en"
    picked = picks(days, verses, corpus)
    text = X.first_of(F.col("en"), F.col("tr")) if en else F.col("tr")
    ayet = verses.select(F.col("id").alias("ayet_id"), F.struct(F.col("kaynakEn" if en else "kaynak").alias("kaynak"), "ar", "okunus", text.alias("tr")).alias("ayet"))
    hadis = corpus.select(F.col("id").alias("hadis_id"), F.struct("kaynak", text.alias("tr"), "ar", F.lit("Sahih (Authentic)" if en else "Sahih").alias("dereceEtiket")).alias("hadis"))
    return picked.join(ayet, "ayet_id", "left").join(hadis, "hadis_id", "left").select("gun", "ayet", "hadis")
