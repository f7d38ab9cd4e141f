from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivaq.functions import geo
from rivaq.functions import text as X


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_normalize(spark):
    got = one(spark, X.normalize, None, "", "Şâhit İÇİN Ilık", "Â b", "a b\tc", "x😀y")
    assert got == ["", "", "sahit icin ilik", "b", "a b c", "x y"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_normalize_twice_is_once(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    once = one(spark, X.normalize, *texts)
    assert one(spark, X.normalize, *once) == once


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    assert one(spark, X.tokens, "Bir taş, bir TAŞ daha ve su", None, "bu da o") == [["tas", "tas"], [], []]


def test_trim(spark):
    assert one(spark, X.trim, " 　a b﻿\n", "", "\t") == ["a b", "", ""]


def test_grade_class_order(spark):
    got = one(spark, X.grade_class, "Hasan Sahih", "Da'if", "Mawdu", "", None, "weak sahih", "Munkar", "Hasan", "?")
    assert got == ["sahih", "zayif", "mevzu", "bilinmiyor", "bilinmiyor", "sahih", "zayif", "hasen", "bilinmiyor"]


def test_bracket_source(spark):
    assert one(spark, X.bracket_source, "söz [Buhari] ", "söz [ Tirmizi ]\n", "söz [a]", "[x y] söz", None) == ["Buhari", "Tirmizi", "", "", ""]


def test_number_label(spark):
    rows = spark.createDataFrame([(1.0,), (2.5,), (None,)], "x double").select(X.number_label(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["1", "2.5", None]


def test_first_hop_and_media(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), ("", "9.9.9.9"), (None, None)], "f string, r string")
    assert [r[0] for r in df.select(X.first_hop(F.col("f"), F.col("r"))).collect()] == ["1.2.3.4", "9.9.9.9", "x"]
    assert one(spark, X.media_type, "/a/b.css", "x.woff2", "noext") == ["text/css; charset=utf-8", "font/woff2", "application/octet-stream"]


def test_places_and_articles(spark):
    assert one(spark, X.revelation_place, "Mecca", "Medina", "MEKKE", None) == ["Mekke", "Medine", "Mekke", "Medine"]
    assert one(spark, X.article_case, "AL-Fatiha", "al-Kahf", "Yusuf") == ["Al-Fatiha", "Al-Kahf", "Yusuf"]


def test_links(spark):
    assert one(spark, X.links, "bkz. https://a.b/c. ve (http://d/e)!", None) == [["https://a.b/c", "http://d/e"], []]


def test_bearing_and_sun(spark):
    df = spark.createDataFrame([(41.0082, 28.9784), (21.4225241, 0.0), (80.0, 0.0)], "a double, b double")
    rows = df.select(geo.bearing(F.col("a"), F.col("b")).alias("k"), geo.prayer_minutes(F.col("a"), F.col("b"), F.lit("2024-06-21").cast("date")).alias("v")).collect()
    assert abs(rows[0].k - 151.6) < 0.1
    v = rows[0].v  # Istanbul in midsummer, minutes UTC: sunrise 02:32 and sunset 17:40, before the fixed shifts
    assert abs(v.gunes + 7 - 152) < 3 and abs(v.aksam - 7 - 1060) < 3 and v.imsak < v.gunes < v.ogle < v.ikindi < v.aksam < v.yatsi
    assert rows[2].v.gunes is None
