"""Bearings and solar times as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latitude and longitude of the place that bearings lead to.
TARGET = (21.4225241, 39.8261818)
# Sun angles at dawn and nightfall, and minutes added to sunrise, noon, afternoon and sunset.
DAWN, NIGHT, SUNRISE_MIN, NOON_MIN, AFTERNOON_MIN, SUNSET_MIN = 18.0, 17.0, -7, 5, 4, 7


def bearing(lat: Column, lng: Column, to: tuple[float, float] = TARGET) -> Column:
    """Initial great-circle bearing in degrees from north, 0 to 360."""
    f, t, d = F.radians(lat), F.radians(F.lit(to[0])), F.radians(F.lit(to[1]) - lng)
    a = F.degrees(F.atan2(F.sin(d), F.cos(f) * F.tan(t) - F.sin(f) * F.cos(d)))
    return F.pmod(a + 360.0, F.lit(360.0))


def _sun(day: Column) -> tuple[Column, Column]:
    """Declination in radians and equation of time in minutes at noon UTC of a date."""
    n = F.datediff(day, F.lit("2000-01-01").cast("date")).cast("double")
    g = F.radians(F.pmod(357.529 + 0.98560028 * n, F.lit(360.0)))
    q = F.pmod(280.459 + 0.98564736 * n, F.lit(360.0))
    lon = F.radians(F.pmod(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g), F.lit(360.0)))
    tilt = F.radians(23.439 - 0.00000036 * n)
    right = F.degrees(F.atan2(F.cos(tilt) * F.sin(lon), F.cos(lon)))
    return F.asin(F.sin(tilt) * F.sin(lon)), 4 * (F.pmod(q - right + 180.0, F.lit(360.0)) - 180.0)


def next_dawn(lat: Column, lng: Column, day: Column) -> Column:
    """Minutes after midnight UTC of the given day of the dawn of the day after."""
    return prayer_minutes(lat, lng, F.date_add(day, 1))["imsak"] + 1440.0


def prayer_minutes(lat: Column, lng: Column, day: Column) -> Column:
    """Struct of minutes after midnight UTC of dawn, sunrise, noon, afternoon, sunset and nightfall; null where the sun does not reach the angle."""
    dec, eot = _sun(day)
    f = F.radians(lat)
    noon = 720.0 - 4.0 * lng - eot

    def arc(altitude: Column) -> Column:
        x = (F.sin(altitude) - F.sin(f) * F.sin(dec)) / (F.cos(f) * F.cos(dec))
        return F.when(F.abs(x) <= 1, 4.0 * F.degrees(F.acos(x)))

    low = lambda angle: arc(F.radians(F.lit(-angle)))
    shade = arc(F.atan(1.0 / (1.0 + F.tan(F.abs(f - dec)))))
    return F.struct(
        (noon - low(DAWN)).alias("imsak"), (noon - low(0.833) + SUNRISE_MIN).alias("gunes"), (noon + NOON_MIN).alias("ogle"),
        (noon + shade + AFTERNOON_MIN).alias("ikindi"), (noon + low(0.833) + SUNSET_MIN).alias("aksam"), (noon + low(NIGHT)).alias("yatsi"),
    )
