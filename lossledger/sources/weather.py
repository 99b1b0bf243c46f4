"""Weather inputs derived from the driver's `events` table.

`forecast`: one row per event, a point forecast for a city and a valid day,
issued at the event time. `climatology`: per (city, day of year) averages of
the same measures over all events (the long-run normal used where no
forecast exists). The events span few days, so an event stands for the day of
the year that its ten-minute slot falls on when slots are counted around the
year: normals then cover all days, forecasts only the events' own. Both grow
with the events table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.functions.pick import pick
from lossledger.sources.reference import FORECAST_CITIES

MEASURES = ["MIN_TEMPERATURE_AIR_2M_F", "AVG_TEMPERATURE_AIR_2M_F", "MAX_TEMPERATURE_AIR_2M_F",
            "MIN_HUMIDITY_RELATIVE_2M_PCT", "AVG_HUMIDITY_RELATIVE_2M_PCT", "MAX_HUMIDITY_RELATIVE_2M_PCT",
            "AVG_PRESSURE_MEAN_SEA_LEVEL_MB", "MAX_WIND_SPEED_MPH", "AVG_WIND_SPEED_MPH", "WIND_DIRECTION_DEG",
            "TOT_PRECIPITATION_IN", "TOT_SNOWFALL_IN", "AVG_CLOUD_COVER_TOT_PCT"]
PROBABILITIES = ["PROBABILITY_OF_PRECIPITATION_PCT", "PROBABILITY_OF_SNOW_PCT"]
SLOT_SECONDS, DAYS_OF_YEAR = 600, 366


def _wrap(v, m):
    """v modulo m for doubles, as v - m * floor(v / m)."""
    return v - F.floor(v / m) * m


def forecast(ctx) -> DataFrame:
    def build():
        e = ctx.table("events").select("event_id", "ts", "user_id", "value")
        v = F.col("value")
        wind = _wrap(v, 70)
        temp = 40 + _wrap(v, 60)
        precip = F.greatest(_wrap(v, 5) - 2.5, F.lit(0.0))
        snow = F.greatest(_wrap(v, 10) - 8, F.lit(0.0))
        return e.select(
            pick(FORECAST_CITIES, F.col("user_id") % 3).alias("CITY_NAME"),
            F.lit("US").alias("COUNTRY_CODE"),
            F.to_date("ts").alias("DATE_VALID_STD"),
            F.col("ts").alias("TIME_INIT_UTC"),
            F.col("event_id").alias("FORECAST_ID"),
            (temp - 10).alias("MIN_TEMPERATURE_AIR_2M_F"),
            temp.alias("AVG_TEMPERATURE_AIR_2M_F"),
            (temp + 10).alias("MAX_TEMPERATURE_AIR_2M_F"),
            F.greatest(_wrap(v, 100) - 15, F.lit(0.0)).alias("MIN_HUMIDITY_RELATIVE_2M_PCT"),
            _wrap(v, 100).alias("AVG_HUMIDITY_RELATIVE_2M_PCT"),
            F.least(_wrap(v, 100) + 15, F.lit(100.0)).alias("MAX_HUMIDITY_RELATIVE_2M_PCT"),
            (990 + _wrap(v, 45)).alias("AVG_PRESSURE_MEAN_SEA_LEVEL_MB"),
            wind.alias("MAX_WIND_SPEED_MPH"),
            (wind / 2).alias("AVG_WIND_SPEED_MPH"),
            _wrap(v * 7, 360).alias("WIND_DIRECTION_DEG"),
            precip.alias("TOT_PRECIPITATION_IN"),
            snow.alias("TOT_SNOWFALL_IN"),
            _wrap(v * 3, 100).alias("AVG_CLOUD_COVER_TOT_PCT"),
            F.when(precip > 0, 50 + _wrap(v, 50)).otherwise(_wrap(v, 30)).alias("PROBABILITY_OF_PRECIPITATION_PCT"),
            F.when(snow > 0, 50 + _wrap(v, 40)).otherwise(_wrap(v, 20)).alias("PROBABILITY_OF_SNOW_PCT"),
        )
    return ctx.memo(("weather", "forecast"), build)


def climatology(ctx) -> DataFrame:
    """Per (city, day of year): mean of each measure (rounded to 6 places),
    rain and snow over the days that have any, the wind's direction as the
    mean vector, and how often (%) there is rain or snow. Partial
    aggregation runs before the shuffle, so a hot city costs no skew."""
    def build():
        slot = F.floor(F.unix_timestamp("TIME_INIT_UTC") / SLOT_SECONDS)
        f = forecast(ctx).withColumn("DOY_STD", (F.pmod(slot, F.lit(DAYS_OF_YEAR)) + 1).cast("int"))

        def mean(m):
            if m.startswith("TOT_"):
                return F.round(F.coalesce(F.avg(F.when(F.col(m) > 0, F.col(m))), F.lit(0.0)), 6)
            if m == "WIND_DIRECTION_DEG":
                turn = F.degrees(F.atan2(F.avg(F.sin(F.radians(m))), F.avg(F.cos(F.radians(m)))))
                return F.round(F.when(turn < 0, turn + 360).otherwise(turn), 4)
            return F.round(F.avg(m), 6)
        aggs = [mean(m).alias(m) for m in MEASURES]
        aggs += [F.round(F.avg(F.when(F.col(m) > 0, 100.0).otherwise(0.0)), 6).alias(p)
                 for m, p in zip(["TOT_PRECIPITATION_IN", "TOT_SNOWFALL_IN"], PROBABILITIES)]
        return f.groupBy("CITY_NAME", "COUNTRY_CODE", "DOY_STD").agg(*aggs)
    return ctx.memo(("weather", "climatology"), build)
