"""90-day weather outlook per claim state.

For every state and each of the next `horizon_days` days from `as_of`:
the latest forecast of the state's proxy city if one exists, otherwise the
day-of-year climatology. Built from

* latest_per_key (forecast reissues: newest issue time wins, forecast id
  breaks ties) — planned as a WindowGroupLimit, so each map task forwards
  only its best row per (city, day);
* a bounded broadcast of the 10-row state → proxy-city map (one city feeds
  several states);
* a day spine × states cross product (horizon × 10 rows — fixed size, so the
  cross join is bounded), joined to climatology on an expression key
  (day-of-year of the spine date);
* an anti join on (state, day) that drops climatology rows where a forecast
  exists, and a UNION ALL of the two sources.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.functions.rules import weather_condition, weather_risk
from lossledger.operators.latest import latest_per_key
from lossledger.sources import reference as ref
from lossledger.sources.weather import MEASURES, PROBABILITIES, climatology, forecast

WEATHER_AS_OF = dt.date(2024, 1, 1)
HORIZON_DAYS = 90

OUTLOOK_COLUMNS = ["CLAIM_STATE", "STATE_NAME", "SOURCE_CITY", "FORECAST_DATE", "LATITUDE_DEG", "LONGITUDE_DEG",
                   "ZIP_CODE", *MEASURES, *PROBABILITIES,
                   "DATA_SOURCE", "WEATHER_CONDITION", "WEATHER_RISK_LEVEL"]


def latest_forecast(ctx, as_of: dt.date = WEATHER_AS_OF, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    f = forecast(ctx).where((F.col("COUNTRY_CODE") == "US")
                            & F.col("DATE_VALID_STD").between(F.lit(as_of), F.date_add(F.lit(as_of),
                                                                                       horizon_days - 1)))
    return latest_per_key(f, ["CITY_NAME", "DATE_VALID_STD"], ["TIME_INIT_UTC", "FORECAST_ID"])


def _classify(df: DataFrame, with_severe_wind: bool) -> DataFrame:
    snow, wind, precip = F.col("TOT_SNOWFALL_IN"), F.col("MAX_WIND_SPEED_MPH"), F.col("TOT_PRECIPITATION_IN")
    return df.select("*", weather_condition(snow, wind, precip, with_severe_wind).alias("WEATHER_CONDITION"),
                     weather_risk(snow, wind, precip).alias("WEATHER_RISK_LEVEL"))


def weather_outlook(ctx, as_of: dt.date = WEATHER_AS_OF, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    spark = ctx.spark
    cities = F.broadcast(ref.weather_state_cities(spark))
    fl = latest_forecast(ctx, as_of, horizon_days)
    fc = fl.join(cities, fl.CITY_NAME == cities.PROXY_CITY)
    fc = fc.select(
        "CLAIM_STATE", "STATE_NAME", F.col("CITY_NAME").alias("SOURCE_CITY"),
        F.col("DATE_VALID_STD").alias("FORECAST_DATE"), F.col("LATITUDE").alias("LATITUDE_DEG"),
        F.col("LONGITUDE").alias("LONGITUDE_DEG"), "ZIP_CODE", *MEASURES, *PROBABILITIES,
        F.lit("FORECAST").alias("DATA_SOURCE"))
    forecast_rows = _classify(fc, with_severe_wind=True)

    spine = spark.range(horizon_days).select(F.date_add(F.lit(as_of), F.col("id").cast("int")).alias("FORECAST_DATE"))
    grid = spine.crossJoin(cities)  # horizon_days x 10 rows, fixed size
    clim = climatology(ctx).where(F.col("COUNTRY_CODE") == "US")
    cj = grid.join(clim, (clim.CITY_NAME == grid.PROXY_CITY) & (clim.DOY_STD == F.dayofyear(grid.FORECAST_DATE)))
    have = forecast_rows.select(F.col("CLAIM_STATE").alias("_S"), F.col("FORECAST_DATE").alias("_D"))
    cj = cj.join(have, (cj.CLAIM_STATE == have._S) & (cj.FORECAST_DATE == have._D), "left_anti")
    cl = cj.select(
        "CLAIM_STATE", "STATE_NAME", F.col("CITY_NAME").alias("SOURCE_CITY"), "FORECAST_DATE",
        F.col("LATITUDE").alias("LATITUDE_DEG"), F.col("LONGITUDE").alias("LONGITUDE_DEG"), "ZIP_CODE", *MEASURES, *PROBABILITIES,
        F.lit("CLIMATOLOGY").alias("DATA_SOURCE"))
    clim_rows = _classify(cl, with_severe_wind=False)
    return forecast_rows.unionByName(clim_rows).select(*OUTLOOK_COLUMNS)


def forecast_latest(ctx) -> DataFrame:
    """Latest forecast per (city, day) inside the outlook window (W-2)."""
    return latest_forecast(ctx).select("CITY_NAME", "DATE_VALID_STD", "TIME_INIT_UTC", "FORECAST_ID", *MEASURES)


def climatology_table(ctx) -> DataFrame:
    return climatology(ctx)
