"""Oracle SQL for the weather outlook and its inputs."""

from __future__ import annotations

from lossledger.functions.pick import pick_sql, sql_values
from lossledger.plans.outlook import HORIZON_DAYS, WEATHER_AS_OF
from lossledger.sources.weather import DAYS_OF_YEAR, MEASURES, SLOT_SECONDS
from lossledger.sources import reference as ref

W_AS_OF = f"DATE '{WEATHER_AS_OF.isoformat()}'"


def _wrap(v, m):
    return f"({v} - floor({v} / {m}) * {m})"


PRECIP = f"greatest({_wrap('value', 5)} - CAST(2.5 AS DOUBLE), CAST(0 AS DOUBLE))"
SNOW = f"greatest({_wrap('value', 10)} - 8, CAST(0 AS DOUBLE))"
FORECAST = f"""
SELECT {pick_sql(ref.FORECAST_CITIES, 'user_id % 3')} AS CITY_NAME, 'US' AS COUNTRY_CODE,
  CAST(ts AS DATE) AS DATE_VALID_STD, ts AS TIME_INIT_UTC, event_id AS FORECAST_ID,
  40 + {_wrap('value', 60)} - 10 AS MIN_TEMPERATURE_AIR_2M_F,
  40 + {_wrap('value', 60)} AS AVG_TEMPERATURE_AIR_2M_F,
  40 + {_wrap('value', 60)} + 10 AS MAX_TEMPERATURE_AIR_2M_F,
  greatest({_wrap('value', 100)} - 15, 0.0) AS MIN_HUMIDITY_RELATIVE_2M_PCT,
  {_wrap('value', 100)} AS AVG_HUMIDITY_RELATIVE_2M_PCT,
  least({_wrap('value', 100)} + 15, 100.0) AS MAX_HUMIDITY_RELATIVE_2M_PCT,
  990 + {_wrap('value', 45)} AS AVG_PRESSURE_MEAN_SEA_LEVEL_MB,
  {_wrap('value', 70)} AS MAX_WIND_SPEED_MPH,
  {_wrap('value', 70)} / 2 AS AVG_WIND_SPEED_MPH,
  {_wrap('(value * 7)', 360)} AS WIND_DIRECTION_DEG,
  {PRECIP} AS TOT_PRECIPITATION_IN,
  {SNOW} AS TOT_SNOWFALL_IN,
  {_wrap('(value * 3)', 100)} AS AVG_CLOUD_COVER_TOT_PCT,
  CASE WHEN {PRECIP} > 0 THEN 50 + {_wrap('value', 50)} ELSE {_wrap('value', 30)} END AS PROBABILITY_OF_PRECIPITATION_PCT,
  CASE WHEN {SNOW} > 0 THEN 50 + {_wrap('value', 40)} ELSE {_wrap('value', 20)} END AS PROBABILITY_OF_SNOW_PCT
FROM events"""

TURN = "degrees(atan2(AVG(sin(radians(WIND_DIRECTION_DEG))), AVG(cos(radians(WIND_DIRECTION_DEG)))))"
DOY = f"(CAST(floor(epoch(TIME_INIT_UTC)) AS BIGINT) // {SLOT_SECONDS}) % {DAYS_OF_YEAR} + 1"


def _mean(m: str) -> str:
    if m.startswith("TOT_"):
        return f"ROUND(COALESCE(AVG({m}) FILTER ({m} > 0), 0), 6)"
    if m == "WIND_DIRECTION_DEG":
        return f"ROUND(CASE WHEN {TURN} < 0 THEN {TURN} + 360 ELSE {TURN} END, 4)"
    return f"ROUND(AVG({m}), 6)"


CLIMATOLOGY = (f"SELECT CITY_NAME, COUNTRY_CODE, CAST({DOY} AS INTEGER) AS DOY_STD, "
               + ", ".join(f"{_mean(m)} AS {m}" for m in MEASURES)
               + ", ROUND(AVG(CASE WHEN TOT_PRECIPITATION_IN > 0 THEN 100.0 ELSE 0.0 END), 6) "
                 "AS PROBABILITY_OF_PRECIPITATION_PCT"
               + ", ROUND(AVG(CASE WHEN TOT_SNOWFALL_IN > 0 THEN 100.0 ELSE 0.0 END), 6) AS PROBABILITY_OF_SNOW_PCT"
               + f" FROM w_forecast GROUP BY CITY_NAME, COUNTRY_CODE, {DOY}")

LATEST = f"""
SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY CITY_NAME, DATE_VALID_STD
                               ORDER BY TIME_INIT_UTC DESC NULLS LAST, FORECAST_ID DESC NULLS LAST) AS RN
  FROM w_forecast
  WHERE COUNTRY_CODE = 'US'
    AND DATE_VALID_STD BETWEEN {W_AS_OF} AND CAST({W_AS_OF} + {HORIZON_DAYS - 1} AS DATE))
WHERE RN = 1"""

CITY_MAP = ("SELECT CLAIM_STATE, STATE_NAME, PROXY_CITY, CAST(LAT AS DOUBLE) AS LATITUDE, "
            "CAST(LON AS DOUBLE) AS LONGITUDE, ZIP_CODE FROM (VALUES " + sql_values(ref.WEATHER_STATE_CITIES) +
            ") AS t(CLAIM_STATE, STATE_NAME, PROXY_CITY, LAT, LON, ZIP_CODE)")


def _cond(with_severe: bool) -> str:
    sev = "WHEN MAX_WIND_SPEED_MPH >= 58 THEN 'Severe Wind' " if with_severe else ""
    return ("CASE WHEN TOT_SNOWFALL_IN > 0 AND MAX_WIND_SPEED_MPH >= 35 THEN 'Blizzard' "
            "WHEN TOT_PRECIPITATION_IN >= 2.0 THEN 'Heavy Rain' " + sev +
            "WHEN MAX_WIND_SPEED_MPH >= 40 THEN 'High Wind' WHEN TOT_PRECIPITATION_IN >= 0.5 THEN 'Moderate Rain' "
            "WHEN TOT_SNOWFALL_IN > 0 THEN 'Snow' WHEN TOT_PRECIPITATION_IN > 0 THEN 'Light Rain' "
            "ELSE 'Clear/Dry' END")


RISK = ("CASE WHEN MAX_WIND_SPEED_MPH >= 58 THEN 'High' WHEN TOT_PRECIPITATION_IN >= 2.0 THEN 'High' "
        "WHEN MAX_WIND_SPEED_MPH >= 40 OR TOT_SNOWFALL_IN >= 6 THEN 'Medium' "
        "WHEN TOT_PRECIPITATION_IN >= 0.5 OR TOT_SNOWFALL_IN > 0 THEN 'Low' ELSE 'None' END")

M = ", ".join(MEASURES)

FORECAST_ROWS = f"""
SELECT m.CLAIM_STATE, m.STATE_NAME, f.CITY_NAME AS SOURCE_CITY, f.DATE_VALID_STD AS FORECAST_DATE,
  m.LATITUDE AS LATITUDE_DEG, m.LONGITUDE AS LONGITUDE_DEG, m.ZIP_CODE, {', '.join('f.' + x for x in MEASURES)},
  f.PROBABILITY_OF_PRECIPITATION_PCT, f.PROBABILITY_OF_SNOW_PCT,
  'FORECAST' AS DATA_SOURCE
FROM w_latest f JOIN w_cities m ON f.CITY_NAME = m.PROXY_CITY"""

CLIM_ROWS = f"""
SELECT m.CLAIM_STATE, m.STATE_NAME, c.CITY_NAME AS SOURCE_CITY, s.FORECAST_DATE,
  m.LATITUDE AS LATITUDE_DEG, m.LONGITUDE AS LONGITUDE_DEG, m.ZIP_CODE, {', '.join('c.' + x for x in MEASURES)},
  c.PROBABILITY_OF_PRECIPITATION_PCT, c.PROBABILITY_OF_SNOW_PCT, 'CLIMATOLOGY' AS DATA_SOURCE
FROM (SELECT CAST({W_AS_OF} + CAST(i AS INTEGER) AS DATE) AS FORECAST_DATE FROM range({HORIZON_DAYS}) t(i)) s
CROSS JOIN w_cities m
JOIN w_climatology c ON c.CITY_NAME = m.PROXY_CITY AND c.DOY_STD = dayofyear(s.FORECAST_DATE)
  AND c.COUNTRY_CODE = 'US'
WHERE NOT EXISTS (SELECT 1 FROM w_frows fd WHERE fd.CLAIM_STATE = m.CLAIM_STATE
                  AND fd.FORECAST_DATE = s.FORECAST_DATE)"""

CTES = [("w_forecast", FORECAST), ("w_climatology", CLIMATOLOGY), ("w_latest", LATEST), ("w_cities", CITY_MAP),
        ("w_frows", FORECAST_ROWS), ("w_crows", CLIM_ROWS)]


def _with(select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s}\n)" for n, s in CTES) + "\n" + select


OUTLOOK_COLS = ("CLAIM_STATE, STATE_NAME, SOURCE_CITY, FORECAST_DATE, LATITUDE_DEG, LONGITUDE_DEG, ZIP_CODE, "
                f"{M}, PROBABILITY_OF_PRECIPITATION_PCT, PROBABILITY_OF_SNOW_PCT, DATA_SOURCE")

WEATHER = {
    "weather_outlook": _with(f"""
SELECT {OUTLOOK_COLS}, {_cond(True)} AS WEATHER_CONDITION, {RISK} AS WEATHER_RISK_LEVEL FROM w_frows
UNION ALL
SELECT {OUTLOOK_COLS}, {_cond(False)} AS WEATHER_CONDITION, {RISK} AS WEATHER_RISK_LEVEL FROM w_crows"""),
    "forecast_latest": _with(f"SELECT CITY_NAME, DATE_VALID_STD, TIME_INIT_UTC, FORECAST_ID, {M} FROM w_latest"),
    "climatology": _with("SELECT * FROM w_climatology"),
}
