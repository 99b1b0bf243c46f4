"""Business classification ladders as single CASE expressions.

Threshold constants are fixed values of the claims model (stated here once);
each ladder is an ordered `F.when` chain evaluated top to bottom.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lossledger.functions.pick import pick
from lossledger.sources.reference import SEVERITIES, STATUS_BANDS

# FIXED VALUES — fraud tier thresholds
FRAUD_SCORE_RULE = {"high": 60, "medium": 30}
FRAUD_INDICATOR_RULE = {"high": 80, "medium": 50}
# FIXED VALUES — catastrophe event severity tiers (industry loss)
EVENT_TIER_DEFAULT_CATASTROPHIC = 25_000_000_000
EVENT_TIER_SEVERE = 10_000_000_000
EVENT_TIER_MAJOR = 5_000_000_000


def fraud_risk_tier(score: Column, indicator: Column | None = None, rule: str = "score") -> Column:
    """Fraud tier. rule="score": score only (>=60 High, >=30 Medium, else No
    Flag). rule="indicator": flagged claims only (>=80 High, >=50 Medium,
    flagged otherwise Low; unflagged No Flag). A NULL score is No Flag."""
    if rule == "score":
        return (F.when(score >= FRAUD_SCORE_RULE["high"], "High Risk")
                .when(score >= FRAUD_SCORE_RULE["medium"], "Medium Risk")
                .otherwise("No Flag"))
    if rule == "indicator":
        flagged = F.coalesce(indicator, F.lit(False))
        return (F.when(flagged & (score >= FRAUD_INDICATOR_RULE["high"]), "High Risk")
                .when(flagged & (score >= FRAUD_INDICATOR_RULE["medium"]), "Medium Risk")
                .when(flagged, "Low Risk")
                .otherwise("No Flag"))
    raise ValueError(f"unknown fraud rule {rule!r}")


def fraud_score_bucket(score: Column) -> Column:
    """Ten fixed-width labels '0-9' … '80-89', top bucket '90-100'. A NULL
    score gets 'Unknown' instead of silently landing in the top bucket."""
    lower = (F.floor(score / 10) * 10).cast("int")
    label = F.concat(lower.cast("string"), F.lit("-"), (lower + 9).cast("string"))
    return (F.when(score.isNull(), "Unknown")
            .when(score >= 90, "90-100")
            .when(score < 10, "0-9")
            .otherwise(label))


def status_from_band(k: Column) -> Column:
    """Claim status from `k % 100` bands."""
    r = k % 100
    expr = None
    for upper, status in STATUS_BANDS:
        expr = F.when(r < upper, status) if expr is None else expr.when(r < upper, status)
    return expr


def severity_rank(sev: Column) -> Column:
    """Ordinal risk order Minor=1 … Catastrophic=5 (NULL otherwise)."""
    expr = None
    for i, s in enumerate(SEVERITIES, start=1):
        expr = F.when(sev == s, i) if expr is None else expr.when(sev == s, i)
    return expr


def primary_weather_driver(event_type: Column) -> Column:
    return (F.when(event_type.isin("Hurricane"), "Wind/Rain")
            .when(event_type.isin("Wildfire"), "Heat/Fire")
            .when(event_type.isin("Winter Storm", "Ice Storm"), "Snow/Ice")
            .when(event_type.isin("Tornado", "Derecho"), "Wind/Hail")
            .when(event_type.isin("Flood"), "Rain/Flood")
            .when(event_type.isin("Severe Storm", "Hailstorm"), "Wind/Hail")
            .otherwise("Multiple"))


def event_severity_tier(loss: Column, catastrophic: int = EVENT_TIER_DEFAULT_CATASTROPHIC) -> Column:
    return (F.when(loss >= catastrophic, "Catastrophic")
            .when(loss >= EVENT_TIER_SEVERE, "Severe")
            .when(loss >= EVENT_TIER_MAJOR, "Major")
            .otherwise("Moderate"))


def weather_condition(snow: Column, wind: Column, precip: Column, with_severe_wind: bool = True) -> Column:
    """Eight-step condition ladder; the climatology variant has no Severe
    Wind step."""
    expr = (F.when((snow > 0) & (wind >= 35), "Blizzard")
            .when(precip >= 2.0, "Heavy Rain"))
    if with_severe_wind:
        expr = expr.when(wind >= 58, "Severe Wind")
    return (expr.when(wind >= 40, "High Wind")
            .when(precip >= 0.5, "Moderate Rain")
            .when(snow > 0, "Snow")
            .when(precip > 0, "Light Rain")
            .otherwise("Clear/Dry"))


def weather_risk(snow: Column, wind: Column, precip: Column) -> Column:
    return (F.when(wind >= 58, "High")
            .when(precip >= 2.0, "High")
            .when((wind >= 40) | (snow >= 6), "Medium")
            .when((precip >= 0.5) | (snow > 0), "Low")
            .otherwise("None"))
