"""Semantic layer: named metrics by named dimensions over the star schema.

`SemanticModel(ctx).query(metrics, dimensions, where, order_by, limit)`
returns a DataFrame. It resolves names and synonyms, finds the join path from
each metric's fact table to each dimension's table (a direct relationship is
preferred; expense reaches claim-level dimensions through the claims fact),
left-joins from the fact (unmatched fact rows stay, as a NULL group), and
aggregates.

Metrics of two facts in one request are aggregated separately on the shared
dimensions and then full-outer-joined on them ("drill-across"): joining the
facts first would repeat each claim once per expense line and inflate the
claim metrics.

Money metrics are exact DECIMAL(38,2) sums; averages are rounded to 2
places (the model's rule); counts are BIGINT.
"""

from __future__ import annotations

import datetime as dt
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.functions.money import avg_round, round_div


@dataclass(frozen=True)
class LogicalTable:
    name: str
    table: str
    primary_key: str
    synonyms: tuple = ()


@dataclass(frozen=True)
class Relationship:
    from_table: str
    from_column: str
    to_table: str
    to_column: str


@dataclass(frozen=True)
class Dimension:
    name: str
    table: str
    column: str
    synonyms: tuple = ()


@dataclass(frozen=True)
class Metric:
    name: str
    table: str
    kind: str            # "sum" | "count" | "avg"
    expr: str            # column name, or a row-level fact name
    synonyms: tuple = ()


# ---------------------------------------------------------------------------
# FIXED VALUES — the claims semantic model (tables, relationships, row-level
# facts, dimensions, metrics, with their synonyms)
# ---------------------------------------------------------------------------
TABLES = [
    LogicalTable("fact_claims", "FACT_CLAIMS", "CLAIM_KEY", ("claims", "insurance claims")),
    LogicalTable("fact_expense", "FACT_CLAIM_EXPENSE", "EXPENSE_KEY", ("claim expenses", "expenses")),
    LogicalTable("dim_date", "DIM_DATE", "DATE_KEY", ("calendar", "dates")),
    LogicalTable("dim_geography", "DIM_GEOGRAPHY", "GEOGRAPHY_KEY", ("geography", "location")),
    LogicalTable("dim_claim_type", "DIM_CLAIM_TYPE", "CLAIM_TYPE_KEY", ("line of business", "LOB")),
    LogicalTable("dim_loss_cause", "DIM_LOSS_CAUSE", "LOSS_CAUSE_KEY", ("cause of loss", "loss reason")),
    LogicalTable("dim_weather", "DIM_WEATHER_EVENT", "WEATHER_EVENT_KEY", ("catastrophe", "weather event")),
    LogicalTable("dim_policy", "DIM_POLICY", "POLICY_KEY", ("insurance policy", "policy")),
]

RELATIONSHIPS = [
    Relationship("fact_claims", "DATE_KEY", "dim_date", "DATE_KEY"),
    Relationship("fact_claims", "GEOGRAPHY_KEY", "dim_geography", "GEOGRAPHY_KEY"),
    Relationship("fact_claims", "CLAIM_TYPE_KEY", "dim_claim_type", "CLAIM_TYPE_KEY"),
    Relationship("fact_claims", "LOSS_CAUSE_KEY", "dim_loss_cause", "LOSS_CAUSE_KEY"),
    Relationship("fact_claims", "WEATHER_EVENT_KEY", "dim_weather", "WEATHER_EVENT_KEY"),
    Relationship("fact_claims", "POLICY_KEY", "dim_policy", "POLICY_KEY"),
    Relationship("fact_expense", "CLAIM_KEY", "fact_claims", "CLAIM_KEY"),
    Relationship("fact_expense", "DATE_KEY", "dim_date", "DATE_KEY"),
    Relationship("fact_expense", "GEOGRAPHY_KEY", "dim_geography", "GEOGRAPHY_KEY"),
    Relationship("fact_expense", "CLAIM_TYPE_KEY", "dim_claim_type", "CLAIM_TYPE_KEY"),
    Relationship("fact_expense", "LOSS_CAUSE_KEY", "dim_loss_cause", "LOSS_CAUSE_KEY"),
    Relationship("fact_expense", "WEATHER_EVENT_KEY", "dim_weather", "WEATHER_EVENT_KEY"),
    Relationship("fact_expense", "POLICY_KEY", "dim_policy", "POLICY_KEY"),
]

# row-level facts: name -> (table, expression)
ROW_FACTS = {
    "fraud_flag": ("fact_claims", "CASE WHEN FRAUD_INDICATOR THEN 1 ELSE 0 END"),
    "weather_flag": ("fact_claims", "CASE WHEN IS_WEATHER_RELATED THEN 1 ELSE 0 END"),
    "cat_flag": ("fact_claims", "CASE WHEN CAT_INDICATOR THEN 1 ELSE 0 END"),
    "budgeted_total": ("fact_expense", "BUDGETED_LEGAL_FEES + BUDGETED_ADJUSTOR_COSTS + "
                                       "BUDGETED_INVESTIGATION_CHARGES + BUDGETED_ULAE"),
}

DIMENSIONS = [
    Dimension("calendar_year", "dim_date", "YEAR", ("year",)),
    Dimension("calendar_quarter", "dim_date", "QUARTER", ("quarter",)),
    Dimension("calendar_month", "dim_date", "MONTH", ("month number",)),
    Dimension("month_name_dim", "dim_date", "MONTH_NAME", ("month name", "month")),
    Dimension("year_month_period", "dim_date", "YEAR_MONTH", ("year-month", "monthly period")),
    Dimension("year_quarter_period", "dim_date", "YEAR_QUARTER", ("year-quarter", "quarterly period")),
    Dimension("state_name", "dim_geography", "STATE_NAME", ("state",)),
    Dimension("region", "dim_geography", "REGION", ("geographic region", "area")),
    Dimension("city", "dim_geography", "CITY", ("city name",)),
    Dimension("claim_type", "dim_claim_type", "CLAIM_TYPE", ("insurance type", "line of business")),
    Dimension("claim_category", "dim_claim_type", "CLAIM_CATEGORY", ("claim group", "business category")),
    Dimension("loss_cause", "dim_loss_cause", "LOSS_CAUSE", ("cause of loss", "root cause")),
    Dimension("loss_category", "dim_loss_cause", "LOSS_CATEGORY", ("loss type", "cause category")),
    Dimension("is_weather_related", "dim_loss_cause", "IS_WEATHER_RELATED", ("weather related flag",)),
    Dimension("weather_condition_type", "dim_loss_cause", "WEATHER_CONDITION_MAPPING", ("weather type",)),
    Dimension("event_name", "dim_weather", "EVENT_NAME", ("catastrophe name", "weather event name")),
    Dimension("weather_condition", "dim_weather", "WEATHER_CONDITION", ("event type", "weather category")),
    Dimension("event_severity", "dim_weather", "EVENT_SEVERITY_TIER", ("weather severity", "event severity")),
    Dimension("primary_weather_driver_dim", "dim_weather", "PRIMARY_WEATHER_DRIVER", ("weather driver",)),
    Dimension("coverage_type", "dim_policy", "COVERAGE_TYPE", ("coverage", "policy coverage")),
    Dimension("policy_status", "dim_policy", "POLICY_STATUS", ("policy state",)),
    Dimension("claim_status", "fact_claims", "CLAIM_STATUS", ("status",)),
    Dimension("claim_severity", "fact_claims", "CLAIM_SEVERITY", ("severity", "severity level")),
    Dimension("fraud_risk_tier", "fact_claims", "FRAUD_RISK_TIER", ("fraud tier", "fraud risk")),
    Dimension("payment_type", "fact_claims", "PAYMENT_TYPE", ("payment method",)),
    Dimension("expense_category", "fact_expense", "EXPENSE_CATEGORY", ("expense type",)),
]

METRICS = [
    Metric("total_revenue", "fact_claims", "sum", "PAID_AMOUNT", ("total paid", "revenue", "paid amount")),
    Metric("total_incurred_loss", "fact_claims", "sum", "INCURRED_LOSS", ("total incurred", "incurred loss")),
    Metric("reserve_fund", "fact_claims", "sum", "RESERVE_AMOUNT", ("total reserves", "reserve", "reserves")),
    Metric("total_net_incurred", "fact_claims", "sum", "NET_INCURRED", ("net loss", "net incurred")),
    Metric("total_recovery", "fact_claims", "sum", "RECOVERY_AMOUNT", ("recoveries", "total recovered")),
    Metric("claim_count", "fact_claims", "count", "CLAIM_KEY", ("number of claims", "claims count")),
    Metric("avg_claim_amount", "fact_claims", "avg", "PAID_AMOUNT", ("average claim", "average paid")),
    Metric("fraud_claim_count", "fact_claims", "sum", "fraud_flag", ("fraudulent claims", "fraud count")),
    Metric("weather_claim_count", "fact_claims", "sum", "weather_flag", ("weather claims count",)),
    Metric("catastrophe_claim_count", "fact_claims", "sum", "cat_flag", ("cat claims count",)),
    Metric("avg_fraud_score", "fact_claims", "avg", "FRAUD_SCORE", ("average fraud score",)),
    Metric("avg_days_to_close", "fact_claims", "avg", "DAYS_TO_CLOSE", ("average close time", "settlement time")),
    Metric("total_expenses", "fact_expense", "sum", "TOTAL_ACTUAL_EXPENSE", ("total actual expenses",
                                                                            "actual expenses")),
    Metric("total_budget_variance", "fact_expense", "sum", "TOTAL_EXPENSE_VARIANCE", ("budget variance",
                                                                                     "expense variance")),
    Metric("total_budgeted_expense", "fact_expense", "sum", "budgeted_total", ("total budget", "budgeted expenses")),
    Metric("avg_expense_per_claim", "fact_expense", "avg", "TOTAL_ACTUAL_EXPENSE", ("average expense",)),
]


@dataclass(frozen=True)
class Range:
    """A filter value: from `low` to `high`, both included; either may be open."""
    low: object = None
    high: object = None


def condition(c: Column, v) -> Column:
    """A filter on a column: a value, a collection of values, or a Range."""
    if isinstance(v, Range):
        low, high = (F.lit(True) if x is None else test(F.lit(x)) for x, test in ((v.low, c.__ge__), (v.high, c.__le__)))
        return low & high
    return c.isin(*v) if isinstance(v, (list, tuple, set)) else c == v


class AmbiguousName(ValueError):
    pass


@dataclass
class SemanticModel:
    ctx: object
    tables: list = field(default_factory=lambda: list(TABLES))
    relationships: list = field(default_factory=lambda: list(RELATIONSHIPS))
    dimensions: list = field(default_factory=lambda: list(DIMENSIONS))
    metrics: list = field(default_factory=lambda: list(METRICS))

    # -- names ---------------------------------------------------------------
    def _lookup(self, name: str, items: list) -> object:
        key = name.strip().lower()
        exact = [i for i in items if i.name == key]
        if exact:
            return exact[0]
        hits = [i for i in items if key in (s.lower() for s in i.synonyms)]
        if len(hits) > 1:
            raise AmbiguousName(f"{name!r} could mean {[h.name for h in hits]}")
        if not hits:
            raise KeyError(name)
        return hits[0]

    def metric(self, name) -> Metric:
        return name if isinstance(name, Metric) else self._lookup(name, self.metrics)

    def dimension(self, name) -> Dimension:
        return name if isinstance(name, Dimension) else self._lookup(name, self.dimensions)

    def table(self, name: str) -> LogicalTable:
        return next(t for t in self.tables if t.name == name)

    # -- join paths ------------------------------------------------------------
    def join_path(self, src: str, dst: str) -> list[Relationship]:
        """Shortest relationship path src -> dst (direct edges first)."""
        if src == dst:
            return []
        q = deque([(src, [])])
        seen = {src}
        while q:
            node, path = q.popleft()
            for r in self.relationships:
                if r.from_table == node and r.to_table not in seen:
                    p = path + [r]
                    if r.to_table == dst:
                        return p
                    seen.add(r.to_table)
                    q.append((r.to_table, p))
        raise ValueError(f"no relationship path from {src} to {dst}")

    def _df(self, logical: str) -> DataFrame:
        return self.ctx.star.by_name(self.table(logical).table)

    def _source(self, m: Metric) -> Column:
        return F.expr(ROW_FACTS[m.expr][1]) if m.expr in ROW_FACTS else F.col(m.expr)

    def _partials(self, m: Metric) -> list[Column]:
        """Partial aggregates of a metric (exact: integer counts, decimal sums)."""
        src = self._source(m)
        if m.kind == "count":
            return [F.count(src).alias(f"_n_{m.name}")]
        if m.kind == "avg":
            return [F.sum(src).alias(f"_s_{m.name}"), F.count(src).alias(f"_n_{m.name}")]
        return [F.sum(src).alias(f"_s_{m.name}")]

    def _final(self, m: Metric) -> Column:
        if m.kind == "count":
            return F.coalesce(F.sum(f"_n_{m.name}"), F.lit(0)).cast("long")
        if m.kind == "avg":
            return round_div(F.sum(f"_s_{m.name}"), F.sum(f"_n_{m.name}"), 2)
        if m.expr in ROW_FACTS:
            return F.sum(f"_s_{m.name}").cast("long")
        return F.sum(f"_s_{m.name}").cast("decimal(38,2)")

    def _fact_frame(self, fact: str, dims: list[Dimension], metrics: list[Metric],
                    fact_filters: dict) -> DataFrame:
        """The fact pre-aggregated by the foreign keys its dimensions are
        reached through (plus the requested fact-level columns), then joined
        along the relationship paths. Pre-aggregation shrinks the fact to one
        row per key combination before any join, so a dimension too large to
        broadcast only meets the reduced rows; the partial sums and counts
        are exact, so the final metrics are unchanged."""
        base = self._df(fact)
        for d, v in fact_filters.items():
            base = base.where(condition(F.col(d.column), v))
        fks, own = [], []
        for d in dims:
            if d.table == fact:
                own.append(d.column)
            else:
                first = self.join_path(fact, d.table)[0].from_column
                if first not in fks:
                    fks.append(first)
        keys = fks + [c for c in own if c not in fks]
        parts = [p for m in metrics for p in self._partials(m)]
        pre = base.groupBy(*keys).agg(*parts) if keys else base.agg(*parts)
        out = pre.alias(fact)
        joined = {fact}
        for d in dims:
            for r in self.join_path(fact, d.table):
                if r.to_table in joined:
                    continue
                tgt = self._df(r.to_table).alias(r.to_table)
                out = out.join(tgt, F.col(f"{r.from_table}.{r.from_column}") == F.col(f"{r.to_table}.{r.to_column}"),
                               "left")
                joined.add(r.to_table)
        return out

    def query(self, metrics: list, dimensions: list | None = None, where: dict | None = None,
              order_by: list | None = None, limit: int | None = None) -> DataFrame:
        """Metrics by dimensions. `where` maps a dimension (a name, or any
        column as a Dimension) to a value, a collection of values or a Range:
        a span of periods, or amounts over a bound."""
        ms = [self.metric(m) for m in metrics]
        ds = [self.dimension(d) for d in (dimensions or [])]
        filt = {self.dimension(k): v for k, v in (where or {}).items()}
        by_fact: dict[str, list[Metric]] = {}
        for m in ms:
            by_fact.setdefault(m.table, []).append(m)
        parts = []
        for fact, fms in by_fact.items():
            need = ds + [d for d in filt if d not in ds]
            own_filters = {d: v for d, v in filt.items() if d.table == fact}
            frame = self._fact_frame(fact, need, fms, own_filters)
            for d, v in filt.items():
                if d.table == fact:
                    continue
                frame = frame.where(condition(F.col(f"{d.table}.{d.column}"), v))
            keys = [F.col(f"{d.table}.{d.column}").alias(d.name) for d in ds]
            aggs = [self._final(m).alias(m.name) for m in fms]
            parts.append(frame.groupBy(*keys).agg(*aggs) if keys else frame.agg(*aggs))
        out = parts[0]
        names = [d.name for d in ds]
        for p in parts[1:]:
            if not names:
                out = out.crossJoin(p)
                continue
            # rename the right side so the join never has to disambiguate
            # columns of two plans over the same star tables
            r = p.select(*[F.col(c).alias(f"_r_{c}") for c in p.columns])
            cond = None
            for n in names:
                c = F.col(n).eqNullSafe(F.col(f"_r_{n}"))
                cond = c if cond is None else cond & c
            joined = out.join(r, cond, "full")
            out = joined.select(*[F.coalesce(F.col(n), F.col(f"_r_{n}")).alias(n) for n in names],
                                *[F.col(c) for c in out.columns if c not in names],
                                *[F.col(f"_r_{c}").alias(c) for c in p.columns if c not in names])
        out = out.select(*names, *[m.name for m in ms])
        if order_by:
            cols = []
            for o in order_by:
                name, desc = (o[1:], True) if o.startswith("-") else (o, False)
                cols.append(F.col(name).desc() if desc else F.col(name).asc())
            out = out.orderBy(*cols)
        if limit is not None:
            out = out.limit(limit)
        return out


# ---------------------------------------------------------------------------
# Canned questions as named semantic requests
# ---------------------------------------------------------------------------
CANNED = {
    "sq_open_claims": dict(metrics=["claim_count"], where={"claim_status": "Open"}),
    "sq_claims_by_status": dict(metrics=["claim_count"], dimensions=["status"]),
    "sq_paid_by_claim_type": dict(metrics=["total paid"], dimensions=["claim_type"]),
    "sq_paid_vs_reserves_by_severity": dict(metrics=["total_revenue", "reserves"], dimensions=["severity"]),
    "sq_net_incurred": dict(metrics=["net incurred"]),
    "sq_top_loss_causes": dict(metrics=["claim_count"], dimensions=["loss_cause"],
                               order_by=["-claim_count", "loss_cause"], limit=5),
    "sq_days_to_close_by_severity": dict(metrics=["avg_days_to_close"], dimensions=["claim_severity"]),
    "sq_monthly_trend": dict(metrics=["claim_count"], dimensions=["year_month_period"],
                             order_by=["-year_month_period"], limit=12),
    "sq_fraud_claims": dict(metrics=["fraud_claim_count"]),
    "sq_fraud_by_region": dict(metrics=["fraud_claim_count", "claim_count"], dimensions=["region"]),
    "sq_fraud_score_by_tier": dict(metrics=["avg_fraud_score"], dimensions=["fraud_risk_tier"]),
    "sq_fraud_by_loss_cause": dict(metrics=["fraud_claim_count"], dimensions=["loss_cause"],
                                   order_by=["-fraud_claim_count", "loss_cause"], limit=5),
    "sq_weather_claims": dict(metrics=["weather_claim_count"]),
    "sq_claims_by_weather_condition": dict(metrics=["claim_count"], dimensions=["weather_condition"]),
    "sq_cat_events": dict(metrics=["claim_count", "catastrophe_claim_count"], dimensions=["event_name"]),
    "sq_weather_paid_by_region": dict(metrics=["total_revenue"], dimensions=["region"],
                                      where={"is_weather_related": True}),
    "sq_expense_by_category": dict(metrics=["total_expenses", "total_budgeted_expense", "total_budget_variance"],
                                   dimensions=["expense_category"]),
}


#: Columns that questions filter or group by besides the model's dimensions.
PAID = Dimension("paid", "fact_claims", "PAID_AMOUNT")
CLAIM_DATE = Dimension("claim_date", "dim_date", "DATE_KEY")
EVENT_DURATION = Dimension("event_duration_days", "dim_weather", "EVENT_DURATION_DAYS")

CANNED |= {
    "sq_paid_by_quarter_of_year": dict(metrics=["total_revenue", "claim_count"], dimensions=["calendar_year", "calendar_quarter"]),
    "sq_claims_by_month_name": dict(metrics=["claim_count"], dimensions=["calendar_month", "month_name_dim"]),
    "sq_paid_by_state_last_quarters": dict(metrics=["total_revenue", "total_recovery"], dimensions=["state_name", "year_quarter_period"],
                                           where={"year_quarter_period": Range("2000-Q3", "2001-Q2")}),
    "sq_claims_by_city_since": dict(metrics=["claim_count", "avg_claim_amount"], dimensions=["city"],
                                    where={CLAIM_DATE: Range(low=dt.date(1999, 7, 1))}),
    "sq_weather_driver": dict(metrics=["claim_count", "total_incurred_loss"],
                              dimensions=["primary_weather_driver_dim", "event_severity", "weather_condition_type"]),
    "sq_event_duration": dict(metrics=["claim_count", "total_net_incurred"], dimensions=[EVENT_DURATION, "primary_weather_driver_dim"]),
    "sq_policy_coverage": dict(metrics=["claim_count", "reserve_fund"], dimensions=["coverage_type", "policy_status"]),
    "sq_large_payments_by_type": dict(metrics=["claim_count", "total_revenue"], dimensions=["payment_type"],
                                      where={PAID: Range(low=50_000), "calendar_year": Range(1996, 2000)}),
}


def canned(key: str):
    spec = CANNED[key]

    def run(ctx) -> DataFrame:
        return SemanticModel(ctx).query(**spec)
    run.__name__ = key
    return run


def semantic_metrics(ctx) -> DataFrame:
    """All twelve claims metrics over the whole fact."""
    return SemanticModel(ctx).query([m.name for m in METRICS if m.table == "fact_claims"])


def semantic_by_dimension(ctx) -> DataFrame:
    return SemanticModel(ctx).query(["claim_count", "total_revenue", "avg_claim_amount", "avg_fraud_score"],
                                    ["region", "claim_category"])


def semantic_join_path(ctx) -> DataFrame:
    """Expense metrics by claim-level dimensions: the path runs
    expense -> claims (fact to fact) for claim_status, and expense ->
    dim_loss_cause directly for loss_category."""
    return SemanticModel(ctx).query(["total_expenses", "avg_expense_per_claim", "total_budgeted_expense"],
                                    ["claim_status", "loss_category"])


def semantic_drill_across(ctx) -> DataFrame:
    return SemanticModel(ctx).query(["claim_count", "total_revenue", "total_expenses", "total_budget_variance"],
                                    ["region"])


def sq_legal_fees(ctx) -> DataFrame:
    """Ad-hoc metric (not in the model): total legal fees by expense category."""
    legal = Metric("total_legal_fees", "fact_expense", "sum", "ACTUAL_LEGAL_FEES")
    return SemanticModel(ctx).query([legal], ["expense_category"])


def sq_expense_ratio_by_claim_type(ctx) -> DataFrame:
    """Expense ratio = total_expenses / total_incurred_loss per claim type
    (undefined in the original; computed by drill-across)."""
    q = SemanticModel(ctx).query(["total_expenses", "total_incurred_loss"], ["claim_type"])
    return q.select("*", round_div(F.col("total_expenses"), F.col("total_incurred_loss"), 4).alias("expense_ratio"))
