"""Oracle SQL for semantic-layer requests, written per request shape:
fact LEFT JOIN the dimension tables it needs, filter, group, aggregate;
two facts are aggregated separately and full-outer-joined on the
dimensions."""

from __future__ import annotations

import datetime as dt

from lossledger.oracle.base import avg_sql, round_div_sql, with_base
from lossledger.plans import semantic as S

CTE = {"fact_claims": "fact_claims", "fact_expense": "fact_expense", "dim_date": "dim_date",
       "dim_geography": "dim_geography", "dim_claim_type": "dim_claim_type", "dim_loss_cause": "dim_loss_cause",
       "dim_weather": "dim_weather_event", "dim_policy": "dim_policy"}
KEY = {"dim_date": "DATE_KEY", "dim_geography": "GEOGRAPHY_KEY", "dim_claim_type": "CLAIM_TYPE_KEY",
       "dim_loss_cause": "LOSS_CAUSE_KEY", "dim_weather": "WEATHER_EVENT_KEY", "dim_policy": "POLICY_KEY",
       "fact_claims": "CLAIM_KEY"}


def _lit(v):
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, str):
        return "'" + v + "'"
    return str(v)


def _condition(c: str, v) -> str:
    if isinstance(v, S.Range):
        bounds = [f"{c} >= {_lit(v.low)}"] * (v.low is not None) + [f"{c} <= {_lit(v.high)}"] * (v.high is not None)
        return " AND ".join(bounds) or "TRUE"
    return f"{c} IN ({', '.join(_lit(x) for x in v)})" if isinstance(v, (list, tuple, set)) else f"{c} = {_lit(v)}"


def _metric_sql(m) -> str:
    if m.expr in S.ROW_FACTS:
        src = S.ROW_FACTS[m.expr][1]
        return f"CAST(SUM({src}) AS BIGINT)"
    if m.kind == "count":
        return f"COUNT({m.expr})"
    if m.kind == "avg":
        scale = 0 if m.expr == "DAYS_TO_CLOSE" else 2
        return avg_sql(m.expr, 2, scale)
    return f"CAST(SUM({m.expr}) AS DECIMAL(38,2))"


def _part(fact, metrics, dims, where) -> str:
    joins, seen = [], {fact}
    for d in list(dims) + list(where):
        t = d.table
        if t in seen:
            continue
        seen.add(t)
        joins.append(f"LEFT JOIN {CTE[t]} {t} ON {fact}.{KEY[t]} = {t}.{KEY[t]}")
    conds = []
    for d, v in where.items():
        conds.append(_condition(f"{d.table}.{d.column}", v))
    sel = [f"{d.table}.{d.column} AS {d.name}" for d in dims] + [f"{_metric_sql(m)} AS {m.name}" for m in metrics]
    sql = f"SELECT {', '.join(sel)} FROM {CTE[fact]} {fact} " + " ".join(joins)
    if conds:
        sql += " WHERE " + " AND ".join(conds)
    if dims:
        sql += " GROUP BY " + ", ".join(f"{d.table}.{d.column}" for d in dims)
    return sql


def semantic_sql(metrics, dimensions=None, where=None, order_by=None, limit=None, extra_metrics=None) -> str:
    model = S.SemanticModel(None)
    ms = [model.metric(m) for m in metrics]
    ds = [model.dimension(d) for d in (dimensions or [])]
    wh = {model.dimension(k): v for k, v in (where or {}).items()}
    facts = []
    for m in ms:
        if m.table not in facts:
            facts.append(m.table)
    parts = [(f, _part(f, [m for m in ms if m.table == f], ds, wh)) for f in facts]
    names = [d.name for d in ds]
    if len(parts) == 1:
        body = parts[0][1]
    else:
        a, b = parts[0][1], parts[1][1]
        if names:
            on = " AND ".join(f"a.{n} IS NOT DISTINCT FROM b.{n}" for n in names)
            keys = ", ".join(f"COALESCE(a.{n}, b.{n}) AS {n}" for n in names)
            body = f"SELECT {keys}, a.* EXCLUDE ({', '.join(names)}), b.* EXCLUDE ({', '.join(names)}) " \
                   f"FROM ({a}) a FULL OUTER JOIN ({b}) b ON {on}"
        else:
            body = f"SELECT * FROM ({a}) a CROSS JOIN ({b}) b"
    sql = f"SELECT {', '.join(names + [m.name for m in ms])} FROM ({body}) q"
    if order_by:
        sql += " ORDER BY " + ", ".join(f"{o[1:]} DESC" if o.startswith("-") else f"{o} ASC" for o in order_by)
    if limit is not None:
        sql += f" LIMIT {limit}"
    return with_base(sql)


SEMANTIC: dict[str, str] = {k: semantic_sql(**spec) for k, spec in S.CANNED.items()}
SEMANTIC["semantic_metrics"] = semantic_sql([m.name for m in S.METRICS if m.table == "fact_claims"])
SEMANTIC["semantic_by_dimension"] = semantic_sql(["claim_count", "total_revenue", "avg_claim_amount",
                                                  "avg_fraud_score"], ["region", "claim_category"])
SEMANTIC["semantic_join_path"] = semantic_sql(["total_expenses", "avg_expense_per_claim", "total_budgeted_expense"],
                                              ["claim_status", "loss_category"])
SEMANTIC["semantic_drill_across"] = semantic_sql(["claim_count", "total_revenue", "total_expenses",
                                                  "total_budget_variance"], ["region"])
SEMANTIC["sq_legal_fees"] = with_base("""
SELECT EXPENSE_CATEGORY AS expense_category, CAST(SUM(ACTUAL_LEGAL_FEES) AS DECIMAL(38,2)) AS total_legal_fees
FROM fact_expense GROUP BY EXPENSE_CATEGORY""")
_ratio_inner = semantic_sql(["total_expenses", "total_incurred_loss"], ["claim_type"])
_w = _ratio_inner.rindex("SELECT claim_type, total_expenses, total_incurred_loss FROM (")
SEMANTIC["sq_expense_ratio_by_claim_type"] = (
    _ratio_inner[:_w] + "SELECT *, " + round_div_sql("total_expenses", "total_incurred_loss", 4, 2, 2)
    + " AS expense_ratio FROM (" + _ratio_inner[_w:] + ")")
