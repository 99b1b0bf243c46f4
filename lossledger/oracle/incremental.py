"""Oracle SQL for the change-feed queries: the same feed rules in SQL, the
net change per key by ROW_NUMBER, and each MERGE as "unchanged target rows
UNION ALL rebuilt changed rows" (every non-key column refreshed on match)."""

from __future__ import annotations

from lossledger.oracle.base import AS_OF, star_ctes, with_base

_STAR = dict(star_ctes())


def _ch(src: str, where: str, action: str, key: str, step: int, replace: str = "") -> str:
    rep = f" REPLACE ({replace})" if replace else ""
    return f"SELECT *{rep}, '{action}' AS action, CAST({key} * 10 + {step} AS BIGINT) AS seq FROM {src} WHERE {where}"


CLAIM_FEED = "\nUNION ALL\n".join([
    _ch("r_claims", "CLAIM_STATUS = 'Open'", "DELETE", "CLAIM_ID", 0),
    _ch("r_claims", "CLAIM_STATUS = 'Open'", "INSERT", "CLAIM_ID", 1,
        f"'Closed' AS CLAIM_STATUS, {AS_OF} AS CLOSE_DATE, {AS_OF} AS LAST_ACTIVITY_DATE"),
    _ch("r_claims", "CLAIM_STATUS = 'Stalled'", "DELETE", "CLAIM_ID", 0),
    _ch("r_claims", "CLAIM_STATUS = 'Stalled'", "INSERT", "CLAIM_ID", 1, "'Negotiation' AS CLAIM_STAGE"),
    _ch("r_claims", "CLAIM_STATUS = 'Stalled'", "DELETE", "CLAIM_ID", 2, "'Negotiation' AS CLAIM_STAGE"),
    _ch("r_claims", "CLAIM_STATUS = 'Stalled'", "INSERT", "CLAIM_ID", 3, "'Settlement Review' AS CLAIM_STAGE"),
    _ch("r_claims", "CLAIM_STATUS = 'Pending Review'", "DELETE", "CLAIM_ID", 0),
    _ch("r_claims", "CLAIM_STATUS = 'Pending Review'", "INSERT", "CLAIM_ID", 1,
        "CAST(NULL AS VARCHAR) AS CLAIM_STAGE"),
    _ch("r_claims", "CLAIM_STATUS = 'Rejected'", "DELETE", "CLAIM_ID", 0),
])

EXPENSE_FEED = "\nUNION ALL\n".join([
    _ch("r_expense", "EXPENSE_CATEGORY = 'Legal'", "DELETE", "EXPENSE_ID", 0),
    _ch("r_expense", "EXPENSE_CATEGORY = 'Legal'", "INSERT", "EXPENSE_ID", 1,
        "CAST(LEGAL_FEES + 250 AS DECIMAL(12,2)) AS LEGAL_FEES"),
])

POLICY_FEED = "\nUNION ALL\n".join([
    _ch("r_policy", "POLICY_STATUS = 'Cancelled'", "DELETE", "POLICY_ID", 0),
    _ch("r_policy", "POLICY_STATUS = 'Cancelled'", "INSERT", "POLICY_ID", 1,
        "'Active' AS POLICY_STATUS, CAST(PREMIUM + 100 AS DECIMAL(10,2)) AS PREMIUM"),
])


def _net(feed: str, key: str) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY seq DESC) AS rn "
            f"FROM {feed} WHERE action = 'INSERT') WHERE rn = 1")


INC: dict[str, str] = {}
INC["cdc_net_changes"] = with_base("SELECT * FROM c_net", [("c_feed", CLAIM_FEED), ("c_net", _net("c_feed", "CLAIM_ID"))])

_changed_fact = _STAR["fact_claims"].replace("FROM r_claims c\n", "FROM c_net c\n")
assert _changed_fact != _STAR["fact_claims"]
INC["merge_fact_claims"] = with_base(
    "SELECT * FROM fact_claims WHERE CLAIM_KEY NOT IN (SELECT CLAIM_KEY FROM c_fact)\nUNION ALL\n"
    "SELECT * FROM c_fact",
    [("c_feed", CLAIM_FEED), ("c_net", _net("c_feed", "CLAIM_ID")), ("c_fact", _changed_fact)])

_changed_exp = _STAR["fact_expense"].replace("FROM r_expense e JOIN", "FROM e_net e JOIN")
assert _changed_exp != _STAR["fact_expense"]
INC["merge_fact_expense"] = with_base(
    "SELECT * FROM fact_expense WHERE EXPENSE_KEY NOT IN (SELECT EXPENSE_KEY FROM e_fact)\nUNION ALL\n"
    "SELECT * FROM e_fact",
    [("e_feed", EXPENSE_FEED), ("e_net", _net("e_feed", "EXPENSE_ID")), ("e_fact", _changed_exp)])

_changed_pol = _STAR["dim_policy"].replace("FROM r_policy p LEFT JOIN", "FROM p_net p LEFT JOIN")
assert _changed_pol != _STAR["dim_policy"]
INC["merge_dim_policy"] = with_base(
    "SELECT * FROM dim_policy WHERE POLICY_KEY NOT IN (SELECT POLICY_KEY FROM p_dim)\nUNION ALL\n"
    "SELECT * FROM p_dim",
    [("p_feed", POLICY_FEED), ("p_net", _net("p_feed", "POLICY_ID")), ("p_dim", _changed_pol)])


FIN_FEED = "\nUNION ALL\n".join([
    _ch("r_financial", "CLAIM_ID IN (SELECT CLAIM_ID FROM r_claims WHERE CLAIM_STATUS = 'Approved')", "DELETE",
        "FINANCIAL_ID", 0),
    _ch("r_financial", "CLAIM_ID IN (SELECT CLAIM_ID FROM r_claims WHERE CLAIM_STATUS = 'Approved')", "INSERT",
        "FINANCIAL_ID", 1, "CAST(PAID_AMOUNT + 100 AS DECIMAL(15,2)) AS PAID_AMOUNT"),
])
LIT_CORE = "(SELECT * EXCLUDE (LITIGATION_ID) FROM r_litigation)"
LIT_FEED = "\nUNION ALL\n".join([
    _ch(LIT_CORE, "LITIGATION_STATUS = 'Discovery'", "DELETE", "CLAIM_ID", 0),
    _ch(LIT_CORE, "LITIGATION_STATUS = 'Discovery'", "INSERT", "CLAIM_ID", 1, "'Mediation' AS LITIGATION_STATUS"),
])


def _apply(base: str, net: str, key: str) -> str:
    """Source table after its net changes (changed keys replaced)."""
    return (f"SELECT * FROM {base} WHERE {key} NOT IN (SELECT {key} FROM {net})\nUNION ALL\n"
            f"SELECT * EXCLUDE (action, seq) FROM {net}")


_all_fact = (_STAR["fact_claims"].replace("FROM r_claims c\n", "FROM a_claims c\n")
             .replace("LEFT JOIN r_financial f", "LEFT JOIN a_fin f")
             .replace("LEFT JOIN r_litigation l", "LEFT JOIN a_lit l")
             + "\nWHERE c.CLAIM_ID IN (SELECT CLAIM_ID FROM a_ids)")
assert "a_fin f" in _all_fact and "a_lit l" in _all_fact
INC["merge_fact_claims_all_sources"] = with_base(
    "SELECT * FROM fact_claims WHERE CLAIM_KEY NOT IN (SELECT CLAIM_KEY FROM a_fact)\nUNION ALL\n"
    "SELECT * FROM a_fact",
    [("c_feed", CLAIM_FEED), ("c_net", _net("c_feed", "CLAIM_ID")),
     ("f_feed", FIN_FEED), ("f_net", _net("f_feed", "FINANCIAL_ID")),
     ("l_feed", LIT_FEED), ("l_net", _net("l_feed", "CLAIM_ID")),
     ("a_claims", _apply("r_claims", "c_net", "CLAIM_ID")),
     ("a_fin", _apply("r_financial", "f_net", "FINANCIAL_ID")),
     ("a_lit", _apply(LIT_CORE, "l_net", "CLAIM_ID")),
     ("a_ids", "SELECT CLAIM_ID FROM c_net UNION SELECT CLAIM_ID FROM f_net UNION SELECT CLAIM_ID FROM l_net"),
     ("a_fact", _all_fact)])


# -- streaming runs: the drops of each task, and what its runs log ------------------
INC["stream_fact_claims"] = INC["merge_fact_claims"]
_DROPS = """
SELECT 'INCR_DIM_POLICY' AS TASK, 0 AS drop_no, COUNT(*) AS input_rows, COUNT(*) FILTER (action = 'INSERT') AS n FROM p_feed
UNION ALL
SELECT 'INCR_FACT_CLAIMS', CASE WHEN seq % 10 <= 1 THEN 0 ELSE 1 END, COUNT(*), COUNT(*) FILTER (action = 'INSERT') FROM c_feed GROUP BY 2
UNION ALL
SELECT 'INCR_FACT_EXPENSE', 0, COUNT(*), COUNT(*) FILTER (action = 'INSERT') FROM e_feed"""
_FEEDS = [("c_feed", CLAIM_FEED), ("e_feed", EXPENSE_FEED), ("p_feed", POLICY_FEED), ("drops", _DROPS)]
INC["run_history"] = with_base("""
SELECT TASK, CAST(3 AS BIGINT) AS TOTAL_RUNS, COUNT(*) FILTER (input_rows > 0) AS SUCCEEDED,
  3 - COUNT(*) FILTER (input_rows > 0) AS SKIPPED, CAST(0 AS BIGINT) AS FAILED, CAST(SUM(n) AS BIGINT) AS ROWS, 'SKIPPED' AS CURRENT_STATE
FROM drops GROUP BY TASK""", _FEEDS)
INC["stream_status"] = with_base(
    "SELECT TASK, COUNT(*) FILTER (input_rows > 0) AS BATCHES_WITH_DATA FROM drops GROUP BY TASK", _FEEDS)


# -- dimensions after two batches with new members ----------------------------------------
_MOVE = ("LOSS_CAUSE || '{m}' AS LOSS_CAUSE, CLAIM_CITY || '{s}' AS CLAIM_CITY, "
         "CAST(LOSS_DATE + INTERVAL {y} YEAR AS DATE) AS LOSS_DATE")


def _moved(status: str, mark: str, side: str, years: int) -> str:
    return f"SELECT * REPLACE ({_MOVE.format(m=mark, s=side, y=years)}) FROM r_claims WHERE CLAIM_STATUS = '{status}'"


_dims = dict(star_ctes())
_cause_rows = _dims["dim_loss_cause"].split("FROM (SELECT DISTINCT")[1].split("LEFT JOIN", 1)[1]
_geo_rows = _dims["dim_geography"].split("LEFT JOIN", 1)[1]


def _next_causes(before: str, claims: str, batch: str) -> str:
    return f"""
SELECT * FROM {before} UNION ALL
SELECT (SELECT MAX(LOSS_CAUSE_KEY) FROM {before}) + ROW_NUMBER() OVER (ORDER BY d.LOSS_CAUSE), d.LOSS_CAUSE,
  r.LOSS_CATEGORY, COALESCE(r.IS_WEATHER_RELATED, FALSE), r.WEATHER_CONDITION_MAPPING, '{batch}'
FROM (SELECT DISTINCT LOSS_CAUSE FROM {claims} WHERE LOSS_CAUSE NOT IN (SELECT LOSS_CAUSE FROM {before})) d
LEFT JOIN {_cause_rows}"""


def _next_geography(before: str, claims: str, batch: str) -> str:
    return f"""
SELECT * FROM {before} UNION ALL
SELECT g.GEOGRAPHY_KEY, g.STATE_CODE, COALESCE(s.STATE_NAME, g.STATE_CODE), COALESCE(s.REGION, 'Unknown'), g.CITY, g.ZIP_CODE, '{batch}'
FROM (SELECT (SELECT MAX(GEOGRAPHY_KEY) FROM {before})
             + ROW_NUMBER() OVER (ORDER BY STATE_CODE, CITY NULLS FIRST, ZIP_CODE NULLS FIRST) AS GEOGRAPHY_KEY, *
      FROM (SELECT CLAIM_STATE AS STATE_CODE, CLAIM_CITY AS CITY, CLAIM_ZIP AS ZIP_CODE FROM {claims} WHERE CLAIM_STATE IS NOT NULL
            EXCEPT SELECT STATE_CODE, CITY, ZIP_CODE FROM {before})) g
LEFT JOIN {_geo_rows}"""


def _next_days(before: str, claims: str, batch: str) -> str:
    return f"""
SELECT * FROM {before} UNION ALL
SELECT CAST(d AS DATE), '{batch}' FROM (
  SELECT unnest(generate_series(date_trunc('year', lo), date_trunc('year', hi) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d
  FROM (SELECT MIN(x) AS lo, MAX(x) AS hi FROM (SELECT DATE_KEY AS x FROM {before} UNION ALL SELECT LOSS_DATE FROM {claims})))
WHERE CAST(d AS DATE) NOT IN (SELECT DATE_KEY FROM {before})"""


def _fact_of(claims: str, geo: str, cause: str) -> str:
    out = (_STAR["fact_claims"].replace("FROM r_claims c\n", f"FROM {claims} c\n").replace("LEFT JOIN dim_geography g", f"LEFT JOIN {geo} g")
           .replace("LEFT JOIN dim_loss_cause lc", f"LEFT JOIN {cause} lc"))
    assert claims in out and geo in out and cause in out
    return out


_TWO = [("n1", _moved("Stalled", " (reopened)", " NORTH", 10)),
        ("n2", _moved("Pending Review", " (review)", " SOUTH", 20) + "\nUNION ALL\n" + _moved("Rejected", " (reopened)", " NORTH", 10)),
        ("c0", "SELECT *, 'build' AS ALLOCATED_IN FROM dim_loss_cause"), ("c1", _next_causes("c0", "n1", "1")), ("c2", _next_causes("c1", "n2", "2")),
        ("g0", "SELECT *, 'build' AS ALLOCATED_IN FROM dim_geography"), ("g1", _next_geography("g0", "n1", "1")), ("g2", _next_geography("g1", "n2", "2")),
        ("d0", "SELECT DATE_KEY, 'build' AS ALLOCATED_IN FROM dim_date"), ("d1", _next_days("d0", "n1", "1")), ("d2", _next_days("d1", "n2", "2")),
        ("f1", _fact_of("n1", "g1", "c1")), ("f2", _fact_of("n2", "g2", "c2")),
        ("after", "SELECT * FROM f2 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM fact_claims "
                  "WHERE CLAIM_KEY NOT IN (SELECT CLAIM_KEY FROM f1 UNION ALL SELECT CLAIM_KEY FROM f2)")]
INC["grown_loss_causes"] = with_base("SELECT * FROM c2", _TWO)
INC["grown_geography"] = with_base("SELECT * FROM g2", _TWO)
INC["grown_calendar"] = with_base("""
SELECT ALLOCATED_IN, CAST(year(DATE_KEY) AS INTEGER) AS YEAR, COUNT(*) AS DAYS, MIN(DATE_KEY) AS FIRST_DAY, MAX(DATE_KEY) AS LAST_DAY
FROM d2 GROUP BY 1, 2""", _TWO)
INC["fact_after_two_merges"] = with_base("SELECT * FROM after", _TWO)
INC["gaps_after_two_merges"] = with_base("\nUNION ALL\n".join(
    f"SELECT '{k}' AS FK, COUNT({k}) AS CHILD_KEYS, COUNT(*) FILTER ({k} IS NULL) AS NULL_KEYS, "
    f"COUNT(*) FILTER ({k} IS NOT NULL AND {k} NOT IN (SELECT {k} FROM {dim})) AS ORPHAN_ROWS FROM after"
    for k, dim in (("DATE_KEY", "d2"), ("GEOGRAPHY_KEY", "g2"), ("LOSS_CAUSE_KEY", "c2"))), _TWO)


# -- changes followed through reverse foreign keys ------------------------------------------
_INSURED_FEED = "\nUNION ALL\n".join([
    _ch("r_insured", "STATE = 'FL'", "DELETE", "INSURED_ID", 0),
    _ch("r_insured", "STATE = 'FL'", "INSERT", "INSURED_ID", 1, "LAST_NAME || ' (renamed)' AS LAST_NAME"),
])
_SEVERE = _ch("r_claims", "CLAIM_STATUS = 'Stalled'", "INSERT", "CLAIM_ID", 1, "'Severe' AS CLAIM_SEVERITY")
_PROPAGATED = [
    ("i_feed", _INSURED_FEED), ("i_net", _net("i_feed", "INSURED_ID")), ("p_feed", POLICY_FEED), ("p_net", _net("p_feed", "POLICY_ID")),
    ("c_feed", CLAIM_FEED), ("c_net", _net("c_feed", "CLAIM_ID")), ("f_feed", FIN_FEED), ("f_net", _net("f_feed", "FINANCIAL_ID")),
    ("l_feed", LIT_FEED), ("l_net", _net("l_feed", "CLAIM_ID")), ("e_feed", EXPENSE_FEED), ("e_net", _net("e_feed", "EXPENSE_ID")),
    ("s_net", _SEVERE), ("a_insured", _apply("r_insured", "i_net", "INSURED_ID")), ("a_policy", _apply("r_policy", "p_net", "POLICY_ID")),
    ("a_fin", _apply("r_financial", "f_net", "FINANCIAL_ID")), ("a_lit", _apply(LIT_CORE, "l_net", "CLAIM_ID")),
    ("a_claims", _apply("r_claims", "s_net", "CLAIM_ID")), ("a_expense", _apply("r_expense", "e_net", "EXPENSE_ID")),
]
# The whole star rebuilt from the changed sources: propagation must give the same.
INC["propagate_dim_policy"] = with_base(
    _STAR["dim_policy"].replace("FROM r_policy p LEFT JOIN r_insured i", "FROM a_policy p LEFT JOIN a_insured i"), _PROPAGATED)
INC["propagate_fact_claims"] = with_base(
    _STAR["fact_claims"].replace("LEFT JOIN r_financial f", "LEFT JOIN a_fin f").replace("LEFT JOIN r_litigation l", "LEFT JOIN a_lit l"), _PROPAGATED)
INC["propagate_fact_expense"] = with_base(
    _STAR["fact_expense"].replace("FROM r_expense e JOIN fact_claims fc", "FROM a_expense e JOIN s_fact fc"),
    [*_PROPAGATED, ("s_fact", _STAR["fact_claims"].replace("FROM r_claims c\n", "FROM a_claims c\n"))])
assert all(name in INC[key] for key, name in (("propagate_dim_policy", "a_policy p LEFT JOIN a_insured i"), ("propagate_fact_claims", "LEFT JOIN a_fin f"),
                                              ("propagate_fact_expense", "FROM a_expense e JOIN s_fact fc")))
INC["touched_rows"] = with_base("""
SELECT STAR_TABLE, CHANGED_TABLE, COUNT(*) AS ROWS FROM (
  SELECT DISTINCT 'DIM_POLICY' AS STAR_TABLE, 'INSURED' AS CHANGED_TABLE, POLICY_ID AS k FROM r_policy WHERE INSURED_ID IN (SELECT INSURED_ID FROM i_net)
  UNION SELECT 'DIM_POLICY', 'POLICY', POLICY_ID FROM p_net
  UNION SELECT * FROM t_claims
  UNION SELECT 'FACT_CLAIM_EXPENSE', 'CLAIMS_EXPENSE', EXPENSE_ID FROM e_net
  UNION SELECT 'FACT_CLAIM_EXPENSE', t.CHANGED_TABLE, e.EXPENSE_ID FROM r_expense e JOIN t_claims t ON t.k = e.CLAIM_ID)
GROUP BY 1, 2""", [*_PROPAGATED, ("t_claims", """
SELECT 'FACT_CLAIMS' AS STAR_TABLE, 'CLAIMS' AS CHANGED_TABLE, CLAIM_ID AS k FROM c_net
UNION SELECT 'FACT_CLAIMS', 'FINANCIAL_DATA', CLAIM_ID FROM f_net
UNION SELECT 'FACT_CLAIMS', 'LITIGATION', CLAIM_ID FROM l_net""")])

_RAW_CTE = {"INSURED": "r_insured", "LINE_OF_BUSINESS": "r_lob", "POLICY": "r_policy", "VENDOR": "r_vendor", "CATASTROPHE": "r_catastrophe",
            "CLAIMS": "r_claims", "CLAIM_ASSIGNMENT": "(SELECT CLAIM_ID FROM r_claims)", "FINANCIAL_DATA": "r_financial", "CLAIMS_EXPENSE": "r_expense", "LITIGATION": "r_litigation"}


def reverse_references_sql(edges) -> str:
    return with_base("\nUNION ALL\n".join(f"""
SELECT '{parent}' AS PARENT_TABLE, '{key}' AS PARENT_COLUMN, '{child}' AS CHILD_TABLE, '{col}' AS CHILD_COLUMN,
  CAST(COALESCE(SUM(n), 0) AS BIGINT) AS CHILD_ROWS, COUNT(n) AS REFERENCED_KEYS, COUNT(*) - COUNT(n) AS UNREFERENCED_KEYS,
  CAST(COALESCE(MAX(n), 0) AS BIGINT) AS MOST_CHILD_ROWS
FROM {_RAW_CTE[parent]} p LEFT JOIN (SELECT {col} AS k, COUNT(*) AS n FROM {_RAW_CTE[child]} GROUP BY 1) c ON c.k = p.{key}""" for child, col, parent, key in edges))


# -- reports kept from the feed: the full reports over the merged fact; profit and loss ---------
from lossledger.oracle.reports import REPORTS as _REPORTS  # noqa: E402


def _over_merged(key: str) -> str:
    select = _REPORTS[key][len(with_base("")):] if _REPORTS[key].startswith(with_base("")) else None
    assert select and "fact_claims" in select, key
    return with_base(select.replace("FROM fact_claims", "FROM m_fact"),
                     [("c_feed", CLAIM_FEED), ("c_net", _net("c_feed", "CLAIM_ID")), ("c_fact", _changed_fact),
                      ("m_fact", "SELECT * FROM fact_claims WHERE CLAIM_KEY NOT IN (SELECT CLAIM_KEY FROM c_fact) UNION ALL SELECT * FROM c_fact")])


INC["status_counts_from_feed"] = _over_merged("status_counts")
INC["region_performance_from_feed"] = _over_merged("region_performance")
INC["profit_and_loss"] = with_base("""
SELECT LEVEL, PERIOD, EARNED AS EARNED_PREMIUM, PAID AS PAID_LOSSES, EXPENSE AS EXPENSES, CAST(EARNED - PAID - EXPENSE AS DECIMAL(38,2)) AS RESULT FROM (
  SELECT CASE WHEN D IS NOT NULL THEN 'DAY' WHEN M IS NOT NULL THEN 'MONTH' ELSE 'QUARTER' END AS LEVEL, COALESCE(D, M, Q) AS PERIOD,
    CAST(SUM(EARNED) AS DECIMAL(38,2)) AS EARNED, CAST(SUM(PAID) AS DECIMAL(38,2)) AS PAID, CAST(SUM(EXPENSE) AS DECIMAL(38,2)) AS EXPENSE
  FROM (SELECT strftime(DAY, '%Y-%m-%d') AS D, strftime(DAY, '%Y-%m') AS M, CAST(year(DAY) AS VARCHAR) || '-Q' || CAST(quarter(DAY) AS VARCHAR) AS Q, EARNED, PAID, EXPENSE
        FROM days WHERE DAY IS NOT NULL)
  GROUP BY GROUPING SETS ((D), (M), (Q)))
WHERE EARNED <> 0 OR PAID <> 0 OR EXPENSE <> 0""", [
    ("terms", "SELECT POLICY_EFFECTIVE_DATE AS a, CAST(PREMIUM * 100 AS BIGINT) AS c, date_diff('day', POLICY_EFFECTIVE_DATE, POLICY_EXPIRATION_DATE) AS d FROM dim_policy"),
    ("days", """
SELECT CAST(a + CAST(i AS INTEGER) AS DATE) AS DAY, CAST(c // d + CASE WHEN i < c % d THEN 1 ELSE 0 END AS DECIMAL(38,2)) / 100 AS EARNED, 0 AS PAID, 0 AS EXPENSE
FROM (SELECT *, unnest(range(d)) AS i FROM terms WHERE d > 0)
UNION ALL SELECT PAYMENT_DATE, 0, PAID_AMOUNT, 0 FROM fact_claims
UNION ALL SELECT EXPENSE_DATE, 0, 0, TOTAL_ACTUAL_EXPENSE FROM fact_expense""")])
