"""Registrations beyond the dashboard reports."""

from lossledger.catalog import register
from lossledger.oracle.tables import TABLES
from lossledger.oracle.weather import WEATHER
from lossledger.plans import outlook, tables

for _k, _sql in TABLES.items():
    register(_k, getattr(tables, _k), _sql)

register("weather_outlook", outlook.weather_outlook, WEATHER["weather_outlook"])
register("forecast_latest", outlook.forecast_latest, WEATHER["forecast_latest"])
register("climatology", outlook.climatology_table, WEATHER["climatology"])

from lossledger.oracle.quality import Q as _QUALITY_SQL
from lossledger.plans import quality

for _k in ["orphan_keys", "primary_key_check", "relationship_map", "fk_coverage", "required_tables",
           "build_validation", "numeric_histogram", "category_top_n", "numeric_profile", "null_profile",
           "distinct_counts", "numeric_profile_events", "histogram_event_value", "histogram_event_id"]:
    register(_k, getattr(quality, _k), _QUALITY_SQL[_k])
# schema-derived columns: rows-only check
register("table_inventory", quality.table_inventory)
register("column_inventory", quality.column_inventory)

from lossledger.oracle.semantic import SEMANTIC as _SEM_SQL
from lossledger.plans import semantic as _sem

for _k in ["semantic_metrics", "semantic_by_dimension", "semantic_join_path", "semantic_drill_across",
           "sq_legal_fees", "sq_expense_ratio_by_claim_type"]:
    register(_k, getattr(_sem, _k), _SEM_SQL[_k])
for _k in _sem.CANNED:
    register(_k, _sem.canned(_k), _SEM_SQL[_k])

from lossledger.oracle.incremental import INC as _INC_SQL
from lossledger.plans import incremental as _inc

for _k in ["cdc_net_changes", "merge_fact_claims", "merge_fact_expense", "merge_dim_policy",
           "merge_fact_claims_all_sources"]:
    register(_k, getattr(_inc, _k), _INC_SQL[_k])

from lossledger.streaming import pipeline as _stream

# these write change files and tables under spark.checkpoint.dir
register("stream_fact_claims", _stream.stream_fact_claims, _INC_SQL["stream_fact_claims"])
register("run_history", _stream.stream_run_history, _INC_SQL["run_history"])
register("stream_status", _stream.stream_status, _INC_SQL["stream_status"])

from lossledger.plans import growing as _growing

for _k in ["grown_loss_causes", "grown_geography", "grown_calendar", "fact_after_two_merges", "gaps_after_two_merges"]:
    register(_k, getattr(_growing, _k), _INC_SQL[_k])

from lossledger.oracle.incremental import reverse_references_sql as _reverse_sql
from lossledger.plans import propagate as _propagate

for _k in ["propagate_dim_policy", "propagate_fact_claims", "propagate_fact_expense", "touched_rows"]:
    register(_k, getattr(_propagate, _k), _INC_SQL[_k])
register("reverse_references", _propagate.reverse_references, _reverse_sql(quality.RAW_EDGES))

from lossledger.oracle.intake import INTAKE as _INTAKE_SQL
from lossledger.plans import intake as _intake

for _k in _INTAKE_SQL:
    register(_k, getattr(_intake, _k), _INTAKE_SQL[_k])

from lossledger.plans import running as _running

for _k in ["status_counts_from_feed", "region_performance_from_feed", "profit_and_loss"]:
    register(_k, getattr(_running, _k), _INC_SQL[_k])
