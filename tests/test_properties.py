"""Properties of the star schema and reports on the driver tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from lossledger.plans import reports as R
from lossledger.plans.semantic import AmbiguousName, SemanticModel


def test_fact_rows_equal_claims(ctx):
    assert ctx.star.fact_claims().count() == ctx.raw.claims().count()
    assert ctx.star.fact_claims().select("CLAIM_KEY").distinct().count() == ctx.raw.claims().count()


def test_net_is_incurred_minus_recoveries(ctx):
    bad = ctx.star.fact_claims().where(
        F.col("NET_INCURRED") != F.col("INCURRED_LOSS") - F.col("RECOVERY_AMOUNT") - F.col("SUBROGATION_AMOUNT")
        - F.col("SALVAGE_AMOUNT"))
    assert bad.count() == 0


def test_geography_not_fanned_out(ctx):
    g = ctx.star.dim_geography()
    assert g.count() == g.select("STATE_CODE", "CITY", "ZIP_CODE").distinct().count()
    assert g.select("GEOGRAPHY_KEY").distinct().count() == g.count()


def test_shares_sum_to_100(ctx):
    total = R.severity_share(ctx).agg(F.sum("PCT")).first()[0]
    assert abs(total - Decimal(100)) <= Decimal("0.5")


def test_drill_across_equals_single_fact_totals(ctx):
    m = SemanticModel(ctx)
    both = m.query(["total_revenue", "total_expenses"], ["region"]).agg(F.sum("total_revenue"),
                                                                        F.sum("total_expenses")).first()
    claims_only = m.query(["total_revenue"]).first()[0]
    exp_only = m.query(["total_expenses"]).first()[0]
    assert both[0] == claims_only and both[1] == exp_only


def test_synonyms_and_ambiguity(ctx):
    m = SemanticModel(ctx)
    assert m.metric("total paid").name == "total_revenue"
    assert m.dimension("severity").name == "claim_severity"
    try:
        m.dimension("cause of loss")
    except AmbiguousName:
        raise AssertionError("'cause of loss' is a dimension synonym only once")
    assert [r.to_table for r in m.join_path("fact_expense", "fact_claims")] == ["fact_claims"]
    assert len(m.join_path("fact_expense", "dim_geography")) == 1


def test_severity_ordering_variants(ctx):
    text = {r["STAGE"]: r for r in R.severity_changes(ctx, "text").collect()}
    risk = {r["STAGE"]: r for r in R.severity_changes(ctx, "risk").collect()}
    assert text.keys() == risk.keys()
    for k in text:
        assert text[k]["SEVERITY_CHANGES"] == risk[k]["SEVERITY_CHANGES"]


def test_top_k_has_full_tie_break(ctx):
    a = [tuple(r) for r in R.top_loss_causes(ctx).collect()]
    b = [tuple(r) for r in R.top_loss_causes(ctx).collect()]
    assert a == b and len(a) == 8


def test_all_dimensions_are_asked_for():
    """The canned questions together use every dimension of the model."""
    from lossledger.plans import semantic as S
    model = S.SemanticModel(None)
    used = {model.dimension(d).name for spec in S.CANNED.values() for d in [*spec.get("dimensions", ()), *spec.get("where", {})]}
    used |= {"region", "claim_category", "claim_status", "loss_category"}  # semantic_by_dimension, semantic_join_path
    assert len(S.DIMENSIONS) == 26 and {d.name for d in S.DIMENSIONS} <= used
