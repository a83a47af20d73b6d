"""The fourteen corpus metrics, declared against their own source tables."""

from __future__ import annotations

from plumbline.plans.spec import Measure, MetricSpec, Predicate, Ratio, Term


def _share(alias: str, flag: str) -> Ratio:
    """Rows with ``flag`` over all rows of the population."""
    return Ratio(alias, Term("1.0D", agg="sum", when=flag), Term("1", agg="count"))


def _counted_share(alias: str, flag: str) -> Ratio:
    """The same share, written with a conditional count."""
    return Ratio(alias, Term("1", agg="count", when=flag), Term("1", agg="count"))


CORPUS: dict[str, MetricSpec] = {
    spec.name: spec
    for spec in (
        MetricSpec(
            "net_revenue",
            dims=(("customer_id", "customer_id"), ("reporting_month", "date_trunc('month', transaction_date)")),
            measures=(
                Measure(
                    "net_revenue",
                    (Term("amount", when="type = 'invoice'"), Term("amount", when="type = 'refund'", sign=-1)),
                ),
            ),
            filters=(Predicate("region", "=", "'NA'"), Predicate("status", "=", "'active'")),
        ),
        MetricSpec(
            "average_order_value",
            dims=(("customer_id", "customer_id"),),
            measures=(Measure("avg_order_value", (Term("order_amount", agg="avg"),)),),
            filters=(Predicate("order_status", "=", "'completed'"), Predicate("is_test", "=", "false")),
        ),
        MetricSpec(
            "monthly_active_users",
            dims=(("reporting_month", "date_trunc('month', login_date)"),),
            measures=(Measure("active_users", (Term("user_id", agg="count", distinct=True),)),),
            filters=(Predicate("status", "=", "'active'"), Predicate("is_bot", "=", "false")),
        ),
        MetricSpec(
            "customer_churn_rate",
            dims=(("plan", "plan"),),
            measures=(_counted_share("churn_rate", "cancelled = true"),),
            filters=(Predicate("is_trial", "=", "false"),),
        ),
        MetricSpec(
            "customer_retention_rate",
            dims=(("cohort_id", "cohort_id"),),
            measures=(_share("retention_rate", "returned_next_period = true"),),
            filters=(Predicate("status", "=", "'active'"),),
        ),
        MetricSpec(
            "inventory_turnover",
            dims=(("warehouse_id", "warehouse_id"),),
            measures=(Ratio("turnover_ratio", Term("cogs"), Term("stock_value")),),
            filters=(Predicate("is_obsolete", "=", "false"),),
        ),
        MetricSpec(
            "sla_compliance_rate",
            dims=(("priority", "priority"),),
            measures=(_share("sla_rate", "resolved_within_sla = true"),),
            filters=(Predicate("is_spam", "=", "false"),),
        ),
        MetricSpec(
            "checkout_conversion_rate",
            dims=(),
            measures=(_counted_share("conversion_rate", "event_name = 'checkout_complete'"),),
            filters=(Predicate("is_internal_ip", "=", "false"),),
        ),
        MetricSpec(
            "ad_campaign_roas",
            dims=(("channel", "channel"),),
            measures=(Ratio("roas", Term("attributed_revenue"), Term("ad_spend")),),
            filters=(Predicate("is_test_campaign", "=", "false"),),
        ),
        MetricSpec(
            "b2b_saas_arr",
            dims=(("customer_id", "customer_id"),),
            measures=(Measure("annual_recurring_revenue", (Term("mrr_amount * 12.0D"),)),),
            filters=(Predicate("status", "=", "'active'"), Predicate("is_internal_account", "=", "false")),
        ),
        MetricSpec(
            "cloud_compute_burn_rate",
            dims=(("team", "team"),),
            measures=(
                Measure(
                    "net_compute_cost",
                    (Term("instance_hours * hourly_rate"), Term("spot_discount_credit", sign=-1)),
                ),
            ),
            filters=(Predicate("is_benchmark_run", "=", "false"),),
        ),
        MetricSpec(
            "fintech_chargeback_rate",
            dims=(("merchant_id", "merchant_id"),),
            measures=(_share("chargeback_rate", "is_disputed = true"),),
            filters=(Predicate("is_sandbox", "=", "false"), Predicate("settlement_status", "=", "'settled'")),
        ),
        MetricSpec(
            "hospital_readmission_rate",
            dims=(("department", "department"),),
            measures=(_share("readmission_rate", "readmitted_30d = true"),),
            filters=(
                Predicate("is_planned_readmission", "=", "false"),
                Predicate("patient_deceased", "=", "false"),
            ),
        ),
        MetricSpec(
            "marketplace_take_rate",
            dims=(("seller_id", "seller_id"),),
            measures=(Ratio("take_rate", Term("commission_fee"), Term("gmv_amount")),),
            filters=(Predicate("is_cancelled", "=", "false"), Predicate("is_test_order", "=", "false")),
        ),
    )
}
