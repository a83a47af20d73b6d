"""Small literal tables with explicit schemas, and what the metrics on them must give."""

import datetime as dt


def _rows(text):
    return [line.split("|") for line in text.strip().splitlines()]


def _parse(value, kind):
    if value == "":
        return None
    return {
        "string": str,
        "double": float,
        "int": int,
        "boolean": lambda v: v == "true",
        "date": dt.date.fromisoformat,
        "timestamp": dt.datetime.fromisoformat,
    }[kind](value)


TABLES = {
    "average_order_value": (
        "order_id string, customer_id string, order_date date, order_amount double, order_status string, is_test boolean",
        """
        O1|C1|2026-01-05|100|completed|false
        O2|C2|2026-01-06|200|completed|false
        O3|C3|2026-01-07|300|completed|false
        O4|C4|2026-01-08|500|cancelled|false
        O5|C5|2026-01-09|10000|completed|true
        """,
    ),
    "checkout_conversion_rate": (
        "session_id string, user_id string, event_name string, is_internal_ip boolean",
        """
        S1|U1|checkout_complete|false
        S2|U2|checkout_start|false
        S3|U3|checkout_complete|false
        S4|U4|checkout_complete|true
        """,
    ),
    "customer_churn_rate": (
        "sub_id string, customer_id string, start_date date, cancelled boolean, is_trial boolean, plan string",
        """
        S1|C1|2026-01-01|false|false|pro
        S2|C2|2026-01-01|true|false|pro
        S3|C3|2026-01-01|false|false|enterprise
        S4|C4|2026-01-01|true|true|free_trial
        S5|C5|2026-01-01|false|false|pro
        """,
    ),
    "customer_retention_rate": (
        "cohort_id string, customer_id string, returned_next_period boolean, status string",
        """
        2026-Q1|C1|true|active
        2026-Q1|C2|true|active
        2026-Q1|C3|false|active
        2026-Q1|C4|false|banned
        """,
    ),
    "inventory_turnover": (
        "sku string, warehouse_id string, cogs double, stock_value double, is_obsolete boolean",
        """
        SKU-A|WH-1|50000|10000|false
        SKU-B|WH-1|20000|5000|false
        SKU-C|WH-2|80000|20000|false
        SKU-D|WH-2|0|15000|true
        """,
    ),
    "monthly_active_users": (
        "user_id string, login_date timestamp, status string, is_bot boolean, region string",
        """
        U1|2026-01-10 09:00:00|active|false|NA
        U1|2026-01-15 14:00:00|active|false|NA
        U2|2026-01-12 11:00:00|active|false|EU
        U3|2026-01-20 16:30:00|suspended|false|NA
        U4|2026-01-22 18:00:00|active|true|NA
        U5|2026-01-25 10:15:00|active|false|NA
        """,
    ),
    "net_revenue": (
        "transaction_id string, customer_id string, transaction_date timestamp, amount double, type string, "
        "status string, region string, last_login date",
        """
        T1|C1|2026-01-05 10:00:00|1000|invoice|active|NA|2026-08-01
        T2|C1|2026-01-12 11:30:00|200|refund|active|NA|2026-08-01
        T3|C2|2026-01-15 09:15:00|2500|invoice|active|NA|2026-08-10
        T4|C2|2026-01-20 14:00:00|500|refund|active|NA|2026-08-10
        T5|C3|2026-01-18 16:45:00|3000|invoice|pending|NA|2026-05-01
        T6|C4|2026-01-22 12:00:00|4500|invoice|active|EU|2026-08-12
        """,
    ),
    "sla_compliance_rate": (
        "ticket_id string, agent_id string, resolved_within_sla boolean, is_spam boolean, priority string",
        """
        T1|A1|true|false|high
        T2|A1|true|false|high
        T3|A2|false|false|medium
        T4|A2|true|false|low
        T5|A3|false|true|low
        """,
    ),
    "ad_campaign_roas": (
        "campaign_id string, channel string, attributed_revenue double, ad_spend double, is_test_campaign boolean",
        """
        CMP-1|paid_search|50000|10000|false
        CMP-2|paid_search|80000|20000|false
        CMP-3|social_ads|30000|15000|false
        CMP-4|staging_test|100|5000|true
        """,
    ),
    "b2b_saas_arr": (
        "contract_id string, customer_id string, mrr_amount double, contract_term_months int, status string, "
        "is_internal_account boolean, billing_frequency string",
        """
        CTR-101|ACME-CORP|5000|12|active|false|annual
        CTR-102|ACME-CORP|1000|12|active|false|annual
        CTR-103|BETA-LLC|12000|24|active|false|annual
        CTR-104|GAMMA-INC|2500|12|churned|false|monthly
        CTR-105|DELTA-INTERNAL|10000|12|active|true|annual
        CTR-106|EPSILON-CO|8000|12|active|false|annual
        """,
    ),
    "cloud_compute_burn_rate": (
        "instance_id string, team string, instance_hours double, hourly_rate double, spot_discount_credit double, "
        "is_benchmark_run boolean",
        """
        I-1|core-ai|100|4.5|50|false
        I-2|core-ai|200|4.5|100|false
        I-3|web-api|50|1.2|0|false
        I-4|benchmark-job|500|8|0|true
        """,
    ),
    "fintech_chargeback_rate": (
        "payment_id string, merchant_id string, amount double, is_disputed boolean, is_sandbox boolean, "
        "settlement_status string",
        """
        PAY-01|MERCH-1|100|false|false|settled
        PAY-02|MERCH-1|250|true|false|settled
        PAY-03|MERCH-2|500|false|false|settled
        PAY-04|MERCH-2|1200|false|false|settled
        PAY-05|MERCH-3|80|true|false|settled
        PAY-06|MERCH-4|9999|true|true|settled
        """,
    ),
    "hospital_readmission_rate": (
        "admission_id string, department string, readmitted_30d boolean, is_planned_readmission boolean, "
        "patient_deceased boolean",
        """
        ADM-1|cardiology|true|false|false
        ADM-2|cardiology|false|false|false
        ADM-3|orthopedics|true|true|false
        ADM-4|orthopedics|false|false|false
        ADM-5|cardiology|true|false|true
        """,
    ),
    "marketplace_take_rate": (
        "order_id string, seller_id string, gmv_amount double, commission_fee double, is_cancelled boolean, "
        "is_test_order boolean",
        """
        ORD-1|SEL-A|1000|150|false|false
        ORD-2|SEL-A|2000|300|false|false
        ORD-3|SEL-B|500|75|false|false
        ORD-4|SEL-C|10000|1500|true|false
        ORD-5|SEL-D|50000|7500|false|true
        """,
    ),
}

# fixed values: result of each metric, rounded to 4, and published contrast score of its table
EXPECTED = {
    "average_order_value": ({"C1": 100.0, "C2": 200.0, "C3": 300.0}, 50.0),
    "checkout_conversion_rate": ({None: 0.6667}, 50.0),
    "customer_churn_rate": ({"pro": 0.3333, "enterprise": 0.0}, 50.0),
    "customer_retention_rate": ({"2026-Q1": 0.6667}, 66.7),
    "inventory_turnover": ({"WH-1": 4.6667, "WH-2": 4.0}, 100.0),
    "monthly_active_users": ({"2026-01": 3}, 100.0),
    "net_revenue": ({"C1": 800.0, "C2": 2000.0}, 100.0),
    "sla_compliance_rate": ({"high": 1.0, "medium": 0.0, "low": 1.0}, 100.0),
    "ad_campaign_roas": ({"paid_search": 4.3333, "social_ads": 2.0}, 100.0),
    "b2b_saas_arr": ({"ACME-CORP": 72000.0, "BETA-LLC": 144000.0, "EPSILON-CO": 96000.0}, 100.0),
    "cloud_compute_burn_rate": ({"core-ai": 1200.0, "web-api": 60.0}, 100.0),
    "fintech_chargeback_rate": ({"MERCH-1": 0.5, "MERCH-2": 0.0, "MERCH-3": 1.0}, 100.0),
    "hospital_readmission_rate": ({"cardiology": 0.5, "orthopedics": 0.0}, 100.0),
    "marketplace_take_rate": ({"SEL-A": 0.15, "SEL-B": 0.15}, 50.0),
}


def table(spark, name):
    schema, text = TABLES[name]
    kinds = [column.split()[1] for column in schema.split(", ")]
    rows = [tuple(_parse(v.strip(), k) for v, k in zip(r, kinds)) for r in _rows(text)]
    return spark.createDataFrame(rows, schema)


def first(df):
    return df.first().asDict()


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
