"""Agent runs: grading, scorecards, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.demos import derived
from plumbline.demos.registry import demo
from plumbline.operators import trajectories as TJ
from plumbline.sources.tables import read_table as t

G = derived.GRADED
RUNS = derived.TRAJECTORIES


def _graded(spark, d):
    return TJ.grade_trajectories(derived.trajectories(spark, d), derived.scenarios(spark, d), derived.verdicts(spark, d))


@demo(
    "tj_grade",
    f"WITH {G} SELECT run_id, execution_success, contract_compliant, result_correct, appropriate_abstention FROM graded",
)
def tj_grade(spark, d):
    return _graded(spark, d).select(
        "run_id", "execution_success", "contract_compliant", "result_correct", "appropriate_abstention"
    )


@demo(
    "tj_golden",
    """
    WITH s AS (SELECT doc_id, doc_id % 6 <> 0 AS golden, CASE WHEN doc_id % 4 = 0 THEN 'ABSTAIN' ELSE 'PRODUCE_SQL' END AS b,
                      doc_id % 3 <> 0 AS has_contract, doc_id % 5 <> 0 AS fingerprinted FROM documents)
    SELECT 'doc_' || s.doc_id AS scenario_id,
           CASE WHEN NOT golden THEN b <> 'PRODUCE_SQL'
                ELSE l.doc_id IS NOT NULL AND (NOT has_contract OR l.quality = 1) AND (NOT fingerprinted OR l.toxic = 0) END AS golden_valid
    FROM s LEFT JOIN labels l ON s.doc_id = l.doc_id
    """,
)
def tj_golden(spark, d):
    doc = F.col("doc_id")
    goldens = t(spark, d, "documents").select(
        F.concat(F.lit("doc_"), doc).alias("scenario_id"),
        F.when(doc % 6 != 0, F.sha2("source", 256)).alias("golden_sql_hash"),
        F.when(doc % 4 == 0, "ABSTAIN").otherwise("PRODUCE_SQL").alias("expected_behavior"),
        (doc % 3 != 0).alias("has_contract"),
        F.when(doc % 5 != 0, F.lit("0")).alias("fixture_fingerprint"),
    )
    judged = t(spark, d, "labels").select(
        F.concat(F.lit("doc_"), doc).alias("scenario_id"),
        F.lit(True).alias("ran"),
        (F.col("quality") == 1).alias("contract_passed"),
        F.col("toxic").cast("string").alias("fingerprint"),
    )
    return TJ.valid_goldens(goldens, judged).select("scenario_id", "golden_valid")


@demo(
    "tj_abstain",
    f"""
    WITH {RUNS} SELECT run_id, abstained AND expected_behavior <> 'PRODUCE_SQL' AS appropriate
    FROM trajectories JOIN scenarios USING (scenario_id)
    """,
)
def tj_abstain(spark, d):
    known = derived.trajectories(spark, d).join(derived.scenarios(spark, d), "scenario_id")
    return known.select("run_id", TJ.appropriate_abstention(F.col("abstained"), F.col("expected_behavior")).alias("appropriate"))


def _card_sql(source, by):
    def share(flag):
        return f"round(avg(CASE WHEN {flag} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4)"

    return f"""
      SELECT {by}, count(*) AS total_evaluations, {share('execution_success')} AS execution_success_rate,
             {share('contract_compliant')} AS contract_compliance_rate, {share('result_correct')} AS result_correctness_rate,
             {share('execution_success AND NOT contract_compliant')} AS unsafe_query_rate, {share('abstained')} AS abstention_rate,
             {share('appropriate_abstention')} AS appropriate_abstention_rate, {share('ceiling_reached')} AS ceiling_reached_rate,
             round(avg(n_calls), 2) AS mean_tool_calls, round(avg(coalesce(estimated_cost_usd, 0)), 4) AS mean_cost_usd,
             round(quantile_cont(latency_ms, 0.5), 2) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms
      FROM {source} GROUP BY 1"""


@demo("tj_scorecard", f"WITH {RUNS} {_card_sql('trajectories', 'agent_type')}")
def tj_scorecard(spark, d):
    return TJ.scorecard(derived.trajectories(spark, d))


@demo(
    "tj_lift",
    f"""
    WITH {RUNS}, c AS ({_card_sql('trajectories', 'agent_type')}),
         b AS (SELECT * FROM c WHERE agent_type = 'blind'), g AS (SELECT * FROM c WHERE agent_type = 'governed')
    SELECT round(g.contract_compliance_rate - b.contract_compliance_rate, 4) AS semantic_lift,
           round(g.result_correctness_rate - b.result_correctness_rate - 0.1::DOUBLE * (g.p95_latency_ms - b.p95_latency_ms) / 1000
                 - 0.5::DOUBLE * (g.mean_cost_usd - b.mean_cost_usd) - 0.2::DOUBLE * (g.abstention_rate - g.appropriate_abstention_rate), 4) AS net_governance_benefit
    FROM b, g
    """,
)
def tj_lift(spark, d):
    return TJ.lift(TJ.scorecard(derived.trajectories(spark, d)))


@demo("tj_by_class", f"WITH {G} {_card_sql('graded', 'scenario_class')}")
def tj_by_class(spark, d):
    return TJ.scorecard(_graded(spark, d), ["scenario_class"])


FATES = """
    stored AS (SELECT DISTINCT k % 25 AS sql_no FROM keyed WHERE k % 25 % 5 <> 0),
    fates AS (SELECT t.run_id, CASE WHEN s.scenario_id IS NULL THEN 'unknown_scenario'
                     WHEN t.final_sql_hash IS NOT NULL AND a.sql_no IS NULL THEN 'unreplayable' ELSE 'replayed' END AS fate
              FROM trajectories t LEFT JOIN scenarios s USING (scenario_id) LEFT JOIN stored a ON t.sql_no = a.sql_no)"""


def _replayed(spark, d):
    return TJ.replay(
        derived.trajectories(spark, d), derived.scenarios(spark, d), derived.artifacts(spark, d), derived.verdicts(spark, d)
    )


@demo(
    "tj_replay",
    f"WITH {G}, {FATES} {_card_sql('(SELECT * FROM graded JOIN fates USING (run_id) WHERE fate = $$replayed$$)', 'agent_type')}",
)
def tj_replay(spark, d):
    graded, _ = _replayed(spark, d)
    return TJ.scorecard(graded)


@demo(
    "tj_replay_counts",
    f"""
    WITH {RUNS}, {FATES} SELECT count(*) FILTER (WHERE fate = 'replayed') AS replayed, count(*) FILTER (WHERE fate = 'unreplayable') AS unreplayable,
         count(*) FILTER (WHERE fate = 'unknown_scenario') AS unknown_scenario FROM fates
    """,
)
def tj_replay_counts(spark, d):
    _, counts = _replayed(spark, d)
    return counts


@demo(
    "tj_confusion",
    """
    SELECT lang, count(*) FILTER (WHERE ok AND quality = 1 AND toxic = 0) AS compliant_match, count(*) FILTER (WHERE ok AND quality = 1 AND toxic = 1) AS compliant_mismatch,
           count(*) FILTER (WHERE ok AND quality = 0 AND toxic = 0) AS violation_match, count(*) FILTER (WHERE ok AND quality = 0 AND toxic = 1) AS violation_mismatch,
           count(*) FILTER (WHERE NOT ok) AS execution_error, count(*) FILTER (WHERE ok AND quality IS NULL) AS unresolved
    FROM (SELECT d.lang, n_chars > 300 AS ok, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1
    """,
)
def tj_confusion(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 300).alias("execution_success"))
    records = docs.join(t(spark, d, "labels"), "doc_id", "left").withColumns(
        {"contract_compliant": F.col("quality") == 1, "result_correct": F.col("toxic") == 0}
    )
    return TJ.confusion(records, ["lang"])


REPORT = """
    count(*) AS total_evaluations, round(count(*) FILTER (WHERE execution_success)::DOUBLE / count(*) * 100, 1) AS execution_success_pct,
    round(count(*) FILTER (WHERE contract_compliant)::DOUBLE / count(*) * 100, 1) AS contract_compliance_pct,
    round(count(*) FILTER (WHERE result_correct)::DOUBLE / count(*) * 100, 1) AS result_correctness_pct, round(avg(latency_ms), 2) AS mean_ms,
    round(quantile_cont(latency_ms, 0.5), 2) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 2) AS p99_ms
"""


@demo(
    "tj_report",
    f"WITH {RUNS} SELECT agent_type, {REPORT} FROM trajectories GROUP BY 1 UNION ALL SELECT 'all', {REPORT} FROM trajectories",
)
def tj_report(spark, d):
    runs = derived.trajectories(spark, d)
    overall = TJ.agent_report(runs).withColumn("agent_type", F.lit("all"))
    return TJ.agent_report(runs, ["agent_type"]).unionByName(overall)


@demo("tj_redact", "SELECT conv_id, turn, role, sha256(trim(text, ' ')) AS text_hash FROM conversations")
def tj_redact(spark, d):
    return TJ.redact(t(spark, d, "conversations"), ["text"])
