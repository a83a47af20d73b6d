"""Preference pairs, derived from the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.demos import corpus, derived
from plumbline.demos.registry import demo
from plumbline.operators import pairs as PD
from plumbline.sources.tables import read_table as t

FAULTS = derived.EVALUATED_FAULTS
FAULT_SQL = derived.FAULT_SQL


@demo(
    "pd_split",
    """
    SELECT source, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'holdout' END AS split, count(*) AS rows
    FROM (SELECT source, ('0x' || md5(source)[1:8])::BIGINT % 100 AS b FROM documents) GROUP BY ALL
    """,
)
def pd_split(spark, d):
    split = PD.family_split(F.col("source")).alias("split")
    return t(spark, d, "documents").groupBy("source", split).agg(F.count(F.lit(1)).alias("rows"))


DOMAINS = ("Healthcare", "finance", "risk", "sales")


def candidates(spark, d):
    """One candidate pair per document: its fault, violations and effect follow from the id."""
    doc = F.col("doc_id")
    return t(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("metric_"), doc % 97).alias("metric"),
        F.get(F.array(*map(F.lit, DOMAINS)), (doc % 4).cast("int")).alias("domain"),
        F.get(F.array(*map(F.lit, FAULTS)), (doc % 8).cast("int")).alias("mutation_type"),
        F.col("source").alias("metric_family"),
        PD.family_split(F.col("source")).alias("split"),
        F.when(doc % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("describe "), "lang")).cast("string").alias("description"),
        F.col("lang").alias("owner"),
        F.lit("month").alias("grain"),
        F.lit("2.1.0").alias("contract_version"),
        F.concat(F.lit("select "), doc % 97).alias("chosen_sql"),
        F.when(doc % 41 == 0, F.concat(F.lit(" select "), doc % 97)).otherwise(F.concat(F.lit("bad "), doc)).alias("rejected_sql"),
        (doc % 13 != 0).alias("executable"),
        (doc % 11 == 0).alias("equivalent"),
        (doc % 5 != 0).alias("result_changed"),
        (doc % 3).cast("int").alias("n_violations"),
        F.transform(F.sequence(F.lit(0), (doc % 3).cast("int")), lambda i: F.concat(F.lit("v"), i)).alias("violations"),
        (doc % 2000 / 100.0).alias("variance_pct"),
        (doc % 5).cast("int").alias("n_required_filters"),
    )


CANDIDATES = f"""
    candidates AS (
      SELECT doc_id, 'metric_' || (doc_id % 97) AS metric, (['Healthcare', 'finance', 'risk', 'sales'])[(doc_id % 4 + 1)::INT] AS domain,
             ({FAULT_SQL})[(doc_id % 8 + 1)::INT] AS mutation_type, source AS metric_family,
             CASE WHEN ('0x' || md5(source)[1:8])::BIGINT % 100 < 70 THEN 'train'
                  WHEN ('0x' || md5(source)[1:8])::BIGINT % 100 < 85 THEN 'validation' ELSE 'holdout' END AS split,
             CASE WHEN doc_id % 3 = 0 THEN 'Write a production-grade SQL query to calculate ''metric_' || (doc_id % 97) || ''' for owner ''' || lang || ''' at ''month'' granularity.'
                  ELSE 'describe ' || lang END AS prompt, lang,
             'select ' || (doc_id % 97) AS chosen_sql, CASE WHEN doc_id % 41 = 0 THEN 'select ' || (doc_id % 97) ELSE 'bad ' || doc_id END AS rejected_sql,
             doc_id % 2000 / 100.0::DOUBLE AS variance_pct
      FROM documents),
    gated AS (
      SELECT *, CASE WHEN chosen_sql = rejected_sql THEN 'identical_pair'
                     WHEN NOT ((split = 'train' AND mutation_type IN ('FILTER_DROP', 'AGGREGATION_SWAP', 'COALESCE_BYPASS'))
                            OR (split = 'validation' AND mutation_type IN ('BOUNDARY_SHIFT', 'DISTINCT_DROP'))
                            OR (split = 'holdout' AND mutation_type IN ('GRAIN_DROP', 'MATH_OPERATOR_INVERT', 'JOIN_PREDICATE_DROP'))) THEN 'outside_split'
                     WHEN doc_id % 13 = 0 THEN 'unexecutable' WHEN doc_id % 11 = 0 THEN 'equivalent_on_fixture'
                     WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN 'rejected_not_semantically_divergent'
                     WHEN doc_id % 3 = 0 THEN 'unresolved_preference'
                     WHEN doc_id % 5 = 0 THEN 'rejected_not_semantically_divergent' END AS rejection
      FROM candidates)"""


@demo(
    "pd_split_rules",
    f"""
    WITH {CANDIDATES}
    SELECT doc_id, CASE WHEN lower(domain) IN ('healthcare', 'infrastructure', 'risk') OR mutation_type IN ('GRAIN_DROP', 'MATH_OPERATOR_INVERT', 'JOIN_PREDICATE_DROP') THEN 'holdout'
                        WHEN mutation_type IN ('BOUNDARY_SHIFT', 'DISTINCT_DROP') THEN 'val' ELSE 'train' END AS split
    FROM candidates
    """,
)
def pd_split_rules(spark, d):
    return candidates(spark, d).select("doc_id", PD.rule_split(F.col("domain"), F.col("mutation_type")).alias("split"))


LEVEL = """CASE WHEN mutation_type IN ('FILTER_DROP', 'AGGREGATION_SWAP', 'COALESCE_BYPASS') THEN 'easy'
                WHEN mutation_type IN ('BOUNDARY_SHIFT', 'DISTINCT_DROP', 'GRAIN_DROP') THEN 'medium' ELSE 'hard' END"""
REASONS = f"""CASE {LEVEL} WHEN 'easy' THEN 'direct_ast_mutation' WHEN 'medium' THEN 'subtle_boundary_or_grain_shift'
                ELSE 'relational_or_deduction_inversion' END || CASE WHEN doc_id % 5 > 2 THEN ',multi_component_metric' ELSE '' END"""


@demo("pd_difficulty", f"WITH {CANDIDATES} SELECT doc_id, {LEVEL} AS difficulty, {REASONS} AS reasons FROM candidates")
def pd_difficulty(spark, d):
    fault = F.col("mutation_type")
    return candidates(spark, d).select(
        "doc_id",
        PD.difficulty(fault).alias("difficulty"),
        F.array_join(PD.difficulty_reasons(fault, F.col("n_required_filters")), ",").alias("reasons"),
    )


@demo(
    "pd_difficulty4",
    f"""
    WITH {CANDIDATES}
    SELECT doc_id, CASE WHEN mutation_type IN ('JOIN_PREDICATE_DROP', 'MATH_OPERATOR_INVERT') THEN 'expert'
                        WHEN mutation_type IN ('GRAIN_DROP', 'BOUNDARY_SHIFT') OR (variance_pct > 0 AND variance_pct <= 5) OR doc_id % 7 = 0 THEN 'hard'
                        WHEN mutation_type IN ('FILTER_DROP', 'COALESCE_BYPASS') THEN 'medium' ELSE 'easy' END AS difficulty
    FROM candidates
    """,
)
def pd_difficulty4(spark, d):
    level = PD.calibrated_difficulty(F.col("mutation_type"), F.col("variance_pct"), F.col("doc_id") % 7 == 0)
    return candidates(spark, d).select("doc_id", level.alias("difficulty"))


def corpus_pairs(spark, d, by_split=True):
    """(pairs, rejects) of the corpus: its kill matrix, its catalogue and its contracts."""
    return PD.build_pairs(corpus.corpus_matrix(spark, d), corpus.contracts(spark), corpus.corpus_catalogue(spark, d), by_split=by_split, fixture_id="corpus")


@demo("pd_gate", f"WITH {corpus.GATED.format(split=corpus.OUTSIDE)} SELECT coalesce(rejection, 'kept') AS reason, count(*) AS pairs FROM gated GROUP BY 1")
def pd_gate(spark, d):
    pairs, rejects = corpus_pairs(spark, d)
    kept = pairs.select(F.lit(None).cast("string").alias("rejection"))
    return PD.rejection_counts(kept.union(rejects.select("rejection")))


@demo(
    "pd_rejects",
    f"""
    WITH {corpus.GATED.format(split="FALSE")}
    SELECT metric, mutation_type, mutation_description, chosen_sql, rejected_sql, array_to_string(violations, ';') AS violations, rejection FROM gated WHERE rejection IS NOT NULL
    """,
)
def pd_rejects(spark, d):
    _, rejects = corpus_pairs(spark, d, by_split=False)
    return rejects.drop("split").withColumn("violations", F.array_join("violations", ";"))


EVIDENCE = """
    '{"chosen":{"assertions_passed":true,"baseline_validated":true,"contract_compliant":true,"execution_success":true,"result_reference":"baseline"},'
    || '"metric":"' || metric || '","mutation":"' || mutation_type || '","rejected":{"assertions_passed":false,"contract_compliant":false,'
    || '"execution_success":true,"rejection_basis":["CONTRACT_VIOLATION","RESULT_DIVERGENCE"],"result_changed_vs_chosen":true,"variance_pct_vs_chosen":'
    || round(variance_pct, 2)::VARCHAR || ',"violations":["v0"' || CASE WHEN doc_id % 3 >= 1 THEN ',"v1"' ELSE '' END
    || CASE WHEN doc_id % 3 = 2 THEN ',"v2"' ELSE '' END || ']}}'
"""


@demo(
    "pd_evidence",
    f"WITH {CANDIDATES} SELECT doc_id, sha256({EVIDENCE}) AS evidence_hash FROM gated WHERE rejection IS NULL",
)
def pd_evidence(spark, d):
    kept = PD.gate(candidates(spark, d)).where("rejection IS NULL")
    return PD.with_evidence(kept).select("doc_id", "evidence_hash")


def built(spark, d):
    kept = PD.gate(candidates(spark, d)).where("rejection IS NULL")
    return PD.pair_rows(kept, fixture_id="documents")


@demo(
    "pd_pairs",
    f"""
    WITH {corpus.GATED.format(split="FALSE")}
    SELECT metric || '_' || lower(mutation_type) AS example_id,
           coalesce(description, 'Write a production-grade SQL query to calculate ''' || metric || ''' for owner ''' || owner || ''' at ''' || grain || ''' granularity.') AS prompt,
           metric AS contract_id, contract_version, chosen_sql, rejected_sql, mutation_type, {LEVEL} AS difficulty, 'corpus' AS fixture_id, '1.0.0' AS policy_version, split,
           family AS metric_family, array_to_string(violations, ';') AS violations
    FROM gated WHERE rejection IS NULL
    """,
)
def pd_pairs(spark, d):
    pairs, _ = corpus_pairs(spark, d, by_split=False)
    violations = F.array_join("rejected_evidence.violations", ";").alias("violations")
    return pairs.select("*", violations).drop("chosen_evidence", "rejected_evidence", "difficulty_reasons", "evidence_hash")


@demo(
    "pd_format_dpo",
    f"""
    WITH {CANDIDATES}
    SELECT '{{"prompt":"' || prompt || '","chosen":"' || chosen_sql || '","rejected":"' || rejected_sql || '","metadata":{{"example_id":"'
           || metric || '_' || lower(mutation_type) || '","contract_id":"' || metric || '","mutation_type":"' || mutation_type || '","difficulty":"' || {LEVEL}
           || '","evidence_hash":"' || sha256({EVIDENCE}) || '","split":"' || split || '","rejection_basis":["CONTRACT_VIOLATION","RESULT_DIVERGENCE"]}}}}' AS line
    FROM gated WHERE rejection IS NULL
    """,
)
def pd_format_dpo(spark, d):
    return PD.format_dpo(built(spark, d)).select(F.to_json(F.struct("*")).alias("line"))


META = f"""'{{"example_id":"' || metric || '_' || lower(mutation_type) || '","contract_id":"' || metric || '","difficulty":"' || {LEVEL}
           || '","evidence_hash":"' || sha256({EVIDENCE}) || '"}}'"""


@demo(
    "pd_format_sft",
    f"""
    WITH {CANDIDATES}
    SELECT '{{"prompt":"' || prompt || '","completion":"' || chosen_sql || '","reason_codes":["CONTRACT_COMPLIANT","ASSERTIONS_PASSED"],"metadata":'
           || {META} || '}}' AS line
    FROM gated WHERE rejection IS NULL
    """,
)
def pd_format_sft(spark, d):
    return PD.format_sft(built(spark, d)).select(F.to_json(F.struct("*")).alias("line"))


@demo(
    "pd_format_rlhf",
    f"""
    WITH {CANDIDATES}
    SELECT '{{"prompt":"' || prompt || '","response":"' || chosen_sql
           || '","reward_components":{{"execution":1.0,"contract":1.0,"assertions":1.0,"fixture_divergence":0.0,"cost":null}},"reward_policy_version":"reward-v1","metadata":'
           || {META} || '}}' AS line
    FROM gated WHERE rejection IS NULL
    """,
)
def pd_format_rlhf(spark, d):
    return PD.format_rlhf(built(spark, d)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


@demo(
    "pd_export",
    f"WITH {CANDIDATES} SELECT prompt, chosen_sql AS chosen, rejected_sql AS rejected, split FROM gated WHERE rejection IS NULL AND split = 'train'",
)
def pd_export(spark, d):
    from plumbline.session import scratch_path
    from plumbline.sources.sinks import write_pairs

    path = scratch_path(spark, "pairs")
    write_pairs(PD.format_dpo(built(spark, d)), F.col("metadata.split"), path, only="train")
    return spark.read.schema("prompt string, chosen string, rejected string, split string").json(path)


# --- audits of a table with planted defects ------------------------------------------------------


def planted(spark, d):
    """Every document as a pair: short ids and texts collide, some fields are missing."""
    doc = F.col("doc_id")
    return t(spark, d, "documents").select(
        F.when(doc % 29 == 0, F.lit(None)).otherwise(F.col("n_chars")).cast("string").alias("example_id"),
        F.when(doc % 31 == 0, F.lit("")).otherwise(F.md5("text")).alias("evidence_hash"),
        F.concat_ws(" ", F.lit("prompt"), "lang", doc % 10).alias("prompt"),
        F.concat(F.lit(" answer "), doc % 20).alias("chosen_sql"),
        F.when(doc % 37 == 0, F.concat(F.lit("answer "), doc % 20)).otherwise(F.lit("bad")).alias("rejected_sql"),
        F.when(doc % 43 != 0, F.lit("1.0.0")).alias("contract_version"),
        F.lit("f").alias("fixture_id"),
        F.get(F.array(*map(F.lit, FAULTS)), (doc % 8).cast("int")).alias("mutation_type"),
        F.get(F.array(*map(F.lit, DOMAINS)), (doc % 4).cast("int")).alias("domain"),
        F.when(doc % 3 == 0, "holdout").otherwise("train").alias("split"),
        F.concat("source", F.lit("-"), doc % 2).alias("metric_family"),
        F.col("lang").alias("difficulty"),
        "doc_id",
    )


PLANTED = f"""
    planted AS (
      SELECT CASE WHEN doc_id % 29 <> 0 THEN n_chars::VARCHAR END AS example_id, CASE WHEN doc_id % 31 = 0 THEN '' ELSE md5(text) END AS evidence_hash,
             'prompt ' || lang || ' ' || (doc_id % 10) AS prompt, 'answer ' || (doc_id % 20) AS chosen_sql,
             CASE WHEN doc_id % 37 = 0 THEN 'answer ' || (doc_id % 20) ELSE 'bad' END AS rejected_sql,
             CASE WHEN doc_id % 43 <> 0 THEN '1.0.0' END AS contract_version, ({FAULT_SQL})[(doc_id % 8 + 1)::INT] AS mutation_type,
             (['Healthcare', 'finance', 'risk', 'sales'])[(doc_id % 4 + 1)::INT] AS domain,
             CASE WHEN doc_id % 3 = 0 THEN 'holdout' ELSE 'train' END AS split, source || '-' || (doc_id % 2) AS metric_family, lang AS difficulty, doc_id
      FROM documents)"""


@demo(
    "pd_audit_integrity",
    f"""
    WITH {PLANTED},
    firsts AS (SELECT prompt, arg_min(chosen_sql, doc_id) AS chosen FROM planted GROUP BY 1)
    SELECT (SELECT count(*) FROM planted) AS total_records,
           (SELECT count(*) FROM planted WHERE chosen_sql = rejected_sql) AS chosen_rejected_identical,
           (SELECT count(*) FILTER (WHERE example_id IS NULL) + count(*) FILTER (WHERE evidence_hash = '') FROM planted) AS missing_evidence,
           (SELECT count(*) FROM planted WHERE contract_version IS NULL) AS missing_contract_versions, 0::BIGINT AS missing_fixture_ids,
           (SELECT count(example_id) - count(DISTINCT example_id) FROM planted) AS duplicate_example_ids,
           (SELECT count(evidence_hash) - count(DISTINCT evidence_hash) FROM planted) AS duplicate_evidence_hashes,
           (SELECT count(*) FROM planted p JOIN firsts f USING (prompt) WHERE p.chosen_sql <> f.chosen) AS conflicting_preference_labels
    """,
)
def pd_audit_integrity(spark, d):
    return PD.audit_integrity(planted(spark, d), order="doc_id")


LEAKAGE = """
    (SELECT count(*) FROM planted WHERE split = 'train' AND mutation_type IN ('GRAIN_DROP', 'MATH_OPERATOR_INVERT', 'JOIN_PREDICATE_DROP')) AS mutation_family_leakage,
    (SELECT count(*) FROM planted WHERE split = 'train' AND lower(domain) IN ('healthcare', 'infrastructure', 'risk')) AS domain_leakage,
    (SELECT count(*) FROM (SELECT 1 FROM planted GROUP BY metric_family HAVING count(DISTINCT split) > 1)) AS metric_family_leakage
"""


@demo("pd_audit_leakage", f"WITH {PLANTED} SELECT {LEAKAGE}")
def pd_audit_leakage(spark, d):
    return PD.audit_leakage(planted(spark, d))


@demo("pd_audit_report", f"WITH {PLANTED} SELECT (SELECT count(*) FROM planted) AS total_records, FALSE AS is_clean, {LEAKAGE}")
def pd_audit_report(spark, d):
    return PD.audit_pairs(planted(spark, d)).select(
        "total_records", "is_clean", "mutation_family_leakage", "domain_leakage", "metric_family_leakage"
    )


def _shares(*fields):
    return " UNION ALL ".join(
        f"SELECT '{f}' AS field, {f} AS value, count(*) AS rows, round(count(*)::DOUBLE / (SELECT count(*) FROM planted) * 100, 1) AS share_pct FROM planted GROUP BY ALL"
        for f in fields
    )


@demo("pd_audit_dist", f"WITH {PLANTED} {_shares('mutation_type', 'difficulty', 'split')}")
def pd_audit_dist(spark, d):
    return PD.distribution(planted(spark, d))


@demo("pd_inspect", f"WITH {PLANTED} SELECT field, value, rows FROM ({_shares('mutation_type', 'difficulty')})")
def pd_inspect(spark, d):
    return PD.distribution(planted(spark, d), ["mutation_type", "difficulty"]).drop("share_pct")
