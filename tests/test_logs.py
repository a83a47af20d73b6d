import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F
from tables import first, rows_by

from plumbline.functions import text
from plumbline.operators import audit as AU
from plumbline.operators import contracts as C
from plumbline.operators import drift as D
from plumbline.operators import governance as G
from plumbline.operators import pairs as PD
from plumbline.operators import provenance as PV
from plumbline.operators import replay as RP
from plumbline.operators import scoring
from plumbline.operators import trajectories as TJ

# --- predicates and compliance ----------------------------------------------------------------

EQUAL = [
    (["status = 'active'", "region = 'NA'"], ["(Region='NA')", "((status  = 'active'))"]),
    (["a = 1 or b = 2"], ["(b = 2) OR (a = 1)"]),
    (["x in ('a','b')"], ["X IN ('a','b')"]),
    (["lower(x) = 'a'"], ["LOWER(x)='a'"]),
    (["(((((a = 1)))))"], ["a=1"]),
    (["(a = 1 or b = 2) and c = 3"], ["c=3 and (b = 2 OR a=1)"]),
    (["a = 1 or (b = 2 or c = 3)"], ["(c=3)or((b=2)or(a=1))"]),
    (["x between 1 and 5 and y = 2"], ["Y=2 AND X BETWEEN 1 AND 5"]),
    (["n = 'it''s (or) so'"], ["N='it''s (or) so'"]),
]
DIFFERENT = [
    (["status = 'active'"], ["status = 'ACTIVE'"]),
    (["a = 1"], ["aa = 1"]),
    (["a = 1 or b = 2"], ["a = 1 or b = 3"]),
    (["a > 1"], ["a >= 1"]),
    (["city = 'New  York'"], ["city = 'New York'"]),
    (["label = '(x)'"], ["label = 'x'"]),
    (["expr = 'a<b'"], ["expr = 'a < b'"]),
    (["(a = 1 or b = 2) and c = 3"], ["a = 1 or (b = 2 and c = 3)"]),
    (["(a + b) * c = 1"], ["a + b * c = 1"]),
]


def test_choices_are_the_texts_they_stand_for(spark):
    df = spark.sql("SELECT array(array('b = 2', 'A=1'), array('c = 3')) AS n, array('c=3', '(a = 1 OR b = 2)') AS t")
    row = first(df.select(text.canonical_choices(F.col("n")).alias("n"), text.canonical_conjuncts(F.col("t")).alias("t")))
    assert row["n"] == row["t"] == ["a = 1 or b = 2", "c = 3"]



@pytest.mark.parametrize(("left", "right", "same"), [(*p, True) for p in EQUAL] + [(*p, False) for p in DIFFERENT])
def test_predicate_equivalence(spark, left, right, same):
    df = spark.createDataFrame([(left, right)], "l array<string>, r array<string>")
    assert first(df.select(D.same_population(F.col("l"), F.col("r")).alias("same")))["same"] is same
    texts = [sorted(map(text.normalise_predicate_text, side)) for side in (left, right)]
    assert (texts[0] == texts[1]) is same
    columns = first(df.select(text.canonical_conjuncts(F.col("l")).alias("c")))["c"]
    assert columns == texts[0]


LOG = (
    "request_id int, metric_id string, sql string, where_conjuncts array<string>, group_by array<string>, "
    "agg_calls array<string>"
)


def contracts(spark):
    return spark.createDataFrame(
        [("rev", ["status = 'active'", "region = 'NA'"], ["is_test = true"], ["customer_id"], "SUM", ["invoice"], ["refund"], "UTC")],
        "metric_id string, required_filters array<string>, forbidden_filters array<string>, required_dimensions array<string>, "
        "required_function string, positive_components array<string>, negative_components array<string>, timezone string",
    )


def test_compliance(spark):
    good = "select sum(invoice) - sum(REFUND)"
    log = spark.createDataFrame(
        [
            (1, "rev", good, ["region = 'NA'", "(STATUS = 'active')"], ["t.Customer_ID"], ["SUM(x)"]),
            (2, "rev", good, ["region = 'NA'"], ["customer_id"], ["sum(x)"]),
            (3, "rev", good + " at time zone 'EST'", ["region = 'NA'", "status = 'active'", "is_test=true"], [], ["AVG(x)"]),
            (4, "rev", None, None, None, None),
            (5, "nope", good, [], [], []),
        ],
        LOG,
    )
    rows = rows_by(G.check_compliance(log, contracts(spark)), "request_id")
    names = {k: sorted(v["rule"] for v in r["violations"]) for k, r in rows.items()}
    assert names[1] == [] and rows[1]["passed"] and rows[1]["rules_checked"] == 4
    assert names[2] == ["required_filters"]
    assert names[3] == ["forbidden_filters", "required_dimensions", "required_function", "timezone"]
    assert names[4] == [
        "negative_components", "positive_components", "required_dimensions", "required_filters", "required_filters", "required_function",
    ]
    assert names[5] == [] and not rows[5]["known_metric"] and not rows[5]["passed"]
    decided = rows_by(G.decide(G.check_compliance(log, contracts(spark)), strict=False), "request_id")
    assert [decided[i]["decision"] for i in (1, 2, 5)] == ["ALLOW", "REQUIRE_REVIEW", "DENY"]
    strict = rows_by(G.decide(G.check_compliance(log, contracts(spark)), breach_is_error=True), "request_id")
    assert strict[2]["decision"] == "DENY" and not strict[2]["execution_allowed"]


def test_text_mode_accepts_what_equality_refuses(spark):
    log = spark.createDataFrame([(1, "rev", "invoice refund", ["status = 'active' OR region = 'NA'"], ["customer_id"], ["SUM(x)"])], LOG)
    assert first(G.check_compliance(log, contracts(spark), mode="contains"))["passed"]
    assert not first(G.check_compliance(log, contracts(spark)))["passed"]


def test_fault_families(spark):
    cases = {
        "required_filters": "FILTER_DROP", "Grain": "GRAIN_DROP", "negative thing": "MATH_OPERATOR_INVERT",
        "Component": "AGGREGATION_SWAP", "null rule": "NULL_COALESCE_DROP", "zzz": "UNKNOWN",
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    got = {r[0]: r[1] for r in df.select("r", G.fault_family(F.col("r"), F.lit("")).alias("f")).collect()}
    assert got == cases


def test_clause_drift(spark):
    schema = (
        "id int, where_conjuncts array<string>, agg_calls array<string>, group_by array<string>, tables array<string>, "
        "n_joins int, n_open_joins int, n_coalesce int, having string"
    )
    base = spark.createDataFrame(
        [(i, ["a = 1", "b = 2"], ["SUM(x)", "SUM(y)"], ["c", "d"], ["t"], 1, 0, 1, None) for i in range(7)], schema
    )
    cand = spark.createDataFrame(
        [
            (0, ["b = 2", "(a = 1)"], ["SUM(y)", "SUM(x)"], ["d", "c"], ["t"], 1, 0, 1, None),
            (1, [], ["SUM(x)", "SUM(y)"], ["c", "d"], ["t"], 1, 0, 1, None),
            (2, ["a = 1"], ["SUM(x)", "AVG(y)"], ["c"], ["t"], 1, 0, 1, None),
            (3, ["a = 1", "b = 2"], ["SUM(x)", "SUM(z)"], ["c", "d"], ["t"], 1, 0, 0, None),
            (4, ["a = 1", "b = 2"], ["SUM(x)", "SUM(y)"], ["c", "d"], ["u"], 2, 1, 1, "n > 1"),
        ],
        schema,
    )
    found = {}
    for row in D.clause_drift(base, cand, "id").collect():
        found.setdefault(row["id"], set()).add(row["drift_type"])
    assert found == {
        1: {"FILTER_REMOVAL"},
        2: {"SEMANTIC_LOGIC_SHIFT", "AGGREGATION_FUNCTION_SHIFT", "GRAIN_DRIFT"},
        3: {"AGGREGATION_EXPRESSION_SHIFT", "NULL_HANDLING_DRIFT"},
        4: {"JOIN_TYPE_SHIFT", "JOIN_PREDICATE_MUTATION", "HAVING_FILTER_SHIFT", "TABLE_TARGET_SHIFT"},
    }
    worst = rows_by(D.max_severity(D.clause_drift(base, cand, "id"), ["id"], cand), "id")
    assert {k: r["decision"] for k, r in worst.items()} == {0: "ALLOW", 1: "DENY", 2: "DENY", 3: "REQUIRE_REVIEW", 4: "DENY"}
    assert worst[0]["max_severity"] == "INFO" and worst[4]["max_severity"] == "FATAL"


def test_routing(spark):
    df = spark.createDataFrame(
        [(1, True, 0, 0, 0, 1), (2, False, 2, 0, 0, 0), (3, True, 2, 0, 0, 0), (4, True, 1, 1, 1, 0)],
        "id int, passed boolean, n_cte int, n_subquery int, n_window int, n_case int",
    )
    rows = rows_by(G.route(df, runtime_passed=F.lit(True)), "id")
    assert [rows[i]["routing_decision"] for i in (1, 2, 3, 4)] == [
        "tier_3_static_approved", "tier_3_static_rejected", "tier_4_escalated_approved", "tier_4_escalated_approved",
    ]
    assert rows[3]["escalation_reason"] == "Complex query graph: 2 CTEs detected"
    forced = rows_by(G.route(df, force=True), "id")
    assert forced[1]["routing_tier"] == "tier_4_escalated" and forced[2]["routing_tier"] == "tier_3_static"


def test_cost(spark):
    df = spark.createDataFrame([(2 * 1024**4,), (10,)], "bytes_processed bigint")
    rows = rows_by(G.estimate_cost(df, G.Pricing(maximum_bytes_billed=1000), apply_free_tier=True), "bytes_processed")
    big = rows[2 * 1024**4]
    assert (big["gross_cost_usd"], big["billable_cost_usd"], big["cost_decision"]) == (12.5, 6.25, "DENY")
    assert rows[10]["cost_decision"] == "ALLOW"


def test_contract_table(spark):
    df = spark.createDataFrame(
        [("net_revenue", "o", "g", "s", "urn:x:fin:net_revenue", "1.0.0"), ("bad slug", None, "g", "s", "urn:x", "1.0")],
        "metric string, owner string, grain string, sql string, urn string, version string",
    )
    rows = rows_by(C.validate_contracts(df), "metric")
    assert rows["net_revenue"]["accepted"]
    assert rows["bad slug"]["reasons"] == ["missing owner", "metric is no slug", "malformed urn", "malformed version"]
    known = spark.createDataFrame([("fin", "m", "1.9.0"), ("fin", "m", "1.10.0")], "domain string, metric string, version string")
    refs = spark.createDataFrame([("urn:a:fin:m",), ("a://contracts/fin/m/1.9.0/invariants",), ("junk",)], "ref string")
    got = rows_by(C.resolve(refs, "ref", known), "ref")
    assert got["urn:a:fin:m"]["version"] == "1.10.0" and got["urn:a:fin:m"]["resolved"]
    assert got["a://contracts/fin/m/1.9.0/invariants"]["part"] == "invariants"
    assert not got["junk"]["resolved"]


# --- trajectories -----------------------------------------------------------------------------


def test_twenty_scenarios(spark):
    """Eight clear scenarios answered, twelve left alone: 0.40 compliance, 0.60 abstention, lift 0.40."""
    behaviours = ["PRODUCE_SQL"] * 8 + ["ASK_CLARIFICATION"] * 4 + ["ABSTAIN"] * 4 + ["REQUIRE_REVIEW"] * 4
    scenarios = spark.createDataFrame(
        [(f"s{i}", b, i < 8, i < 8) for i, b in enumerate(behaviours)],
        "scenario_id string, expected_behavior string, has_contract boolean, has_golden boolean",
    )
    runs, verdicts = [], []
    for i, b in enumerate(behaviours):
        wrote = b == "PRODUCE_SQL"
        runs.append((f"s{i}", "governed", f"g{i}" if wrote else None, not wrote, ["lookup", "check"][: 2 if wrote else 1], 1.0 + i / 100, 0.001))
        runs.append((f"s{i}", "blind", f"b{i}", False, [], 150.0, 0.05))
        verdicts.append((f"b{i}", f"s{i}", True, False, False))
        if wrote:
            verdicts.append((f"g{i}", f"s{i}", True, True, True))
    trajectories = spark.createDataFrame(
        runs,
        "scenario_id string, agent_type string, final_sql_hash string, abstained boolean, tool_calls array<string>, "
        "latency_ms double, estimated_cost_usd double",
    ).withColumn("ceiling_reached", F.lit(False))
    judged = spark.createDataFrame(
        verdicts, "sql_hash string, scenario_id string, ran boolean, contract_passed boolean, matches_golden boolean"
    )
    cards = TJ.scorecard(TJ.grade_trajectories(trajectories, scenarios, judged))
    rows = rows_by(cards, "agent_type")
    governed, blind = rows["governed"], rows["blind"]
    assert (governed["contract_compliance_rate"], governed["abstention_rate"]) == (0.4, 0.6)
    assert governed["appropriate_abstention_rate"] == 0.6 and governed["mean_tool_calls"] == 1.4
    assert (blind["contract_compliance_rate"], blind["unsafe_query_rate"], blind["p95_latency_ms"]) == (0.0, 1.0, 150.0)
    result = first(TJ.lift(cards))
    assert result["semantic_lift"] == 0.4
    expected = 0.4 - 0.1 * (governed["p95_latency_ms"] - 150.0) / 1000 - 0.5 * (0.001 - 0.05)
    assert abs(result["net_governance_benefit"] - expected) < 1e-4
    stored = spark.createDataFrame([(f"g{i}",) for i in range(7)] + [(f"b{i}",) for i in range(20)], "sql_hash string")
    graded, counts = TJ.replay(trajectories, scenarios, stored, judged)
    assert first(counts) == {"replayed": 39, "unreplayable": 1, "unknown_scenario": 0}
    assert graded.count() == 39


def test_confusion_and_report(spark):
    df = spark.createDataFrame(
        [(True, True, True, 1.0), (True, True, False, 2.0), (True, False, True, 3.0), (True, False, False, 4.0), (False, False, False, 5.0), (True, None, True, 6.0)],
        "execution_success boolean, contract_compliant boolean, result_correct boolean, latency_ms double",
    )
    assert set(first(TJ.confusion(df)).values()) == {1}
    report = first(TJ.agent_report(df))
    assert (report["execution_success_pct"], report["p50_ms"]) == (83.3, 3.5)


# --- pairs ------------------------------------------------------------------------------------


def test_splits_and_difficulty(spark):
    df = spark.createDataFrame([(f"family{i}",) for i in range(50)], "f string")
    for row in df.select("f", PD.family_split(F.col("f")).alias("s")).collect():
        bucket = int(hashlib.md5(row["f"].encode()).hexdigest()[:8], 16) % 100
        assert row["s"] == ("train" if bucket < 70 else "validation" if bucket < 85 else "holdout")
    faults = spark.createDataFrame([("FILTER_DROP", 3), ("GRAIN_DROP", 0), ("MATH_OPERATOR_INVERT", 0)], "m string, n int")
    got = [
        tuple(r)
        for r in faults.select(
            PD.difficulty(F.col("m")), PD.difficulty_reasons(F.col("m"), F.col("n")), PD.calibrated_difficulty(F.col("m"), F.lit(50.0))
        ).collect()
    ]
    assert got == [
        ("easy", ["direct_ast_mutation", "multi_component_metric"], "medium"),
        ("medium", ["subtle_boundary_or_grain_shift"], "hard"),
        ("hard", ["relational_or_deduction_inversion"], "expert"),
    ]


def test_pair_pipeline(spark):
    df = spark.createDataFrame(
        [
            ("keep", "a", "b", True, False, True, 1),
            ("same", "a", " a ", True, False, True, 1),
            ("crash", "a", "b", False, False, True, 1),
            ("equal", "a", "b", True, True, False, 1),
            ("nothing", "a", "b", True, False, False, 0),
            ("taste", "a", "b", True, False, True, 0),
            ("latent", "a", "b", True, False, False, 1),
        ],
        "metric string, chosen_sql string, rejected_sql string, executable boolean, equivalent boolean, result_changed boolean, n_violations int",
    ).withColumns(
        {
            "mutation_type": F.lit("FILTER_DROP"), "split": F.lit("train"), "violations": F.array(F.lit("v")), "variance_pct": F.lit(12.345),
            "description": F.lit(None).cast("string"), "owner": F.lit("o"), "grain": F.lit("g"), "contract_version": F.lit(None).cast("string"),
            "metric_family": F.lit("f"), "n_required_filters": F.lit(1),
        }
    )
    reasons = {k: r["rejection"] for k, r in rows_by(PD.gate(df), "metric").items()}
    assert reasons == {
        "keep": None, "same": "identical_pair", "crash": "unexecutable", "equal": "equivalent_on_fixture",
        "nothing": "rejected_not_semantically_divergent", "taste": "unresolved_preference", "latent": "rejected_not_semantically_divergent",
    }
    assert rows_by(PD.gate(df, require_divergence=False), "metric")["latent"]["rejection"] is None
    assert rows_by(PD.gate(df.withColumn("split", F.lit("holdout"))), "metric")["keep"]["rejection"] == "outside_split"
    pairs = PD.pair_rows(PD.gate(df).where("rejection IS NULL"))
    row = first(pairs)
    evidence = {
        "chosen": {"execution_success": True, "contract_compliant": True, "assertions_passed": True, "baseline_validated": True, "result_reference": "baseline"},
        "rejected": {
            "execution_success": True, "contract_compliant": False, "assertions_passed": False, "result_changed_vs_chosen": True,
            "variance_pct_vs_chosen": 12.35, "rejection_basis": ["CONTRACT_VIOLATION", "RESULT_DIVERGENCE"], "violations": ["v"],
        },
        "mutation": "FILTER_DROP", "metric": "keep",
    }
    payload = json.dumps(evidence, sort_keys=True, separators=(",", ":"))
    assert row["evidence_hash"] == hashlib.sha256(payload.encode()).hexdigest()
    assert row["prompt"].startswith("Write a production-grade SQL query to calculate 'keep' for owner 'o'")
    assert row["example_id"] == "keep_filter_drop" and row["contract_version"] == "1.0.0"
    assert first(PD.format_dpo(pairs))["metadata"]["rejection_basis"] == ["CONTRACT_VIOLATION", "RESULT_DIVERGENCE"]
    assert first(PD.format_sft(pairs, True))["reason_codes"] == ["CONTRACT_COMPLIANT", "ASSERTIONS_PASSED"]
    both = PD.format_rlhf(pairs, both=True).collect()
    assert [r["reward_components"]["contract"] for r in both] == [1.0, 0.0]


def test_pair_audit(spark):
    rows = [
        ("e1", "h1", "p", "a", "b", "train", "FILTER_DROP", "f1", "sales"),
        ("e1", "h2", "p", "a", "b", "train", "GRAIN_DROP", "f1", "sales"),
        ("e2", "h1", "p", "c", "c", "train", "FILTER_DROP", "f1", "Risk"),
        (None, "", "q", "a", "b", "holdout", "GRAIN_DROP", "f1", "sales"),
    ]
    df = spark.createDataFrame(
        rows,
        "example_id string, evidence_hash string, prompt string, chosen_sql string, rejected_sql string, split string, mutation_type string, "
        "metric_family string, domain string",
    ).withColumns({"contract_version": F.lit("1"), "fixture_id": F.lit(None).cast("string"), "difficulty": F.lit("easy")})
    report = first(PD.audit_pairs(df))
    assert report["duplicate_example_ids"] == 1 and report["duplicate_evidence_hashes"] == 1
    assert report["conflicting_preference_labels"] == 1 and report["chosen_rejected_identical"] == 1
    assert report["missing_evidence"] == 2 and report["missing_fixture_ids"] == 4
    assert (report["mutation_family_leakage"], report["metric_family_leakage"], report["domain_leakage"]) == (1, 1, 1)
    assert not report["is_clean"]


# --- audit chain ------------------------------------------------------------------------------


def audit_log(spark, n=20, tenants=("a", 'b "q"')):
    rows = [
        (f"ev-{t}-{i}", i, 1767225600.25 + i, "tools/call", None, "uri", t, "ALLOW" if i % 2 else None, 0.5 * i)
        for t in tenants
        for i in range(1, n + 1)
    ]
    df = spark.createDataFrame(
        rows,
        "event_id string, sequence_num bigint, timestamp_utc double, method string, tool_name string, resource_uri string, tenant_id string, "
        "decision string, latency_ms double",
    )
    nothing = F.lit(None).cast("string")
    return df.withColumns({"metric_id": nothing, "domain": nothing, "sql_sha256": nothing, "client_id": F.lit("c"), "key_id": F.lit("k")})


def reference_hash(row, previous):
    data = {k: row[k] for k in AU.EVENT_FIELDS if k != "previous_event_hash"} | {"previous_event_hash": previous}
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("size", [4, 1000])
def test_chain_matches_python(spark, size):
    chain = AU.build_chain(audit_log(spark), size).orderBy("tenant_id", "sequence_num").collect()
    previous = None
    for row in chain:
        place = row["sequence_num"] - 1
        if place == 0:
            previous = AU.GENESIS
        elif place % size == 0:
            previous = hashlib.sha256(f"segment:{row['tenant_id']}:{place // size}".encode()).hexdigest()
        assert row["previous_event_hash"] == previous
        previous = reference_hash(row.asDict(), previous)
        assert row["event_hash"] == previous


def test_tampering_is_found(spark, tmp_path):
    path = str(tmp_path / "log")
    AU.build_chain(audit_log(spark), 8).write.parquet(path)
    chain = spark.read.parquet(path)
    assert AU.verify_chain(chain, 8).count() == 0
    edited = chain.withColumn(
        "decision", F.when((F.col("tenant_id") == "a") & (F.col("sequence_num") == 5), "DENY").otherwise(F.col("decision"))
    )
    assert [tuple(r)[:2] + (r["problem"],) for r in AU.verify_chain(edited, 8).collect()] == [("a", 5, "hash_mismatch")]
    rehashed = edited.withColumn("event_hash", F.when(F.col("sequence_num") == 5, AU.event_hash()).otherwise(F.col("event_hash")))
    assert [(r["sequence_num"], r["problem"]) for r in AU.verify_chain(rehashed, 8).collect()] == [(6, "broken_link")]
    lost = chain.where("sequence_num <> 3")
    assert {(r["sequence_num"], r["problem"]) for r in AU.verify_chain(lost, 8).collect()} == {(4, "missing_predecessor")}
    doubled = chain.union(chain.where("tenant_id = 'a' AND sequence_num = 2"))
    assert {(r["sequence_num"], r["problem"]) for r in AU.verify_chain(doubled, 8).collect()} == {(2, "duplicate_sequence")}


def test_checkpoints(spark):
    chain = AU.build_chain(audit_log(spark))
    signed = AU.sign_checkpoints(AU.checkpoint(chain.where("sequence_num <= 10"), 1767225600.5, "k"), "secret")
    row = rows_by(signed, "tenant_id")["a"]
    payload = f"{row['checkpoint_id']}:10:{row['last_event_hash']}:10:{row['root_hash']}:1767225600.5:k"
    assert row["signature"] == hmac.new(b"secret", payload.encode(), hashlib.sha256).hexdigest()
    assert all(r["valid"] for r in AU.verify_checkpoints(chain, signed, "secret").collect())
    assert not any(r["valid"] for r in AU.verify_checkpoints(chain, signed, "other").collect())
    cut = rows_by(AU.verify_checkpoints(chain.where("tenant_id <> 'a' OR sequence_num < 10"), signed, "secret"), "tenant_id")
    assert not cut["a"]["anchored"] and not cut["a"]["valid"] and cut['b "q"']["valid"]


def test_segment_roots_match_python(spark):
    tails = AU.segment_tails(AU.build_chain(audit_log(spark, 37, ("a",)), 4), 4)
    hashes = [r["tail_hash"] for r in tails.orderBy("segment").collect()]
    for level in range(2):
        groups = [hashes[i : i + 4] for i in range(0, len(hashes), 4)]
        hashes = []
        for up, group in enumerate(groups):
            last = hashlib.sha256(f"level:{level}:a:{up}".encode()).hexdigest()
            for h in group:
                last = hashlib.sha256((last + h).encode()).hexdigest()
            hashes.append(last)
    assert len(hashes) == 1
    assert first(AU.link_segments(tails, 4)) == {"tenant_id": "a", "root_hash": hashes[0], "roots": 1}


def plain_root(hashes, size, tenant):
    level = 0
    while level == 0 or len(hashes) > 1:
        folded = []
        for up in range(0, len(hashes), size):
            last = hashlib.sha256(f"level:{level}:{tenant}:{up // size}".encode()).hexdigest()
            for h in hashes[up : up + size]:
                last = hashlib.sha256((last + h).encode()).hexdigest()
            folded.append(last)
        hashes, level = folded, level + 1
    return hashes[0]


def test_state_at_every_place_is_that_of_the_log_cut_there(spark):
    chain = AU.build_chain(audit_log(spark, 37, ("a", "b")), 3)
    places = chain.selectExpr("tenant_id", "sequence_num AS sequence_end")
    missing = spark.createDataFrame([("a", 40), ("c", 1), ("a", None), (None, 4)], "tenant_id string, sequence_end long")
    got = {(r["tenant_id"], r["sequence_end"]): r for r in AU.state_at(chain, places.union(places).union(missing), 3).collect()}
    assert len(got) == 2 * 37 + 4
    for tenant in ("a", "b"):
        hashes = [r["event_hash"] for r in chain.where(F.col("tenant_id") == tenant).orderBy("sequence_num").collect()]
        for end in range(1, 38):
            tails = [hashes[min(i + 3, end) - 1] for i in range(0, end, 3)]
            r = got[tenant, end]
            assert (r["events"], r["held"], r["held_rows"], r["root_hash"]) == (end, hashes[end - 1], 1, plain_root(tails, 3, tenant))
    assert (got["a", 40]["events"], got["a", 40]["held"], got["a", 40]["held_rows"]) == (37, None, 0)
    assert got["c", 1]["root_hash"] is None and got["c", 1]["events"] == 0
    one = AU.checkpoint(chain.where("sequence_num <= 20"), 1.0, "k", 3)
    assert sorted(AU.checkpoints_at(chain, places.where("sequence_end = 20"), 1.0, "k", 3).collect()) == sorted(one.collect())
    assert AU.checkpoints_at(chain, missing, 1.0, "k", 3).count() == 0
    assert AU.state_at(chain.limit(0), places.limit(0), 3).count() == 0


def joined_rows(df):
    """Rows that the joins of a query gave, from its metrics."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().get("numOutputRows").get().value() if "Join" in name else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_checkpoints_cost_the_same_each_however_many_and_however_long_the_log(spark, tmp_path):
    AU.build_chain(audit_log(spark, 2000, ("a",)), 4).write.parquet(f"{tmp_path}/log")
    chain = spark.read.parquet(f"{tmp_path}/log")
    for count in (1, 10, 100):
        places = chain.where(F.col("sequence_num") % (2000 // count) == 0).selectExpr("tenant_id", "sequence_num AS sequence_end")
        rows = joined_rows(AU.state_at(chain, places, 4))
        # own events, the place itself, and a row for each of the five levels of 500 segments; not count * 500
        assert count <= rows <= count * (4 + 1 + 5)


def test_lost_and_rewritten_segments_are_found(spark, tmp_path):
    AU.build_chain(audit_log(spark, 40, ("a",)), 8).write.parquet(f"{tmp_path}/log")
    chain = spark.read.parquet(f"{tmp_path}/log")
    signed = AU.sign_checkpoints(AU.checkpoint(chain, 1.0, "k", 8), "secret")

    def problems(log):
        return {(r["sequence_num"], r["problem"]) for r in AU.verify_chain(log, 8).collect()}

    def judged(log):
        row = AU.verify_checkpoints(log, signed, "secret", 8).first()
        return row["chain_ok"], row["complete"], row["root_ok"], row["valid"]

    assert judged(chain) == (True, True, True, True)
    assert problems(chain.where("sequence_num NOT BETWEEN 12 AND 16")) == {(17, "missing_predecessor")}
    assert problems(chain.where("sequence_num > 8")) == {(9, "missing_predecessor")}
    assert problems(chain.where("sequence_num NOT BETWEEN 9 AND 16")) == {(17, "missing_predecessor")}
    assert judged(chain.where("sequence_num <= 38")) == (True, False, False, False)
    forged = AU.build_chain(chain.where("sequence_num <= 8").withColumn("decision", F.lit("ALLOW")), 8)
    assert judged(forged.unionByName(chain.where("sequence_num > 8"))) == (True, True, False, False)
    again = chain.union(chain.where("sequence_num = 5"))
    assert judged(again)[3] is False
    with pytest.raises(Exception, match="repeated sequence number"):
        AU.build_chain(again, 8).collect()


def test_numbers_hash_as_json_writes_them(spark):
    values = [0.0, -0.0, 0.5, 1.2345678901234, 1e-4, 1.5e-5, -2.5e-7, 123456789.125, 1e15, 1.5e16, 1e20, -1e300, 1e7, 12345678.9, 0.001, 0.00012, 100.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(AU._json_number(F.col("v")).alias("t"))
    assert [r["t"] for r in got.collect()] == [json.dumps(v) for v in values]


# --- replay and provenance --------------------------------------------------------------------


def test_replay(spark):
    df = spark.createDataFrame(
        [("t1", "ALLOW", "m", "s"), ("t2", "DENY", "m", "s"), ("t3", "AUDIT", None, "s"), ("t4", "AUDIT", "m", ""), ("t5", "AUDIT", "m", "s")],
        "trace_id string, decision string, metric_id string, sql string",
    )
    assert {r["trace_id"] for r in RP.select_traces(df).collect()} == {"t1", "t5"}
    traces = spark.range(5000).selectExpr("cast(id as string) trace_id", "'a' agent_id", "cast(id % 2 as string) metric_id")
    once = {r["trace_id"] for r in RP.sample_traces(traces, 0.1).collect()}
    again = {r["trace_id"] for r in RP.sample_traces(traces.repartition(13), 0.1).collect()}
    assert once == again and 350 < len(once) < 650
    assert RP.sample_traces(traces, 0.0, {("a", "1"): 1.0}).count() == 2500
    suite = RP.suite_for("rev", ["x = 1"], "src", "k")
    assert [a.kind for a in suite.assertions] == ["population", "metric_value"]


def test_suggestions(spark):
    df = spark.createDataFrame(
        [
            ("FILTER_DROP", "Dropped predicate: status = 'active'"),
            ("FILTER_DROP", "drop where clause predicate:  status = 'active' "),
            ("FILTER_DROP", "odd"),
            ("GRAIN_DROP", "Dropped dimension: customer_id"),
            ("BOUNDARY_SHIFT", "b"),
            ("DISTINCT_DROP", "ignored"),
        ],
        "mutation_type string, description string",
    ).withColumn("metric_id", F.lit("m"))
    got = {(r["invariant"], r["suggestion"]): r["spots"] for r in RP.suggest_invariants(df).collect()}
    assert got == {
        ("population_required", "status = 'active'"): 2, ("population_required", "odd"): 1,
        ("grain_dimensions", "customer_id"): 1, ("boundary_rules", "b"): 1,
    }


def test_provenance(spark):
    docs = spark.createDataFrame(
        [
            ("a.yaml", "metric: m\nprovenance:\n  repository: org/r\n  reference_path: x.sql, y.sql\n  verified_symbols: [amount, zzz]\n"),
            ("b.yml", "# Provenance: u\n# Repository: org/r\nmodels:\n- columns:\n  - name: status\n    tests:\n    - accepted_values: {values: [open]}\n"),
            ("c.yml", "metric: m\n"),
            ("d.yml", "provenance: [broken"),
            ("e.yml", "# Provenance: u\n# Repository: org/none\n# Reference: q.sql\n"),
        ],
        "source_file string, text string",
    )
    files = spark.createDataFrame(
        [("org/r", "x.sql", "sum(amount)"), ("org/r", "z.yml", "status open")], "repository string, path string, content string"
    )
    rows = rows_by(PV.verify_claims(PV.extract_claims(docs), files), "source_file")
    assert set(rows) == {"a.yaml", "b.yml", "e.yml"}
    assert rows["a.yaml"]["verified_symbols"] == ["amount"] and rows["a.yaml"]["missing_symbols"] == ["zzz"]
    assert rows["b.yml"]["passed"] and rows["b.yml"]["verified_symbols"] == ["status", "open"]
    assert not rows["e.yml"]["file_exists"] and not rows["e.yml"]["passed"]


# --- scoring ----------------------------------------------------------------------------------


def test_accounting(spark):
    rows = [("m", True, False, [])] * 2 + [("m", False, True, [])] * 2 + [("m", False, False, ["x"])] * 4 + [("m", False, False, [])] * 2
    df = spark.createDataFrame(rows, "model string, runtime_error boolean, equivalent boolean, assertions_failed array<string>")
    score = first(scoring.catch_scores(scoring.classify(df), ["model"]))
    assert (score["generated"], score["equivalent"], score["unexecutable"], score["valid_defects"]) == (10, 2, 2, 6)
    assert (score["detected"], score["surviving"], score["effective_catch_pct"]) == (4, 2, 66.7)
    none = first(scoring.catch_scores(scoring.classify(df.where("equivalent")), ["model"]))
    assert none["valid_defects"] == 0 and none["effective_catch_pct"] is None


def test_grades_and_wilson(spark):
    df = spark.createDataFrame(
        [("a", 80.0, 60.0, 4, 25), ("b", 60.0, 40.0, 0, 0), ("c", 100.0, 39.9, 11, 18)],
        "model string, fixture_adequacy_pct double, contract_coverage_pct double, detected int, valid_defects int",
    )
    graded = scoring.grade(df).withColumns({"track": F.col("model"), "effective_catch_pct": F.lit(1.0)})
    rows = rows_by(graded, "model")
    assert [rows[m]["validity"] for m in "abc"] == ["CONCLUSIVE", "QUALIFIED", "INCONCLUSIVE"]
    tracks = rows_by(scoring.track_summary(graded), "track")
    assert (tracks["a"]["wilson_low_pct"], tracks["a"]["wilson_high_pct"]) == (6.4, 34.7)
    assert tracks["b"]["pooled_catch_pct"] is None and tracks["b"]["wilson_low_pct"] is None
    assert (tracks["c"]["pooled_catch_pct"], tracks["c"]["wilson_low_pct"]) == (61.1, 38.6)


def test_tiers(spark):
    ok = dict(syntax_ok=True, tier1_ok=True, project_ok=True, non_negative_ok=True, contract_ok=True, semantic_ok=True)
    df = spark.createDataFrame(
        [tuple(ok.values()) + (1.0,), tuple((ok | {"tier1_ok": False}).values()) + (3.0,)],
        ", ".join(f"{k} boolean" for k in ok) + ", latency_ms double",
    )
    tiers = rows_by(scoring.ladder(scoring.tier_verdicts(df)), "tier")
    assert [tiers[i]["caught"] for i in range(5)] == [0, 1, 1, 0, 0]
    assert tiers[1]["catch_rate_pct"] == 50.0 and tiers[0]["p50_ms"] == 2.0


def test_survivors(spark):
    df = spark.createDataFrame(
        [("ad_campaign_roas", "BOUNDARY_SHIFT"), ("other", "FILTER_DROP")], "model string, operator string"
    ).withColumn("classification", F.lit(scoring.SURVIVED))
    rows = rows_by(scoring.explain_survivors(df, scoring.survivor_taxonomy(spark)), "model")
    assert rows["ad_campaign_roas"]["root_cause_category"] == "MISSING_CONTRACT" and rows["other"]["severity"] is None
    assert scoring.explain_survivors(df, scoring.survivor_taxonomy(spark), "other").count() == 1


def test_claims_of_odd_shape_are_refused(spark):
    odd = {
        "symbols": "provenance: {repository: r, verified_symbols: abc}",
        "models": "# Provenance: x\n# Repository: r\nmodels: {a: 1}",
        "column": "# Provenance: x\n# Repository: r\nmodels: [{columns: [a]}]",
        "block": "provenance: [1]",
    }
    fine = {
        "header": "# Provenance: x\n# Repository: r\n# Reference: a, b\nmodels: [{columns: [{name: n, tests: [unique, {accepted_values: {values: [1, v]}}]}]}]",
        "no_yaml": "# Provenance: x\n# Repository: r\n{",
    }
    docs = spark.createDataFrame(list((odd | fine).items()), "source_file string, text string")
    assert {r["source_file"] for r in PV.refused_claims(docs).collect()} == set(odd)
    claims = rows_by(PV.extract_claims(docs), "source_file")
    assert set(claims) == set(fine) and claims["header"]["claimed_symbols"] == ["n", "1", "v"] and claims["header"]["reference_path"] == "a, b"
