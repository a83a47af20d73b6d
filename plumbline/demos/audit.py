"""Audit chains, replay of traces and provenance claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.demos import corpus, derived
from plumbline.demos.registry import demo
from plumbline.operators import audit as AU
from plumbline.operators import provenance as PV
from plumbline.operators import replay as RP
from plumbline.operators import scoring
from plumbline.operators.containment import occurrences
from plumbline.operators.governance import check_compliance, decide
from plumbline.operators.snapshots import SnapshotRegistry
from plumbline.session import scratch_path, stored
from plumbline.sources.tables import read_table as t

CHAIN = derived.AUDIT_CHAIN
SEGMENT = derived.AUDIT_SEGMENT


def _chain(spark, d):
    return AU.build_chain(derived.audit_events(spark, d), SEGMENT)


@demo(
    "au_event_hash",
    f"""
    WITH RECURSIVE {CHAIN}
    SELECT 'ev-' || ((seq - 1) * 4 + tn) AS event_id, sha256(head || repeat('0', 64) || tail) AS event_hash FROM parts
    """,
)
def au_event_hash(spark, d):
    events = derived.audit_events(spark, d).withColumn("previous_event_hash", F.lit(AU.GENESIS))
    return events.select("event_id", AU.event_hash().alias("event_hash"))


@demo(
    "au_chain_build",
    f"WITH RECURSIVE {CHAIN} SELECT 'tenant_' || tn AS tenant_id, seq AS sequence_num, prev AS previous_event_hash, hash AS event_hash FROM chain",
)
def au_chain_build(spark, d):
    return _chain(spark, d).select("tenant_id", "sequence_num", "previous_event_hash", "event_hash")


@demo(
    "au_segment_tails",
    f"""
    WITH RECURSIVE {CHAIN}
    SELECT 'tenant_' || tn AS tenant_id, seg AS segment, max(seq) AS sequence_end, arg_max(hash, seq) AS tail_hash, count(*) AS events FROM chain GROUP BY tn, seg
    """,
)
def au_segment_tails(spark, d):
    return AU.segment_tails(_chain(spark, d), SEGMENT)


def _roots_ctes(tails, key="tn", tenant="'tenant_' || tn"):
    """Each level folds up to a segment's worth of hashes of the level below, until one is left."""
    levels, below = [], f"(SELECT t.*, max(place) OVER (PARTITION BY {key}) AS last FROM ({tails}) t)"
    for level in range(4):
        start = f"sha256('level:{level}:' || {tenant} || ':' || (place // {SEGMENT}))"
        fold = f"list_reduce(list_prepend(any_value({start}), list(h ORDER BY place)), lambda a, b: sha256(a || b))"
        levels.append(
            f"l{level} AS (SELECT {key}, last // {SEGMENT} AS last, place // {SEGMENT} AS place, CASE WHEN last > 0 OR {level} = 0 THEN {fold} ELSE any_value(h) END AS h "
            f"FROM {below} GROUP BY {key}, last, place // {SEGMENT})"
        )
        below = f"l{level}"
    return ", ".join(levels)


def _roots_sql():
    tails = "SELECT tn, seg AS place, arg_max(hash, seq) AS h FROM chain GROUP BY tn, seg"
    return f"WITH RECURSIVE {CHAIN}, {_roots_ctes(tails)} SELECT 'tenant_' || tn AS tenant_id, h AS root_hash, 1::BIGINT AS roots FROM l3"


@demo("au_segment_roots", _roots_sql())
def au_segment_roots(spark, d):
    return AU.link_segments(AU.segment_tails(_chain(spark, d), SEGMENT), SEGMENT)


def _tampered(chain):
    """Changed decisions, re-hashed events, lost events and a repeated number."""
    number = F.col("sequence_num")
    edited = chain.withColumn("decision", F.when(number % 101 == 0, "ALLOWED").otherwise(F.col("decision")))
    rehashed = edited.withColumn("latency_ms", F.when(number % 103 == 0, F.lit(0.0)).otherwise(F.col("latency_ms"))).withColumn(
        "event_hash", F.when(number % 103 == 0, AU.event_hash()).otherwise(F.col("event_hash"))
    )
    return rehashed.where("sequence_num % 107 <> 0").withColumn(
        "copies", F.when(number % 109 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    ).select("*", F.explode("copies")).drop("copies", "col")


TAMPER = f"""
    {CHAIN},
    kept AS (SELECT * FROM chain WHERE seq % 107 <> 0),
    problems AS (
      SELECT k.tn, k.seq, CASE WHEN k.seq % 109 = 0 THEN 'duplicate_sequence' WHEN k.seq % 101 = 0 AND k.seq % 103 <> 0 THEN 'hash_mismatch'
             WHEN k.seq <> 1 AND p.seq IS NULL THEN 'missing_predecessor' WHEN k.pos <> 0 AND p.seq % 103 = 0 THEN 'broken_link' END AS problem
      FROM kept k LEFT JOIN kept p ON p.tn = k.tn AND p.seq = k.seq - 1)"""


@demo(
    "au_chain_verify",
    f"""
    WITH RECURSIVE {TAMPER}
    SELECT 'tenant_' || tn AS tenant_id, seq AS sequence_num, CASE WHEN seq % 109 = 0 THEN 2 ELSE 1 END::BIGINT AS rows, problem FROM problems WHERE problem IS NOT NULL
    """,
)
def au_chain_verify(spark, d):
    return AU.verify_chain(_tampered(stored(_chain(spark, d), "audit-chain")), SEGMENT)


# Two checkpoints for each tenant: one early, one at the end of the log.
EARLY = 50
CHECKPOINTS = f"""
    ends AS (SELECT tn, min(e) AS e FROM (SELECT tn, max(seq) AS e FROM chain GROUP BY tn UNION ALL SELECT tn, {EARLY} FROM chain) GROUP BY tn
             UNION SELECT tn, max(seq) FROM chain GROUP BY tn),
    cps AS (SELECT c.tn, e, arg_max(hash, seq) AS h, count(*) AS n FROM ends JOIN chain c ON c.tn = ends.tn AND c.seq <= e GROUP BY c.tn, e)"""


def _checkpoints(chain):
    early = AU.checkpoint(chain.where(F.col("sequence_num") <= EARLY), 1767225600.0, "key-1", SEGMENT)
    return AU.sign_checkpoints(early.unionByName(AU.checkpoint(chain, 1767225600.0, "key-1", SEGMENT)).distinct(), "demo key")


@demo(
    "au_checkpoint",
    f"""
    WITH RECURSIVE {TAMPER}, {CHECKPOINTS},
    held AS (SELECT c.tn, e, sum(CASE WHEN k.seq % 109 = 0 THEN 2 ELSE 1 END) AS rows,
                    count(*) FILTER (k.seq % 103 = 0) AS changed, count(*) FILTER (k.seq = e AND k.seq % 109 <> 0 AND k.seq % 103 <> 0) AS there
             FROM cps c JOIN kept k ON k.tn = c.tn AND k.seq <= e GROUP BY c.tn, e),
    bad AS (SELECT c.tn, e, count(*) AS b FROM cps c JOIN problems p ON p.tn = c.tn AND seq <= e WHERE problem IS NOT NULL GROUP BY c.tn, e)
    SELECT 'cp-tenant_' || c.tn || '-' || e AS checkpoint_id, e AS sequence_end, n AS total_events, h AS last_event_hash,
           there = 1 AS anchored, rows = n AS complete, b IS NULL AS chain_ok, there = 1 AND rows = n AND b IS NULL AS valid
    FROM cps c LEFT JOIN bad USING (tn, e) LEFT JOIN held USING (tn, e)
    """,
)
def au_checkpoint(spark, d):
    chain = stored(_chain(spark, d), "audit-chain")
    checked = AU.verify_checkpoints(_tampered(chain), _checkpoints(chain), "demo key", SEGMENT)
    return checked.select(
        "checkpoint_id", "sequence_end", "total_events", "last_event_hash", "anchored", "complete", "chain_ok", "valid"
    )


@demo(
    "au_checkpoint_signed",
    f"""
    WITH RECURSIVE {CHAIN}, {CHECKPOINTS}, {_roots_ctes("SELECT c.tn * 1000000000 + e AS tn, seg AS place, arg_max(hash, seq) AS h FROM cps c JOIN chain USING (tn) WHERE seq <= e GROUP BY 1, 2", "tn", "'tenant_' || (tn // 1000000000)")}
    SELECT 'cp-tenant_' || c.tn || '-' || e AS checkpoint_id, l.h AS root_hash, s AS signature_ok, TRUE AS root_ok, s AS valid
    FROM cps c JOIN l3 l ON l.tn = c.tn * 1000000000 + e, (VALUES (TRUE), (FALSE)) AS v(s)
    """,
)
def au_checkpoint_signed(spark, d):
    """With the signing key, and with another."""
    chain = stored(_chain(spark, d), "audit-chain")
    signed = stored(_checkpoints(chain), "signed")
    checked = [AU.verify_checkpoints(chain, signed, key, SEGMENT) for key in ("demo key", "other key")]
    return checked[0].unionByName(checked[1]).select("checkpoint_id", "root_hash", "signature_ok", "root_ok", "valid")


# A checkpoint after every fiftieth event of a tenant.
EVERY = 50
MANY = f"""
    ends AS (SELECT tn, seq AS e FROM chain WHERE seq % {EVERY} = 0),
    cps AS (SELECT c.tn, e, arg_max(hash, seq) AS h, count(*) AS n FROM ends JOIN chain c ON c.tn = ends.tn AND c.seq <= e GROUP BY c.tn, e)"""


def _many(chain):
    places = chain.where(F.col("sequence_num") % EVERY == 0).select("tenant_id", F.col("sequence_num").alias("sequence_end"))
    return AU.checkpoints_at(chain, places, 1767225600.0, "key-1", SEGMENT)


@demo(
    "au_checkpoints_at",
    f"""
    WITH RECURSIVE {CHAIN}, {MANY}, {_roots_ctes("SELECT c.tn * 1000000000 + e AS tn, seg AS place, arg_max(hash, seq) AS h FROM cps c JOIN chain USING (tn) WHERE seq <= e GROUP BY 1, 2", "tn", "'tenant_' || (tn // 1000000000)")}
    SELECT 'cp-tenant_' || c.tn || '-' || e AS checkpoint_id, c.h AS last_event_hash, n AS total_events, l.h AS root_hash
    FROM cps c JOIN l3 l ON l.tn = c.tn * 1000000000 + e
    """,
)
def au_checkpoints_at(spark, d):
    """Roots of many prefixes of one log, from one tree."""
    return _many(stored(_chain(spark, d), "audit-chain")).select("checkpoint_id", "last_event_hash", "total_events", "root_hash")


@demo(
    "au_checkpoint_many",
    f"""
    WITH RECURSIVE {TAMPER}, {MANY},
    held AS (SELECT c.tn, e, sum(CASE WHEN k.seq % 109 = 0 THEN 2 ELSE 1 END) AS rows,
                    count(*) FILTER (k.seq = e AND k.seq % 109 <> 0 AND k.seq % 103 <> 0) AS there
             FROM cps c JOIN kept k ON k.tn = c.tn AND k.seq <= e GROUP BY c.tn, e),
    bad AS (SELECT c.tn, e, count(*) AS b FROM cps c JOIN problems p ON p.tn = c.tn AND seq <= e WHERE problem IS NOT NULL GROUP BY c.tn, e)
    SELECT 'cp-tenant_' || c.tn || '-' || e AS checkpoint_id, there = 1 AS anchored, rows = n AS complete, b IS NULL AS chain_ok,
           there = 1 AND rows = n AND b IS NULL AS valid
    FROM cps c LEFT JOIN bad USING (tn, e) LEFT JOIN held USING (tn, e)
    """,
)
def au_checkpoint_many(spark, d):
    chain = stored(_chain(spark, d), "audit-chain")
    taken = AU.sign_checkpoints(_many(chain), "demo key")
    checked = AU.verify_checkpoints(_tampered(chain), taken, "demo key", SEGMENT)
    return checked.select("checkpoint_id", "anchored", "complete", "chain_ok", "valid")


@demo(
    "au_truncated",
    f"""
    WITH RECURSIVE {CHAIN}, {CHECKPOINTS}, gone AS (SELECT tn, max(seq) AS top FROM chain GROUP BY tn)
    SELECT 'cp-tenant_' || c.tn || '-' || e AS checkpoint_id, NOT (e BETWEEN 33 AND 64 OR e > top - 5) AS anchored, e < 33 AS complete, e < 33 AS root_ok,
           e <= 64 AS chain_ok, e < 33 AS valid
    FROM cps c JOIN gone USING (tn)
    """,
)
def au_truncated(spark, d):
    """The second half of the first segment and the end of the log are gone."""
    chain = stored(_chain(spark, d), "audit-chain")
    # one row a tenant: stored, it is known to be small, and the chain is not moved by tenant to meet it
    top = stored(chain.groupBy("tenant_id").agg(F.max("sequence_num").alias("top")), "tops")
    cut = chain.join(top, "tenant_id").where("NOT (sequence_num BETWEEN 33 AND 64 OR sequence_num > top - 5)").drop("top")
    return AU.verify_checkpoints(cut, _checkpoints(chain), "demo key", SEGMENT).select(
        "checkpoint_id", "anchored", "complete", "root_ok", "chain_ok", "valid"
    )


@demo(
    "au_rewritten",
    f"""
    WITH RECURSIVE {CHAIN}, {CHECKPOINTS}
    SELECT 'cp-tenant_' || tn || '-' || e AS checkpoint_id, e > {SEGMENT} AS anchored, TRUE AS complete, FALSE AS root_ok, TRUE AS chain_ok, FALSE AS valid FROM cps
    """,
)
def au_rewritten(spark, d):
    """One latency in the first segment is changed and the segment hashed again from there: only the signed root tells."""
    chain = stored(_chain(spark, d), "audit-chain")
    first = chain.where(F.col("sequence_num") <= SEGMENT)
    changed = first.withColumn("latency_ms", F.when(F.col("sequence_num") == 7, F.col("latency_ms") + 1e-10).otherwise(F.col("latency_ms")))
    forged = AU.build_chain(changed, SEGMENT).unionByName(chain.where(F.col("sequence_num") > SEGMENT))
    return AU.verify_checkpoints(forged, _checkpoints(chain), "demo key", SEGMENT).select(
        "checkpoint_id", "anchored", "complete", "root_ok", "chain_ok", "valid"
    )


# --- replay ----------------------------------------------------------------------------------------


def traces(spark, d):
    """Decided requests as traces; some carry no SQL."""
    decided = decide(check_compliance(derived.query_log(spark, d), derived.rules(spark, d)))
    return decided.select(
        F.concat(F.lit("trace-"), "request_id").alias("trace_id"),
        "agent_id",
        "metric_id",
        F.when(F.col("k") % 29 != 0, F.col("sql")).alias("sql"),
        "decision",
        "k",
        "ts",
    )


TRACES = (
    derived.VIOLATIONS
    + """,
    per AS (SELECT request_id, bool_or(severity = 'CRITICAL') AS err FROM violations GROUP BY 1),
    traces AS (SELECT 'trace-' || q.request_id AS trace_id, agent_id, metric_id, k,
                      CASE WHEN metric_id = 'error' THEN 'DENY' WHEN err IS NULL THEN 'ALLOW' WHEN err THEN 'DENY' ELSE 'AUDIT' END AS decision
               FROM query_log q LEFT JOIN per USING (request_id)),
    selected AS (SELECT * FROM traces WHERE decision IN ('ALLOW', 'AUDIT') AND k % 29 <> 0)"""
)


@demo("rp_select", f"WITH {TRACES} SELECT trace_id, decision FROM selected")
def rp_select(spark, d):
    return RP.select_traces(traces(spark, d)).select("trace_id", "decision")


@demo(
    "rp_sample",
    f"""
    WITH {TRACES}
    SELECT trace_id, agent_id, metric_id FROM traces
    WHERE ('0x' || md5(trace_id)[1:15])::BIGINT < 1152921504606846976 * CASE WHEN agent_id = 'agent_1' AND metric_id = 'purchase' THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END
    """,
)
def rp_sample(spark, d):
    sampled = RP.sample_traces(traces(spark, d), 0.2, {("agent_1", "purchase"): 0.9})
    return sampled.select("trace_id", "agent_id", "metric_id")


@demo(
    "rp_sample_exact",
    f"""
    WITH {TRACES},
    ranked AS (SELECT trace_id, agent_id, metric_id, row_number() OVER (PARTITION BY agent_id, metric_id ORDER BY ('0x' || md5(trace_id)[1:15])::BIGINT, trace_id) AS n FROM traces)
    SELECT trace_id, agent_id, metric_id FROM ranked WHERE n <= CASE WHEN agent_id = 'agent_1' AND metric_id = 'purchase' THEN 40 ELSE 15 END
    """,
)
def rp_sample_exact(spark, d):
    sampled = RP.sample_exact(traces(spark, d), 15, {("agent_1", "purchase"): 40})
    return sampled.select("trace_id", "agent_id", "metric_id")


@demo(
    "rp_suite",
    """
    WITH kinds AS (SELECT DISTINCT event_type AS m FROM events WHERE event_type <> 'error')
    SELECT m AS metric_id, 'population' AS type, 'status = ''active''' AS argument FROM kinds
    UNION ALL SELECT m, 'population', 'region = ''NA''' FROM kinds WHERE m = 'purchase'
    UNION ALL SELECT m, 'metric_value', 'min_value=0' FROM kinds
    """,
)
def rp_suite(spark, d):
    return RP.suite_specs(derived.rules(spark, d))


def snapshot_registry(spark, d):
    """Snapshots of the events as they stood on some days, registered for every metric but ``error``."""
    registry = SnapshotRegistry(spark, scratch_path(spark, "snapshots"))
    events = t(spark, d, "events")
    for name, taken in corpus.SNAPSHOTS:
        registry.write(name, {"events": events.where(F.col("ts") < F.lit(taken))})
        registry.register({kind: ["events"] for kind in corpus.REPLAYED}, name, taken)
    return registry


def replayed(spark, d):
    metrics = {
        kind: RP.Replayable(corpus.event_metric(kind), "events", RP.suite_for(kind, [corpus.REQUIRED], "events", "user_id", "total"))
        for kind in corpus.REPLAYED
    }
    return RP.replay(traces(spark, d), snapshot_registry(spark, d), metrics)


@demo(
    "rp_blindspots",
    f"""
    WITH {TRACES}, {corpus.REPLAY}
    SELECT trace_id, metric_id, snapshot_id, CASE WHEN snapshot_id IS NULL THEN 'no_snapshot' ELSE 'replayed' END AS status,
           effective_catch_pct, valid_defects, undetected_defects, undetected_defects > 0 AS contract_underspecified
    FROM placed LEFT JOIN spots USING (metric_id, snapshot_id)
    """,
)
def rp_blindspots(spark, d):
    return replayed(spark, d)[0]


SPOTS = f"""
    {derived.EVALUATIONS},
    spots AS (
      SELECT model AS metric_id, operator, CASE operator WHEN 'FILTER_DROP' THEN CASE WHEN flag = 'A' THEN 'cut a conjunct' ELSE 'status = ''' || flag || '''' END
                   WHEN 'GRAIN_DROP' THEN 'dim_' || flag WHEN 'AGGREGATION_SWAP' THEN 'swap ' || flag WHEN 'MATH_OPERATOR_INVERT' THEN 'invert'
                   WHEN 'BOUNDARY_SHIFT' THEN 'shift ' || flag END AS suggestion,
             CASE operator WHEN 'FILTER_DROP' THEN 'population_required' WHEN 'GRAIN_DROP' THEN 'grain_dimensions' WHEN 'AGGREGATION_SWAP' THEN 'aggregation_review_needed'
                   WHEN 'MATH_OPERATOR_INVERT' THEN 'aggregation_review_needed' WHEN 'BOUNDARY_SHIFT' THEN 'boundary_rules' END AS invariant
      FROM evaluations WHERE suite = 'semantic' AND classification = 'VALID_DEFECT_SURVIVED')"""


@demo(
    "rp_suggest",
    f"WITH {SPOTS} SELECT metric_id, invariant, suggestion, count(*) AS spots FROM spots WHERE invariant IS NOT NULL GROUP BY ALL",
)
def rp_suggest(spark, d):
    survivors = RP.surviving_spots(scoring.classify(derived.evaluations(spark, d)).where("suite = 'semantic'"))
    fault, flag = F.col("operator"), F.col("flag")
    description = (
        F.when((fault == "FILTER_DROP") & (flag == "A"), "cut a conjunct")
        .when(fault == "FILTER_DROP", F.concat(F.lit("DROPPED predicate:  status = '"), flag, F.lit("'")))
        .when(fault == "GRAIN_DROP", F.concat(F.lit("Drop GROUP BY dimension: dim_"), flag))
        .when(fault == "AGGREGATION_SWAP", F.concat(F.lit("swap "), flag))
        .when(fault == "MATH_OPERATOR_INVERT", "invert")
        .otherwise(F.concat(F.lit("shift "), flag))
    )
    spots = survivors.select(F.col("model").alias("metric_id"), fault.alias("mutation_type"), description.alias("description"))
    return RP.suggest_invariants(spots)


# --- provenance ------------------------------------------------------------------------------------


def _documents(spark, d):
    """A contract document per page: a structured block, a comment header, or neither."""
    page = F.col("page_id")
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    # the block names two texts: one every page has, and one few have
    block = F.concat(
        F.lit("metric: m\nprovenance:\n  repository: "), host, F.lit("\n  reference_path: page/"), page,
        F.lit(", page/none\n  verified_symbols: [html, number"), page % 100, F.lit("]\n"),
    )
    header = F.concat(
        F.lit("# Provenance: upstream\n# Repository: "), host,
        F.lit("\nmodels:\n  - name: m\n    columns:\n      - name: body\n      - name: number"), page % 100,
        F.lit("\n        tests:\n          - accepted_values:\n              values: [div]\n"),
    )
    text = F.when(page % 3 == 0, block).when(page % 3 == 1, header).otherwise("metric: m\n")
    return t(spark, d, "pages").select(F.concat(F.lit("doc/"), page).alias("source_file"), text.alias("text"))


def _files(spark, d):
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return t(spark, d, "pages").where("page_id % 7 <> 0").select(
        host.alias("repository"), F.concat(F.lit("page/"), "page_id").alias("path"), F.col("html").alias("content")
    )


CLAIMS = """
    hosts AS (SELECT page_id, html, split_part(split_part(url, '//', 2), '/', 1) AS repository FROM pages),
    claims AS (
      SELECT 'doc/' || page_id AS source_file, repository, 'page/' || page_id || ', page/none' AS reference_path, page_id,
             ['html', 'number' || (page_id % 100)] AS symbols FROM hosts WHERE page_id % 3 = 0
      UNION ALL
      SELECT 'doc/' || page_id, repository, NULL, page_id, ['body', 'number' || (page_id % 100), 'div'] FROM hosts WHERE page_id % 3 = 1)"""


@demo("pv_claims", f"WITH {CLAIMS} SELECT source_file, repository, reference_path, array_to_string(symbols, ',') AS claimed_symbols FROM claims")
def pv_claims(spark, d):
    claims = PV.extract_claims(_documents(spark, d))
    return claims.select(
        "source_file", "repository", "reference_path", F.array_join("claimed_symbols", ",").alias("claimed_symbols")
    )


@demo(
    "pv_verify",
    f"""
    WITH {CLAIMS},
    files AS (SELECT repository, page_id, html FROM hosts WHERE page_id % 7 <> 0),
    meets AS (SELECT c.*, (SELECT count(*) FROM files f WHERE f.repository = c.repository AND (c.reference_path IS NULL OR f.page_id = c.page_id)) > 0 AS file_exists FROM claims c),
    each AS (SELECT source_file, unnest(symbols) AS s, generate_subscripts(symbols, 1) AS i FROM claims),
    found AS (SELECT DISTINCT e.source_file, e.s FROM each e JOIN claims c USING (source_file)
              JOIN files f ON f.repository = c.repository AND (c.reference_path IS NULL OR f.page_id = c.page_id) WHERE contains(f.html, e.s))
    SELECT e.source_file, any_value(m.file_exists) AS file_exists,
           coalesce(string_agg(e.s, ',' ORDER BY i) FILTER (WHERE f.s IS NOT NULL), '') AS verified_symbols,
           coalesce(string_agg(e.s, ',' ORDER BY i) FILTER (WHERE f.s IS NULL), '') AS missing_symbols,
           any_value(m.file_exists) AND count(*) FILTER (WHERE f.s IS NULL) = 0 AS passed
    FROM each e JOIN meets m USING (source_file) LEFT JOIN found f ON f.source_file = e.source_file AND f.s = e.s GROUP BY 1
    """,
)
def pv_verify(spark, d):
    verified = PV.verify_claims(stored(PV.extract_claims(_documents(spark, d)), "claims"), _files(spark, d))
    return verified.select(
        "source_file",
        "file_exists",
        F.array_join("verified_symbols", ",").alias("verified_symbols"),
        F.array_join("missing_symbols", ",").alias("missing_symbols"),
        "passed",
    )


@demo(
    "pv_symbol_corpus",
    """
    WITH symbols AS (SELECT DISTINCT substr(text, 1 + 24 * i::INTEGER, (12 + (doc_id + i) % 4)::INTEGER) AS symbol
                     FROM (SELECT doc_id, text, unnest(range(0, length(text) // 24)) AS i FROM documents)),
         places AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents),
         windows AS (SELECT doc_id, substr(text, i::INTEGER, n::INTEGER) AS symbol FROM places CROSS JOIN range(12, 16) AS r(n) WHERE i + n <= length(text) + 1)
    SELECT symbol, count(DISTINCT doc_id) AS documents FROM windows SEMI JOIN symbols USING (symbol) GROUP BY 1
    """,
)
def pv_symbol_corpus(spark, d):
    """Every 24th place of each text gives a symbol; in how many documents does each occur?"""
    documents = t(spark, d, "documents")
    # pieces of 24 characters in one pass over the text: a place far behind costs no more than the first
    pieces = documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{24}"), F.lit(0))).alias("i", "piece"))
    symbols = pieces.select(F.substr("piece", F.lit(1), (12 + (F.col("doc_id") + F.col("i")) % 4).cast("int")).alias("symbol"))
    return occurrences(symbols, documents, count="doc_id").withColumnRenamed("n", "documents")


@demo(
    "jn_symbol",
    """
    WITH c AS (SELECT item_id, item_id AS doc_id, list_distinct(string_split(text, ' ')) AS symbols FROM benchmark),
         e AS (SELECT item_id, doc_id, unnest(symbols) AS s FROM c)
    SELECT e.item_id, count(*) AS claimed, count(*) FILTER (WHERE contains(d.text, e.s)) AS found, bool_or(d.doc_id IS NOT NULL) AS file_exists
    FROM e LEFT JOIN documents d ON d.doc_id = e.doc_id GROUP BY 1
    """,
)
def jn_symbol(spark, d):
    claims = t(spark, d, "benchmark").select(
        "item_id", F.col("item_id").alias("doc_id"), F.array_distinct(F.split("text", " ")).alias("symbols")
    )
    found = PV.find_symbols(claims, t(spark, d, "documents"), on="doc_id")
    return found.select(
        "item_id", F.size("symbols").cast("bigint").alias("claimed"), F.size("found").cast("bigint").alias("found"), "file_exists"
    )
