"""State changes, evidence, drafts, retrieval, review and investigations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.catalog.bank import SQL as BANK_SQL
from ledgerwatch.catalog.registry import Registry
from ledgerwatch.operators import drafts, evidence, governance, retrieval, state
from ledgerwatch.plans import questions
from ledgerwatch.operators.search_index import SearchIndex
from ledgerwatch.plans.workspace import Workspace
from ledgerwatch.session import shared_dir
from ledgerwatch.sources import export

_FINDINGS = (
    "finding_id; alert_id; account_id; customer_id; finding_type; severity; risk_score:d; finding_status; summary; evidence_count:i; confidence:d; "
    "created_at:t; updated_at:t"
)
_FINDING_COLS = [c.split(":")[0] for c in _FINDINGS.split("; ")]
_EVIDENCE = (
    "finding_id; alert_id; account_id; customer_id; evidence_id; evidence_type; source_object; source_record_id; evidence_text; policy_id; rule_id; "
    "confidence:d; event_ts:t"
)
_EVIDENCE_COLS = [c.split(":")[0] for c in _EVIDENCE.split("; ")]


def insert_listed(w: Workspace) -> DataFrame:
    """Ground-truth rows for listed customers whose account has none yet."""
    listed = (
        w.accounts.where("account_type <> 'LOAN'")
        .join(w.watchlist.select(F.col("matched_customer_id").alias("customer_id")), "customer_id", "left_semi")
        .select("account_id", "customer_id", F.lit("LISTED").alias("scenario"))
    )
    return state.insert_if_absent(w.scenarios, listed, ["account_id"])


def reprofile_mules(w: Workspace) -> DataFrame:
    """Give every known mule the profile of a new low-income student."""
    mules = w.scenarios.where("scenario = 'MULE'").select("customer_id")
    return state.joined_update(
        w.customers, mules, ["customer_id"],
        {
            "onboarded_date": F.lit("2026-06-15").cast("date"), "occupation": F.lit("Student"),
            "declared_annual_income": F.lit(180000), "kyc_risk_rating": F.lit("HIGH"),
        },
    )


def bundle_facts(w: Workspace) -> DataFrame:
    bundles = evidence.evidence_bundles(w.alerts, w.signals, w.transactions, w.t)
    txns = F.col("transactions")
    return bundles.select(
        "alert_id", "city", "watchlist_hit", F.coalesce(F.size(txns), F.lit(0)).alias("n_txns"),
        F.transform(txns, lambda x: x["txn_id"]).alias("txn_ids"),
        F.aggregate(txns, F.lit(0).cast("decimal(38,2)"), lambda acc, x: (acc + x["amount_inr"]).cast("decimal(38,2)")).alias("amount_inr"),
    )


def retrieved(w: Workspace, index: SearchIndex | None = None, **attributes: str) -> DataFrame:
    hits = (index or w.search_index).search(retrieval.alert_queries(w.alerts), retrieval.alert_vocabulary(), bounded=True, **attributes)
    return hits.select(F.col("query_id").alias("query_text"), "section", "rank", "score")


def refreshed_search(w: Workspace, batches: int = 3) -> DataFrame:
    """The search over an index that was appended in batches.

    Documents are dealt to the batches by a hash. Those of the first come there in an earlier edition
    with other words and title, and in the last as they are.
    """
    index = SearchIndex(w.spark, shared_dir(w.spark, "search-refresh"))
    part = F.pmod(F.xxhash64("section"), F.lit(batches))
    for i in range(batches):
        mine = w.policy_docs.where(part == i)
        if i == 0:
            mine = mine.withColumn("chunk_text", F.concat(F.lit("money mule filing "), F.reverse("chunk_text"))).withColumn("doc_title", F.lit("earlier"))
        if i == batches - 1:
            mine = mine.unionByName(w.policy_docs.where(part == 0))
        index.append(mine, i)
    return retrieved(w, index)


def nearest_to_centre(w: Workspace) -> DataFrame:
    corpus = w.given("embeddings")
    return retrieval.nearest_vectors(corpus, retrieval.centroid(corpus).scalar(), 10)


def _triage(w: Workspace, max_drafts: int) -> tuple[DataFrame, DataFrame]:
    """What a run chooses, and the cases that it drafts."""
    chosen = governance.triage_selection(w.alerts, w.cases, max_drafts)
    requests = chosen.select(
        "alert_id", F.lit("task").alias("requested_by"), w.t.now.alias("requested_at"), F.lit(None).cast("string").alias("note")
    )
    return chosen, drafts.generate_drafts(requests, w.alerts, w.signals, w.transactions, w.search_index, w.t).cases


def triage_run(w: Workspace, max_drafts: int = 3) -> DataFrame:
    chosen, cases = _triage(w, max_drafts)
    return governance.triage_summary(chosen, cases, w.lcr_daily)


def triage_record(w: Workspace, max_drafts: int = 3) -> DataFrame:
    chosen, cases = _triage(w, max_drafts)
    return governance.triage_event(chosen, cases, w.lcr_daily, w.t.now)


def package_facts(w: Workspace) -> DataFrame:
    return governance.audit_packages(w.findings, w.evidence, w.t.now).select(
        "finding_id", "package_type", "generated_at", F.col("finding.severity").alias("severity"),
        F.col("finding.risk_score").alias("risk_score"), F.col("finding.status").alias("status"), F.size("evidence").alias("n_evidence"),
        F.transform("evidence", lambda e: e["type"]).alias("types"), F.transform("evidence", lambda e: e["text"]).alias("texts"),
    )


def validated(w: Workspace) -> DataFrame:
    unknown = w.given("customer").where("c_custkey % 100 = 9").select(F.expr("concat('FND-UNKNOWN-', c_custkey)").alias("finding_id"))
    return governance.validate_findings(w.findings.select("finding_id").unionByName(unknown), w.findings, w.evidence)


def register(reg: Registry) -> None:
    reg.add(
        "io6", insert_listed, "account_id; customer_id; 'LISTED' AS scenario",
        "FROM accounts WHERE account_type <> 'LOAN' AND customer_id IN (SELECT matched_customer_id FROM watchlist) "
        "AND account_id NOT IN (SELECT account_id FROM scenarios)",
    )
    mule = "customer_id IN (SELECT customer_id FROM scenarios WHERE scenario = 'MULE')"
    reg.add(
        "io7", reprofile_mules,
        f"customer_id; full_name; segment; CASE WHEN {mule} THEN 'HIGH' ELSE kyc_risk_rating END AS kyc_risk_rating; city; is_pep; "
        f"CASE WHEN {mule} THEN DATE '2026-06-15' ELSE onboarded_date END AS onboarded_date:y; "
        f"CASE WHEN {mule} THEN 'Student' ELSE occupation END AS occupation; "
        f"CASE WHEN {mule} THEN 180000 ELSE declared_annual_income END AS declared_annual_income:i",
        "FROM customers",
    )
    reg.add("io10", lambda w: w.compute_findings().select(_FINDING_COLS), _FINDINGS, "FROM risk_findings")
    reg.add(
        "io13", lambda w: export.parsed_back(export.json_records(w.recent_high_risk)),
        "txn_id; customer_id; amount_inr:d; risk_score:i; len(evidence_flags) AS n_flags:i", "FROM recent_high_risk",
    )
    reg.add(
        "e1", lambda w: evidence.finding_changes(w.alerts),
        "alert_id; account_id; customer_id; finding_type; severity; risk_score:d; summary; evidence_count:i; confidence:d; event_ts:t", "FROM finding_changes",
    )
    reg.add("e2", lambda w: w.compute_new_evidence().select(_EVIDENCE_COLS), _EVIDENCE, "FROM new_evidence")
    reg.add(
        "e3", lambda w: evidence.case_summary(governance.investigation_rows(w.investigation_outcomes), w.findings),
        "o.finding_id; o.case_id; o.alert_id; o.account_id; o.customer_id; 'FRAUD_RISK_INVESTIGATION' AS case_type; upper(priority) AS priority; "
        "'OPEN' AS status; o.summary; n_evidence AS evidence_count:i; 'investigator_1' AS created_by; requested_at AS created_at:t; f.risk_score:d; "
        "f.severity; f.finding_type",
        "FROM investigation_outcomes o LEFT JOIN risk_findings f ON f.finding_id = o.finding_id WHERE o.status = 'SUCCESS'",
    )
    reg.add(
        "e4", bundle_facts,
        "a.alert_id; s.city; s.watchlist_hit; count(x.txn_id) AS n_txns:i; string_agg(x.txn_id, '; ' ORDER BY x.txn_ts, x.txn_id) AS txn_ids; "
        "sum(x.amount_inr) AS amount_inr:d",
        "FROM fraud_alerts a JOIN account_signals s ON s.account_id = a.account_id LEFT JOIN alert_txns x ON x.alert_id = a.alert_id GROUP BY ALL",
    )
    reg.add("e5", retrieved, "query_text; section; rank:i; score:d", "FROM library_hits")
    reg.add("st2_search", refreshed_search, "query_text; section; rank:i; score:d", "FROM library_hits")
    reg.add("e5_domain", lambda w: retrieved(w, domain="AML"), "query_text; section; rank:i; score:d", "FROM domain_hits")
    reg.add(
        "e5_vectors", nearest_to_centre, "vec_id:i; cosine:d",
        "FROM (SELECT vec_id, round(list_inner_product(v, c) / sqrt(list_inner_product(v, v) * list_inner_product(c, c)), 6) AS cosine "
        "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
        "(SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(CAST(x AS DOUBLE)) AS m FROM "
        "(SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos))) z ORDER BY z.cosine DESC, z.vec_id LIMIT 10",
    )
    guard = lambda name: F.col(f"guardrail_result.{name}")
    reg.add(
        "e6", lambda w: w.drafts.cases.select(
            "case_id", guard("passed").alias("passed"), guard("unverified_citations").alias("unverified"),
            guard("retrieved_sections").alias("retrieved"), F.array_sort(guard("cited_sections")).alias("cited"), guard("confidence").alias("confidence"),
            guard("human_review_required").alias("human_review_required")),
        "case_id; passed; bad AS unverified:a; allowed AS retrieved:a; cited:a; CASE WHEN red_flag_count >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence; "
        "true AS human_review_required",
        "FROM new_cases",
    )
    reg.add(
        "e7", lambda w: w.drafts.cases.select(
            "case_id", "alert_id", "account_id", "typology", "risk_score", "status", "action_taken", "sar_draft", "missing_docs", "created_by", "created_at"),
        "case_id; alert_id; account_id; typology; risk_score:i; status; action_taken; sar_draft; missing_docs:a; created_by; created_at:t", "FROM new_cases",
    )
    reg.add(
        "e8", lambda w: w.drafts.rejected,
        "alert_id; requested_by; requested_at:t; 'ERROR' AS status; 'Alert ' || alert_id || ' not found. No report generated.' AS message",
        "FROM draft_requests WHERE alert_id NOT IN (SELECT alert_id FROM fraud_alerts)",
    )

    reg.add("k1", questions.QUESTIONS["b44"].build, *BANK_SQL["b44"])
    reg.add(
        "g1", lambda w: governance.queue_kpis(w.alerts),
        "count(*) AS open_alerts:i; count(*) FILTER (recommended_action = 'FREEZE_ACCOUNT') AS critical_freeze:i; "
        "round(CAST(sum(outflow_amt_48h) AS DOUBLE) / 1e5, 1) AS outflow_at_risk_lakh:d; round(avg(risk_score)) AS avg_risk_score:d",
        "FROM fraud_alerts",
    )
    due = "risk_score >= 60 AND alert_id NOT IN (SELECT alert_id FROM cases)"
    reg.add(
        "g2", lambda w: governance.triage_selection(w.alerts, w.cases, 50), "alert_id; account_id; risk_score:i",
        f"FROM fraud_alerts a WHERE {due} ORDER BY a.risk_score DESC, alert_id LIMIT 50",
    )
    reg.add(
        "g2_run", triage_run,
        f"least(3, (SELECT count(*) FROM fraud_alerts WHERE {due})) AS drafted:i; (SELECT count(*) FROM (SELECT account_id FROM fraud_alerts WHERE {due} ORDER BY risk_score DESC, alert_id LIMIT 3) ANTI JOIN account_signals USING (account_id)) AS failed:i; as_of_date AS as_of:y; lcr_pct:d; lcr_status; lcr_stress_s1_pct AS stress_s1:d",
        "FROM latest_lcr",
    )
    reg.add(
        "g2_event", triage_record, "(SELECT t FROM ref_ts) AS event_ts:t; 'task' AS event_user; 'SYSTEM' AS event_role; 'AUTO_TRIAGE_RUN' AS event_type; 'TASK' AS object_id; "
        "CAST(json_object('drafted', ifnull((SELECT list(json_object('alert', alert_id, 'case', 'CASE-' || account_id || '-' || strftime(requested_at, '%Y%m%d%H%M%S'), "
        "'guardrail_passed', len(bad) = 0) ORDER BY risk_score DESC, alert_id) FROM run_checked), []), "
        "'failed', ifnull((SELECT list(json_object('alert', alert_id, 'error', 'no case was drafted') ORDER BY risk_score DESC, alert_id) "
        "FROM run_requests ANTI JOIN run_checked USING (alert_id)), []), "
        "'lcr', json_object('as_of', CAST(as_of_date AS VARCHAR), 'lcr_pct', lcr_pct, 'status', lcr_status, 'stress_s1', lcr_stress_s1_pct)) AS VARCHAR) AS details",
        "FROM latest_lcr",
    )
    reg.add(
        "g1_queue", lambda w: governance.alert_queue(w.alerts, ["AML_LAYERING", "MONEY_MULE"]),
        "alert_id; account_id; full_name; typology; risk_score:i; recommended_action; red_flag_count:i; inflow_amt_48h:d; outflow_amt_48h:d; kyc_risk_rating; occupation",
        "FROM fraud_alerts WHERE typology = 'AML_LAYERING' OR typology = 'MONEY_MULE'",
    )
    reg.add(
        "g4_actions", lambda w: governance.investigation_actions(w.investigation_outcomes).drop("error_message"),
        "'ACT-' || substr(sha256(case_id || '|' || request_id), 1, 32) AS action_id; case_id; finding_id; 'CREATE_INVESTIGATION' AS action_type; "
        "'WAREHOUSE' AS target_system; 'investigator_1' AS requested_by; requested_at:t; 'SUCCESS' AS status; "
        "CAST(json_object('case_id', case_id, 'evidence_count', n_evidence) AS VARCHAR) AS result",
        "FROM investigation_outcomes o WHERE o.status = 'SUCCESS'",
    )
    reg.add(
        "g3", lambda w: w.second_reviews,
        "decision_id; case_id; decision; reviewer; reviewer_role; decided_at:t; notes; maker; status; message; new_status; missing_notes", "FROM reviewed",
    )
    reg.add(
        "g4", lambda w: w.investigation_outcomes,
        "request_id; finding_id; status; message; case_id; alert_id; account_id; customer_id; "
        "CASE WHEN status = 'SUCCESS' THEN 'FRAUD_RISK_INVESTIGATION' END AS case_type; CASE WHEN status = 'SUCCESS' THEN upper(priority) END AS priority; "
        "summary; CASE WHEN status = 'SUCCESS' THEN n_evidence END AS evidence_count:i; 'investigator_1' AS requested_by; requested_at:t",
        "FROM investigation_outcomes",
    )
    reg.add(
        "g5", package_facts,
        "f.finding_id; 'AUDIT_READY_RISK_FINDING' AS package_type; (SELECT t FROM ref_ts) AS generated_at:t; f.severity; f.risk_score:d; f.finding_status AS status; "
        "count(e.evidence_id) AS n_evidence:i; coalesce(string_agg(e.evidence_type, '; ' ORDER BY e.evidence_id), '') AS types; "
        "coalesce(string_agg(e.evidence_text, '; ' ORDER BY e.evidence_id), '') AS texts",
        "FROM risk_findings f LEFT JOIN risk_evidence e ON e.finding_id = f.finding_id GROUP BY f.finding_id, f.severity, f.risk_score, f.finding_status",
    )
    reg.add(
        "g6", lambda w: governance.high_risk_findings(w.findings, 50),
        "finding_id; alert_id; account_id; customer_id; finding_type; severity; risk_score:d; summary; evidence_count:i; confidence:d; created_at:t",
        "FROM risk_findings f WHERE f.risk_score >= 60 ORDER BY f.risk_score DESC, f.created_at DESC, finding_id LIMIT 50",
    )
    reg.add("g7", lambda w: governance.evidence_chain(w.evidence).drop("regulation_id"), _EVIDENCE, "FROM risk_evidence")
    reg.add(
        "g8", validated,
        "r.finding_id; CASE WHEN f.finding_id IS NULL THEN 'ERROR' WHEN f.risk_score < 60 OR n > 0 THEN 'VALID' ELSE 'INSUFFICIENT_EVIDENCE' END AS status; "
        "CASE WHEN f.finding_id IS NULL THEN 'FINDING_NOT_FOUND' END AS message; f.risk_score:d; CASE WHEN f.finding_id IS NOT NULL THEN n END AS evidence_count:i; "
        "CASE WHEN f.finding_id IS NOT NULL THEN true END AS human_review_required",
        "FROM (SELECT finding_id, (SELECT count(*) FROM risk_evidence e WHERE e.finding_id = q.finding_id) AS n FROM (SELECT finding_id FROM risk_findings "
        "UNION ALL SELECT 'FND-UNKNOWN-' || c_custkey FROM customer WHERE c_custkey % 100 = 9) q) r LEFT JOIN risk_findings f ON f.finding_id = r.finding_id",
    )
    reg.add(
        "g9", lambda w: governance.notification_requests(
            governance.investigation_rows(w.investigation_outcomes), F.concat(F.lit("Please look at "), "case_id"), "investigator_1"
        ).drop("finding_id", "error_message"),
        "'ACT-' || substr(sha256(case_id), 1, 32) AS action_id; case_id; 'NOTIFY_FRAUD_TEAM' AS action_type; 'CHAT' AS target_system; "
        "'investigator_1' AS requested_by; requested_at:t; 'PENDING' AS status; CAST(json_object('message', 'Please look at ' || case_id) AS VARCHAR) AS result",
        "FROM investigation_outcomes o WHERE o.status = 'SUCCESS'",
    )
    reg.add(
        "g10", lambda w: governance.latest_events(w.audit_log, 150), "event_ts:t; event_user; event_role; event_type; object_id; details",
        "FROM audit_log g ORDER BY g.event_ts DESC, object_id, event_type LIMIT 150",
    )
