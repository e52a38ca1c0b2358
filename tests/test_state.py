"""State changes, snapshots, reviews, investigations."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerwatch.operators import checks, governance, state

T = dt.datetime(2026, 9, 28, 12, 0)
DEC = "decision_id string, case_id string, decision string, notes string, reviewer string, reviewer_role string, decided_at timestamp_ntz"


def test_merge_keeps_and_updates(spark):
    target = spark.createDataFrame([(1, "a", "OPEN", 10), (2, "b", "CLOSED", 20), (3, "c", "OPEN", 30)], "k int, v string, status string, made int")
    source = spark.createDataFrame([(2, "B"), (3, None), (4, "D")], "k int, v string")
    merged = state.merge_snapshot(target, source, "k", ["v"], on_match={"made": F.lit(99)}, on_insert={"status": F.lit("NEW"), "made": F.lit(0)})
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a", "OPEN", 10), (2, "B", "CLOSED", 99), (3, None, "OPEN", 99), (4, "D", "NEW", 0)]
    assert merged.schema.fieldNames() == target.columns


def test_insert_if_absent_and_joined_update(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert [tuple(r) for r in state.insert_if_absent(target, new, ["k"]).collect()] == [(3, "y")]
    out = state.joined_update(target, spark.createDataFrame([(2, "Z")], "k int, w string"), ["k"], {"v": F.col("s_w")})
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a"), (2, "Z")]


def test_snapshot_store(spark, tmp_path):
    store = state.SnapshotStore(spark, str(tmp_path / "t"), "k int")
    assert store.read().count() == 0 and not store.committed(0)
    store.commit(spark.createDataFrame([(1,)], "k int"), 0)
    store.commit(store.read().unionByName(spark.createDataFrame([(2,)], "k int")), 1)
    assert sorted(r.k for r in store.read().collect()) == [1, 2]
    store.commit(spark.createDataFrame([(9,)], "k int"), 1)  # the same batch again changes nothing
    assert sorted(r.k for r in store.read().collect()) == [1, 2]


def test_snapshot_slots_are_reused(spark, tmp_path):
    store = state.SnapshotStore(spark, str(tmp_path / "t"), "k int", keep=2)
    for i in range(5):
        store.commit(store.read().unionByName(spark.createDataFrame([(i,)], "k int")), i)
    assert sorted(r.k for r in store.read().collect()) == [0, 1, 2, 3, 4]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["_commits", "slot-0", "slot-1"]


def test_review_rules(spark):
    cases = spark.createDataFrame(
        [("c1", "ann", "PENDING_REVIEW"), ("c2", "ann", "INFO_REQUESTED"), ("c3", "ann", "CLOSED_NO_STR"), ("c4", "bob", "PENDING_REVIEW"), ("c5", "bob", "PENDING_REVIEW")],
        "case_id string, created_by string, status string",
    )
    d = [
        ("1", "c1", "APPROVE_FOR_FILING", "ok", "ann", "CHECKER", T),
        ("2", "c1", "APPROVE_FOR_FILING", None, "ann", "ACCOUNTADMIN", T + dt.timedelta(minutes=1)),
        ("3", "c1", "REJECT", "late", "eve", "CHECKER", T + dt.timedelta(minutes=2)),
        ("4", "c2", "ESCALATE", "x", "eve", "CHECKER", T),
        ("5", "c2", "REJECT", " ", "ann", "CHECKER", T + dt.timedelta(minutes=1)),
        ("6", "c3", "REQUEST_INFO", "x", "eve", "CHECKER", T),
        ("7", "nope", "REJECT", "x", "eve", "CHECKER", T),
        ("8", "c4", "REQUEST_INFO", "x", "eve", "CHECKER", T),
        ("9", "c4", "APPROVE_FOR_FILING", "x", "eve", "CHECKER", T + dt.timedelta(minutes=1)),
    ]
    outcomes = governance.review(spark.createDataFrame(d, DEC), cases)
    got = {r.decision_id: (r.status, r.message or r.new_status, r.missing_notes) for r in outcomes.collect()}
    assert got == {
        "1": ("ERROR", "Maker-checker violation: the case creator cannot approve it", False),
        "2": ("OK", "APPROVED_FOR_FILING", True),
        "3": ("ERROR", "Case already APPROVED_FOR_FILING", False),
        "4": ("ERROR", "Decision must be APPROVE_FOR_FILING, REJECT or REQUEST_INFO", False),
        "5": ("OK", "CLOSED_NO_STR", True),
        "6": ("ERROR", "Case already CLOSED_NO_STR", False),
        "7": ("ERROR", "Case not found", False),
        "8": ("OK", "INFO_REQUESTED", False),
        "9": ("OK", "APPROVED_FOR_FILING", False),
    }
    full = cases.selectExpr("*", "CAST(NULL AS STRING) review_decision", "CAST(NULL AS STRING) review_notes", "CAST(NULL AS STRING) reviewed_by",
                            "CAST(NULL AS TIMESTAMP_NTZ) reviewed_at")
    after = {r.case_id: (r.status, r.reviewed_by) for r in governance.apply_reviews(full, outcomes).collect()}
    assert after == {
        "c1": ("APPROVED_FOR_FILING", "ann"), "c2": ("CLOSED_NO_STR", "ann"), "c3": ("CLOSED_NO_STR", None),
        "c4": ("APPROVED_FOR_FILING", "eve"), "c5": ("PENDING_REVIEW", None),
    }
    assert governance.review_audit(outcomes).count() == 4


def test_investigations_and_validation(spark):
    findings = spark.createDataFrame(
        [("f1", "a1", "A1", "C1", 80.0, "CRITICAL"), ("f2", "a2", "A2", "C2", 70.0, "HIGH"), ("f3", "a3", "A3", "C3", 40.0, "MEDIUM")],
        "finding_id string, alert_id string, account_id string, customer_id string, risk_score double, severity string",
    )
    evidence = spark.createDataFrame([("e1", "f1"), ("e2", "f1")], "evidence_id string, finding_id string")
    requests = spark.createDataFrame(
        [("r1", "f1", "critical", "s", "u", T), ("r2", "f1", "URGENT", "s", "u", T), ("r3", "zz", "LOW", "s", "u", T), ("r4", "f3", "LOW", "s", "u", T), ("r5", "f1", None, "s", "u", T)],
        "request_id string, finding_id string, priority string, summary string, requested_by string, requested_at timestamp_ntz",
    )
    out = governance.open_investigations(requests, findings, evidence)
    got = {r.request_id: (r.status, r.message, r.priority, r.evidence_count) for r in out.collect()}
    assert got == {
        "r1": ("SUCCESS", None, "CRITICAL", 2), "r2": ("ERROR", "INVALID_PRIORITY", None, None), "r3": ("ERROR", "FINDING_NOT_FOUND", None, None),
        "r4": ("SUCCESS", None, "LOW", 0), "r5": ("ERROR", "INVALID_PRIORITY", None, None),
    }
    assert governance.investigation_rows(out).count() == governance.investigation_actions(out).count() == 2
    asked = spark.createDataFrame([("f1",), ("f2",), ("f3",), ("zz",)], "finding_id string")
    status = {r.finding_id: (r.status, r.message) for r in governance.validate_findings(asked, findings, evidence).collect()}
    assert status == {"f1": ("VALID", None), "f2": ("INSUFFICIENT_EVIDENCE", None), "f3": ("VALID", None), "zz": ("ERROR", "FINDING_NOT_FOUND")}
    assert [r.finding_id for r in checks.high_risk_without_evidence(findings, evidence).collect()] == ["f2"]


def test_clamp_and_triage(spark):
    assert [governance.clamp(n) for n in (-5, 0, 1, 50, 51)] == [1, 1, 1, 50, 50]
    alerts = spark.createDataFrame([("a", "A", 90), ("b", "B", 60), ("c", "C", 59), ("d", "D", 90)], "alert_id string, account_id string, risk_score int")
    cases = spark.createDataFrame([("d", "CASE-1")], "alert_id string, case_id string")
    chosen = governance.triage_selection(alerts, cases, 3)
    assert [r.alert_id for r in chosen.collect()] == ["a", "b"]
    lcr = spark.createDataFrame([(dt.date(2026, 9, 28), 99.0, "REGULATORY_BREACH", 50.0)], "as_of_date date, lcr_pct double, lcr_status string, lcr_stress_s1_pct double")
    drafted = spark.createDataFrame([("a", "CASE-2"), ("b", None)], "alert_id string, case_id string")
    run = governance.triage_summary(chosen, drafted, lcr).first()
    assert (run.drafted, run.failed, run.lcr_status) == (1, 1, "REGULATORY_BREACH")  # a draft without a case counts as failed


def test_check_result_compares_json_arrays_in_any_order(spark):
    rows = spark.createDataFrame([('["a","b"]', '["b","a"]'), ('["a"]', '["b"]'), ("0", "0"), ("0", "1"), ("[]", "[]")], "expected string, actual string")
    assert [r.result for r in checks.with_result(rows).collect()] == ["PASS", "FAIL", "PASS", "FAIL", "PASS"]
