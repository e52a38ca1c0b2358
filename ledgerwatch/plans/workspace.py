"""Lazy wiring of sources to operators for one data folder.

Without a store every attribute is a plain lazy DataFrame. With a store the tables
that are refreshed rather than recomputed (see ``plans.store``) are written on first
use and read back.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions.windows import DATE_PARTITION, Anchor, fixed, latest, reference_time
from ledgerwatch.operators import credit, cycles, drafts, evidence, governance, liquidity, network, rules, signals
from ledgerwatch.operators.adjacency import LinkTables
from ledgerwatch.operators.search_index import SearchIndex
from ledgerwatch.plans.store import CuratedStore, session_store
from ledgerwatch.session import shared_dir
from ledgerwatch.sources import derived, derived_state

STRESS_SCENARIOS = [
    ("S0", 0.0, 0.0, 0.0),
    ("S1", 15.0, 30.0, 0.0),
    ("S2", 0.0, 0.0, 50.0),
    ("S3", 15.0, 30.0, 50.0),
    ("BAD", 101.0, 0.0, 0.0),
]


class Workspace:
    def __init__(self, spark: SparkSession, data_dir: str, store: CuratedStore | None = None, as_of: dt.datetime | None = None):
        self.spark = spark
        self.data_dir = data_dir
        self.store = store
        self.as_of = as_of

    @classmethod
    def shared(cls, spark: SparkSession, data_dir: str) -> "Workspace":
        return cls(spark, data_dir, session_store(spark, data_dir))

    def given(self, name: str) -> DataFrame:
        return derived.given(self.spark, self.data_dir, name)

    def _stored(self, name: str, build: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
        return self.store.table(name, build, partition) if self.store else build()

    # --- base tables -----------------------------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        return derived.customers(self.given("customer"), self.given("nation"))

    @cached_property
    def accounts(self) -> DataFrame:
        return derived.accounts(self.given("customer"))

    @cached_property
    def scenarios(self) -> DataFrame:
        return derived.scenarios(self.given("customer"))

    @cached_property
    def transactions(self) -> DataFrame:
        def build() -> DataFrame:
            rows = derived.transactions(self.given("orders"), self.given("customer"))
            return rows.withColumn(DATE_PARTITION, F.col("txn_ts").cast("date")) if self.store else rows

        return self._stored("transactions", build, DATE_PARTITION)

    @cached_property
    def loans(self) -> DataFrame:
        return derived.loans(self.given("customer"))

    @cached_property
    def watchlist(self) -> DataFrame:
        return derived.watchlist(self.given("customer"))

    @cached_property
    def hqla_holdings(self) -> DataFrame:
        return self._stored("hqla_holdings", lambda: derived.hqla_holdings(self.given("orders")), "as_of_date")

    @cached_property
    def cashflow_positions(self) -> DataFrame:
        return self._stored("cashflow_positions", lambda: derived.cashflow_positions(self.given("lineitem")), "as_of_date")

    @cached_property
    def policy_docs(self) -> DataFrame:
        return derived.policy_docs(self.spark, self.given("documents"))

    @cached_property
    def search_index(self) -> SearchIndex:
        """The inverted index of the policy library; with a store it is built once per refresh."""

        def build(path: str) -> SearchIndex:
            index = SearchIndex(self.spark, path)
            index.append(self.policy_docs, 0)
            return index

        return self.store.folder("search_index", build) if self.store else build(shared_dir(self.spark, "search-index"))

    @cached_property
    def policy_sections(self) -> DataFrame:
        return derived.policy_sections(self.spark)

    @cached_property
    def stress_scenarios(self) -> DataFrame:
        return self.spark.createDataFrame(
            STRESS_SCENARIOS, "scenario_id string, retail_run_pct double, l2a_markdown_pct double, wholesale_run_pct double"
        )

    # --- curated tables --------------------------------------------------
    @cached_property
    def t(self) -> Anchor:
        """Reference time: as given, else the latest transaction.

        With a store it is computed once per refresh and then a literal in every plan,
        so that days and row groups are pruned; without, it is a scalar subquery.
        """
        if self.as_of is not None:
            return fixed(self.spark, self.as_of)
        if self.store is None:
            return latest(self.transactions)
        return fixed(self.spark, self.store.value("clock", lambda: reference_time(self.transactions)))

    @cached_property
    def rings(self) -> DataFrame:
        """Fund-flow cycles of the last seven days, one row per ring."""
        return self._stored("rings", lambda: cycles.cycles(self.transactions, self.t))

    def compute_signals(self) -> DataFrame:
        return signals.account_signals(self.accounts, self.customers, self.transactions, self.watchlist, self.t, rings=self.rings)

    @cached_property
    def signals(self) -> DataFrame:
        return self._stored("account_signals", self.compute_signals)

    @cached_property
    def alerts(self) -> DataFrame:
        return self._stored("fraud_alerts", lambda: rules.fraud_alerts(self.signals))

    def compute_loan_ews(self) -> DataFrame:
        return credit.loan_ews(self.loans, self.customers)

    @cached_property
    def loan_ews(self) -> DataFrame:
        return self._stored("loan_ews", self.compute_loan_ews)

    @cached_property
    def concentration(self) -> DataFrame:
        return credit.industry_concentration(self.loans)

    def compute_lcr(self) -> DataFrame:
        return liquidity.lcr_daily(self.hqla_holdings, self.cashflow_positions)

    @cached_property
    def lcr_daily(self) -> DataFrame:
        return self._stored("lcr_daily", self.compute_lcr)

    @cached_property
    def flows(self) -> DataFrame:
        return self._stored("flow_links", lambda: network.flow_edges(self.transactions, self.accounts, self.customers))

    @cached_property
    def device_use(self) -> DataFrame:
        return self._stored("device_use", lambda: network.device_use(self.transactions, self.accounts, self.customers))

    @cached_property
    def links(self) -> LinkTables:
        """Links and device members in folders by owner and device; with a store they are written once per refresh."""

        def build(path: str) -> LinkTables:
            tables = LinkTables(self.spark, path)
            tables.build(self.accounts, self.flows, self.device_use)
            return tables

        return self.store.folder("link_tables", build) if self.store else build(shared_dir(self.spark, "link-tables"))

    @cached_property
    def recent_high_risk(self) -> DataFrame:
        return rules.recent_high_risk_transactions(self.transactions, self.alerts, self.t)

    # --- cases and audit -------------------------------------------------
    @cached_property
    def draft_requests(self) -> DataFrame:
        return derived_state.draft_requests(self.alerts, self.given("customer"))

    @cached_property
    def drafts(self) -> drafts.DraftResult:
        return drafts.generate_drafts(
            self.draft_requests, self.alerts, self.signals, self.transactions, self.search_index, self.t
        )

    @cached_property
    def new_cases(self) -> DataFrame:
        return self._stored("draft_cases", lambda: self.drafts.cases)

    @cached_property
    def first_reviews(self) -> DataFrame:
        return governance.review(derived_state.first_decisions(self.new_cases), self.new_cases)

    @cached_property
    def cases(self) -> DataFrame:
        return self._stored("cases", lambda: governance.apply_reviews(self.new_cases, self.first_reviews))

    @cached_property
    def second_reviews(self) -> DataFrame:
        return governance.review(derived_state.second_decisions(self.cases, self.given("customer")), self.cases)

    def compute_audit_log(self) -> DataFrame:
        cols = ["event_ts", "event_user", "event_role", "event_type", "object_id", "details"]
        as_of = self.t.now
        event = liquidity.threshold_event(self.lcr_daily).select(
            as_of.alias("event_ts"), F.lit("task").alias("event_user"), F.lit("SYSTEM").alias("event_role"),
            F.lit("LCR_THRESHOLD_EVENT").alias("event_type"), F.lit("LCR").alias("object_id"),
            F.to_json(F.struct(F.col("as_of_date").cast("string").alias("as_of"), "lcr_pct", "status", "stress_s1")).alias("details"),
        )
        runs = liquidity.stress(self.stress_scenarios, self.hqla_holdings, self.cashflow_positions).where("status = 'OK'").select(
            as_of.alias("event_ts"), F.lit("alm_desk").alias("event_user"), F.lit("ALM").alias("event_role"),
            F.lit("LIQUIDITY_STRESS_RUN").alias("event_type"), F.concat(F.lit("LCR-"), "scenario_id").alias("object_id"),
            F.to_json(F.struct("baseline_lcr_pct", "stressed_lcr_pct")).alias("details"),
        )
        drafted = self.new_cases.select(
            F.col("created_at").alias("event_ts"), F.col("created_by").alias("event_user"),
            F.lit(drafts.DRAFT_ROLE).alias("event_role"), F.lit("SAR_DRAFT_GENERATED").alias("event_type"),
            F.col("case_id").alias("object_id"),
            F.to_json(F.struct("alert_id", F.col("guardrail_result.passed").alias("passed"))).alias("details"),
        )
        refused = drafts.rejection_audit(drafts.rejected_requests(self.draft_requests, self.alerts))
        parts = [drafted, refused, governance.review_audit(self.first_reviews), event, runs]
        out = parts[0].select(cols)
        for part in parts[1:]:
            out = out.unionByName(part.select(cols))
        return out

    @cached_property
    def audit_log(self) -> DataFrame:
        return self._stored("audit_log", self.compute_audit_log)

    # --- findings and evidence -------------------------------------------
    @cached_property
    def earlier_findings(self) -> DataFrame:
        return derived_state.earlier_findings(self.alerts, self.given("customer"))

    @cached_property
    def earlier_evidence(self) -> DataFrame:
        return derived_state.earlier_evidence(self.alerts)

    def compute_findings(self) -> DataFrame:
        return evidence.upsert_findings(self.earlier_findings, self.alerts)

    @cached_property
    def findings(self) -> DataFrame:
        return self._stored("risk_findings", self.compute_findings)

    def compute_new_evidence(self) -> DataFrame:
        return evidence.new_evidence(self.earlier_evidence, self.alerts, self.findings)

    @cached_property
    def evidence(self) -> DataFrame:
        return self._stored("risk_evidence", lambda: self.earlier_evidence.unionByName(self.compute_new_evidence()))

    @cached_property
    def investigation_outcomes(self) -> DataFrame:
        requests = derived_state.investigation_requests(self.findings, self.given("customer"))
        return governance.open_investigations(requests, self.findings, self.evidence)
