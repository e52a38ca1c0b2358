"""Fixed values the analytics depend on, stated plainly.

Nothing here is logic. The policy section labels, the regulatory haircuts and
run-off rates, the rules' names, weights and limits must equal the published values
for the results to agree; the short texts of the policy sections are our own wording.
"""

from __future__ import annotations

# Label of every policy section with its document and domain.
# (doc_id, doc_title, doc_type, section, domain, effective_date, chunk_text)
POLICY_SECTIONS = [
    ("AML-POL-01", "Internal AML & CFT Policy v4.1", "INTERNAL_POLICY", "AML-POL 3.1 Customer Risk Categorisation", "AML", "2026-04-01",
     "Every customer gets a low, medium or high risk grade at onboarding. A PEP, a near sanctions match or heavy cash use means high risk, enhanced due diligence and senior sign-off; PEP activity is watched."),
    ("AML-POL-01", "Internal AML & CFT Policy v4.1", "INTERNAL_POLICY", "AML-POL 4.2 Money Mule Red Flags", "FRAUD", "2026-04-01",
     "Signs of a money mule: (a) a new or dormant account with a burst of credits; (b) many distinct remitters in two days; (c) rapid pass through of the inflow by RTGS or NEFT; (d) device or IP anomaly; (e) profile mismatch with declared income. Two signs freeze the account."),
    ("AML-POL-01", "Internal AML & CFT Policy v4.1", "INTERNAL_POLICY", "AML-POL 4.3 Structuring / Threshold Avoidance", "AML", "2026-04-01",
     "Structuring means splitting cash deposits so that each stays under the ten lakh reporting threshold. Three deposits between nine and ten lakh in ten days are suspected structuring and are assessed for an STR."),
    ("AML-POL-01", "Internal AML & CFT Policy v4.1", "INTERNAL_POLICY", "AML-POL 4.4 Round-Tripping and Layering", "AML", "2026-04-01",
     "Round tripping and layering: money that leaves an account and comes back through other accounts inside 72 hours without a business reason. Circular flow of similar value goes to the principal officer."),
    ("AML-POL-01", "Internal AML & CFT Policy v4.1", "INTERNAL_POLICY", "AML-POL 6.1 STR Filing Timeline", "AML", "2026-04-01",
     "An STR is filed within seven working days of the decision that a transaction is suspicious. The customer is never told. Each STR draft needs a maker and a separate checker before filing."),
    ("AML-POL-01", "Internal AML & CFT Policy v4.1", "INTERNAL_POLICY", "AML-POL 6.2 STR Narrative Standard", "AML", "2026-04-01",
     "The STR narrative says who, what, when, where, why and how, quotes transaction ids and lists the documents that are still missing before filing."),
    ("AML-POL-01", "Internal AML & CFT Policy v4.1", "INTERNAL_POLICY", "AML-POL 7.1 Sanctions Screening", "AML", "2026-04-01",
     "Customers and counterparties are screened against each sanctions watchlist. A watchlist hit with a match score of 0.85 or more needs second line disposition before money leaves; a true match is frozen."),
    ("REG-PMLA", "Prevention of Money Laundering Act, 2002 - Reference Summary", "REGULATION_SUMMARY", "PMLA Section 12", "AML", "2023-03-07",
     "Reporting entities keep records of transactions for five years, verify who their clients are, and furnish suspicious transactions to the financial intelligence unit."),
    ("REG-KYC-MD", "RBI Master Direction - KYC - Reference Summary", "REGULATION_SUMMARY", "KYC MD - Cash Transaction Reports", "AML", "2025-06-12",
     "Cash transactions over ten lakh, or connected cash transactions that add up to more within a month, are reported by the fifteenth of the next month."),
    ("REG-FINCEN-STR", "FinCEN Guidance on Structuring (31 CFR § 1010.314)", "REGULATION_SUMMARY", "FinCEN AML Structuring Guidance Section 3.1", "AML", "2024-01-15",
     "Breaking up currency deposits to stay under the ten thousand dollar report is structuring, also when it is spread over many branches or days. A suspicious activity report follows within thirty days."),
    ("REG-FINCEN-SAR", "FinCEN SAR Filing Requirements (31 CFR § 1020.320)", "REGULATION_SUMMARY", "FinCEN SAR Filing Standard Section 2.4", "AML", "2024-01-15",
     "A suspicious activity report is required from five thousand dollars when funds look illegal, evade reporting rules or serve no lawful purpose. Filing in good faith is protected; tipping off is not allowed."),
    ("REG-BASEL-LCR", "Basel III Liquidity Coverage Ratio - Reference Summary", "REGULATION_SUMMARY", "LCR Minimum and HQLA Composition", "LIQUIDITY", "2019-01-01",
     "The coverage ratio is liquid assets over net outflows of the next thirty days, at least one hundred percent. Level two assets stay within forty percent and level two B within fifteen percent; inflows count up to three quarters of outflows."),
    ("REG-BASEL-LCR", "Basel III Liquidity Coverage Ratio - Reference Summary", "REGULATION_SUMMARY", "LCR Run-off Rates", "LIQUIDITY", "2019-01-01",
     "Run-off rates: five percent for stable and ten for less stable retail deposits, twenty five for operational and forty for other wholesale funding, ten for undrawn facilities."),
    ("ALM-POL-02", "Internal ALM & Liquidity Risk Policy v3.0", "INTERNAL_POLICY", "ALM-POL 5.1 Internal LCR Buffer", "LIQUIDITY", "2026-01-01",
     "The board keeps the ratio above 110 percent. Under 115 the committee is alerted, under 110 the contingency funding plan starts."),
    ("ALM-POL-02", "Internal ALM & Liquidity Risk Policy v3.0", "INTERNAL_POLICY", "ALM-POL 6.2 Stress Scenarios", "LIQUIDITY", "2026-01-01",
     "Stress cases: a fifteen percent retail run with a thirty percent mark-down of level two A assets; half of other wholesale funding leaving; both together."),
    ("CR-POL-03", "Internal Credit Risk & EWS Policy v2.4", "INTERNAL_POLICY", "CR-POL 4.1 SMA Classification", "CREDIT", "2026-02-01",
     "Days past due set the class: up to 30 SMA-0, up to 60 SMA-1, up to 90 SMA-2, beyond that non performing. Stage two is presumed at 30 days."),
    ("CR-POL-03", "Internal Credit Risk & EWS Policy v2.4", "INTERNAL_POLICY", "CR-POL 5.3 EWS Triggers and Actions", "CREDIT", "2026-02-01",
     "Early warning: high utilisation, two bounced mandates, a sales drop of thirty percent, a bureau score under 600. One trigger is watched, two freeze the limit, three go to the credit committee."),
    ("CR-POL-03", "Internal Credit Risk & EWS Policy v2.4", "INTERNAL_POLICY", "CR-POL 7.1 Concentration Limits", "CREDIT", "2026-02-01",
     "One industry may hold fifteen percent of funded exposure; real estate and lending to finance companies ten percent each."),
]

# Liquid instruments (name, level, haircut, base value in crore).
INSTRUMENTS = [
    ("G-SEC 7.26% 2033", "LEVEL_1", "0.00", 42000),
    ("T-BILL 364D", "LEVEL_1", "0.00", 18000),
    ("CASH & CRR EXCESS", "LEVEL_1", "0.00", 9000),
    ("AA+ CORPORATE BONDS", "LEVEL_2A", "0.15", 14000),
    ("PSU BONDS AAA", "LEVEL_2A", "0.15", 9000),
    ("NIFTY50 EQUITIES", "LEVEL_2B", "0.50", 4000),
    ("AA- CORPORATE BONDS", "LEVEL_2B", "0.50", 3000),
]

# Cash-flow categories (name, flow, run-off rate, base value in crore).
FLOW_CATEGORIES = [
    ("Retail deposits - stable", "OUTFLOW", "0.05", 380000),
    ("Retail deposits - less stable", "OUTFLOW", "0.10", 210000),
    ("Unsecured wholesale - operational", "OUTFLOW", "0.25", 60000),
    ("Unsecured wholesale - non-operational", "OUTFLOW", "0.40", 55000),
    ("Undrawn committed credit facilities", "OUTFLOW", "0.10", 70000),
    ("Derivative net outflows", "OUTFLOW", "1.00", 4000),
    ("Performing loan inflows (50%)", "INFLOW", "0.50", 30000),
    ("Interbank placements maturing", "INFLOW", "1.00", 8000),
]

# Maturity buckets and their weights.
BUCKETS = [("1-7D", "0.45"), ("8-14D", "0.25"), ("15-30D", "0.30")]

# Industries of the loan book.
INDUSTRIES = [
    "Textiles", "Real Estate", "IT Services", "Pharma", "Auto Components",
    "Retail Trade", "Agriculture", "Construction", "NBFC Lending", "Hospitality",
]

# Red-flag rules in order (flag, policy reference, weight).
RULE_BOOK = [
    ("NEW_OR_DORMANT_BURST", "AML-POL 4.2(a)", 20),
    ("MANY_REMITTERS", "AML-POL 4.2(b)", 20),
    ("RAPID_PASS_THROUGH", "AML-POL 4.2(c)", 25),
    ("DEVICE_IP_ANOMALY", "AML-POL 4.2(d)", 10),
    ("PROFILE_MISMATCH", "AML-POL 4.2(e)", 10),
    ("STRUCTURING", "AML-POL 4.3", 35),
    ("ROUND_TRIPPING", "AML-POL 4.4", 35),
    ("SANCTIONS_WATCHLIST_HIT", "AML-POL 7.1", 30),
    ("PEP_ACTIVITY", "AML-POL 3.1", 10),
]

# Limits of the rules.
RULE_LIMITS = {
    "new_account_days": 180,
    "dormant_days": 30,
    "burst_credits": 10,
    "remitters": 15,
    "pass_through": 0.8,
    "pass_through_inflow": 200_000,
    "devices": 4,
    "risky_origins": 5,
    "income_share": 0.5,
    "near_threshold_deposits": 3,
    "cycles": 1,
    "watchlist_score": 0.85,
}

# Cash deposits just below the reporting threshold, and the days looked back.
CASH_LOW, CASH_HIGH, CASH_DAYS = 900_000, 999_999, 10

# Round trips (least amount, days looked back, hours from first to last transfer, amount tolerance).
RING_MIN_AMOUNT, RING_DAYS, RING_HOURS, RING_TOLERANCE = 1_000_000, 7, 72, "0.1"

# Score of an alert, and the action by summed weight (from, action).
KYC_BONUS, MAX_SCORE, FLAGS_FOR_ALERT = 10, 100, 2
ACTION_BANDS = [(0, "REVIEW_AND_CLEAR"), (20, "STEP_UP_AUTH"), (35, "PLACE_HOLD"), (60, "FREEZE_ACCOUNT")]

# Loan warnings.
LOAN_LIMITS = {"utilisation": 90, "bounces": 2, "sales_drop": -30, "bureau_score": 600}

# Asset class by days past due (from, class, its level of action), stage by days past due (from, stage).
DPD_CLASSES = [(0, "STANDARD", 0), (1, "SMA-0", 1), (31, "SMA-1", 1), (61, "SMA-2", 3), (91, "NPA", 4)]
STAGE_BANDS = [(0, "STAGE_1"), (30, "STAGE_2"), (91, "STAGE_3")]

# Action by level, the higher of the level of the class and the number of triggers (three at most).
EWS_ACTIONS = [
    (0, "NO_ACTION"),
    (1, "WATCHLIST"),
    (2, "LIMIT_FREEZE_AND_COLLATERAL_REVALUATION"),
    (3, "RESTRUCTURING_DISCUSSION_CREDIT_COMMITTEE"),
    (4, "NPA_RECOVERY_AND_PROVISIONING"),
]
