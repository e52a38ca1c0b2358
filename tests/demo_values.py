"""The demo customer and feed."""

from __future__ import annotations

# The demo customer.
DEMO_CUSTOMER = ("CUST-9821", "Rajesh K. Verma", "INDIVIDUAL", "HIGH", "Mumbai", False, "2026-01-10", "Retail Trader", 600000)
DEMO_ACCOUNT = ("ACC0009821", "CUST-9821", "SAVINGS", "2026-01-15", "ACTIVE", "1450000.00")
DEMO_CASH_DEPOSITS = [
    ("BRANCH-SOUTH-MUMBAI", 950000, "2026-09-27 09:15:00"),
    ("BRANCH-ANDHERI-WEST", 960000, "2026-09-27 10:45:00"),
    ("BRANCH-BANDRA-EAST", 940000, "2026-09-27 12:30:00"),
    ("BRANCH-FORT-MAIN", 980000, "2026-09-27 14:10:00"),
    ("BRANCH-BKC-PLAZA", 920000, "2026-09-27 16:00:00"),
    ("BRANCH-SOUTH-MUMBAI", 955000, "2026-09-27 17:30:00"),
    ("BRANCH-ANDHERI-WEST", 970000, "2026-09-28 09:30:00"),
    ("BRANCH-BANDRA-EAST", 935000, "2026-09-28 10:50:00"),
    ("BRANCH-FORT-MAIN", 990000, "2026-09-28 11:45:00"),
    ("BRANCH-BKC-PLAZA", 945000, "2026-09-28 13:15:00"),
    ("BRANCH-SOUTH-MUMBAI", 965000, "2026-09-28 14:30:00"),
    ("BRANCH-ANDHERI-WEST", 930000, "2026-09-28 15:40:00"),
    ("BRANCH-BANDRA-EAST", 975000, "2026-09-28 16:50:00"),
    ("BRANCH-FORT-MAIN", 985000, "2026-09-28 18:00:00"),
    ("BRANCH-BKC-PLAZA", 915000, "2026-09-28 19:10:00"),
    ("BRANCH-SOUTH-MUMBAI", 960000, "2026-09-28 20:20:00"),
    ("BRANCH-ANDHERI-WEST", 940000, "2026-09-28 21:30:00"),
]

# The four-row demo feed (timestamp, amount, device).
DEMO_FEED = [
    ("2026-10-04 10:01:00", 15000, "DEV-OLD-001"),
    ("2026-10-04 10:04:00", 25000, "DEV-OLD-001"),
    ("2026-10-04 10:07:00", 485000, "DEV-NEW-987"),
    ("2026-10-04 10:09:00", 375000, "DEV-NEW-987"),
]
