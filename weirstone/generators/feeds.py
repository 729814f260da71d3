"""Seeded batch feeds: branches twice under two names (CSV), products (JSON), exchange rates (Parquet)."""

from __future__ import annotations

import csv
import json
import random
from datetime import date, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

#: Fixed values.
BUSINESS_DATE = "2026-01-01"
REGIONS = ["kanto", "kansai", "chubu", "kyushu", "tohoku"]
PRODUCTS = [
    ("CHK-STD", "Standard Checking", "deposit"), ("SAV-STD", "Standard Savings", "deposit"), ("SAV-HI", "High-Yield Savings", "deposit"),
    ("TD-12M", "12M Term Deposit", "deposit"), ("LN-PERS", "Personal Loan", "lending"), ("LN-MTG", "Residential Mortgage", "lending"),
    ("LN-AUTO", "Auto Loan", "lending"), ("CRD-STD", "Standard Card", "card"), ("CRD-PLT", "Platinum Card", "card"),
]
BASE_RATES = {"USD": 0.0064, "EUR": 0.0059, "GBP": 0.0050, "AUD": 0.0099, "SGD": 0.0086}


def write_feeds(landing: str | Path, seed: int = 42) -> dict[str, int]:
    """Rows by dataset."""
    chance, root = random.Random(seed), Path(landing)
    folder = lambda name: (root / name).mkdir(parents=True, exist_ok=True) or root / name
    opened = lambda: (date(1990, 1, 1) + timedelta(days=chance.randrange(11_000))).isoformat()
    branches = [{"branch_id": f"BR-{i:03d}", "branch_name": f"Branch {i}", "region": chance.choice(REGIONS), "opened_date": opened(), "business_date": BUSINESS_DATE} for i in range(1, 26)]
    for suffix in ("", "_resend"):
        with (folder("branches") / f"branches_{BUSINESS_DATE}{suffix}.csv").open("w", newline="", encoding="utf-8") as out:
            writer = csv.DictWriter(out, list(branches[0]))
            writer.writeheader()
            writer.writerows(branches)
    products = [{"product_code": c, "name": n, "category": k, "annual_rate_pct": round(chance.uniform(0.01, 14.5), 2), "active": True, "business_date": BUSINESS_DATE} for c, n, k in PRODUCTS]
    (folder("products") / f"products_{BUSINESS_DATE}.json").write_text(json.dumps(products, indent=2, sort_keys=True), encoding="utf-8")
    rates = [{"base_currency": "JPY", "quote_currency": q, "rate": round(r * chance.uniform(0.97, 1.03), 6), "business_date": BUSINESS_DATE} for q, r in BASE_RATES.items()]
    pq.write_table(pa.Table.from_pylist(rates), folder("fx_rates") / f"fx_rates_{BUSINESS_DATE}.parquet")
    return {"branches": 2 * len(branches), "products": len(products), "fx_rates": len(rates)}
