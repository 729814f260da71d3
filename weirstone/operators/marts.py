"""Staging views and marts over the versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.functions import in_base_currency
from weirstone.operators.dedup import latest_per_key
from weirstone.operators.scd2 import current

#: The columns that each view shows.
CUSTOMERS = ["customer_id", "full_name", "email", "phone", "address", "segment", "risk_rating", "created_at", "updated_at", "valid_from", "business_key"]
ACCOUNTS = ["account_id", "customer_id", "account_type", "currency", "balance", "status", "opened_at", "updated_at"]
LOANS = ["application_id", "customer_id", "product", "amount", "term_months", "status", "credit_score", "submitted_at", "updated_at"]
TRANSACTIONS = ["transaction_id", "account_id", "amount", "currency", "txn_type", "counterparty", "channel", "status", "booked_at"]


def stg_customers(customers: DataFrame) -> DataFrame:
    return current(customers).select(*CUSTOMERS)


def stg_accounts(accounts: DataFrame) -> DataFrame:
    return current(accounts).select(*ACCOUNTS)


def stg_loan_applications(loans: DataFrame) -> DataFrame:
    return current(loans).select(*LOANS)


def stg_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.select(*TRANSACTIONS, F.to_date("booked_at").alias("booked_date"))


def _newest(rows: DataFrame) -> Sequence[Column]:
    """The latest load wins; of one load the last file."""
    return [F.desc("_ingest_ts"), *([F.desc("_source_file")] if "_source_file" in rows.columns else [])]


def stg_branches(branches: DataFrame) -> DataFrame:
    held = latest_per_key(branches, ["branch_id"], _newest(branches))
    return held.select("branch_id", "branch_name", "region", F.col("opened_date").cast("date").alias("opened_date"), F.col("business_date").cast("date").alias("business_date"))


def stg_fx_rates(rates: DataFrame) -> DataFrame:
    held = latest_per_key(rates, ["quote_currency", "business_date"], _newest(rates))
    return held.select("base_currency", "quote_currency", "rate", F.col("business_date").cast("date").alias("business_date"))


def dim_customers(customers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Customers without identifiers, with the number and balance of their active accounts; those without any stay."""
    active = accounts.where("status = 'active'").select("customer_id", "account_id", "balance")
    who = customers.select("customer_id", "segment", "risk_rating", F.to_date("created_at").alias("customer_since"))
    keys = ["customer_id", "segment", "risk_rating", "customer_since"]
    total = F.coalesce(F.sum("balance"), F.lit(0)).alias("total_balance")
    return who.join(active, "customer_id", "left").groupBy(*keys).agg(F.countDistinct("account_id").alias("active_accounts"), total)


def fct_transactions(transactions: DataFrame, accounts: DataFrame, rates: DataFrame, base: str = "JPY", digits: int | None = 2) -> DataFrame:
    """Transactions with their customer and the amount in the base currency, rounded to ``digits`` unless that is None.

    Rates join by currency alone: a currency quoted for two dates doubles its rows, which the unique
    check on (quote_currency) of the rates guards.
    """
    owner = accounts.select("account_id", "customer_id")
    rates = rates.where(F.col("base_currency") == base).select(F.col("quote_currency").alias("_quote"), F.col("rate").alias("_rate"))
    joined = transactions.join(owner, "account_id", "left").join(rates, F.col("currency") == F.col("_quote"), "left")
    amount = in_base_currency(F.col("amount"), F.col("currency"), F.col("_rate"), base, digits).alias("amount_jpy")
    return joined.select("transaction_id", "account_id", "customer_id", "booked_date", "booked_at", "txn_type", "channel", "status", "currency", "amount", amount)


def funnel(rows: DataFrame, by: str, status: str, amount: str, score: str | None, states: Sequence[str] = ("submitted", "under_review", "approved", "rejected")) -> DataFrame:
    """Per group: rows, rows by state, the share approved of those decided, mean amount and score; largest first."""
    n = lambda *names: F.count_if(F.col(status).isin(*names))
    rate = F.round(n("approved") / F.nullif(n("approved", "rejected"), F.lit(0)), 3)
    means = [F.round(F.avg(amount).cast("double"), 2).alias("avg_amount")] + ([F.round(F.avg(score), 0).alias("avg_credit_score")] if score else [])
    out = rows.groupBy(by).agg(F.count("*").alias("applications"), *(n(s).alias(s) for s in states), rate.alias("approval_rate"), *means)
    return out.orderBy(F.desc("applications"), by)


def mart_loan_funnel(loans: DataFrame) -> DataFrame:
    return funnel(loans, "product", "status", "amount", "credit_score")
