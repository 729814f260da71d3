"""Daily account aggregates with screening flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """A large amount, the share of it that counts as near, and how many of a kind flag a day."""

    large: float = 700_000.0
    near: float = 0.85
    velocity: int = 6
    structuring: int = 3


def account_days(transactions: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Per account and day, over transactions that were not reversed (a null status drops out as well)."""
    amount, large = F.col("amount"), F.lit(thresholds.large)
    booked = transactions.where(F.col("status") != "reversed").select("account_id", F.to_date("booked_at").alias("txn_date"), F.col("amount").cast("double").alias("amount"), "txn_type", "channel")
    credit = F.col("txn_type") == "deposit"
    days = booked.groupBy("account_id", "txn_date").agg(
        F.count("*").alias("txn_count"),
        F.sum(F.when(credit, amount).otherwise(0.0)).alias("total_credits"),
        F.sum(F.when(credit, 0.0).otherwise(amount)).alias("total_debits"),
        F.max("amount").alias("max_txn_amount"),
        F.countDistinct("channel").alias("distinct_channels"),
        F.count_if(amount >= large).alias("_large"),
        F.count_if((amount >= thresholds.near * large) & (amount < large)).alias("_near"),
    )
    flags = {"net_amount": F.col("total_credits") - F.col("total_debits"), "large_txn_flag": F.col("_large") > 0, "high_velocity_flag": F.col("txn_count") >= thresholds.velocity, "structuring_flag": F.col("_near") >= thresholds.structuring}
    return days.withColumns(flags).drop("_large", "_near")


COLUMNS = (
    "account_id", "txn_date", "customer_id", "account_type", "currency", "segment", "risk_rating", "txn_count", "total_credits",
    "total_debits", "net_amount", "max_txn_amount", "distinct_channels", "large_txn_flag", "high_velocity_flag", "structuring_flag",
)


def account_daily_metrics(transactions: DataFrame, accounts: DataFrame, customers: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Account days with the current account's and customer's attributes; days of unknown accounts stay.

    Aggregation comes before both joins, so they move a row by account and day only.
    """
    accounts = accounts.where("is_current").select("account_id", "customer_id", "account_type", "currency")
    customers = customers.where("is_current").select("customer_id", "segment", "risk_rating")
    out = account_days(transactions, thresholds).join(accounts, "account_id", "left").join(customers, "customer_id", "left")
    return out.select(*COLUMNS)
