import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weirstone.contracts import latest_contracts
from weirstone.operators import enforcement, envelope, gold, marts, merge, reconcile, scd2
from weirstone.operators.dedup import latest_per_key

GOOD = {"op": "c", "ts_ms": 1, "source": {"table": "t", "lsn": 1}}


def without(*names):
    return {k: v for k, v in GOOD.items() if k not in names}


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        (None, "unparseable_json"), ("", "unparseable_json"), ("  ", "unparseable_json"), ('{"op":', "corrupt_envelope"), ("GARBAGE", "corrupt_envelope"), ("[]", "corrupt_envelope"),
        ("5", "corrupt_envelope"), (json.dumps(GOOD | {"ts_ms": "soon"}), "corrupt_envelope"), (json.dumps(without("op")), "missing_op"), (json.dumps(GOOD | {"op": "x"}), "unknown_op"),
        (json.dumps(without("ts_ms")), "missing_or_invalid_ts_ms"), (json.dumps(without("source")), "missing_source_table"), (json.dumps(GOOD | {"source": {}}), "missing_source_table"), (json.dumps(GOOD), None),
    ],
)
def test_classification(spark, raw, reason):
    rows = spark.createDataFrame([("e", None, raw, "r")], "entity string, event_key string, raw_value string, source_ref string")
    parsed = envelope.parse_envelope(rows)
    assert parsed.first()["error_reason"] == reason
    assert envelope.quarantined(parsed).count() == (reason is not None)
    assert envelope.events_of(parsed, "e").count() == (reason is None)
    assert envelope.mark_unknown_entities(parsed, ["other"]).first()["error_reason"] == (reason or "unknown_entity")


CUSTOMER = {"customer_id": "C1", "full_name": "A", "email": "a@x", "segment": "retail", "risk_rating": "low", "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-01T00:00:00Z"}


def events(spark, *rows):
    made = [(json.dumps({"before": b, "after": a}), op, ts, lsn, "run") for op, ts, lsn, b, a in rows]
    return spark.createDataFrame(made, "raw_value string, op string, ts_ms long, lsn long, run_id string")


@pytest.mark.parametrize(
    ("op", "after", "violations"),
    [
        ("c", CUSTOMER, None),
        ("c", CUSTOMER | {"email": None}, ["null_violation:email"]),
        ("u", CUSTOMER | {"segment": "vip", "risk_rating": None}, ["enum_violation:segment", "null_violation:risk_rating"]),
        ("u", CUSTOMER | {"preferred_language": "fr"}, ["enum_violation:preferred_language"]),
        ("r", None, [enforcement.NO_IMAGE]),
        ("d", None, None),
    ],
)
def test_enforcement(spark, op, after, violations):
    valid, broken, rules = enforcement.enforce_contract(events(spark, (op, 1, 1, CUSTOMER, after)), latest_contracts()["customers"])
    assert rules == 10
    if violations is None:
        assert valid.count() == 1 and broken.count() == 0 and "violations" not in valid.columns
    else:
        row = enforcement.quarantine_rows(broken, latest_contracts()["customers"]).first()
        assert valid.count() == 0 and sorted(row["violations"]) == sorted(violations) and row["contract_version"] == 2


def test_a_payload_that_is_no_object_breaks_every_required_field(spark):
    _, broken, _ = enforcement.enforce_contract(events(spark, ("c", 1, 1, None, "text")), latest_contracts()["customers"])
    assert "null_violation:customer_id" in broken.first()["violations"]


def versions(spark, *rows):
    contract = latest_contracts()["customers"]
    valid, _, _ = enforcement.enforce_contract(events(spark, *rows), contract)
    return scd2.build_versions(valid, contract)


def line(df):
    return [tuple(r) for r in df.orderBy("business_key", "valid_from").select("business_key", F.unix_millis("valid_from"), F.unix_millis("valid_to"), "is_current", "is_deleted").collect()]


def test_histories(spark):
    made = versions(spark, ("c", 1, 1, None, CUSTOMER), ("u", 2, 2, CUSTOMER, CUSTOMER), ("u", 2, 2, CUSTOMER, CUSTOMER), ("d", 3, 3, CUSTOMER, None), ("c", 4, 4, None, CUSTOMER))
    assert line(made) == [("C1", 1, 2, False, False), ("C1", 2, 3, False, True), ("C1", 4, None, True, False)]
    assert made.columns[-5:] == ["valid_from", "valid_to", "is_current", "_run_id", "is_deleted"]
    assert scd2.chain_violations(made).count() == 0 and scd2.current(made).count() == 1


def test_events_at_one_time_leave_the_last(spark):
    made = versions(spark, ("c", 1, 1, None, CUSTOMER | {"segment": "retail"}), ("u", 1, 2, CUSTOMER, CUSTOMER | {"segment": "premium"}))
    assert [r["segment"] for r in made.collect()] == ["premium"]


def test_a_delete_alone_opens_nothing(spark):
    assert versions(spark, ("d", 1, 1, CUSTOMER, None)).count() == 0


def test_as_of(spark):
    made = versions(spark, ("c", 1000, 1, None, CUSTOMER), ("u", 5000, 2, CUSTOMER, CUSTOMER | {"segment": "private"}))
    probes = spark.createDataFrame([("C1", 0), ("C1", 1000), ("C1", 4999), ("C1", 9000), ("C2", 9000)], "business_key string, ms long").withColumn("at", F.timestamp_millis("ms"))
    found = {(r["business_key"], r["ms"]): r["segment"] for r in scd2.as_of(made, probes, "business_key", "at").collect()}
    assert found == {("C1", 0): None, ("C1", 1000): "retail", ("C1", 4999): "retail", ("C1", 9000): "private", ("C2", 9000): None}


def test_upsert_touches_only_the_named_columns(spark):
    target = spark.createDataFrame([("k", 1, "old", None, True)], "k string, v int, attr string, valid_to int, cur boolean")
    source = spark.createDataFrame([("k", 1, "CHANGED", 5, False, "z"), ("k", 5, "n", None, True, "z")], "k string, v int, attr string, valid_to int, cur boolean, extra string")
    out = [tuple(r) for r in merge.upsert(target, source, ["k", "v"], ["valid_to", "cur"]).orderBy("v").collect()]
    assert out == [("k", 1, "old", 5, False, None), ("k", 5, "n", None, True, "z")]
    assert merge.insert_absent(target, source, ["k", "v"]).count() == 1


def transactions(spark, *rows):
    made = [(f"T{i}", "A1", float(a), kind, "online", status, datetime.fromisoformat(at)) for i, (a, kind, status, at) in enumerate(rows)]
    return spark.createDataFrame(made, "transaction_id string, account_id string, amount double, txn_type string, channel string, status string, booked_at timestamp")


def days(spark, *rows):
    accounts = spark.createDataFrame([("A1", "C1", "checking", "JPY", True), ("A1", "C9", "old", "USD", False)], "account_id string, customer_id string, account_type string, currency string, is_current boolean")
    customers = spark.createDataFrame([("C1", "retail", "low", True), ("C1", "private", "high", False)], "customer_id string, segment string, risk_rating string, is_current boolean")
    return gold.account_daily_metrics(transactions(spark, *rows), accounts, customers).orderBy("txn_date").collect()


DAY = "2026-01-05T10:00:00"


def test_account_days(spark):
    (one,) = days(spark, (100, "deposit", "posted", DAY), (30, "fee", "pending", DAY), (999_999, "fee", "reversed", DAY))
    assert (one["txn_count"], one["total_credits"], one["total_debits"], one["net_amount"], one["max_txn_amount"]) == (2, 100, 30, 70, 100)
    assert (one["customer_id"], one["segment"], one["currency"], one["distinct_channels"]) == ("C1", "retail", "JPY", 1)
    assert not (one["large_txn_flag"] or one["high_velocity_flag"] or one["structuring_flag"])
    assert list(one.asDict()) == list(gold.COLUMNS)


def test_screening_flags(spark):
    near = 0.85 * 700_000 + 1000
    flags = lambda r: (r["large_txn_flag"], r["high_velocity_flag"], r["structuring_flag"])
    assert flags(days(spark, (750_000, "fee", "posted", DAY))[0]) == (True, False, False)
    assert flags(days(spark, *[(near, "fee", "posted", DAY)] * 3)[0]) == (False, False, True)
    assert flags(days(spark, *[(1, "fee", "posted", DAY)] * 6)[0]) == (False, True, False)


def test_days_part_at_midnight(spark):
    assert len(days(spark, (1, "fee", "posted", "2026-01-05T23:59:00"), (1, "fee", "posted", "2026-01-06T00:01:00"))) == 2


def test_marts(spark):
    customers = spark.createDataFrame([("C1", "retail", "low"), ("C2", "private", "high")], "customer_id string, segment string, risk_rating string").withColumn("created_at", F.to_timestamp(F.lit("2026-01-01 05:00:00")))
    accounts = spark.createDataFrame([("A1", "C1", 10.0, "active"), ("A2", "C1", 5.0, "active"), ("A3", "C1", 7.0, "closed")], "account_id string, customer_id string, balance double, status string")
    dim = {r["customer_id"]: (r["active_accounts"], r["total_balance"]) for r in marts.dim_customers(customers, accounts).collect()}
    assert dim == {"C1": (2, 15.0), "C2": (0, 0.0)}
    t = spark.createDataFrame([("1", "A1", "JPY", 100.0), ("2", "A1", "USD", 1.0), ("3", "A9", "GBP", 1.0), ("4", "A1", "AUD", 1.0)], "transaction_id string, account_id string, currency string, amount double")
    for c in ("booked_date", "booked_at", "txn_type", "channel", "status"):
        t = t.withColumn(c, F.lit(None).cast("string"))
    rates = spark.createDataFrame([("JPY", "USD", 0.0064), ("JPY", "GBP", 0.0), ("EUR", "AUD", 1.0)], "base_currency string, quote_currency string, rate double")
    fct = {r["transaction_id"]: (r["customer_id"], r["amount_jpy"]) for r in marts.fct_transactions(t, accounts, rates).collect()}
    assert fct == {"1": ("C1", 100.0), "2": ("C1", 156.25), "3": (None, None), "4": ("C1", None)}
    loans = spark.createDataFrame([("card", "approved", 1.0, 700), ("card", "rejected", 2.0, None), ("card", "approved", 3.0, 701), ("mortgage", "submitted", 9.0, 600)], "product string, status string, amount double, credit_score int")
    first, second = marts.mart_loan_funnel(loans).collect()
    assert (first["product"], first["applications"], first["approval_rate"], first["avg_amount"], first["avg_credit_score"]) == ("card", 3, 0.667, 2.0, 701.0)
    assert (second["product"], second["approval_rate"]) == ("mortgage", None)


def test_latest_per_key_and_reconcile(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 0, "d")], "k int, at int, f string")
    assert sorted(r["f"] for r in latest_per_key(rows, ["k"], [F.desc("at"), F.desc("f")]).collect()) == ["c", "d"]
    other = spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(tuple(r) for r in reconcile.reconcile_counts(rows.select("k"), other, "k").collect()) == [(1, 3, 1, False), (2, 1, 0, False), (3, 0, 1, False)]
