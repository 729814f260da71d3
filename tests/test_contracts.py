import pytest
from pydantic import ValidationError
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.contracts import Contract, breaks, check_all, field_rows, latest_contracts, load_definitions, observed_fields, spark_type, struct_type


def made(**changes):
    """A contract of parcels."""
    raw = {
        "contract": "parcels", "version": 1, "owner": "depot", "primary_key": ["code"], "event_time_field": "scanned", "sla": {"freshness_hours": 6},
        "fields": [
            {"name": "code", "type": "string", "nullable": False}, {"name": "scanned", "type": "timestamp", "nullable": False},
            {"name": "state", "type": "string", "allowed_values": ["held", "sent"]}, {"name": "grams", "type": "integer"},
        ],
    }
    return Contract.model_validate(raw | changes)


def fields(*more, drop=()):
    return [f.model_dump() for f in made().fields if f.name not in drop] + list(more)


def test_shipped_contracts_load_and_are_compatible(spark):
    held = latest_contracts()
    assert {n: c.version for n, c in held.items()} == {"accounts": 1, "customers": 2, "loan_applications": 1, "transactions": 1}
    assert [f.name for f in held["customers"].pii_fields] == ["full_name", "email", "phone", "address"]
    assert len(load_definitions()) == 5 and check_all(spark).count() == 0


def test_no_definitions(tmp_path):
    with pytest.raises(FileNotFoundError):
        load_definitions(tmp_path)


@pytest.mark.parametrize(
    "changes",
    [
        {"version": 0}, {"sla": {"freshness_hours": 0}}, {"primary_key": ["grams"]}, {"primary_key": []}, {"primary_key": ["nowhere"]}, {"event_time_field": "nowhere"}, {"fields": []},
        {"fields": fields({"name": "code", "type": "string"})}, {"fields": fields({"name": "Grams", "type": "string"})}, {"fields": fields({"name": "kilos", "type": "float"})},
        {"fields": fields({"name": "sender", "type": "string", "pii": True})}, {"fields": fields({"name": "sender", "type": "string", "pii_category": "sensitive"})}, {"colour": "red"},
    ],
)
def test_bad_contracts(changes):
    with pytest.raises(ValidationError):
        made(**changes)


def test_field_lookup():
    assert made().field("state").allowed_values == ["held", "sent"]
    with pytest.raises(KeyError):
        made().field("nowhere")


def test_types():
    assert spark_type("decimal(18, 2)") == T.DecimalType(18, 2) and spark_type("bigint") == T.LongType()
    assert all(f.nullable for f in struct_type(made()))
    with pytest.raises(ValueError):
        spark_type("text")


def after(**changes):
    """The fields of ``made()`` with some changed by name: None takes one out."""
    return [f.model_dump() | changes.get(f.name, {}) for f in made().fields if changes.get(f.name, {}) is not None]


def test_breaks_between_versions(spark):
    versions = [
        made(),
        made(version=2, fields=fields({"name": "note", "type": "string"})),  # more that may be null: no break
        made(version=4, fields=after(state={"allowed_values": ["sent", "lost"]}, grams={"type": "bigint", "nullable": False}) + [{"name": "route", "type": "string", "nullable": False}]),
        made(version=5, fields=after(grams=None, state={"allowed_values": None}) + [{"name": "route", "type": "string", "nullable": False}]),
        made(version=6, primary_key=["route", "code"], event_time_field="loaded", fields=after(grams=None) + [{"name": "route", "type": "string", "nullable": False}, {"name": "loaded", "type": "timestamp"}]),
    ]
    alone = made(contract="pallets", version=3)
    found = breaks(field_rows(spark, [*versions[::-1], alone]))
    assert {(r.old_version, r.version, r.field, r.kind, r.detail) for r in found.collect()} == {
        (2, 4, "note", "removed", ""), (2, 4, "state", "values_lost", "held"), (2, 4, "grams", "type_changed", "integer to bigint"), (2, 4, "grams", "became_required", ""), (2, 4, "route", "added_required", ""),
        (4, 5, "grams", "removed", ""), (4, 5, "state", "values_lost", "lost,sent"),
        (5, 6, "code", "key_changed", "0 to 1"), (5, 6, "route", "key_changed", "none to 0"), (5, 6, "scanned", "event_time_changed", ""), (5, 6, "loaded", "event_time_changed", ""),
    }
    assert found.count() == 11 and found.where("contract <> 'parcels'").count() == 0


def test_what_rows_show_of_a_contract(spark):
    rows = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 1, None, 2.0), ("a", 1, "y", None), ("a", 2, None, 1.5), ("b", 1, "z", 7.0)], "c string, v int, s string, n double")
    found = {(r.contract, r.version, r.field): (r.type, r.nullable, r.allowed_values) for r in observed_fields(rows, F.col("c"), F.col("v"), ("s",), ("n",)).collect()}
    assert found == {
        ("a", 1, "s"): ("string", True, ["x", "y"]), ("a", 1, "n"): ("bigint", True, None), ("a", 2, "n"): ("double", False, None), ("b", 1, "s"): ("string", False, ["z"]), ("b", 1, "n"): ("bigint", False, None),
    }
    assert {(r.field, r.kind) for r in breaks(observed_fields(rows, F.col("c"), F.col("v"), ("s",), ("n",))).collect()} == {("s", "removed"), ("n", "type_changed"), ("n", "became_required")}
