"""The amounts that fct_fx_normalized shows are the operator's."""

import os

import pytest

from weirstone.operators import marts
from weirstone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_wrong_amounts_of_the_operator_show(spark, monkeypatch):
    right = {r["transaction_id"]: r["amount_jpy"] for r in catalogue.fct_fx_normalized(spark, SF).collect()}
    made = marts.in_base_currency
    monkeypatch.setattr(marts, "in_base_currency", lambda *a: made(*a) * 2)
    wrong = {r["transaction_id"]: r["amount_jpy"] for r in catalogue.fct_fx_normalized(spark, SF).collect()}
    assert wrong == {i: x and 2 * x for i, x in right.items()}
