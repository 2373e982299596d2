"""Rule predicates, first rule, categorisation order and manual edits."""

import datetime as dt
from decimal import Decimal

import pytest

from passbook.operators import categorize as c
from passbook.operators import rules as ru

LEDGER = (
    "id long, transaction_date timestamp_ntz, amount decimal(12,2), source_type string, currency string, transaction_type string, "
    "original_description string, cleaned_description string, merchant_id long, category_id long, is_category_auto boolean, "
    "applied_rule_id long, notes string"
)


def tx(i, text, amount="150.00", merchant=None, category=None, auto=True, rule=None, cleaned=""):
    return (i, dt.datetime(2026, 1, 1), Decimal(amount), "bank_csv", "INR", "expense", text, cleaned, merchant, category, auto, rule, None)


@pytest.fixture(scope="module")
def merchants(spark):
    return spark.createDataFrame(
        [(1, "Swiggy", "business", 4), (2, "Plain", "business", None), (3, "Uber", "business", 8)],
        "id long, name string, type string, default_category_id long",
    )


def matches(spark, merchants, conditions, *rows):
    df = ru.with_merchant(spark.createDataFrame(list(rows), LEDGER), merchants)
    return {r["id"] for r in df.filter(ru.predicate(conditions)).collect()}


def one(field, operator, value, **more):
    return {"rules": [{"field": field, "operator": operator, "value": value, **more}]}


CASES = [
    (one("description", "contains", "swiggy"), True),
    (one("description", "contains", "swiggy", case_sensitive=True), False),
    (one("description", "starts_with", "upi-"), True),
    (one("description", "ends_with", "order1"), True),
    (one("description", "equals", "UPI-SWIGGY BANGALORE ORDER1"), True),
    (one("description", "not_contains", "zomato"), True),
    (one("description", "regex", r"swiggy\s+bang"), True),
    (one("description", "regex", "(?P<n>SWIG)gy"), True),
    (one("description", "regex", "("), False),
    (one("amount", "greater_than", 100), True),
    (one("amount", "less_than", "150"), False),
    (one("amount", "equals_number", 150.009), True),
    (one("amount", "equals_number", 150.02), False),
    (one("amount", "between", [150, 200]), True),
    (one("amount", "between", [150]), False),
    (one("amount", "contains", "50.0"), True),
    (one("merchant_name", "equals", "swiggy"), True),
    (one("source_type", "equals", "BANK_CSV"), True),
    (one("nothing", "equals", ""), True),
    (one("description", "contains", None), False),
    (one("description", "unknown", "x"), False),
    ({"rules": []}, False),
    ({}, True),
    ({"pattern": "swiggy", "min_amount": 150, "max_amount": 150}, True),
    ({"merchant_id": 2}, False),
    ({"rules": [one("amount", "greater_than", 1)["rules"][0], one("amount", "less_than", 1)["rules"][0]]}, False),
    ({"rules": [one("amount", "greater_than", 1)["rules"][0], one("amount", "less_than", 1)["rules"][0]], "logic": "or"}, True),
]


def test_conditions(spark, merchants):
    row = tx(1, "  UPI-SWIGGY BANGALORE ORDER1 ", merchant=1)
    df = ru.with_merchant(spark.createDataFrame([row], LEDGER), merchants)
    got = df.select(*[ru.predicate(spec).alias(str(i)) for i, (spec, _) in enumerate(CASES)]).collect()[0]
    assert [got[str(i)] for i in range(len(CASES))] == [want for _, want in CASES]


def test_number_in_rule_must_parse():
    with pytest.raises(ValueError):
        ru.condition({"field": "amount", "operator": "greater_than", "value": "many"})


RULES = [
    {"id": 5, "name": "late", "priority": 10, "merchant_id": 3, "conditions": one("description", "contains", "shop")},
    {"id": 4, "name": "early", "priority": 10, "merchant_id": 2, "conditions": one("description", "contains", "shop")},
    {"id": 1, "name": "off", "priority": 1, "merchant_id": 3, "is_active": False, "conditions": {}},
    {"id": 2, "name": "nobody", "priority": 1, "merchant_id": None, "conditions": {}},
    {"id": 9, "name": "unknown merchant", "priority": 90, "merchant_id": 77, "conditions": one("description", "contains", "odd")},
]


def test_order_of_precedence(spark, merchants):
    rows = [
        tx(1, "shop", merchant=1, category=9, auto=False, rule=6),  # manual
        tx(2, "shop", merchant=1, category=9, rule=6),  # merchant default
        tx(3, "shop", merchant=2, category=9, rule=6),  # first rule, whose merchant has no default
        tx(4, "none", category=9, rule=6),  # nothing matches
        tx(5, "odd", category=9),  # rule with unknown merchant keeps the category
    ]
    got = {r["id"]: r for r in c.categorize(spark.createDataFrame(rows, LEDGER), merchants, RULES).collect()}
    state = {i: (r["merchant_id"], r["category_id"], r["applied_rule_id"], r["rule"]) for i, r in got.items()}
    assert state == {
        1: (1, 9, 6, None),
        2: (1, 4, None, "merchant_default:Swiggy"),
        3: (2, None, 4, "early"),
        4: (None, 9, None, None),
        5: (77, 9, 9, "unknown merchant"),
    }


def test_many_rules(spark, merchants):
    rules = [
        {"id": i, "name": f"r{i}", "priority": 1, "merchant_id": 3, "conditions": one("description", "equals", f"t{i}")}
        for i in range(1, 260)
    ]
    rows = [tx(i, f"t{i}") for i in (1, 150, 259, 300)]
    df = ru.with_merchant(spark.createDataFrame(rows, LEDGER), merchants)
    got = {r["id"]: r["rule"] for r in df.select("id", ru.first_rule(rules).alias("rule")).collect()}
    assert got == {1: 1, 150: 150, 259: 259, 300: None}


def test_apply_rule_skips_manual_rows(spark, merchants):
    rows = [tx(1, "shop", category=9, auto=False), tx(2, "shop"), tx(3, "none")]
    done = c.apply_rule(spark.createDataFrame(rows, LEDGER), merchants, 8, one("description", "contains", "shop"), 3)
    assert tuple(c.apply_counts(done).collect()[0]) == (1, 1)
    assert {r["id"]: (r["category_id"], r["applied_rule_id"]) for r in done.collect()} == {1: (9, None), 2: (8, 8), 3: (None, None)}
    with pytest.raises(ValueError):
        c.apply_rule(spark.createDataFrame(rows, LEDGER), merchants, 8, {}, 99)


def test_edits(spark, merchants):
    rows = [tx(1, "a", merchant=2, category=9, auto=False), tx(2, "a", merchant=2, category=9), tx(3, "a", merchant=2, category=9), tx(4, "a")]
    edits = spark.createDataFrame(
        [(1, "1", "n1"), (2, "", None), (3, "x", "n3")], "transaction_id long, merchant_id string, notes string"
    )
    got = {r["id"]: r for r in c.apply_edits(spark.createDataFrame(rows, LEDGER), merchants, edits).collect()}
    assert (got[1]["merchant_id"], got[1]["category_id"], got[1]["is_category_auto"], got[1]["notes"]) == (1, 4, True, "n1")
    assert (got[2]["merchant_id"], got[2]["category_id"]) == (None, 9)
    assert (got[3]["merchant_id"], got[3]["notes"]) == (2, "n3")
