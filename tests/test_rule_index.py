"""The rule index finds what the chain of all rules finds, and its plan holds no rule."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from passbook.operators import rule_index
from passbook.operators import rules as ru

ROWS = (
    "id long, amount decimal(12,2), merchant_id long, merchant_name string, cleaned_description string, "
    "original_description string, source_type string, currency string, transaction_date timestamp_ntz"
)
BOOK = "id long, name string, priority long, is_active boolean, conditions string, merchant_id long"


def words(rng):
    return "".join(rng.choices("abcß", k=rng.randint(0, 4)))


def random_rows(rng, n):
    out = []
    for i in range(n):
        text = " ".join(words(rng) for _ in range(rng.randint(0, 4)))
        out.append((
            i, Decimal(rng.randint(-20000, 90000)) / 100, rng.choice([None, 1, 2, 3]), rng.choice([None, "Shop A", "shop b"]),
            rng.choice([None, "", text.upper()]), rng.choice([None, text, text + " X"]), rng.choice(["bank_csv", "card_pdf"]),
            rng.choice([None, "INR"]), dt.datetime(2026, 1, 1),
        ))
    return out


def random_condition(rng):
    field = rng.choice(["description", "original_description", "merchant_name", "source_type", "currency", "amount", "other"])
    operator = rng.choice(["contains", "starts_with", "ends_with", "equals", "not_contains", "regex", "between", "greater_than", "less_than", "equals_number", "odd"])
    value = rng.choice([words(rng), words(rng) + " " + words(rng), "INR", "shop", ""])
    if field == "amount":
        operator = rng.choice(["between", "greater_than", "less_than", "equals_number"])
    if operator in ("greater_than", "less_than", "equals_number"):
        value = rng.choice([rng.randint(-200, 900), "12.5", rng.random() * 500])
    elif operator == "between":
        value = rng.choice([[rng.randint(-200, 100), str(rng.randint(0, 900))], [5], [80.5, 3]])
    spec = {"field": field, "operator": operator, "value": rng.choice([value] * 9 + [None])}
    if rng.random() < 0.3:
        spec["case_sensitive"] = True
    return spec


def random_conditions(rng):
    if rng.random() < 0.2:
        flat = {"merchant_id": rng.choice([None, 0, 1, 3]), "pattern": rng.choice(["", None, "ab", "c"]), "min_amount": rng.choice([None, 5]), "max_amount": rng.choice([None, 300.5])}
        return {k: v for k, v in flat.items() if rng.random() < 0.7}
    conditions = {"rules": [random_condition(rng) for _ in range(rng.choice([0, 1, 1, 2, 3]))]}
    if rng.random() < 0.5:
        conditions["logic"] = rng.choice(["OR", "or", "AND"])
    return conditions


def check(spark, rows, book):
    ledger = spark.createDataFrame(rows, ROWS).repartition(4)
    frame = spark.createDataFrame([(i, f"r{i}", p, a, json.dumps(c), m) for i, p, a, c, m in book], BOOK)
    rules = ru.load_rules(frame)
    want = ledger.select("id", F.explode(ru.matching_rules(rules)).alias("rule_id"))
    found = rule_index.rule_matches(ledger, frame)
    got = [(r.id, r.rule_id) for r in found.collect()]
    assert sorted(got) == sorted((r.id, r.rule_id) for r in want.collect())
    first = ledger.select("id", ru.first_rule(rules).alias("rule_id")).filter("rule_id IS NOT NULL")
    assert sorted(map(tuple, rule_index.first_rules(found).collect())) == sorted(map(tuple, first.collect()))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_chain(spark, seed):
    rng = random.Random(seed)
    book = [(i, rng.randint(0, 5), rng.choice([True, True, None, False]), random_conditions(rng), rng.choice([None, 0, 4, 5])) for i in range(90)]
    book = [(i, p, a is not False, c, m) for i, p, a, c, m in book]
    check(spark, random_rows(rng, 150), book)


def test_empty(spark):
    rows = random_rows(random.Random(1), 3)
    check(spark, rows, [(1, 1, True, {"rules": []}, 1)])
    check(spark, [], [(1, 1, True, {"rules": [{"value": "a"}]}, 1)])


def test_many_rules_without_a_chain(spark):
    """Three thousand rules; the plan is no longer than that of one."""
    rng = random.Random(4)
    rows = [(i, Decimal(i % 500), None, None, None, f"PAY shop {i % 3500} store", "bank_csv", "INR", dt.datetime(2026, 1, 1)) for i in range(4000)]
    book = [(i, i % 7, True, {"rules": [{"value": f"shop {i} "}, {"field": "amount", "operator": "less_than", "value": 400}]}, 9) for i in range(3000)]
    rng.shuffle(book)
    ledger = spark.createDataFrame(rows, ROWS)
    frame = spark.createDataFrame([(i, "", p, a, json.dumps(c), m) for i, p, a, c, m in book], BOOK)
    found = rule_index.rule_matches(ledger, frame)
    plan = found._jdf.queryExecution().toString()
    assert "shop 17" not in plan and len(plan) < 200_000
    want = {(r[0], r[0] % 3500) for r in rows if r[0] % 3500 < 3000 and r[1] < 400}
    assert {(r.id, r.rule_id) for r in found.collect()} == want
