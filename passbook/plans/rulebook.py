"""The categorisation rules the registered queries use."""

import json

from pyspark.sql import DataFrame, SparkSession


def one_condition(field, operator, value, **more):
    return {"field": field, "operator": operator, "value": value, **more}


def _rule(id, name, priority, merchant_id, conditions, is_active=True):
    return {
        "id": id, "name": name, "priority": priority, "merchant_id": merchant_id,
        "conditions": conditions, "is_active": is_active,
    }


RULES = [
    _rule(1, "Rings", 10, 3, {"rules": [one_condition("description", "contains", "ring")]}),
    _rule(2, "Hot transfers", 10, 4, {"rules": [one_condition("description", "regex", r"^(upi|neft)-hot\b")]}),
    _rule(3, "Middle amounts", 5, 7, {
        "rules": [one_condition("amount", "between", [50, 80]), one_condition("description", "not_contains", "RED")],
        "logic": "AND",
    }),
    _rule(4, "Small or plate", 20, 1, {
        "rules": [
            one_condition("description", "starts_with", "UPI-SMALL"),
            one_condition("original_description", "ends_with", "PLATE", case_sensitive=True),
        ],
        "logic": "OR",
    }),
    _rule(5, "Legacy widgets", 30, 6, {"pattern": "widget", "min_amount": 20, "max_amount": 60}),
    _rule(6, "Switched off", 1, 2, {"rules": [one_condition("description", "contains", "E")]}, is_active=False),
    _rule(7, "No merchant", 1, None, {"rules": [one_condition("description", "contains", "E")]}),
    _rule(8, "By merchant", 40, 5, {"rules": [one_condition("merchant_name", "equals", "supplier#000000003")]}),
    _rule(9, "Broken pattern", 2, 8, {"rules": [one_condition("description", "regex", "(")]}),
    _rule(10, "Card rows", 50, 9, {
        "rules": [one_condition("source_type", "equals", "credit_card_pdf"), one_condition("amount", "greater_than", 100)],
    }),
    _rule(11, "Exact amount", 45, 10, {"rules": [one_condition("amount", "equals_number", "25.5")]}),
    _rule(12, "Tiny", 60, 2, {"rules": [one_condition("amount", "less_than", 1.5), one_condition("currency", "equals", "inr")]}),
]

# The same predicates in SQL over a row with columns d (stripped description), o (stripped
# original), u (upper unstripped description), merchant_name, amount, source_type, currency.
RULE_SQL = {
    1: "contains(upper(d), 'RING')",
    2: "regexp_matches(d, '(?i)^(upi|neft)-hot\\b')",
    3: "(amount BETWEEN 50 AND 80 AND NOT contains(upper(d), 'RED'))",
    4: "(starts_with(upper(d), 'UPI-SMALL') OR ends_with(o, 'PLATE'))",
    5: "(contains(u, 'WIDGET') AND amount >= 20 AND amount <= 60)",
    8: "upper(coalesce(merchant_name, '')) = 'SUPPLIER#000000003'",
    10: "(source_type = 'credit_card_pdf' AND amount > 100)",
    11: "abs(CAST(amount AS DOUBLE) - 25.5) < 0.01",
    12: "(amount < 1.5 AND currency = 'INR')",
}

RULE_ROWS_SQL = """
rule_rows AS (
  SELECT l.*, m.name AS merchant_name, m.default_category_id,
    trim(coalesce(nullif(cleaned_description, ''), original_description, '')) AS d,
    trim(coalesce(original_description, '')) AS o,
    upper(coalesce(nullif(cleaned_description, ''), original_description, '')) AS u
  FROM ledger l LEFT JOIN merchants m ON m.id = l.merchant_id)"""


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as a DataFrame, conditions as JSON text."""
    rows = [
        (r["id"], r["name"], r["priority"], r["is_active"], json.dumps(r["conditions"]), r["merchant_id"]) for r in rules
    ]
    schema = "id bigint, name string, priority bigint, is_active boolean, conditions string, merchant_id bigint"
    return spark.createDataFrame(rows, schema)


def rules_values_sql() -> str:
    values = ", ".join(
        f"({r['id']}, '{r['name']}', {r['priority']}, {str(r['is_active']).upper()}, {r['merchant_id'] or 'NULL'})"
        for r in RULES
    )
    return f"""rules AS (SELECT CAST(id AS BIGINT) AS id, name, CAST(priority AS BIGINT) AS priority, is_active,
      CAST(merchant_id AS BIGINT) AS merchant_id FROM (VALUES {values}) v(id, name, priority, is_active, merchant_id))"""
