"""User-written rules compiled to predicates.

A rule's JSON conditions become one Column, so Catalyst sees plain
expressions.  Rules are written by hand and come as a Python list; the columns
they read are those of the ledger plus ``merchant_name``.
"""

import json
import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions.compute import spread_key
from passbook.functions.text import all_of, any_of, first_nonempty, strip

RULES_PER_STEP = 100


def load_rules(rules: DataFrame) -> list[dict]:
    """Rules table as a list: rules are written by hand, and all of them count."""
    return [{**r.asDict(), "conditions": json.loads(r["conditions"])} for r in rules.collect()]


def rule_field(field: str) -> Column:
    """The value a condition reads, as text; unknown fields are empty."""
    if field == "description":
        return strip(first_nonempty(F.col("cleaned_description"), F.col("original_description")))
    if field == "original_description":
        return strip(F.coalesce("original_description", F.lit("")))
    if field in ("merchant_name", "source_type", "currency"):
        return F.coalesce(field, F.lit(""))
    if field == "amount":
        return F.col("amount").cast("string")
    return F.lit("")


def text_condition(field: Column, operator: str, value: str, case_sensitive: bool) -> Column:
    """P5: contains, starts_with, ends_with, equals, not_contains."""
    needle = F.lit(value)
    if not case_sensitive:
        field, needle = F.upper(field), F.upper(needle)
    if operator == "starts_with":
        return field.startswith(needle)
    if operator == "ends_with":
        return field.endswith(needle)
    if operator == "equals":
        return field == needle
    found = field.contains(needle)
    return ~found if operator == "not_contains" else found


def regex_condition(field: Column, pattern: str, case_sensitive: bool) -> Column:
    """Regex search; a pattern that does not compile matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    java = re.sub(r"\(\?P<", "(?<", pattern)
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", java)
    java = ("(?U)" if case_sensitive else "(?iuU)") + java
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(java)
    except IllegalArgumentException:
        return F.lit(False)
    return field.rlike(java)


#: Ledger amounts are smaller than this.
LARGEST = 10**12


def at_least(field: Column, value) -> Column:
    """Whether an amount is ``value`` or more, for any size of ``value``."""
    if abs(float(value)) >= LARGEST:
        return field.isNotNull() & F.lit(float(value) < 0)
    return field >= F.lit(str(value)).cast("decimal(18,6)")


def at_most(field: Column, value) -> Column:
    """Whether an amount is ``value`` or less, for any size of ``value``."""
    if abs(float(value)) >= LARGEST:
        return field.isNotNull() & F.lit(float(value) > 0)
    return field <= F.lit(str(value)).cast("decimal(18,6)")


def number_condition(field: Column, operator: str, value) -> Column:
    """Comparisons as double; a field that is no number never matches."""
    number = field.try_cast("double")
    if operator == "between":
        if not (isinstance(value, (list, tuple)) and len(value) == 2):
            return F.lit(False)
        hit = number.between(float(value[0]), float(value[1]))
    elif operator == "greater_than":
        hit = number > float(value)
    elif operator == "less_than":
        hit = number < float(value)
    else:
        hit = F.abs(number - float(value)) < 0.01
    return F.coalesce(hit, F.lit(False))


def condition(spec: dict) -> Column:
    """One condition; a missing value or an unknown operator matches nothing."""
    value = spec.get("value")
    if value is None:
        return F.lit(False)
    name = spec.get("field", "description")
    operator = spec.get("operator", "contains")
    exact = spec.get("case_sensitive", False)
    field = rule_field(name)
    if operator in ("contains", "starts_with", "ends_with", "equals", "not_contains"):
        return text_condition(field, operator, str(value), exact)
    if operator == "regex":
        return regex_condition(field, str(value), exact)
    if operator in ("greater_than", "less_than", "equals_number", "between"):
        return number_condition(F.col("amount") if name == "amount" else field, operator, value)
    return F.lit(False)


def flat_condition(spec: dict) -> Column:
    """P10: the older flat form; an empty one matches every row."""
    parts = []
    if spec.get("merchant_id"):
        parts.append(F.coalesce(F.col("merchant_id") == spec["merchant_id"], F.lit(False)))
    if spec.get("pattern"):
        text = F.upper(first_nonempty(F.col("cleaned_description"), F.col("original_description")))
        parts.append(text.contains(F.upper(F.lit(spec["pattern"]))))
    if spec.get("min_amount") is not None:
        parts.append(at_least(F.col("amount"), spec["min_amount"]))
    if spec.get("max_amount") is not None:
        parts.append(at_most(F.col("amount"), spec["max_amount"]))
    return all_of(parts)


def predicate(conditions: dict) -> Column:
    """All conditions (or any, with logic OR); an empty list matches nothing."""
    if "rules" not in conditions:
        return flat_condition(conditions)
    parts = [condition(c) for c in conditions["rules"]]
    if not parts:
        return F.lit(False)
    return any_of(parts) if conditions.get("logic", "AND").upper() == "OR" else all_of(parts)


def evaluation_order(rules: list[dict]) -> list[dict]:
    """Active rules by priority, ties by id."""
    return sorted((r for r in rules if r.get("is_active", True)), key=lambda r: (r["priority"], r["id"]))


def with_merchant(ledger: DataFrame, merchants: DataFrame) -> DataFrame:
    """Adds merchant_name and merchant_default for the rules to read."""
    m = merchants.select(
        F.col("id").cast("string").alias("m_key"),
        F.col("name").alias("merchant_name"),
        F.col("default_category_id").alias("merchant_default"),
    )
    return ledger.withColumn("m_key", spread_key("merchant_id")).join(m, "m_key", "left").drop("m_key")


def deciding_rules(rules: list[dict]) -> list[dict]:
    """Active rules that name a merchant, in evaluation order."""
    return [r for r in evaluation_order(rules) if r.get("merchant_id")]


def first_place(rules: list[dict]) -> Column:
    """W5 first_rule_wins: place of the first match among the deciding rules, else null.

    Long rule sets are cut into chains, so that no single expression grows without bound.
    """
    numbered = list(enumerate(deciding_rules(rules)))
    chains = []
    for start in range(0, len(numbered), RULES_PER_STEP):
        chain = None
        for place, rule in numbered[start : start + RULES_PER_STEP]:
            hit = predicate(rule["conditions"])
            chain = F.when(hit, F.lit(place)) if chain is None else chain.when(hit, F.lit(place))
        chains.append(chain)
    return F.coalesce(*chains) if chains else F.lit(None).cast("int")


def listed(values: list, place: Column, kind: str) -> Column:
    """The value at a place of a short list known on the driver."""
    return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), place)


def first_rule(rules: list[dict]) -> Column:
    """Id of the rule at ``first_place``."""
    return listed([r["id"] for r in deciding_rules(rules)], first_place(rules), "bigint")


def matching_rules(rules: list[dict]) -> Column:
    """J9 rule_match: ids of all active rules that match, in evaluation order."""
    hits = [
        F.when(predicate(r["conditions"]), F.lit(r["id"]).cast("long")) for r in evaluation_order(rules)
    ]
    if not hits:
        return F.array().cast("array<bigint>")
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def rule_conflicts(ledger: DataFrame, merchants: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that more than one rule matches."""
    rows = with_merchant(ledger, merchants).select("id", F.size(matching_rules(rules)).alias("rule_matches"))
    return rows.filter(F.col("rule_matches") > 1).select("id", F.col("rule_matches").cast("long").alias("rule_matches"))


def preview(ledger: DataFrame, merchants: DataFrame, conditions: dict) -> DataFrame:
    """The rows a rule would match."""
    return with_merchant(ledger, merchants).filter(predicate(conditions))


def preview_totals(ledger: DataFrame, merchants: DataFrame, conditions: dict) -> DataFrame:
    """Number, amount and manual/auto split of the matches."""
    return preview(ledger, merchants, conditions).agg(
        F.count("*").alias("total_matches"),
        F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(12,2)")).cast("double").alias("total_amount"),
        F.count_if(~F.col("is_category_auto")).alias("manual_count"),
        F.count_if(F.col("is_category_auto")).alias("auto_count"),
    )


def preview_categories(
    ledger: DataFrame, merchants: DataFrame, categories: DataFrame, conditions: dict
) -> DataFrame:
    """Matches per present category id; null is Uncategorized, an unknown id Unknown."""
    n = preview(ledger, merchants, conditions).groupBy("category_id").agg(F.count("*").alias("n"))
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    label = F.when(F.col("category_id").isNull(), "Uncategorized").otherwise(
        F.coalesce("category_name", F.lit("Unknown"))
    )
    return n.join(names, "category_id", "left").select("category_id", label.alias("category_name"), "n")


def preview_page(
    ledger: DataFrame, merchants: DataFrame, conditions: dict, page: int = 1, page_size: int = 20
) -> DataFrame:
    """One page of matching rows in id order."""
    rows = preview(ledger, merchants, conditions).orderBy("id").offset((page - 1) * page_size).limit(page_size)
    return rows.select(
        "id",
        F.date_format("transaction_date", "yyyy-MM-dd").alias("date"),
        first_nonempty(F.col("cleaned_description"), F.col("original_description")).alias("description"),
        F.col("amount").cast("double").alias("amount"),
        F.col("category_id").alias("current_category_id"),
        (~F.col("is_category_auto")).alias("is_manual"),
    )
