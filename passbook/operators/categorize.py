"""Categorisation: merchant defaults, rules, manual edits, and the history of each step."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.compute import shuffled
from passbook.functions.text import collapse, dedup_hash, first_nonempty, payment_handle
from passbook.operators.rules import deciding_rules, first_place, listed, predicate, with_merchant

STATE = ["merchant_id", "category_id", "is_category_auto", "applied_rule_id"]


def _json(**fields: Column) -> Column:
    packed = F.struct(*[c.alias(k) for k, c in fields.items()])
    return F.to_json(packed, {"ignoreNullFields": "false"})


def rule_targets(rules: DataFrame, merchants: DataFrame) -> DataFrame:
    """J10 rule_merchant_default: every deciding rule with its merchant and that one's default category."""
    m = merchants.select(F.col("id").alias("merchant_id"), F.col("default_category_id").alias("category_id"))
    deciding = rules.filter(F.col("is_active") & F.col("merchant_id").isNotNull())
    return deciding.select(F.col("id").alias("rule_id"), "merchant_id").join(m, "merchant_id", "left")


def _default_categories(merchants: DataFrame, rules: list[dict]) -> dict[int, int | None]:
    """Default category per merchant the rules name; there are no more of them than rules."""
    wanted = sorted({r["merchant_id"] for r in rules})
    named = merchants.filter(F.col("id").isin(wanted)).groupBy("id")
    rows = named.agg(F.max("default_category_id").alias("default_category_id")).collect()
    return {r["id"]: r["default_category_id"] for r in rows}


def categorize(ledger: DataFrame, merchants: DataFrame, rules: list[dict]) -> DataFrame:
    """Manual choice, else merchant default, else first matching rule, else unchanged.

    A rule sets the category to its merchant's default even where that is null.  The state
    before is kept in ``before_*``; ``rule`` says what decided.  What the rules lead to is
    looked up by their place in a literal list: a join by rule would gather all rows that no
    rule matches under one key.
    """
    deciding = deciding_rules(rules)
    defaults = _default_categories(merchants, deciding)
    rows = with_merchant(ledger, merchants)
    manual = F.col("category_id").isNotNull() & ~F.coalesce("is_category_auto", F.lit(False))
    has_default = (F.coalesce("merchant_id", F.lit(0)) != 0) & (F.coalesce("merchant_default", F.lit(0)) != 0)
    rows = rows.withColumn("is_manual", manual).withColumn("by_default", ~manual & has_default)
    rows = rows.withColumn("place", F.when(~F.col("is_manual") & ~F.col("by_default"), first_place(rules)))

    def of_rule(values, kind):
        return listed(values, F.col("place"), kind)

    targets = [r["merchant_id"] for r in deciding]
    hit = F.col("place").isNotNull()
    known = of_rule([m in defaults for m in targets], "boolean")
    category = (
        F.when(F.col("by_default"), F.col("merchant_default"))
        .when(hit & known, of_rule([defaults.get(m) for m in targets], "bigint"))
        .otherwise(F.col("category_id"))
    )
    rule_id = of_rule([r["id"] for r in deciding], "bigint")
    after = {
        "merchant_id": F.when(hit, of_rule(targets, "bigint")).otherwise(F.col("merchant_id")),
        "category_id": category,
        "is_category_auto": F.when(F.col("by_default") | hit, True).otherwise(F.col("is_category_auto")),
        "applied_rule_id": F.when(F.col("is_manual"), F.col("applied_rule_id")).otherwise(rule_id),
    }
    rule = F.when(F.col("by_default"), F.concat(F.lit("merchant_default:"), "merchant_name")).when(
        hit, of_rule([r["name"] for r in deciding], "string")
    )
    keep = [c for c in ledger.columns if c not in STATE]
    return rows.select(
        *keep,
        *[F.col(c).alias(f"before_{c}") for c in STATE],
        *[after[c].alias(c) for c in STATE],
        rule.alias("rule"),
    )


def recategorize(
    ledger: DataFrame,
    merchants: DataFrame,
    rules: list[dict],
    merchant_id: int | None = None,
    category_id: int | None = None,
) -> DataFrame:
    """Categorize again the rows that are automatic (of one merchant or category)."""
    rows = ledger.filter("is_category_auto")
    if merchant_id:
        rows = rows.filter(F.col("merchant_id") == merchant_id)
    if category_id:
        rows = rows.filter(F.col("category_id") == category_id)
    return categorize(rows, merchants, rules)


def category_changes(recategorized: DataFrame) -> DataFrame:
    """D12 report: rows whose category changed."""
    changed = ~F.col("before_category_id").eqNullSafe(F.col("category_id"))
    return recategorized.filter(changed).select(
        F.col("id").alias("transaction_id"),
        first_nonempty(F.col("cleaned_description"), F.col("original_description")).alias("description"),
        F.col("before_category_id").alias("before_category"),
        F.col("category_id").alias("after_category"),
        F.col("rule").alias("rule_applied"),
    )


def changes_sample(changes: DataFrame, n: int = 50) -> DataFrame:
    """The first changes, for display."""
    return changes.orderBy("transaction_id").limit(n)


def rule_attribution(ledger: DataFrame, merchants: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows whose applied rule would change if every row were categorized again."""
    done = categorize(ledger, merchants, rules)
    changed = ~F.col("before_applied_rule_id").eqNullSafe(F.col("applied_rule_id"))
    return done.filter(changed).select(
        "id", F.col("before_applied_rule_id").alias("old_rule_id"), F.col("applied_rule_id").alias("new_rule_id")
    )


def _target(merchants: DataFrame, merchant_id: int) -> Column:
    """Default category of one merchant, looked up by key (at most one row)."""
    found = merchants.filter(F.col("id") == merchant_id).select("default_category_id").limit(1).collect()
    if not found:
        raise ValueError(f"Merchant {merchant_id} not found")
    return F.lit(found[0][0]).cast("long")


def apply_rule(
    ledger: DataFrame, merchants: DataFrame, rule_id: int, conditions: dict, merchant_id: int
) -> DataFrame:
    """One rule written over all automatic rows it matches, whatever their rule was.

    ``outcome`` is 'updated', 'skipped' (manual row that matches) or null.
    """
    target = _target(merchants, merchant_id)
    rows = with_merchant(ledger, merchants).withColumn("is_match", predicate(conditions))
    auto = F.coalesce("is_category_auto", F.lit(False))
    outcome = F.when(F.col("is_match") & auto, "updated").when(F.col("is_match"), "skipped")
    hit = F.col("outcome") == "updated"
    after = {
        "merchant_id": F.lit(merchant_id).cast("long"),
        "category_id": target,
        "is_category_auto": F.lit(True),
        "applied_rule_id": F.lit(rule_id).cast("long"),
    }
    rows = rows.withColumn("outcome", outcome)
    keep = [c for c in ledger.columns if c not in STATE]
    return rows.select(
        *keep,
        F.col("category_id").alias("before_category_id"),
        *[F.when(hit, after[c]).otherwise(F.col(c)).alias(c) for c in STATE],
        "outcome",
    )


def rule_application_history(applied: DataFrame, rule_name: str) -> DataFrame:
    """D9 lineage: one row per updated transaction, step 99."""
    return applied.filter(F.col("outcome") == "updated").select(
        F.col("id").alias("transaction_id"),
        F.lit("rule_application").alias("step_name"),
        F.lit(99).cast("long").alias("step_order"),
        _json(category_id=F.col("before_category_id")).alias("input_data"),
        _json(category_id=F.col("category_id"), merchant_id=F.col("merchant_id")).alias("output_data"),
        F.lit(rule_name).alias("rule_applied"),
    )


def apply_counts(applied: DataFrame) -> DataFrame:
    """D9 report: updated and skipped rows."""
    return applied.agg(
        F.count_if(F.col("outcome") == "updated").alias("transactions_updated"),
        F.count_if(F.col("outcome") == "skipped").alias("transactions_skipped"),
    )


def reapply_rule(
    ledger: DataFrame, merchants: DataFrame, rule_id: int, conditions: dict, merchant_id: int
) -> DataFrame:
    """Forget where the rule applied (categories stay), then apply it anew."""
    cleared = ledger.withColumn("applied_rule_id", F.nullif(F.col("applied_rule_id"), F.lit(rule_id).cast("long")))
    return apply_rule(cleared, merchants, rule_id, conditions, merchant_id)


def rule_batch(ledger: DataFrame, patterns: list[tuple[str, str, int]]) -> DataFrame:
    """An ordered list of (name, pattern, category) applied one after the other.

    Later rules overwrite earlier ones on automatic rows, so the last match decides.
    """
    text = F.upper(first_nonempty(F.col("cleaned_description"), F.col("original_description")))
    chain = None
    for name, pattern, category_id in reversed(patterns):
        hit = text.contains(pattern.upper())
        value = F.struct(F.lit(name).alias("name"), F.lit(category_id).cast("long").alias("category_id"))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    auto = F.coalesce("is_category_auto", F.lit(False))
    rows = ledger.withColumn("batch", F.when(auto, chain))
    return rows.withColumn("category_id", F.coalesce("batch.category_id", "category_id")).withColumn(
        "batch_rule", F.col("batch.name")
    ).drop("batch")


def apply_edits(ledger: DataFrame, merchants: DataFrame, edits: DataFrame) -> DataFrame:
    """User edits (transaction_id, merchant_id text or null, notes).

    An empty merchant text clears the merchant and keeps the category; a number sets it and
    takes over that merchant's default category if there is one; anything else is ignored.
    Notes are replaced.
    """
    e = edits.select(
        F.col("transaction_id").alias("id"),
        F.col("merchant_id").alias("edit_text"),
        F.col("merchant_id").try_cast("bigint").alias("edit_merchant"),
        F.col("notes").alias("edit_notes"),
        F.lit(True).alias("edited"),
    )
    m = merchants.select(F.col("id").alias("edit_merchant"), F.col("default_category_id").alias("edit_category"))
    rows = ledger.join(e.join(m, "edit_merchant", "left"), "id", "left")
    takes = F.coalesce("edit_category", F.lit(0)) != 0
    after = {
        "merchant_id": F.when(F.col("edit_text") == "", F.lit(None).cast("long")).otherwise(
            F.coalesce("edit_merchant", "merchant_id")
        ),
        "category_id": F.when(takes, F.col("edit_category")).otherwise(F.col("category_id")),
        "is_category_auto": F.when(takes, True).otherwise(F.col("is_category_auto")),
        "notes": F.when(F.col("edited"), F.col("edit_notes")).otherwise(F.col("notes")),
    }
    return rows.select(*[after.get(c, F.col(c)).alias(c) for c in ledger.columns])


def normalized(ledger: DataFrame) -> DataFrame:
    """D5 normalize: collapsed description and the payee handle as merchant hint."""
    text = collapse(F.coalesce("original_description", F.lit("")))
    return ledger.withColumn("cleaned_description", text).withColumn("merchant_hint", payment_handle(text))


def process_history(ledger: DataFrame, matched: DataFrame, merchants: DataFrame, rules: list[dict]) -> DataFrame:
    """Four lineage rows per transaction (normalize, dedupe, match_merchant, categorize).

    ``matched`` holds (id, new_merchant_id, match_rule) from the alias match of the
    normalized rows.
    """
    before = ledger.select(
        "*",
        F.col("cleaned_description").alias("old_cleaned"),
        F.col("merchant_id").alias("old_merchant_id"),
    )
    rows = normalized(before).join(shuffled(matched), "id").withColumn("merchant_id", F.col("new_merchant_id"))
    done = categorize(rows, merchants, rules)
    digest = dedup_hash(
        F.col("transaction_date"), F.col("amount"), F.col("original_description"), F.col("transaction_type")
    )

    def cat(prefix):
        return _json(**{c: F.col(f"{prefix}{c}") for c in STATE[1:]})

    # A manual or unmatched row reports its state as it was before.
    unchanged = F.col("rule").isNull()
    steps = [
        ("normalize", _json(cleaned_description=F.col("old_cleaned")),
         _json(cleaned_description=F.col("cleaned_description"), upi_handle=F.col("merchant_hint")), F.lit(None)),
        ("dedupe", F.lit(None), _json(dedup_hash=digest), F.lit(None)),
        ("match_merchant", _json(merchant_id=F.col("old_merchant_id")),
         _json(merchant_id=F.col("before_merchant_id")), F.col("match_rule")),
        ("categorize", cat("before_"), F.when(unchanged, cat("before_")).otherwise(cat("")), F.col("rule")),
    ]
    packed = F.array(
        *[
            F.struct(
                F.lit(name).alias("step_name"),
                F.lit(i).cast("long").alias("step_order"),
                old.cast("string").alias("input_data"),
                new.cast("string").alias("output_data"),
                rule.cast("string").alias("rule_applied"),
            )
            for i, (name, old, new, rule) in enumerate(steps, start=1)
        ]
    )
    return done.select(F.col("id").alias("transaction_id"), F.inline(packed))
