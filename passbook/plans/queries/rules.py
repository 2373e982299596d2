"""Rule, categorisation and merchant-matching queries."""

from pyspark.sql import functions as F

from passbook.functions import text as t
from passbook.functions.compute import shuffled
from passbook.operators import categorize as c
from passbook.operators import matching as m
from passbook.operators import rule_index
from passbook.operators import rules as ru
from passbook.plans.registry import register
from passbook.plans.rulebook import RULE_ROWS_SQL, RULE_SQL, RULES, rules_frame, rules_values_sql
from passbook.plans.rulebook import one_condition as _one
from passbook.plans.testdata import aliases, categories, ledger, merchants, oracle

BY_ID = {r["id"]: r for r in RULES}


def _rows(spark, sf_dir):
    return ru.with_merchant(ledger(spark, sf_dir), merchants(spark, sf_dir))


# One query per rule operator: the ids of the rows the operator accepts.
def _predicate_queries():
    specs = {
        "rule_contains": ({"rules": [_one("description", "contains", "ring")]}, "contains(upper(d), 'RING')"),
        "rule_starts_with": (
            {"rules": [_one("description", "starts_with", "upi-h")]}, "starts_with(upper(d), 'UPI-H')"
        ),
        "rule_ends_with": ({"rules": [_one("description", "ends_with", "rod")]}, "ends_with(upper(d), 'ROD')"),
        "rule_equals": ({"rules": [_one("description", "equals", "hot gear")]}, "upper(d) = 'HOT GEAR'"),
        "rule_not_contains": (
            {"rules": [_one("original_description", "not_contains", "Neft", case_sensitive=True)]},
            "NOT contains(o, 'Neft')",
        ),
        "rule_regex": (
            {"rules": [_one("description", "regex", r"^(upi|neft)-\w+ r\w+$")]},
            r"regexp_matches(d, '(?i)^(upi|neft)-\w+ r\w+$')",
        ),
        "rule_greater_than": ({"rules": [_one("amount", "greater_than", "99.5")]}, "amount > 99.5"),
        "rule_less_than": ({"rules": [_one("amount", "less_than", 3)]}, "amount < 3"),
        "rule_equals_number": (
            {"rules": [_one("amount", "equals_number", 25.5)]}, "abs(CAST(amount AS DOUBLE) - 25.5) < 0.01"
        ),
        "rule_between": ({"rules": [_one("amount", "between", [10, "20.5"])]}, "amount BETWEEN 10 AND 20.5"),
        "rule_logic": (BY_ID[4]["conditions"], RULE_SQL[4]),
        "rule_legacy": (BY_ID[5]["conditions"], RULE_SQL[5]),
        "rule_merchant_name": (BY_ID[8]["conditions"], RULE_SQL[8]),
    }
    for name, (conditions, sql) in specs.items():

        def run(spark, sf_dir, conditions=conditions):
            return ru.preview(ledger(spark, sf_dir), merchants(spark, sf_dir), conditions).select("id")

        register(name, oracle(f"SELECT id FROM rule_rows WHERE {sql}", more=RULE_ROWS_SQL))(run)


_predicate_queries()

RULE_FIELDS = ["description", "original_description", "merchant_name", "amount", "source_type", "currency", "other"]


@register(
    "rule_field",
    oracle(
        """SELECT id, d AS description, o AS original_description, coalesce(merchant_name, '') AS merchant_name,
      CAST(amount AS VARCHAR) AS amount, source_type, currency, '' AS other FROM rule_rows""",
        more=RULE_ROWS_SQL,
    ),
)
def rule_field(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", *[ru.rule_field(f).alias(f) for f in RULE_FIELDS])


ACTIVE = [r for r in ru.evaluation_order(RULES) if r["id"] in RULE_SQL]
MATCHED_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {RULE_SQL[r['id']]} THEN {r['id']} END" for r in ACTIVE
) + "], lambda x: x IS NOT NULL)"
# Rule 7 names no merchant but still counts as a match where all matches are listed.
ALL_MATCHED_SQL = f"list_concat(CASE WHEN contains(upper(d), 'E') THEN [7] ELSE [] END, {MATCHED_SQL})"


@register(
    "rule_match",
    oracle(
        f"""SELECT id, CAST(unnest({ALL_MATCHED_SQL}) AS BIGINT) AS rule_id FROM rule_rows""", more=RULE_ROWS_SQL
    ),
)
def rule_match(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", F.explode(ru.matching_rules(RULES)).alias("rule_id"))


@register(
    "rule_conflicts",
    oracle(
        f"""SELECT id, CAST(len({ALL_MATCHED_SQL}) AS BIGINT) AS rule_matches FROM rule_rows
    WHERE len({ALL_MATCHED_SQL}) > 1""",
        more=RULE_ROWS_SQL,
    ),
)
def rule_conflicts(spark, sf_dir):
    return ru.rule_conflicts(ledger(spark, sf_dir), merchants(spark, sf_dir), RULES)


@register(
    "first_rule_wins",
    oracle(
        f"""SELECT id, CAST(({MATCHED_SQL})[1] AS BIGINT) AS rule_id FROM rule_rows""", more=RULE_ROWS_SQL
    ),
)
def first_rule_wins(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", ru.first_rule(RULES).alias("rule_id"))


# D7 in SQL: decided(id, ..., mid, cid, auto, rid, rule)
_NAMES = " ".join(f"WHEN {r['id']} THEN '{r['name']}'" for r in ACTIVE)
_TARGETS = " ".join(f"WHEN {r['id']} THEN {r['merchant_id']}" for r in ACTIVE)


def decided_sql(rows: str) -> str:
    return f"""
stage AS (
  SELECT r.*, r.category_id IS NOT NULL AND NOT is_category_auto AS manual,
    NOT (r.category_id IS NOT NULL AND NOT is_category_auto) AND default_category_id IS NOT NULL AS dflt,
    ({MATCHED_SQL})[1] AS hit FROM {rows} r),
stage2 AS (SELECT *, CASE WHEN NOT manual AND NOT dflt THEN hit END AS rid0 FROM stage),
stage3 AS (SELECT *, CAST(CASE rid0 {_TARGETS} END AS BIGINT) AS rmid FROM stage2),
decided AS (
  SELECT s.*, coalesce(rmid, s.merchant_id) AS mid,
    CASE WHEN dflt THEN s.default_category_id WHEN rid0 IS NOT NULL THEN
      CASE WHEN rm.id IS NOT NULL THEN rm.default_category_id ELSE s.category_id END ELSE s.category_id END AS cid,
    CASE WHEN dflt OR rid0 IS NOT NULL THEN TRUE ELSE is_category_auto END AS auto,
    CASE WHEN manual THEN applied_rule_id ELSE CAST(rid0 AS BIGINT) END AS rid,
    CASE WHEN dflt THEN 'merchant_default:' || merchant_name ELSE CASE rid0 {_NAMES} END END AS rule
  FROM stage3 s LEFT JOIN merchants rm ON rm.id = s.rmid)"""


DECIDED = RULE_ROWS_SQL + "," + decided_sql("rule_rows")


@register(
    "rule_merchant_default",
    oracle(
        """SELECT r.id AS rule_id, r.merchant_id, m.default_category_id AS category_id FROM rules r
    LEFT JOIN merchants m ON m.id = r.merchant_id WHERE r.is_active AND r.merchant_id IS NOT NULL""",
        more=rules_values_sql(),
    ),
)
def rule_merchant_default(spark, sf_dir):
    return c.rule_targets(rules_frame(spark, RULES), merchants(spark, sf_dir))


@register(
    "categorize",
    oracle(
        """SELECT id, mid AS merchant_id, cid AS category_id, auto AS is_category_auto, rid AS applied_rule_id, rule
    FROM decided""",
        more=DECIDED,
    ),
)
def categorize(spark, sf_dir):
    done = c.categorize(ledger(spark, sf_dir), merchants(spark, sf_dir), RULES)
    return done.select("id", *c.STATE, "rule")


@register(
    "recategorize",
    oracle(
        """SELECT id AS transaction_id,
      coalesce(nullif(cleaned_description, ''), nullif(original_description, ''), '') AS description,
      category_id AS before_category, cid AS after_category, rule AS rule_applied
    FROM decided WHERE is_category_auto AND category_id IS DISTINCT FROM cid""",
        more=DECIDED,
    ),
)
def recategorize(spark, sf_dir):
    return c.category_changes(c.recategorize(ledger(spark, sf_dir), merchants(spark, sf_dir), RULES))


@register(
    "changes_sample",
    oracle(
        """SELECT id AS transaction_id,
      coalesce(nullif(cleaned_description, ''), nullif(original_description, ''), '') AS description,
      category_id AS before_category, cid AS after_category, rule AS rule_applied
    FROM decided WHERE is_category_auto AND category_id IS DISTINCT FROM cid ORDER BY id LIMIT 50""",
        more=DECIDED,
    ),
)
def changes_sample(spark, sf_dir):
    return c.changes_sample(recategorize(spark, sf_dir))


@register(
    "rule_attribution_backfill",
    oracle(
        """SELECT id, applied_rule_id AS old_rule_id, rid AS new_rule_id FROM decided
    WHERE applied_rule_id IS DISTINCT FROM rid""",
        more=DECIDED,
    ),
)
def rule_attribution_backfill(spark, sf_dir):
    return c.rule_attribution(ledger(spark, sf_dir), merchants(spark, sf_dir), RULES)


RING = BY_ID[1]["conditions"]
APPLIED = (
    RULE_ROWS_SQL
    + """,
applied AS (SELECT *, CASE WHEN contains(upper(d), 'RING') THEN CASE WHEN is_category_auto THEN 'updated' ELSE 'skipped' END END AS outcome,
    (SELECT default_category_id FROM merchants WHERE id = 3) AS target FROM rule_rows)"""
)


@register(
    "apply_rule",
    oracle(
        """SELECT id, CASE WHEN outcome = 'updated' THEN 3 ELSE merchant_id END AS merchant_id,
      CASE WHEN outcome = 'updated' THEN target ELSE category_id END AS category_id,
      CASE WHEN outcome = 'updated' THEN 1 ELSE applied_rule_id END AS applied_rule_id, outcome FROM applied""",
        more=APPLIED,
    ),
)
def apply_rule(spark, sf_dir):
    done = c.apply_rule(ledger(spark, sf_dir), merchants(spark, sf_dir), 1, RING, 3)
    return done.select("id", "merchant_id", "category_id", "applied_rule_id", "outcome")


@register(
    "apply_rule_counts",
    oracle(
        """SELECT count(*) FILTER (outcome = 'updated') AS transactions_updated,
      count(*) FILTER (outcome = 'skipped') AS transactions_skipped FROM applied""",
        more=APPLIED,
    ),
)
def apply_rule_counts(spark, sf_dir):
    return c.apply_counts(c.apply_rule(ledger(spark, sf_dir), merchants(spark, sf_dir), 1, RING, 3))


@register(
    "rule_application_history",
    oracle(
        """SELECT id AS transaction_id, 'rule_application' AS step_name, CAST(99 AS BIGINT) AS step_order,
      '{"category_id":' || coalesce(CAST(category_id AS VARCHAR), 'null') || '}' AS input_data,
      '{"category_id":' || coalesce(CAST(target AS VARCHAR), 'null') || ',"merchant_id":3}' AS output_data,
      'Rings' AS rule_applied FROM applied WHERE outcome = 'updated'""",
        more=APPLIED,
    ),
)
def rule_application_history(spark, sf_dir):
    return c.rule_application_history(
        c.apply_rule(ledger(spark, sf_dir), merchants(spark, sf_dir), 1, RING, 3), "Rings"
    )


@register(
    "reapply_rule",
    oracle(
        """SELECT id, CASE WHEN outcome = 'updated' THEN 3 ELSE merchant_id END AS merchant_id,
      CASE WHEN outcome = 'updated' THEN target ELSE category_id END AS category_id,
      CASE WHEN outcome = 'updated' THEN 1 ELSE nullif(applied_rule_id, 1) END AS applied_rule_id FROM applied""",
        more=APPLIED,
    ),
)
def reapply_rule(spark, sf_dir):
    done = c.reapply_rule(ledger(spark, sf_dir), merchants(spark, sf_dir), 1, RING, 3)
    return done.select("id", "merchant_id", "category_id", "applied_rule_id")


BATCH = [("Rings", "RING", 4), ("Widgets", "WIDGET", 8), ("Hot", "HOT", 11), ("Transfers", "UPI-", 20)]


@register(
    "rule_batch",
    oracle(
        """SELECT id, coalesce(CASE batch_rule WHEN 'Transfers' THEN 20 WHEN 'Hot' THEN 11 WHEN 'Widgets' THEN 8
      WHEN 'Rings' THEN 4 END, category_id) AS category_id, batch_rule
    FROM (SELECT *, CASE WHEN NOT is_category_auto THEN NULL WHEN contains(u, 'UPI-') THEN 'Transfers'
      WHEN contains(u, 'HOT') THEN 'Hot' WHEN contains(u, 'WIDGET') THEN 'Widgets'
      WHEN contains(u, 'RING') THEN 'Rings' END AS batch_rule FROM rule_rows)""",
        more=RULE_ROWS_SQL,
    ),
)
def rule_batch(spark, sf_dir):
    return c.rule_batch(ledger(spark, sf_dir), BATCH).select("id", "category_id", "batch_rule")


@register(
    "rule_preview",
    oracle(
        """SELECT count(*) AS total_matches, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount,
      count(*) FILTER (NOT is_category_auto) AS manual_count, count(*) FILTER (is_category_auto) AS auto_count
    FROM rule_rows WHERE contains(upper(d), 'RING')""",
        more=RULE_ROWS_SQL,
    ),
)
def rule_preview(spark, sf_dir):
    return ru.preview_totals(ledger(spark, sf_dir), merchants(spark, sf_dir), RING)


@register(
    "rule_preview_categories",
    oracle(
        """SELECT category_id, CASE WHEN category_id IS NULL THEN 'Uncategorized' ELSE coalesce(c.name, 'Unknown') END
      AS category_name, count(*) AS n FROM rule_rows r LEFT JOIN categories c ON c.id = r.category_id
    WHERE contains(upper(d), 'RING') GROUP BY 1, 2""",
        more=RULE_ROWS_SQL,
    ),
)
def rule_preview_categories(spark, sf_dir):
    return ru.preview_categories(
        ledger(spark, sf_dir), merchants(spark, sf_dir), categories(spark, sf_dir), RING
    )


@register(
    "rule_preview_page",
    oracle(
        """SELECT id, strftime(transaction_date, '%Y-%m-%d') AS date,
      coalesce(nullif(cleaned_description, ''), nullif(original_description, ''), '') AS description,
      CAST(amount AS DOUBLE) AS amount, category_id AS current_category_id, NOT is_category_auto AS is_manual
    FROM rule_rows WHERE contains(upper(d), 'RING') ORDER BY id LIMIT 20 OFFSET 20""",
        more=RULE_ROWS_SQL,
    ),
)
def rule_preview_page(spark, sf_dir):
    return ru.preview_page(ledger(spark, sf_dir), merchants(spark, sf_dir), RING, page=2)


NORMAL_SQL = """
normal AS (
  SELECT *, trim(regexp_replace(original_description, '\\s+', ' ', 'g')) AS clean,
    nullif(regexp_extract(trim(regexp_replace(original_description, '\\s+', ' ', 'g')), '(?i)UPI[- ]([A-Z0-9@._]+)', 1), '') AS hint
  FROM ledger),
alias_hit AS (
  SELECT n.id, min(a.id) AS alias_id FROM normal n JOIN aliases a ON lower(a.alias) LIKE '%' || lower(n.hint) || '%'
  WHERE n.merchant_id IS NULL GROUP BY 1),
matched AS (
  SELECT n.id, coalesce(n.merchant_id, a.merchant_id) AS new_merchant_id,
    CASE WHEN n.merchant_id IS NOT NULL THEN 'existing' WHEN a.id IS NOT NULL THEN 'alias:' || a.alias ELSE 'no-match' END AS match_rule
  FROM normal n LEFT JOIN alias_hit h ON h.id = n.id LEFT JOIN aliases a ON a.id = h.alias_id)"""


@register(
    "normalize",
    oracle("SELECT id, clean AS cleaned_description, hint AS merchant_hint FROM normal", more=NORMAL_SQL),
)
def normalize(spark, sf_dir):
    return c.normalized(ledger(spark, sf_dir)).select("id", "cleaned_description", "merchant_hint")


@register(
    "alias_match",
    oracle(
        """SELECT n.id, a.id AS alias_id, a.alias, a.merchant_id FROM normal n JOIN alias_hit h ON h.id = n.id
    JOIN aliases a ON a.id = h.alias_id""",
        more=NORMAL_SQL,
    ),
)
def alias_match(spark, sf_dir):
    rows = c.normalized(ledger(spark, sf_dir)).filter("merchant_id is null")
    rows = rows.select("id", F.lower("merchant_hint").alias("hint"))
    return rows.join(shuffled(m.first_alias(rows.select("hint"), aliases(spark, sf_dir))), "hint").select(
        "id", "alias_id", "alias", F.col("alias_merchant_id").alias("merchant_id")
    )


@register("match_merchant", oracle("SELECT * FROM matched", more=NORMAL_SQL))
def match_merchant(spark, sf_dir):
    return m.match_merchants(c.normalized(ledger(spark, sf_dir)), aliases(spark, sf_dir))


_PROCESSED = (
    NORMAL_SQL
    + """,
rule_rows AS (
  SELECT n.* EXCLUDE (merchant_id, cleaned_description), n.cleaned_description AS old_cleaned, n.clean AS cleaned_description,
    n.merchant_id AS old_merchant_id, x.new_merchant_id AS merchant_id, x.match_rule,
    mm.name AS merchant_name, mm.default_category_id,
    trim(n.clean) AS d, trim(n.original_description) AS o, upper(n.clean) AS u
  FROM normal n JOIN matched x ON x.id = n.id LEFT JOIN merchants mm ON mm.id = x.new_merchant_id),"""
    + decided_sql("rule_rows")
)


def _j(expr):
    return f"coalesce(CAST({expr} AS VARCHAR), 'null')"


def _q(expr):
    return f"coalesce('\"' || {expr} || '\"', 'null')"


@register(
    "process_history",
    oracle(
        f"""SELECT id AS transaction_id, 'normalize' AS step_name, CAST(1 AS BIGINT) AS step_order,
      '{{"cleaned_description":' || {_q('old_cleaned')} || '}}' AS input_data,
      '{{"cleaned_description":' || {_q('cleaned_description')} || ',"upi_handle":' || {_q('hint')} || '}}' AS output_data,
      CAST(NULL AS VARCHAR) AS rule_applied FROM decided
    UNION ALL SELECT id, 'dedupe', 2, NULL, '{{"dedup_hash":"' || sha256(strftime(transaction_date, '%Y-%m-%d') || '|'
      || CAST(amount AS VARCHAR) || '|' || cleaned_description[1:50] || '|' || transaction_type) || '"}}', NULL FROM decided
    UNION ALL SELECT id, 'match_merchant', 3, '{{"merchant_id":' || {_j('old_merchant_id')} || '}}',
      '{{"merchant_id":' || {_j('merchant_id')} || '}}', match_rule FROM decided
    UNION ALL SELECT id, 'categorize', 4,
      '{{"category_id":' || {_j('category_id')} || ',"is_category_auto":' || {_j('is_category_auto')}
        || ',"applied_rule_id":' || {_j('applied_rule_id')} || '}}',
      CASE WHEN rule IS NULL THEN '{{"category_id":' || {_j('category_id')} || ',"is_category_auto":' || {_j('is_category_auto')}
        || ',"applied_rule_id":' || {_j('applied_rule_id')} || '}}'
      ELSE '{{"category_id":' || {_j('cid')} || ',"is_category_auto":' || {_j('auto')}
        || ',"applied_rule_id":' || {_j('rid')} || '}}' END, rule FROM decided""",
        more=_PROCESSED,
    ),
)
def process_history(spark, sf_dir):
    rows, dims = ledger(spark, sf_dir), merchants(spark, sf_dir)
    matched = m.match_merchants(c.normalized(rows), aliases(spark, sf_dir))
    return c.process_history(rows, matched, dims, RULES)


EDITS_SQL = """
edits AS (SELECT event_id AS transaction_id, CASE WHEN event_id % 12 = 0 THEN '' WHEN event_id % 12 = 4 THEN 'x'
    ELSE CAST(event_id % 10 + 1 AS VARCHAR) END AS merchant_text, 'note ' || CAST(event_id AS VARCHAR) AS notes
  FROM events WHERE event_type = 'click')"""


@register(
    "merchant_edit_propagation",
    oracle(
        """SELECT l.id, CASE WHEN e.merchant_text = '' THEN NULL ELSE coalesce(TRY_CAST(e.merchant_text AS BIGINT), l.merchant_id) END AS merchant_id,
      coalesce(em.default_category_id, l.category_id) AS category_id,
      CASE WHEN em.default_category_id IS NOT NULL THEN TRUE ELSE l.is_category_auto END AS is_category_auto,
      CASE WHEN e.transaction_id IS NOT NULL THEN e.notes ELSE l.notes END AS notes
    FROM ledger l LEFT JOIN edits e ON e.transaction_id = l.id
    LEFT JOIN merchants em ON em.id = TRY_CAST(e.merchant_text AS BIGINT)""",
        more=EDITS_SQL,
    ),
)
def merchant_edit_propagation(spark, sf_dir):
    n = F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'click'")
    edits = events.select(
        n.alias("transaction_id"),
        F.when(n % 12 == 0, "").when(n % 12 == 4, "x").otherwise((n % 10 + 1).cast("string")).alias("merchant_id"),
        F.concat(F.lit("note "), n.cast("string")).alias("notes"),
    )
    done = c.apply_edits(ledger(spark, sf_dir), merchants(spark, sf_dir), edits)
    return done.select("id", "merchant_id", "category_id", "is_category_auto", "notes")


@register(
    "dedup_hash",
    oracle(
        """SELECT id, sha256(strftime(transaction_date, '%Y-%m-%d') || '|' || CAST(amount AS VARCHAR) || '|'
      || trim(regexp_replace(original_description, '\\s+', ' ', 'g'))[1:50] || '|' || transaction_type) AS dedup_hash FROM ledger"""
    ),
)
def dedup_hash(spark, sf_dir):
    digest = t.dedup_hash(
        F.col("transaction_date"), F.col("amount"), F.col("original_description"), F.col("transaction_type")
    )
    return ledger(spark, sf_dir).select("id", digest.alias("dedup_hash"))


@register(
    "external_id_norm",
    oracle(
        """SELECT id, CASE WHEN trim(external_id) <> '' THEN coalesce(nullif(ltrim(trim(external_id), '0'), ''), '0') END
      AS external_id FROM ledger"""
    ),
)
def external_id_norm(spark, sf_dir):
    return ledger(spark, sf_dir).select("id", t.external_id_norm(F.col("external_id")).alias("external_id"))


@register(
    "rule_index_match",
    oracle(f"""SELECT id, CAST(unnest({ALL_MATCHED_SQL}) AS BIGINT) AS rule_id FROM rule_rows""", more=RULE_ROWS_SQL),
)
def rule_index_match(spark, sf_dir):
    return rule_index.rule_matches(_rows(spark, sf_dir), rules_frame(spark, RULES)).select("id", "rule_id")


@register(
    "rule_index_first",
    oracle(
        f"""SELECT id, CAST(({MATCHED_SQL})[1] AS BIGINT) AS rule_id FROM rule_rows WHERE len({MATCHED_SQL}) > 0""",
        more=RULE_ROWS_SQL,
    ),
)
def rule_index_first(spark, sf_dir):
    return rule_index.first_rules(rule_index.rule_matches(_rows(spark, sf_dir), rules_frame(spark, RULES)))
