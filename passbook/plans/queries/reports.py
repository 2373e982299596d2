"""Dashboard, listing and search queries."""

from pyspark.sql import functions as F

from passbook.operators import reports as r
from passbook.plans.registry import register
from passbook.plans.rulebook import RULES, rules_frame, rules_values_sql
from passbook.plans.testdata import categories, ledger, merchants, oracle, statement_ledger, statement_oracle, table

EFF = "coalesce(effective_amount, amount)"


@register(
    "monthly_income_vs_expense",
    statement_oracle(
        f"""SELECT strftime(transaction_date, '%Y-%m') AS month,
      CAST(coalesce(sum({EFF}) FILTER (transaction_type = 'expense'), 0) AS DOUBLE) AS expense,
      CAST(coalesce(sum({EFF}) FILTER (transaction_type = 'income'), 0) AS DOUBLE) AS income
    FROM ledger WHERE transaction_type IN ('expense', 'income') AND NOT is_excluded GROUP BY 1"""
    ),
)
def monthly_income_vs_expense(spark, sf_dir):
    return r.monthly_income_vs_expense(statement_ledger(spark, sf_dir))


@register(
    "dashboard_totals",
    oracle(
        f"""SELECT count(*) AS total_count,
      CAST(coalesce(sum({EFF}) FILTER (transaction_type = 'expense' AND NOT is_excluded), 0) AS DOUBLE) AS total_expense,
      CAST(coalesce(sum({EFF}) FILTER (transaction_type = 'income' AND NOT is_excluded), 0) AS DOUBLE) AS total_income,
      CAST(coalesce(sum({EFF}) FILTER (transaction_type = 'income' AND NOT is_excluded), 0)
         - coalesce(sum({EFF}) FILTER (transaction_type = 'expense' AND NOT is_excluded), 0) AS DOUBLE) AS net,
      (SELECT count(*) FROM merchants) AS merchant_count,
      count(*) FILTER (category_id IS NULL) AS uncategorized_count
    FROM ledger"""
    ),
)
def dashboard_totals(spark, sf_dir):
    return r.dashboard_totals(ledger(spark, sf_dir), merchants(spark, sf_dir))


@register(
    "monthly_totals",
    statement_oracle(
        f"""SELECT strftime(transaction_date, '%Y-%m') AS month, CAST(sum({EFF}) AS DOUBLE) AS total
    FROM ledger WHERE transaction_type = 'expense' AND NOT is_excluded GROUP BY 1"""
    ),
)
def monthly_totals(spark, sf_dir):
    return r.monthly_totals(statement_ledger(spark, sf_dir), "expense")


TOP_CATEGORIES = f"""SELECT c.name AS category_name, CAST(sum({EFF}) AS DOUBLE) AS total
    FROM ledger l JOIN categories c ON l.category_id = c.id
    WHERE transaction_type = 'expense' AND NOT is_excluded GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


@register("top_categories", oracle(TOP_CATEGORIES))
def top_categories(spark, sf_dir):
    return r.top_categories(ledger(spark, sf_dir), categories(spark, sf_dir))


@register(
    "category_share",
    oracle(
        f"""SELECT category_name, total, floor(total / sum(total) OVER () * 1000 + 0.5) / 10 AS share_percent
    FROM ({TOP_CATEGORIES})"""
    ),
)
def category_share(spark, sf_dir):
    return r.category_share(r.top_categories(ledger(spark, sf_dir), categories(spark, sf_dir)))


@register(
    "category_spend_join",
    oracle(
        f"""SELECT c.id AS category_id, c.name AS category_name, CAST(sum({EFF}) AS DOUBLE) AS total
    FROM ledger l JOIN categories c ON l.category_id = c.id
    WHERE transaction_type = 'expense' AND NOT is_excluded GROUP BY 1, 2"""
    ),
)
def category_spend_join(spark, sf_dir):
    spent = r.category_spend(ledger(spark, sf_dir), categories(spark, sf_dir))
    return spent.withColumn("total", F.col("total").cast("double"))


@register(
    "enrich_names",
    oracle(
        """SELECT l.id, m.name AS merchant_name, c.name AS category_name FROM ledger l
    LEFT JOIN merchants m ON l.merchant_id = m.id LEFT JOIN categories c ON l.category_id = c.id"""
    ),
)
def enrich_names(spark, sf_dir):
    named = r.with_names(ledger(spark, sf_dir), merchants(spark, sf_dir), categories(spark, sf_dir))
    return named.select("id", "merchant_name", "category_name")


@register(
    "merchant_counts",
    oracle(
        """SELECT m.id, m.name, count(l.id) AS txn_count FROM merchants m
    LEFT JOIN ledger l ON l.merchant_id = m.id GROUP BY 1, 2"""
    ),
)
def merchant_counts(spark, sf_dir):
    counted = r.dimension_counts(merchants(spark, sf_dir), ledger(spark, sf_dir), "merchant_id")
    return counted.select("id", "name", "txn_count")


@register(
    "category_counts",
    oracle(
        """SELECT c.id, c.name, count(l.id) AS txn_count FROM categories c
    LEFT JOIN ledger l ON l.category_id = c.id GROUP BY 1, 2"""
    ),
)
def category_counts(spark, sf_dir):
    counted = r.dimension_counts(categories(spark, sf_dir), ledger(spark, sf_dir), "category_id")
    return counted.select("id", "name", "txn_count")


@register(
    "rule_usage",
    oracle(
        """SELECT r.id, r.name, r.priority, count(l.id) AS usage_count FROM rules r
    LEFT JOIN ledger l ON l.applied_rule_id = r.id GROUP BY 1, 2, 3""",
        more=rules_values_sql(),
    ),
)
def rule_usage(spark, sf_dir):
    return r.rule_usage(rules_frame(spark, RULES), ledger(spark, sf_dir))


@register(
    "rules_sort",
    oracle(
        """SELECT row_number() OVER (ORDER BY priority DESC, r.name) AS position, r.id, r.name, count(l.id) AS usage_count
    FROM rules r LEFT JOIN ledger l ON l.applied_rule_id = r.id GROUP BY r.id, r.name, priority""",
        more=rules_values_sql(),
    ),
)
def rules_sort(spark, sf_dir):
    usage = r.rule_usage(rules_frame(spark, RULES), ledger(spark, sf_dir))
    return usage.selectExpr(
        "cast(row_number() over (order by priority desc, name) as bigint) as position", "id", "name", "usage_count"
    )


@register(
    "category_tree",
    oracle(
        """SELECT p.id AS parent_id, p.name AS parent_name, p.n AS parent_count, c.id AS child_id, c.name AS child_name,
      c.n AS child_count
    FROM counted p LEFT JOIN counted c ON c.parent_id = p.id WHERE p.parent_id IS NULL""",
        more="""counted AS (SELECT c.id, c.name, c.parent_id, count(l.id) AS n FROM categories c
      LEFT JOIN ledger l ON l.category_id = c.id GROUP BY 1, 2, 3)""",
    ),
)
def category_tree(spark, sf_dir):
    return r.category_tree(categories(spark, sf_dir), ledger(spark, sf_dir))


@register(
    "table_stats",
    oracle(
        """SELECT 'transactions' AS table_name, count(*) AS n FROM ledger UNION ALL
    SELECT 'merchants', count(*) FROM merchants UNION ALL SELECT 'categories', count(*) FROM categories"""
    ),
)
def table_stats(spark, sf_dir):
    return r.table_stats(
        transactions=ledger(spark, sf_dir), merchants=merchants(spark, sf_dir), categories=categories(spark, sf_dir)
    )


@register(
    "load_table",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_returnflag FROM lineitem""",
)
def load_table(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag")


@register(
    "pattern_top",
    oracle(
        """SELECT cleaned_description[1:20] AS pattern, count(*) AS n FROM ledger WHERE category_id IS NULL
    GROUP BY 1 ORDER BY n DESC, pattern NULLS FIRST LIMIT 20"""
    ),
)
def pattern_top(spark, sf_dir):
    return r.pattern_top(ledger(spark, sf_dir))


@register(
    "ledger_search",
    oracle(
        """SELECT id, cleaned_description, CAST(amount AS DOUBLE) AS amount FROM ledger
    WHERE lower(cleaned_description) LIKE '%hot_r%' AND merchant_id IS NULL AND transaction_type = 'expense'"""
    ),
)
def ledger_search(spark, sf_dir):
    hits = r.ledger_search(
        ledger(spark, sf_dir), q="Hot_R", category_id="x", merchant_id="3", kind="expense", no_merchant=True
    )
    return hits.select("id", "cleaned_description", F.col("amount").cast("double").alias("amount"))


@register(
    "uncategorized",
    oracle(
        """SELECT id, merchant_id IS NULL AS suggestible FROM ledger WHERE category_id IS NULL"""
    ),
)
def uncategorized(spark, sf_dir):
    return r.uncategorized(ledger(spark, sf_dir)).select("id", F.col("merchant_id").isNull().alias("suggestible"))


@register(
    "spend_scope",
    oracle("""SELECT id FROM ledger WHERE transaction_type = 'expense' AND NOT is_excluded"""),
)
def spend_scope(spark, sf_dir):
    return ledger(spark, sf_dir).filter(r.in_scope("expense")).select("id")


@register(
    "date_range",
    oracle(
        """SELECT id FROM ledger WHERE transaction_date >= TIMESTAMP '2024-01-05'
    AND transaction_date <= TIMESTAMP '2024-01-20'"""
    ),
)
def date_range(spark, sf_dir):
    return r.date_range(ledger(spark, sf_dir), "2024-01-05", "2024-01-20").select("id")


@register(
    "source_label",
    oracle(
        """SELECT id, CASE WHEN id % 3 = 0 THEN 'Acme · Credit Card' ELSE source_type END AS source_label FROM ledger"""
    ),
)
def source_label(spark, sf_dir):
    return r.labelled(ledger(spark, sf_dir)).select("id", "source_label")


@register(
    "ledger_sort",
    oracle(
        """SELECT id, CAST(amount AS DOUBLE) AS amount FROM ledger ORDER BY ledger.amount DESC, id"""
    ),
)
def ledger_sort(spark, sf_dir):
    rows = r.ledger_sort(ledger(spark, sf_dir), "amount", "desc")
    return rows.select("id", F.col("amount").cast("double").alias("amount"))


@register(
    "paginate",
    oracle("""SELECT id FROM ledger ORDER BY transaction_date DESC, id LIMIT 50 OFFSET 100"""),
)
def paginate(spark, sf_dir):
    return r.paginate(r.ledger_sort(ledger(spark, sf_dir)), page=3, page_size=50).select("id")


@register(
    "merchant_sort",
    oracle(
        """SELECT m.id, m.name, count(l.id) AS txn_count FROM merchants m LEFT JOIN ledger l ON l.merchant_id = m.id
    GROUP BY 1, 2 ORDER BY nullif(count(l.id), 0) DESC NULLS LAST, m.id LIMIT 50"""
    ),
)
def merchant_sort(spark, sf_dir):
    counted = r.dimension_counts(merchants(spark, sf_dir), ledger(spark, sf_dir), "merchant_id")
    return r.paginate(r.merchant_sort(counted, "transactions", "desc")).select("id", "name", "txn_count")


@register(
    "recent_n",
    oracle("""SELECT id FROM ledger ORDER BY transaction_date DESC, id LIMIT 10"""),
)
def recent_n(spark, sf_dir):
    return r.recent(ledger(spark, sf_dir)).select("id")


@register(
    "largest_n",
    oracle("""SELECT id, CAST(amount AS DOUBLE) AS amount FROM ledger ORDER BY ledger.amount DESC, id LIMIT 5"""),
)
def largest_n(spark, sf_dir):
    return r.largest(ledger(spark, sf_dir)).select("id", F.col("amount").cast("double").alias("amount"))


@register(
    "export_csv",
    oracle(
        """SELECT l.id, strftime(transaction_date, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(transaction_date) % 1000000 = 0 THEN ''
        ELSE '.' || lpad(CAST(microsecond(transaction_date) % 1000000 AS VARCHAR), 6, '0') END AS date, CAST(amount AS VARCHAR) AS amount, currency,
      coalesce(nullif(cleaned_description, ''), nullif(original_description, ''), '') AS description,
      coalesce(m.name, '') AS merchant, coalesce(c.name, '') AS category
    FROM ledger l LEFT JOIN merchants m ON l.merchant_id = m.id LEFT JOIN categories c ON l.category_id = c.id"""
    ),
)
def export_csv(spark, sf_dir):
    return r.export_rows(ledger(spark, sf_dir), merchants(spark, sf_dir), categories(spark, sf_dir))
