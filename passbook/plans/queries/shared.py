"""Shared-expense queries: every order is an expense between its customer and user 1."""

from pyspark.sql import functions as F

from passbook.functions.compute import settled
from passbook.operators import shared as sh
from passbook.plans.registry import register
from passbook.plans.testdata import dealt, table
from passbook.schemas import SHARED_EXPENSE
from passbook.sources import shared_backup as sb

ME = 1


def _expenses(spark, sf_dir):
    """Expenses as they stand in a backup, written as JSON text and read with the schema.

    The order key modulo 8 picks the case: payment, deleted, user paid, friend paid, no part,
    part from repayments (owed or owing), refund.
    """
    o = dealt(table(spark, sf_dir, "orders"))
    k = F.col("o_orderkey") + 24  # ids start above 0, which means "no id"
    case = k % 8
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    friend = F.col("o_custkey") + 2
    lit = F.lit

    def who(id_, first, last):
        return F.struct(id_.cast("long").alias("id"), first.alias("first_name"), last.alias("last_name"))

    def entry(person, paid, owed):
        return F.struct(
            person.alias("user"), paid.alias("paid_share"), owed.alias("owed_share"), lit("0").alias("net_balance")
        )

    me = who(lit(ME), lit("Mia"), lit("Main"))
    other = who(friend, F.concat(lit("Friend"), (friend % 100).cast("string")), F.when(friend % 2 == 0, lit("Two")).otherwise(lit("")))
    paid = F.when(case.isin(0, 2, 7), price).otherwise("0.00")
    owed = F.when(case == 2, "25.00").when(case == 3, "10.00").when(case == 7, "3.00").otherwise("0.00")
    users = F.when(case.isin(5, 6), F.array(entry(other, price, price))).otherwise(
        F.array(entry(other, lit("0.00"), price), entry(me, paid, owed))
    )
    repay = F.struct(
        F.when(case == 6, friend).otherwise(ME).cast("long").alias("from"),
        F.when(case == 6, lit(ME)).when(k % 3 == 0, friend + 10000000).otherwise(friend).cast("long").alias("to"),
        F.when(case == 5, "7.50").otherwise("4.00").alias("amount"),
    )
    expense = F.struct(
        k.alias("id"),
        F.concat(lit(" Dinner  "), k.cast("string")).alias("description"),
        F.when(case == 7, F.concat(lit("-"), price)).otherwise(price).alias("cost"),
        lit("EUR").alias("currency_code"),
        (case == 0).alias("payment"),
        (k % 5).alias("group_id"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), lit("T10:00:00Z")).alias("date"),
        F.when(case == 1, "2024-01-01T00:00:00Z").alias("deleted_at"),
        other.alias("created_by"),
        users.alias("users"),
        F.array(repay).alias("repayments"),
    )
    text = o.select(k.alias("line_no"), F.to_json(expense).alias("json"))
    text = text.select(lit(ME).cast("long").alias("me"), "line_no", "json")
    return settled(text, e=F.from_json("json", SHARED_EXPENSE)).select("me", "line_no", "e.*")


SHARED_SQL = """
rec AS (
  SELECT o_orderkey + 24 AS k, o_orderkey % 8 AS c, CAST(o_totalprice AS DECIMAL(12,2)) AS price, o_custkey + 2 AS friend, o_orderdate,
    CASE o_orderkey % 8 WHEN 0 THEN 0.00 WHEN 2 THEN 25.00 WHEN 3 THEN 10.00 WHEN 4 THEN 0.00 WHEN 5 THEN 7.50
      WHEN 6 THEN CAST(o_totalprice AS DECIMAL(12,2)) - 4.00 WHEN 7 THEN 3.00 END AS share,
    o_orderkey % 8 IN (0, 2, 7) AS paid,
    CASE o_orderkey % 8 WHEN 0 THEN 'payment' WHEN 7 THEN 'income' ELSE 'expense' END AS kind
  FROM orders WHERE o_orderkey % 8 <> 1),
scen AS (
  SELECT *, CASE WHEN c = 0 THEN 0.00 ELSE share END AS part, CASE WHEN c IN (3, 5, 6) THEN share ELSE price END AS amount,
    CASE WHEN c IN (3, 5, 6) THEN 'expense' ELSE kind END AS final_kind, c IN (3, 5, 6) AS provisional
  FROM rec WHERE c = 0 OR paid OR share > 0),
act AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 'created' WHEN part = CASE WHEN k % 2 = 0 THEN part ELSE 1.00 END THEN 'unchanged'
    ELSE 'updated' END AS action FROM scen)"""


def _records(spark, sf_dir):
    return sb.shared_records(_expenses(spark, sf_dir))


def _actions(spark, sf_dir):
    """Every third expense is stored already; the odd ones of them with another part."""
    scenarios = sh.share_scenario(_records(spark, sf_dir))
    part = F.when(F.col("expense_id") % 2 == 0, F.col("effective_amount")).otherwise(F.lit("1.00").cast("decimal(12,2)"))
    stored = scenarios.filter("expense_id % 3 = 0").select("expense_id", part.alias("effective_amount"))
    return sh.existing_expense(scenarios, stored)


@register(
    "shared_ledger_json_scan",
    f"""WITH {SHARED_SQL} SELECT k AS expense_id, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(price AS DOUBLE) AS amount, kind AS transaction_type,
      'EUR' AS currency, 'Dinner ' || CAST(k AS VARCHAR) AS cleaned_description, k % 5 AS shared_group_id, c = 0 AS is_payment FROM rec""",
)
def shared_ledger_json_scan(spark, sf_dir):
    return _records(spark, sf_dir).select(
        "expense_id", F.date_format("transaction_date", "yyyy-MM-dd").alias("day"), F.col("amount").cast("double").alias("amount"),
        "transaction_type", "currency", "cleaned_description", "shared_group_id", "is_payment",
    )


@register(
    "owed_share",
    f"WITH {SHARED_SQL} SELECT k AS expense_id, CAST(share AS DOUBLE) AS user_share, paid AS user_paid FROM rec",
)
def owed_share(spark, sf_dir):
    return _records(spark, sf_dir).select("expense_id", F.col("user_share").cast("double").alias("user_share"), "user_paid")


@register(
    "share_scenario",
    f"""WITH {SHARED_SQL} SELECT k AS expense_id, CAST(amount AS DOUBLE) AS amount, CAST(part AS DOUBLE) AS effective_amount,
      final_kind AS transaction_type, provisional AS is_provisional FROM scen""",
)
def share_scenario(spark, sf_dir):
    rows = sh.share_scenario(_records(spark, sf_dir))
    return rows.select(
        "expense_id", F.col("amount").cast("double").alias("amount"),
        F.col("effective_amount").cast("double").alias("effective_amount"), "transaction_type", "is_provisional",
    )


@register("existing_expense", f"WITH {SHARED_SQL} SELECT k AS expense_id, action FROM act")
def existing_expense(spark, sf_dir):
    return _actions(spark, sf_dir).select("expense_id", "action")


@register(
    "import_counts",
    f"""WITH {SHARED_SQL} SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated,
      count(*) FILTER (action = 'created' AND provisional) AS auto_created FROM act""",
)
def import_counts(spark, sf_dir):
    return sh.import_counts(_actions(spark, sf_dir))


@register(
    "import_shared",
    f"""WITH {SHARED_SQL} SELECT k AS expense_id, 'splitwise' AS source_type, CAST(amount AS DOUBLE) AS amount, CAST(part AS DOUBLE) AS effective_amount,
      final_kind AS transaction_type, provisional AS is_provisional, sha256(strftime(o_orderdate, '%Y-%m-%d') || '|' || CAST(CAST(amount AS DECIMAL(12,2)) AS VARCHAR)
      || '|Dinner ' || CAST(k AS VARCHAR) || '|' || final_kind) AS dedup_hash FROM act WHERE action = 'created'""",
)
def import_shared(spark, sf_dir):
    rows = sh.created_rows(_actions(spark, sf_dir))
    return rows.select(
        "expense_id", "source_type", F.col("amount").cast("double").alias("amount"),
        F.col("effective_amount").cast("double").alias("effective_amount"), "transaction_type", "is_provisional", "dedup_hash",
    )


@register(
    "updated_parts",
    f"WITH {SHARED_SQL} SELECT k AS expense_id, CAST(part AS DOUBLE) AS effective_amount FROM act WHERE action = 'updated'",
)
def updated_parts(spark, sf_dir):
    rows = sh.updated_parts(_actions(spark, sf_dir))
    return rows.select("expense_id", F.col("effective_amount").cast("double").alias("effective_amount"))


def _persons(spark, sf_dir):
    """User 1 and every customer as friend, then whoever takes part."""
    user = spark.range(1).select(
        F.lit(ME).cast("long").alias("id"), F.lit("Mia").alias("first_name"), F.lit("Main").alias("last_name"),
        F.lit("mia@example.com").alias("email"),
    )
    friends = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 2).alias("id"), F.col("c_name").alias("first_name"), F.lit("").alias("last_name"),
        F.lit("").alias("email"), F.col("c_custkey").alias("pos"),
    )
    return sb.persons(_records(spark, sf_dir), user, friends)


PERSON_SQL = (
    SHARED_SQL
    + """,
people AS (
  SELECT CAST(1 AS BIGINT) AS person_id, 'Mia' AS first_name, 'Main' AS last_name, 'mia@example.com' AS email, TRUE AS is_current_user
  UNION ALL SELECT c_custkey + 2, c_name, '', '', FALSE FROM customer WHERE c_custkey + 2 <> 1
  UNION ALL SELECT DISTINCT friend, 'Friend' || CAST(friend % 100 AS VARCHAR), CASE WHEN friend % 2 = 0 THEN 'Two' ELSE '' END, '', FALSE
    FROM rec WHERE friend NOT IN (SELECT c_custkey + 2 FROM customer))"""
)


@register("person_union", f"WITH {PERSON_SQL} SELECT * FROM people")
def person_union(spark, sf_dir):
    return _persons(spark, sf_dir)


@register(
    "resolve_parties",
    f"""WITH {PERSON_SQL} SELECT k AS expense_id, f AS from_person_id, t AS to_person_id, CAST(a AS DOUBLE) AS amount FROM (
      SELECT k, CASE WHEN c = 6 THEN friend ELSE 1 END AS f, CASE WHEN c = 6 THEN 1 WHEN k % 3 = 0 THEN friend + 10000000 ELSE friend END AS t,
        CASE WHEN c = 5 THEN 7.50 ELSE 4.00 END AS a FROM act WHERE action = 'created')
    WHERE f IN (SELECT person_id FROM people) AND t IN (SELECT person_id FROM people)""",
)
def resolve_parties(spark, sf_dir):
    splits = sh.resolve_parties(_actions(spark, sf_dir), _persons(spark, sf_dir))
    return splits.select("expense_id", "from_person_id", "to_person_id", F.col("amount").cast("double").alias("amount"))


@register(
    "upsert_person",
    f"""WITH {PERSON_SQL}, old AS (SELECT c_custkey + 2 AS person_id, 'Old' AS first_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 99000000, 'Gone')
    SELECT coalesce(p.person_id, o.person_id) AS person_id, coalesce(p.first_name, o.first_name) AS first_name, coalesce(p.last_name, 'Name') AS last_name,
      CASE WHEN o.person_id IS NOT NULL THEN FALSE ELSE p.is_current_user END AS is_current_user
    FROM people p FULL JOIN old o ON o.person_id = p.person_id""",
)
def upsert_person(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0")
    gone = spark.range(99000000, 99000001).select(F.col("id").alias("person_id"), F.lit("Gone").alias("first_name"))
    old = c.select((F.col("c_custkey") + 2).alias("person_id"), F.lit("Old").alias("first_name")).unionByName(gone)
    stored = old.select(
        "person_id", "first_name", F.lit("Name").alias("last_name"), F.lit(None).cast("string").alias("email"),
        F.lit(False).alias("is_current_user"),
    )
    return sh.upsert_persons(stored, _persons(spark, sf_dir)).select("person_id", "first_name", "last_name", "is_current_user")


@register(
    "upsert_group",
    """SELECT CAST(n_nationkey AS BIGINT) AS group_id, CASE WHEN n_nationkey % 3 <> 1 THEN n_name || '!' ELSE n_name END AS name,
      CASE WHEN n_nationkey % 3 <> 2 THEN 'old' ELSE 'new' END AS group_type FROM nation""",
)
def upsert_group(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("long").alias("group_id")
    # stored only, both, incoming only: a third of the nations each
    stored = n.filter("n_nationkey % 3 <> 2").select(key, F.col("n_name").alias("name"), F.lit("old").alias("group_type"))
    incoming = n.filter("n_nationkey % 3 <> 1").select(
        key, F.concat("n_name", F.lit("!")).alias("name"), F.lit("new").alias("group_type")
    )
    return sh.upsert_groups(stored, incoming)


PM_SQL = (
    PERSON_SQL
    + """,
pm AS (SELECT s_suppkey + 1 AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'Friend' || CAST(s_suppkey % 100 AS VARCHAR) END AS name,
    CASE WHEN s_suppkey % 4 = 3 THEN 'business' ELSE 'person' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 2 END AS shared_person_id FROM supplier),
found AS (
  SELECT p.person_id, p.first_name || CASE WHEN p.last_name <> '' THEN ' ' || p.last_name ELSE '' END AS full_name,
    (SELECT min(id) FROM pm WHERE pm.shared_person_id = p.person_id) AS linked,
    (SELECT min(id) FROM pm WHERE type = 'person' AND pm.name = p.first_name || CASE WHEN p.last_name <> '' THEN ' ' || p.last_name ELSE '' END) AS named
  FROM people p WHERE p.person_id <> 1)"""
)


def _person_merchants(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        (k + 1).alias("id"),
        F.when(k % 3 == 0, F.col("s_name")).otherwise(F.concat(F.lit("Friend"), (k % 100).cast("string"))).alias("name"),
        F.when(k % 4 == 3, "business").otherwise("person").alias("type"),
        F.when(k % 3 == 0, k + 2).alias("shared_person_id"),
    )


@register(
    "person_merchant_match",
    f"""WITH {PM_SQL} SELECT person_id, full_name, coalesce(linked, named) AS merchant_id,
      CASE WHEN linked IS NOT NULL THEN 'link' WHEN named IS NOT NULL THEN 'name' ELSE 'new' END AS found_by FROM found""",
)
def person_merchant_match(spark, sf_dir):
    return sh.person_merchant_match(_persons(spark, sf_dir), _person_merchants(spark, sf_dir), ME)


@register(
    "upsert_person_merchant",
    f"""WITH {PM_SQL} SELECT full_name AS name, max(person_id) AS shared_person_id, 'person' AS type FROM found
    WHERE linked IS NULL AND named IS NULL GROUP BY 1
    UNION ALL SELECT pm.name, coalesce(max(f.person_id), any_value(pm.shared_person_id)), any_value(pm.type) FROM pm
      LEFT JOIN found f ON f.linked IS NULL AND f.named = pm.id GROUP BY pm.id, pm.name""",
)
def upsert_person_merchant(spark, sf_dir):
    stored = _person_merchants(spark, sf_dir)
    matches = sh.person_merchant_match(_persons(spark, sf_dir), stored, ME)
    columns = ["name", "shared_person_id", "type"]
    return sh.new_person_merchants(matches).select(*columns).unionByName(
        sh.relink_merchants(stored, matches).select(*columns)
    )
