"""Balance timeline queries; an account is a user of the events table."""

from pyspark.sql import functions as F

from passbook.functions.text import known_balance as known_balance_of
from passbook.operators import timeline as tl
from passbook.operators.reports import date_range
from passbook.plans.registry import register
from passbook.plans.testdata import ledger, merchants, oracle, statement_ledger, statement_oracle

BALANCE_SQL = """
bank AS (
  SELECT *, CASE WHEN transaction_type = 'income' THEN amount ELSE -amount END AS signed,
    CAST(replace(closing, ',', '') AS DECIMAL(18,2)) AS known FROM ledger WHERE source_type = 'bank_csv'),
cum AS (
  SELECT *, sum(signed) OVER (PARTITION BY account ORDER BY transaction_date, id) AS c FROM bank),
lifted AS (
  SELECT *, last_value(known - c IGNORE NULLS) OVER (PARTITION BY account ORDER BY transaction_date, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward,
    first_value(known - c IGNORE NULLS) OVER (PARTITION BY account ORDER BY transaction_date, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS opening,
    first_value(known - c + signed IGNORE NULLS) OVER (PARTITION BY account ORDER BY transaction_date, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS opening_compat FROM cum),
balances AS (
  SELECT *, coalesce(c + forward, c + opening) AS balance, coalesce(c + forward, c - signed + opening_compat) AS compat
  FROM lifted),
closes AS (
  SELECT account, CAST(transaction_date AS DATE) AS day, arg_max(balance, (transaction_date, id)) AS balance
  FROM balances WHERE balance IS NOT NULL GROUP BY 1, 2)"""


def _balances(spark, sf_dir, backward="correct"):
    return tl.running_balance(ledger(spark, sf_dir), backward=backward)


def _day(name="day"):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def _dbl(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


@register(
    "known_balance",
    oracle("SELECT id, CAST(CAST(replace(closing, ',', '') AS DECIMAL(18,2)) AS DOUBLE) AS known_balance FROM ledger"),
)
def known_balance(spark, sf_dir):
    known = known_balance_of(F.col("metadata_json"))
    return ledger(spark, sf_dir).select("id", known.cast("double").alias("known_balance"))


@register(
    "running_balance",
    oracle("SELECT id, account, CAST(balance AS DOUBLE) AS balance FROM balances", more=BALANCE_SQL),
)
def running_balance(spark, sf_dir):
    return _balances(spark, sf_dir).select("id", "account", *_dbl("balance"))


@register(
    "running_balance_compat",
    oracle("SELECT id, account, CAST(compat AS DOUBLE) AS balance FROM balances", more=BALANCE_SQL),
)
def running_balance_compat(spark, sf_dir):
    return _balances(spark, sf_dir, "compat").select("id", "account", *_dbl("balance"))


@register(
    "daily_close",
    oracle(
        "SELECT account, strftime(day, '%Y-%m-%d') AS day, CAST(balance AS DOUBLE) AS balance FROM closes",
        more=BALANCE_SQL,
    ),
)
def daily_close(spark, sf_dir):
    return tl.daily_close(_balances(spark, sf_dir)).select("account", _day(), *_dbl("balance"))


@register(
    "day_change",
    oracle(
        """SELECT account, strftime(day, '%Y-%m-%d') AS day, CAST(balance AS DOUBLE) AS balance,
      CAST(balance - lag(balance, 1, balance) OVER (PARTITION BY account ORDER BY day) AS DOUBLE) AS change FROM closes""",
        more=BALANCE_SQL,
    ),
)
def day_change(spark, sf_dir):
    changes = tl.day_change(tl.daily_close(_balances(spark, sf_dir)))
    return changes.select("account", _day(), *_dbl("balance", "change"))


@register(
    "timeline_summary",
    oracle(
        """SELECT account, CAST(min(balance) AS DOUBLE) AS min_balance, CAST(max(balance) AS DOUBLE) AS max_balance,
      CAST(sum(balance) AS DOUBLE) / count(*) AS avg_balance, CAST(arg_min(balance, day) AS DOUBLE) AS start_balance,
      CAST(arg_max(balance, day) AS DOUBLE) AS end_balance,
      CAST(arg_max(balance, day) - arg_min(balance, day) AS DOUBLE) AS change, count(*) AS total_days
    FROM closes GROUP BY 1""",
        more=BALANCE_SQL,
    ),
)
def timeline_summary(spark, sf_dir):
    return tl.timeline_summary(tl.daily_close(_balances(spark, sf_dir)))


@register(
    "range_extremes",
    oracle(
        """SELECT account, CAST(max(balance) AS DOUBLE) AS max_balance, CAST(min(balance) AS DOUBLE) AS min_balance,
      strftime(min(day) FILTER (balance = hi), '%Y-%m-%d') AS max_day,
      strftime(min(day) FILTER (balance = lo), '%Y-%m-%d') AS min_day
    FROM (SELECT *, max(balance) OVER (PARTITION BY account) AS hi, min(balance) OVER (PARTITION BY account) AS lo
          FROM closes) GROUP BY 1""",
        more=BALANCE_SQL,
    ),
)
def range_extremes(spark, sf_dir):
    ends = tl.range_extremes(tl.daily_close(_balances(spark, sf_dir)))
    return ends.select("account", *_dbl("max_balance", "min_balance"), _day("max_day"), _day("min_day"))


IN_OUT = """CAST(coalesce(sum(amount) FILTER (transaction_type = 'income'), 0) AS DOUBLE) AS total_in,
      CAST(coalesce(sum(amount) FILTER (transaction_type <> 'income'), 0) AS DOUBLE) AS total_out"""


@register(
    "range_in_out",
    statement_oracle(
        f"""SELECT {IN_OUT}, count(*) FILTER (transaction_type = 'income') AS count_in,
      count(*) FILTER (transaction_type <> 'income') AS count_out
    FROM ledger WHERE transaction_date >= TIMESTAMP '1996-01-01' AND transaction_date <= TIMESTAMP '1998-06-30'"""
    ),
)
def range_in_out(spark, sf_dir):
    return tl.range_in_out(date_range(statement_ledger(spark, sf_dir), "1996-01-01", "1998-06-30"))


@register(
    "merchant_net",
    oracle(
        """SELECT coalesce(m.name, 'Unknown') AS merchant, count(*) AS n,
      CAST(sum(CASE WHEN transaction_type = 'income' THEN amount ELSE -amount END) AS DOUBLE) AS net
    FROM ledger l LEFT JOIN merchants m ON m.id = l.merchant_id GROUP BY 1"""
    ),
)
def merchant_net(spark, sf_dir):
    return tl.merchant_net(ledger(spark, sf_dir), merchants(spark, sf_dir)).select("merchant", "n", *_dbl("net"))


@register(
    "day_activity",
    statement_oracle(
        f"""SELECT strftime(transaction_date, '%Y-%m-%d') AS day, count(*) AS n, {IN_OUT},
      CASE WHEN coalesce(sum(amount) FILTER (transaction_type = 'income'), 0)
        > coalesce(sum(amount) FILTER (transaction_type <> 'income'), 0) THEN 'up' ELSE 'down' END AS direction
    FROM ledger GROUP BY 1"""
    ),
)
def day_activity(spark, sf_dir):
    return tl.day_activity(statement_ledger(spark, sf_dir))
