"""Reversal and reconciliation queries, on amounts in whole units so that rows meet."""

from pyspark.sql import functions as F

from passbook.operators import matching as m
from passbook.plans.registry import register
from passbook.plans.testdata import ledger, oracle

REVERSAL_SQL = """
open_rows AS (SELECT *, regexp_matches(lower(original_description),
      'reversal|refund|cancelled|canceled|reversed|return|chargeback|credit adjustment')
    OR coalesce(regexp_matches(lower(cleaned_description),
      'reversal|refund|cancelled|canceled|reversed|return|chargeback|credit adjustment'), FALSE) AS says
  FROM ledger WHERE reconciled_with_id IS NULL AND transaction_type IN ('income', 'expense')),
pairs AS (
  SELECT r.id AS reversal_id, min(o.id) AS original_id FROM open_rows r JOIN open_rows o
    ON r.merchant_id IS NOT DISTINCT FROM o.merchant_id AND r.amount = o.amount AND r.transaction_type <> o.transaction_type
    AND o.transaction_date BETWEEN r.transaction_date - INTERVAL 7 DAYS AND r.transaction_date
  GROUP BY 1)"""


def _ledger(spark, sf_dir):
    return ledger(spark, sf_dir, whole_units=True)


@register(
    "reversal_pairs",
    oracle(
        """SELECT reversal_id, original_id, CASE WHEN NOT r.says THEN 'amount_match' WHEN r.transaction_type = 'income'
      THEN 'expense_refund' ELSE 'income_clawback' END AS reason,
      CAST(floor(epoch(r.transaction_date - o.transaction_date) / 86400) AS BIGINT) AS days_apart
    FROM pairs JOIN ledger o ON o.id = original_id JOIN open_rows r ON r.id = reversal_id""",
        whole_units=True,
        more=REVERSAL_SQL,
    ),
)
def reversal_pairs(spark, sf_dir):
    return m.reversal_pairs(_ledger(spark, sf_dir)).drop("reversal_date")


@register(
    "link_reversals",
    oracle(
        """SELECT l.id, coalesce(p.original_id, l.reconciled_with_id) AS reconciled_with_id,
      is_excluded OR p.original_id IS NOT NULL OR l.id IN (SELECT original_id FROM pairs) AS is_excluded
    FROM ledger l LEFT JOIN pairs p ON p.reversal_id = l.id""",
        whole_units=True,
        more=REVERSAL_SQL,
    ),
)
def link_reversals(spark, sf_dir):
    rows = _ledger(spark, sf_dir)
    return m.link_reversals(rows, m.reversal_pairs(rows)).select("id", "reconciled_with_id", "is_excluded")


@register(
    "reversal_notes",
    oracle(
        """SELECT original_id AS transaction_id, reversal_id, 'Reversed by transaction #' || CAST(reversal_id AS VARCHAR) AS note
    FROM pairs UNION ALL
    SELECT reversal_id, reversal_id, 'Reversal of transaction #' || CAST(original_id AS VARCHAR) FROM pairs""",
        whole_units=True,
        more=REVERSAL_SQL,
    ),
)
def reversal_notes(spark, sf_dir):
    return m.reversal_notes(m.reversal_pairs(_ledger(spark, sf_dir))).drop("reversal_date")


SIDES_SQL = """
shared AS (SELECT *, CAST(transaction_date AS DATE) AS day, CASE WHEN is_payment THEN 'settlement' ELSE 'expense' END AS kind
  FROM ledger WHERE source_type = 'splitwise' AND NOT is_reconciled AND NOT is_excluded AND (is_payment OR user_paid)),
bank AS (SELECT *, CAST(transaction_date AS DATE) AS day FROM ledger WHERE source_type <> 'splitwise' AND NOT is_reconciled)"""

# Mutually first pairs are final in an id-ordered assignment; each step of the recursion fixes
# them and lets the rest go on, until nothing is left.
GREEDY_SQL = (
    SIDES_SQL
    + """,
cand AS (SELECT s.id AS s, b.id AS b FROM shared s JOIN bank b ON s.amount = b.amount AND abs(datediff('day', s.day, b.day)) <= 2),
live(s, b, step) AS (
  SELECT s, b, 0 FROM cand
  UNION ALL
  SELECT s, b, step + 1 FROM (
    SELECT s, b, step, bool_or(mutual) OVER (PARTITION BY s) AS s_done, bool_or(mutual) OVER (PARTITION BY b) AS b_done
    FROM (SELECT s, b, step, b = min(b) OVER (PARTITION BY s) AND s = min(s) OVER (PARTITION BY b) AS mutual FROM live))
  WHERE NOT s_done AND NOT b_done),
pairs AS (
  SELECT s, b FROM (SELECT s, b, b = min(b) OVER (PARTITION BY step, s) AND s = min(s) OVER (PARTITION BY step, b) AS mutual FROM live)
  WHERE mutual)"""
)


@register(
    "reconcile_preview",
    oracle(
        """SELECT s.kind AS type, s.id AS shared_id, min(b.id) AS bank_id FROM shared s JOIN bank b
    ON s.amount = b.amount AND abs(datediff('day', s.day, b.day)) <= 2 GROUP BY 1, 2""",
        whole_units=True,
        more=SIDES_SQL,
    ),
)
def reconcile_preview(spark, sf_dir):
    return m.reconcile_preview(_ledger(spark, sf_dir))


@register(
    "reconcile_pairs",
    oracle(
        """SELECT kind AS type, s AS shared_id, b AS bank_id FROM pairs JOIN shared ON shared.id = s""",
        whole_units=True,
        more=GREEDY_SQL,
    ),
)
def reconcile_pairs(spark, sf_dir):
    return m.reconcile_pairs(_ledger(spark, sf_dir))


@register(
    "reconcile_summary",
    oracle(
        """SELECT count(*) AS total_pairs, count(*) FILTER (kind = 'expense') AS expense_pairs,
      count(*) FILTER (kind = 'settlement') AS settlement_pairs FROM pairs JOIN shared ON shared.id = s""",
        whole_units=True,
        more=GREEDY_SQL,
    ),
)
def reconcile_summary(spark, sf_dir):
    return m.reconcile_summary(m.reconcile_pairs(_ledger(spark, sf_dir)))


@register(
    "reconcile_apply",
    oracle(
        """SELECT l.id, l.is_reconciled OR p.s IS NOT NULL OR q.b IS NOT NULL AS is_reconciled,
      coalesce(p.b, q.s, l.reconciled_with_id) AS reconciled_with_id, l.is_excluded OR p.s IS NOT NULL AS is_excluded,
      CAST(CASE WHEN q.b IS NULL THEN l.effective_amount WHEN sh.kind = 'settlement' THEN 0
        ELSE coalesce(sh.effective_amount, sh.amount) END AS DOUBLE) AS effective_amount,
      CASE WHEN sh.kind = 'settlement' THEN 'payment' ELSE l.transaction_type END AS transaction_type
    FROM ledger l LEFT JOIN pairs p ON p.s = l.id LEFT JOIN pairs q ON q.b = l.id LEFT JOIN shared sh ON sh.id = q.s""",
        whole_units=True,
        more=GREEDY_SQL,
    ),
)
def reconcile_apply(spark, sf_dir):
    rows = _ledger(spark, sf_dir)
    done = m.reconcile_apply(rows, m.reconcile_pairs(rows))
    return done.select(
        "id", "is_reconciled", "reconciled_with_id", "is_excluded",
        F.col("effective_amount").cast("double").alias("effective_amount"), "transaction_type",
    )
