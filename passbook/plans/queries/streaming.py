"""Streaming queries: run over all that is there, then read what they wrote."""

from pyspark.sql import functions as F

from passbook.plans.registry import register
from passbook.plans.testdata import table
from passbook.storage import scratch_path
from passbook.streaming import incremental as inc

RECORDS_SQL = """
r AS (SELECT event_id AS seq, CAST(date_trunc('day', ts) AS TIMESTAMP) AS transaction_date, CAST(floor(value) AS DECIMAL(12,2)) AS amount,
    CASE event_type WHEN 'view' THEN 'income' WHEN 'error' THEN 'payment' ELSE 'expense' END AS transaction_type,
    'PAY ' || CAST(user_id % 20 AS VARCHAR) AS original_description FROM events)"""


def _records(spark, sf_dir):
    """Events as a stream of records, a day's events sharing one date."""
    return _as_records(inc.read_records(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet"))


def _as_records(stream):
    return stream.select(
        F.col("event_id").alias("seq"),
        F.to_date("ts").cast("timestamp_ntz").alias("transaction_date"),
        F.floor("value").cast("decimal(12,2)").alias("amount"),
        F.when(F.col("event_type") == "view", "income").when(F.col("event_type") == "error", "payment").otherwise("expense")
        .alias("transaction_type"),
        F.concat(F.lit("PAY "), (F.col("user_id") % 20).cast("string")).alias("original_description"),
        F.lit(None).cast("string").alias("external_id"),
    )


@register(
    "stream_exact_dedup",
    f"""WITH {RECORDS_SQL} SELECT strftime(transaction_date, '%Y-%m-%d') AS day, CAST(amount AS DOUBLE) AS amount, transaction_type,
      original_description, CAST(1 AS BIGINT) AS n, min(seq % 3) AS batch FROM r GROUP BY ALL""",
)
def stream_exact_dedup(spark, sf_dir):
    """The events come in three batches, so that each day's are late twice; n counts what was kept of each record."""
    path = scratch_path(spark, "stream-dedup")
    events = table(spark, sf_dir, "events")
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = _as_records(inc.read_records(spark, f"{path}/in", events.schema, per_batch=1))
    inc.deduplicated(stream, f"{path}/rows", f"{path}/state").awaitTermination()
    kept = inc.read_deduplicated(spark, f"{path}/rows", stream.schema)
    by = [
        F.date_format("transaction_date", "yyyy-MM-dd").alias("day"), F.col("amount").cast("double").alias("amount"),
        "transaction_type", "original_description",
    ]
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("seq") % 3).alias("batch"))


@register(
    "incremental_import",
    f"""WITH {RECORDS_SQL} SELECT min(seq) AS seq, original_description, CAST(amount AS DOUBLE) AS amount FROM r
    GROUP BY transaction_date, r.amount, transaction_type, original_description""",
)
def incremental_import(spark, sf_dir):
    path = scratch_path(spark, "stream-import")
    inc.incremental_import(_records(spark, sf_dir), f"{path}/ledger", "bank_csv", f"{path}/state").awaitTermination()
    rows = inc.read_store(spark, f"{path}/ledger")
    return rows.select(F.col("id").alias("seq"), "original_description", F.col("amount").cast("double").alias("amount"))
