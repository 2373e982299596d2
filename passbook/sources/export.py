"""Sinks: the CSV export and the ledger as month-partitioned Parquet."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.operators.reports import export_rows


def export_csv(ledger: DataFrame, merchants: DataFrame, categories: DataFrame, path: str) -> None:
    """The export as CSV files with a header, in date order across the files."""
    export_rows(ledger, merchants, categories).write.mode("errorifexists").option("header", True).csv(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """The ledger by month, so that date ranges read only their months."""
    month = F.date_format("transaction_date", "yyyy-MM")
    ledger.withColumn("month", month).write.mode("errorifexists").partitionBy("month").parquet(path)
