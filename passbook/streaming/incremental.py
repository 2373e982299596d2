"""Imports that run as files or rows arrive."""

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from passbook.functions.text import dedup_hash
from passbook.operators.dedup import apply_upgrades, fuzzy_dedup, source_upgrades
from passbook.plans.imports import new_rows
from passbook.storage import cut


def read_records(spark: SparkSession, path: str, schema: StructType, pattern: str = "*", per_batch: int = 100) -> DataFrame:
    """Record files of a folder as a stream, some files at a time."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def with_hash(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "dedup_hash",
        dedup_hash(
            F.col("transaction_date"), F.col("amount"), F.col("original_description"), F.col("transaction_type")
        ),
    )


def exact_dedup(records: DataFrame, within: str = "7 days") -> DataFrame:
    """The first record of every hash, for streams without records older than the watermark: those are lost.

    State is kept per hash and dropped once the watermark passes, so it stays bounded.
    """
    hashed = with_hash(records).withColumn("event_time", F.col("transaction_date").cast("timestamp"))
    return hashed.withWatermark("event_time", within).dropDuplicatesWithinWatermark(["dedup_hash"])


def read_deduplicated(spark: SparkSession, store: str, records: StructType, without: str | None = None) -> DataFrame:
    """What ``deduplicated`` keeps below ``store``, with its hash, day and batch; optionally without one batch."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in records)}, dedup_hash string, batch string, day date"
    return _read(spark, store, schema, without)


def deduplicated(records: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """ST2 stream_exact_dedup: the first record of every hash, however late it comes.

    Records (with a unique ``seq``) are kept by batch and day.  Equal hashes have equal days, so a
    micro-batch reads the stored hashes of its own days only, and no state is held between
    batches.  Within a batch the smallest ``seq`` is kept.  A batch that runs again after a
    failure replaces its own folder.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark, label = batch.sparkSession, f"b{batch_id}"
        hashed = with_hash(batch).withColumn("day", F.to_date("transaction_date"))
        kept = F.min_by(F.struct(*[c for c in hashed.columns if c != "dedup_hash"]), "seq").alias("kept")
        first = cut(hashed.groupBy("dedup_hash").agg(kept).select("kept.*", "dedup_hash"))
        stored = read_deduplicated(spark, store, batch.schema, label).filter(_of_days(_days(first))).select("dedup_hash")
        new = first.join(stored, "dedup_hash", "left_anti").select(*batch.columns, "dedup_hash", "day")
        new.write.mode("overwrite").partitionBy("day").parquet(f"{store}/batch={label}")

    return (
        records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, appended as Parquet with exactly-once bookkeeping."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


STORED = (
    "id bigint, transaction_date timestamp_ntz, amount decimal(12,2), transaction_type string, "
    "original_description string, cleaned_description string, external_id string, source_type string, batch string, day date"
)
UPGRADES = (
    "id bigint, original_description string, cleaned_description string, source_type string, external_id string, "
    "batch string, day date"
)


def _read(spark: SparkSession, folder: str, schema: str, without: str | None) -> DataFrame:
    try:
        rows = spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows if without is None else rows.filter(F.col("batch") != without)


def read_store(
    spark: SparkSession, store: str, without: str | None = None, days: list[dt.date | None] | None = None
) -> DataFrame:
    """The ledger the import keeps, with the upgrades later batches brought; optionally without one batch.

    A row is upgraded once at most, because it then comes from the best source.  ``days``: only
    the rows of these days (None: rows without a date); files of other days are not opened.
    An upgrade is filed under the day of its row.
    """
    rows, upgrades = _read(spark, f"{store}/rows", STORED, without), _read(spark, f"{store}/upgrades", UPGRADES, without)
    if days is not None:
        rows, upgrades = rows.filter(_of_days(days)), upgrades.filter(_of_days(days))
    return apply_upgrades(rows.drop("day"), upgrades)


def _days(rows: DataFrame) -> list[dt.date | None]:
    """The days of ``rows``, one row per calendar day; None where some have no date."""
    return [r["day"] for r in rows.select(F.to_date("transaction_date").alias("day")).distinct().collect()]


def _of_days(days: list[dt.date | None]) -> Column:
    dated = [d for d in days if d is not None]
    found = F.col("day").isin(dated) if dated else F.lit(False)
    return found | F.col("day").isNull() if len(dated) < len(days) else found


def _write_by_day(rows: DataFrame, path: str) -> None:
    """Replaces ``path``, one folder per day; a day of very many rows is written by several tasks."""
    rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)


def incremental_import(
    records: DataFrame, store: str, source_type: str, checkpoint: str, parser_metadata: dict[str, str] | None = None
) -> StreamingQuery:
    """ST1: every micro-batch is checked against the stored ledger, and what is new is added.

    ``seq`` must be unique over all records; it becomes the id.  Each batch of a source writes
    its own folders below ``store``, so a batch that runs again after a failure replaces its
    rows instead of adding them twice.  One ``checkpoint`` belongs to one source.

    Duplicates share their day, so rows and upgrades are stored by day and a batch only reads
    the days it has records of: its cost follows the batch, not the ledger.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        label = f"{source_type}-{batch_id}"
        stored = read_store(batch.sparkSession, store, label, _days(batch))
        decisions = cut(fuzzy_dedup(stored, batch, source_type))
        day = F.to_date("transaction_date").alias("day")
        rows = new_rows(batch, decisions, source_type, parser_metadata or {"source": source_type})
        _write_by_day(rows.select("*", F.col("seq").alias("id"), day), f"{store}/rows/batch={label}")
        own_day = decisions.filter("upgrades").join(batch.select("seq", day), "seq").select(F.col("matched_id").alias("id"), "day")
        _write_by_day(source_upgrades(decisions, batch).join(own_day, "id"), f"{store}/upgrades/batch={label}")

    return (
        records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
