"""The statement import: duplicates, upgrades, new rows and their metadata."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import collapse, dedup_hash, iso_text
from passbook.operators.dedup import apply_upgrades, fuzzy_dedup, source_upgrades


def new_rows(incoming: DataFrame, decisions: DataFrame, source_type: str, parser_metadata: dict[str, str]) -> DataFrame:
    """Ledger rows of the incoming records that are no duplicates.

    ``metadata_json`` holds the record as it came in under 'raw' and the parser's metadata.
    """
    kept = incoming.join(decisions.filter("status = 'new'").select("seq"), "seq", "left_semi")
    description = F.col("original_description")
    return kept.select(
        "seq",
        F.lit(source_type).alias("source_type"),
        F.col("seq").alias("source_line_number"),
        "external_id",
        "transaction_date",
        "amount",
        F.lit("INR").alias("currency"),
        "transaction_type",
        "original_description",
        collapse(F.coalesce(description, F.lit(""))).alias("cleaned_description"),
        dedup_hash(F.col("transaction_date"), F.col("amount"), description, F.col("transaction_type")).alias("dedup_hash"),
        _metadata(parser_metadata).alias("metadata_json"),
    )


def _metadata(parser_metadata: dict[str, str]) -> Column:
    raw = F.struct(
        iso_text(F.col("transaction_date")).alias("transaction_date"),
        F.col("amount").cast("string").alias("amount"),
        "original_description",
        "transaction_type",
        "external_id",
    )
    given = F.struct(*[F.lit(v).alias(k) for k, v in parser_metadata.items()])
    return F.to_json(F.struct(raw.alias("raw"), given.alias("parser_metadata")), {"ignoreNullFields": "false"})


def import_statement(
    stored: DataFrame, incoming: DataFrame, source_type: str, parser_metadata: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows to add, stored rows with their upgrades) for one statement."""
    decisions = fuzzy_dedup(stored, incoming, source_type)
    added = new_rows(incoming, decisions, source_type, parser_metadata or {"source": source_type})
    return added, apply_upgrades(stored, source_upgrades(decisions, incoming))


def unified_ledger(*sources: DataFrame) -> DataFrame:
    """Rows of all sources in one frame; columns a source lacks are null."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
