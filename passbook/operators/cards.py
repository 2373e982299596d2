"""Credit card payments: found by description, reclassified or excluded."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import any_of

# Descriptions of card payments, first and second version of the list.
CARD_PAYMENT_V1 = [
    "credit card payment", "cc payment", "hdfc.*credit card", "icici.*credit card", "sbi.*credit card",
    "axis.*credit card", "kotak.*credit card", "credit card bill", "cc bill payment", "card payment",
    r"upi.*\d{4}x+\d{4}",
]
CARD_PAYMENT_V2 = [
    "bppy cc payment", "credit card payment", "cc payment", "hdfc.*credit card", "icici.*credit card",
    "axis.*credit card", "credit card bill", "billpay.*credit card", "neft.*credit card", "imps.*credit card",
]

# Words that name the card, in this order, and the merchant they stand for.
CARD_TYPES = [
    ("hdfc", "HDFC Credit Card"), ("icici", "ICICI Credit Card"), ("axis", "Axis Credit Card"), ("sbi", "SBI Credit Card"),
]
OTHER_CARD = "Credit Card Payment"

RECLASS_NOTE = "Auto-detected as credit card payment"
EXCLUDE_NOTE = "Auto-detected as credit card payment (excluded from spending)"


def is_card_payment(patterns: list[str]) -> Column:
    """Either description matches one of the patterns."""
    both = [F.coalesce(F.lower(c).rlike("|".join(patterns)), F.lit(False)) for c in ("original_description", "cleaned_description")]
    return any_of(both)


def card_type(description: Column) -> Column:
    """The merchant a card payment goes to."""
    text = F.lower(description)
    chain = F.when(text.contains(CARD_TYPES[0][0]), CARD_TYPES[0][1])
    for word, name in CARD_TYPES[1:]:
        chain = chain.when(text.contains(word), name)
    return chain.otherwise(OTHER_CARD)


def add_note(note: str) -> Column:
    """The notes with this one behind them, unless they already hold it."""
    notes = F.nullif("notes", F.lit(""))
    return (
        F.when(notes.isNull(), F.lit(note))
        .when(notes.contains(note), F.col("notes"))
        .otherwise(F.concat(notes, F.lit("; "), F.lit(note)))
    )


def card_payment_reclass(ledger: DataFrame) -> DataFrame:
    """Matching expenses become transfers."""
    hit = (F.col("transaction_type") == "expense") & is_card_payment(CARD_PAYMENT_V1)
    return _changed(
        ledger, hit, {"transaction_type": F.lit("transfer"), "notes": add_note(RECLASS_NOTE)}
    )


def card_payment_exclude(ledger: DataFrame, merchants: DataFrame, category_id: int) -> DataFrame:
    """Matching expenses leave the reports and go to the merchant of their card.

    ``merchants`` must hold the card merchants (``missing_card_merchants`` lists those to add).
    """
    hit = (F.col("transaction_type") == "expense") & ~F.col("is_excluded") & is_card_payment(CARD_PAYMENT_V2)
    names = [name for _, name in CARD_TYPES] + [OTHER_CARD]
    # one row per card at most, so the ids can stand in the expression
    known = merchants.filter(F.col("name").isin(names)).groupBy("name").agg(F.min("id").alias("id")).collect()
    card = card_type(F.col("original_description"))
    merchant = F.lit(None).cast("long")
    for row in known:
        merchant = F.when(card == row["name"], F.lit(row["id"])).otherwise(merchant)
    return _changed(
        ledger,
        hit,
        {
            "is_excluded": F.lit(True),
            "merchant_id": merchant,
            "category_id": F.lit(category_id).cast("long"),
            "is_category_auto": F.lit(False),
            "notes": add_note(EXCLUDE_NOTE),
        },
    )


def missing_card_merchants(ledger: DataFrame, merchants: DataFrame) -> DataFrame:
    """Names of card merchants that payments need and nobody has created yet."""
    hit = (F.col("transaction_type") == "expense") & ~F.col("is_excluded") & is_card_payment(CARD_PAYMENT_V2)
    wanted = ledger.filter(hit).select(card_type(F.col("original_description")).alias("name")).distinct()
    return wanted.join(merchants, "name", "left_anti")


def _changed(rows: DataFrame, hit: Column, after: dict[str, Column]) -> DataFrame:
    return rows.select(*[F.when(hit, after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c in rows.columns])
