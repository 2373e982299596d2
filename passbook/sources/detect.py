"""Which statement layout a document has."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import all_of, any_of

PROFILES: dict[str, dict] = {}


def profile(name: str, **about):
    """Register a layout: a function from normalised text to a condition, plus catalogue fields."""

    def wrap(rule: Callable[[Column], Column]):
        PROFILES[name] = {"rule": rule, **about}
        return rule

    return wrap


def _has_all(text: Column, *marks: str) -> Column:
    return all_of([text.contains(m) for m in marks])


def _has_any(text: Column, *marks: str) -> Column:
    return any_of([text.contains(m) for m in marks])


# The markers of each layout.
@profile("hdfc_credit_card", bank="hdfc", product="credit_card", priority=60, format="pdf")
def _card_a_modern(text: Column) -> Column:
    return (
        _has_all(text, "HDFC BANK CREDIT CARDS", "STATEMENT DATE")
        & _has_any(text, "CREDIT CARD STATEMENT", "BILLING PERIOD")
        & _has_any(text, "CARD NO", "CREDIT CARD NO", "CARD NUMBER")
    )


@profile("icici_credit_card", bank="icici", product="credit_card", priority=60, format="pdf")
def _card_b(text: Column) -> Column:
    return _has_all(text, "ICICI BANK", "STATEMENT DATE", "PAYMENT DUE DATE") & _has_any(
        text, "TOTAL AMOUNT DUE", "MINIMUM AMOUNT DUE"
    )


@profile("hdfc_credit_card_legacy", bank="hdfc", product="credit_card", priority=59, format="pdf")
def _card_a_legacy(text: Column) -> Column:
    return _has_all(
        text, "HDFC BANK CREDIT CARDS", "CREDIT CARD STATEMENT", "STATEMENT FOR HDFC BANK CREDIT CARD",
        "STATEMENT CARD NO", "PAYMENT DUE DATE", "TOTAL DUES", "MINIMUM AMOUNT DUE", " DATE:",
    ) & _has_any(text, "CARD NO", "CREDIT CARD NO", "CARD NUMBER")


@profile("hdfc_bank_pdf", bank="hdfc", product="bank_statement", priority=55, format="pdf")
def _account(text: Column) -> Column:
    marks = ["NARRATION", "WITHDRAWAL", "DEPOSIT", "CLOSING BALANCE"]
    score = sum((text.contains(m).cast("int") for m in marks), F.lit(0))
    return (
        _has_all(text, "HDFC BANK LIMITED", "ACCOUNT BRANCH")
        & _has_any(text, "CUST ID", "IFSC", "MICR")
        & _has_any(text, "ACCOUNT NO", "ACCOUNT NUMBER", "A/C")
        & (score >= 2)
    )


@profile("hdfc_bank_csv", bank="hdfc", product="bank_statement", priority=40, format="csv")
def _account_csv(text: Column) -> Column:
    return F.lit(True)


# The order in which layouts are tried, and the file endings of each format.
ORDER = ["hdfc_bank_csv", "hdfc_bank_pdf", "icici_credit_card", "hdfc_credit_card_legacy", "hdfc_credit_card"]
ENDINGS = {"pdf": r"(?i)\.pdf$", "csv": r"(?i)\.(csv|txt)$"}


def normalised(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def detect_source(documents: DataFrame, name: str = "filename", text: str = "text") -> DataFrame:
    """The layouts that fit, the one layout if exactly one does, 'ambiguous_match' if several do.

    ``matches`` lists the fitting layouts in the order they are tried.
    """
    listed = [n for n in ORDER if n in PROFILES] + [n for n in PROFILES if n not in ORDER]

    def fits(n):
        fit = F.col(name).rlike(ENDINGS[PROFILES[n]["format"]]) & PROFILES[n]["rule"](F.col("norm_text"))
        return fit | weak_card_b(F.col(name), F.col("norm_text")) if n == "icici_credit_card" else fit

    found = F.array(*[F.when(fits(n), F.lit(n)) for n in listed])
    rows = documents.withColumn("norm_text", normalised(F.col(text)))
    rows = rows.withColumn("matches", F.filter(found, lambda x: x.isNotNull())).drop("norm_text")
    return rows.withColumn("profile", F.when(F.size("matches") == 1, F.get("matches", F.lit(0)))).withColumn(
        "error", F.when(F.size("matches") > 1, "ambiguous_match")
    )


def weak_card_b(name: Column, norm_text: Column) -> Column:
    """A card statement known by its strict file name needs only two of three markers."""
    by_name = name.rlike(r"(?i)^\d{4}[X\d]{8}\d{4}_\d+_Retail_[^_]+_NORM\.pdf")
    score = sum((norm_text.contains(m).cast("int") for m in ("STATEMENT DATE", "PAYMENT DUE DATE", "ICICI")), F.lit(0))
    return by_name & (score >= 2)


def catalogue(spark) -> DataFrame:
    """The registered layouts with their catalogue fields."""
    rows = [(n, p["bank"], p["product"], p["format"], p["priority"]) for n, p in PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, bank string, product string, format string, priority int")
