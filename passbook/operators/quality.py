"""Data checks: personal data in text, statement control totals, keys and references."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.functions.compute import settled, shuffled
from passbook.functions.text import lines_of, strip
from passbook.schemas import SOURCE_TYPES, TRANSACTION_TYPES

# Labels and patterns of personal data, checked line by line.  The last value
# is a text that every hit contains; it spares most lines the pattern.
PII_PATTERNS = [
    ("Aadhaar number (NNNN NNNN NNNN)", r"(?U)\b\d{4}[\s-]\d{4}[\s-]\d{4}\b", ""),
    ("PAN card number", r"(?U)\b[A-Z]{5}\d{4}[A-Z]\b", ""),
    ("Indian phone number", r"(?U)(?:\+91[\s-]?|\b0)[6-9]\d{9}\b", ""),
    (
        "Possible hardcoded password (use env vars instead)",
        r"(?iuU)(?:password|passwd|pwd|secret|api_key)\s*=\s*['\"]"
        r"(?!test|TEST|changeme|YOUR_|your_|example|dummy|fake|placeholder|secret['\"])"
        r"[a-zA-Z0-9@#$%^&*!]{4,}['\"]",
        "=",
    ),
    (
        "Hardcoded secret in os.environ assignment",
        r"(?U)os\.environ\[['\"][^'\"]+['\"]\]\s*=\s*['\"]"
        r"(?!test|TEST|changeme|YOUR_|your_|example|dummy|fake|placeholder)[^'\"]{4,}['\"]",
        "os.environ[",
    ),
    (
        "Email address (use @example.com for tests)",
        r"(?U)\b[a-zA-Z0-9._%+-]+@(?!example\.com\b|example\.org\b|anthropic\.com\b|users\.noreply\.github\.com\b)"
        r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
        "@",
    ),
]


def pii_scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(document, line, label, excerpt) for every pattern found in a line."""
    lines = documents.select(key, F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    line = F.col("line")
    found = [F.when(line.contains(mark) & line.rlike(p), F.lit(label)) for label, p, mark in PII_PATTERNS]
    hits = lines.withColumn("label", F.explode(F.array_compact(F.array(*found))))
    return hits.select(
        key,
        (F.col("pos") + 1).cast("long").alias("line_no"),
        "label",
        F.substring(strip(F.col("line")), 1, 120).alias("excerpt"),
    )


def control_totals(records: DataFrame, expected: DataFrame, net: bool) -> DataFrame:
    """Per file, the sum of its records against the printed total.

    ``net`` takes income off (statements that print the amount due); otherwise all amounts
    add up.  A file without printed total gets no verdict; less than 1.00 off is a match.
    ``expected`` has (file, expected_total).
    """
    amount = F.col("amount")
    if net:
        amount = F.when(F.col("transaction_type") == "income", -amount).otherwise(amount)
    actual = records.groupBy("file").agg(F.sum(amount).alias("actual_total"), F.count("*").alias("actual_count"))
    # settled: a filter on the verdict would read the printed totals again, below any repartitioning
    expected = settled(expected, expected_total=F.col("expected_total"))
    both = expected.join(shuffled(actual), "file", "left").withColumn(
        "actual_total", F.coalesce("actual_total", F.lit(0).cast("decimal(12,2)"))
    )
    difference = F.abs(F.col("actual_total") - F.col("expected_total"))
    return both.select(
        "file",
        "expected_total",
        "actual_total",
        F.coalesce("actual_count", F.lit(0)).alias("actual_count"),
        difference.alias("difference"),
        (difference < 1).alias("matches"),
    )


def control_total_gate(records: DataFrame, totals: DataFrame, policy: str = "reject") -> DataFrame:
    """Records of files whose control total fails are rejected, or only marked ('warn')."""
    failing = shuffled(totals.filter(~F.col("matches")).select("file"))
    if policy == "reject":
        return records.join(failing, "file", "left_anti")
    marked = shuffled(failing.withColumn("mismatch", F.lit(True)))
    return records.join(marked, "file", "left").withColumn(
        "warning", F.when(F.col("mismatch"), "statement total mismatch")
    ).drop("mismatch")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows that point to a missing parent."""
    known = parent.select(F.col(parent_key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys declared unique that occur more than once."""
    present = rows
    for k in key:
        present = present.filter(F.col(k).isNotNull())
    return present.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def unknown_values(ledger: DataFrame) -> DataFrame:
    """Rows whose source or transaction type is none of the declared values."""
    known = F.col("source_type").isin(SOURCE_TYPES) & F.col("transaction_type").isin(TRANSACTION_TYPES)
    return ledger.filter(~F.coalesce(known, F.lit(False)))
