"""Dashboard figures, dimension listings, search, sorting and paging."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.compute import spread_key
from passbook.functions.text import first_nonempty, iso_text, source_label
from passbook.schemas import TRANSACTION_TYPES


def spend_amount() -> Column:
    """The user's own part of a transaction."""
    return F.coalesce("effective_amount", "amount")


def in_scope(kind: str) -> Column:
    """P3 spend_scope: rows of one type that count in reports."""
    return (F.col("transaction_type") == kind) & ~F.coalesce("is_excluded", F.lit(False))


def with_names(ledger: DataFrame, merchants: DataFrame, categories: DataFrame) -> DataFrame:
    """J1 enrich_names: merchant and category names; Spark broadcasts a dimension it measures as small."""
    m = merchants.select(F.col("id").cast("string").alias("m_key"), F.col("name").alias("merchant_name"))
    c = categories.select(F.col("id").cast("string").alias("c_key"), F.col("name").alias("category_name"))
    rows = ledger.withColumn("m_key", spread_key("merchant_id")).withColumn("c_key", spread_key("category_id"))
    return rows.join(m, "m_key", "left").join(c, "c_key", "left").drop("m_key", "c_key")


def dashboard_totals(ledger: DataFrame, merchants: DataFrame) -> DataFrame:
    """A1: all headline figures in one pass over the ledger."""
    amount = spend_amount()
    zero = F.lit(0).cast("decimal(12,2)")
    totals = ledger.agg(
        F.count("*").alias("total_count"),
        F.coalesce(F.sum(F.when(in_scope("expense"), amount)), zero).alias("total_expense"),
        F.coalesce(F.sum(F.when(in_scope("income"), amount)), zero).alias("total_income"),
        F.count_if(F.col("category_id").isNull()).alias("uncategorized_count"),
    )
    counted = totals.unionByName(merchants.agg(F.count("*").alias("merchant_count")), allowMissingColumns=True)
    row = counted.agg(*[F.max(c).alias(c) for c in counted.columns])
    return row.select(
        "total_count",
        F.col("total_expense").cast("double").alias("total_expense"),
        F.col("total_income").cast("double").alias("total_income"),
        (F.col("total_income") - F.col("total_expense")).cast("double").alias("net"),
        "merchant_count",
        "uncategorized_count",
    )


def _month() -> Column:
    """First day of the month; cheaper to group by than its text."""
    return F.trunc(F.to_date("transaction_date"), "month").alias("month")


def monthly_totals(ledger: DataFrame, kind: str) -> DataFrame:
    """A2: own spending (or income) per month."""
    months = ledger.filter(in_scope(kind)).groupBy(_month()).agg(F.sum(spend_amount()).cast("double").alias("total"))
    return months.withColumn("month", F.date_format("month", "yyyy-MM"))


def monthly_income_vs_expense(ledger: DataFrame) -> DataFrame:
    """A3: both month series side by side in one aggregation; a missing side is 0."""
    zero = F.lit(0).cast("decimal(12,2)")
    side = {k: F.sum(F.when(F.col("transaction_type") == k, spend_amount())) for k in ("expense", "income")}
    return (
        ledger.filter(in_scope("expense") | in_scope("income"))
        .groupBy(_month())
        .agg(*[F.coalesce(v, zero).cast("double").alias(k) for k, v in side.items()])
        .withColumn("month", F.date_format("month", "yyyy-MM"))
        .orderBy("month")
    )


def category_spend(ledger: DataFrame, categories: DataFrame, by: str = "id") -> DataFrame:
    """Spending per category; rows are added up per category id before the dimension joins.

    ``by='name'`` merges categories that share a name.
    """
    spent = (
        ledger.filter(in_scope("expense") & F.col("category_id").isNotNull())
        .groupBy("category_id")
        .agg(F.sum(spend_amount()).alias("total"))
    )
    named = spent.join(
        categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name")), "category_id"
    )
    if by == "name":
        return named.groupBy("category_name").agg(F.sum("total").alias("total"))
    return named


def top_categories(ledger: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """A4: the n biggest spending categories by name."""
    return (
        category_spend(ledger, categories, by="name")
        .orderBy(F.desc("total"), "category_name")
        .limit(n)
        .select("category_name", F.col("total").cast("double").alias("total"))
    )


def category_share(top: DataFrame) -> DataFrame:
    """A5: percent of the displayed total, one decimal; the input is a report of a few rows."""
    total = F.sum("total").over(Window.partitionBy())
    share = F.floor(F.col("total") / total * 1000 + 0.5) / 10
    return top.select("category_name", "total", F.when(total > 0, share).otherwise(0.0).alias("share_percent"))


def counts_by(ledger: DataFrame, key: str) -> DataFrame:
    return ledger.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("txn_count"))


def dimension_counts(dimension: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """J3 merchant_counts / category_counts: dimension rows with their transaction count, 0 if none."""
    n = counts_by(ledger, key).withColumnRenamed(key, "id")
    return dimension.join(n, "id", "left").withColumn("txn_count", F.coalesce("txn_count", F.lit(0)))


def rule_usage(rules: DataFrame, ledger: DataFrame) -> DataFrame:
    """How many rows carry each rule; O4 order is priority descending, then name."""
    n = counts_by(ledger, "applied_rule_id").withColumnRenamed("applied_rule_id", "id")
    return (
        rules.join(n, "id", "left")
        .select("id", "name", "priority", F.coalesce("txn_count", F.lit(0)).alias("usage_count"))
        .orderBy(F.desc("priority"), "name")
    )


def category_tree(categories: DataFrame, ledger: DataFrame) -> DataFrame:
    """Parents with their children and the transaction counts of both."""
    counted = dimension_counts(categories, ledger, "category_id")
    parents = counted.filter(F.col("parent_id").isNull()).select(
        F.col("id").alias("parent_id"), F.col("name").alias("parent_name"), F.col("txn_count").alias("parent_count")
    )
    children = counted.filter(F.col("parent_id").isNotNull()).select(
        "parent_id",
        F.col("id").alias("child_id"),
        F.col("name").alias("child_name"),
        F.col("txn_count").alias("child_count"),
    )
    return parents.join(children, "parent_id", "left")


def table_stats(**tables: DataFrame) -> DataFrame:
    """Row count per table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pattern_top(ledger: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent 20-character description prefixes among uncategorised rows."""
    return (
        ledger.filter(F.col("category_id").isNull())
        .groupBy(F.substring("cleaned_description", 1, 20).alias("pattern"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first("pattern"))
        .limit(n)
    )


def _holds(column: str, q: str) -> Column:
    """Whether the column holds ``q`` in any case, with its ``%`` and ``_`` as wildcards."""
    pattern = q.lower().replace("\\", "\\\\")
    return F.lower(column).like(f"%{pattern}%")


def ledger_search(
    ledger: DataFrame,
    q: str | None = None,
    category_id: str | None = None,
    merchant_id: str | None = None,
    kind: str | None = None,
    no_merchant: bool = False,
) -> DataFrame:
    """Optional filters, all of which must hold.

    ``%`` and ``_`` in ``q`` are wildcards; ids that are no integers and unknown types are
    ignored; ``no_merchant`` takes precedence over ``merchant_id``.
    """

    def as_int(text):
        try:
            return int(text)
        except (TypeError, ValueError):
            return None

    out = ledger
    if q:
        out = out.filter(_holds("cleaned_description", q))
    if as_int(category_id) is not None:
        out = out.filter(F.col("category_id") == as_int(category_id))
    if no_merchant:
        out = out.filter(F.col("merchant_id").isNull())
    elif as_int(merchant_id) is not None:
        out = out.filter(F.col("merchant_id") == as_int(merchant_id))
    if kind in TRANSACTION_TYPES:
        out = out.filter(F.col("transaction_type") == kind)
    return out


def uncategorized(ledger: DataFrame, without_merchant: bool = False) -> DataFrame:
    """No category (dashboard), or neither category nor merchant (suggestions)."""
    out = ledger.filter(F.col("category_id").isNull())
    return out.filter(F.col("merchant_id").isNull()) if without_merchant else out


def date_range(
    ledger: DataFrame, start: str | None = None, end: str | None = None, inclusive_day: bool = False
) -> DataFrame:
    """Rows from ``start`` to ``end``; malformed dates are ignored.

    The end is midnight of that day unless ``inclusive_day`` asks for the whole day.
    """
    from datetime import datetime, timedelta

    def day(text):
        try:
            return datetime.strptime(text, "%Y-%m-%d")
        except (TypeError, ValueError):
            return None

    out = ledger
    ts = F.col("transaction_date")
    if day(start):
        out = out.filter(ts >= F.lit(str(day(start))).cast("timestamp_ntz"))
    if day(end):
        bound = F.lit(str(day(end) + timedelta(days=1 if inclusive_day else 0))).cast("timestamp_ntz")
        out = out.filter(ts < bound if inclusive_day else ts <= bound)
    return out


def ledger_sort(ledger: DataFrame, sort: str = "date", order: str = "desc") -> DataFrame:
    """O1: by amount or date, ties by id; anything but 'asc' is descending."""
    key = "amount" if sort == "amount" else "transaction_date"
    return ledger.orderBy(F.asc(key) if order == "asc" else F.desc(key), F.asc("id"))


def paginate(ordered: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """O2: one page of an ordered listing (page size 10 to 200)."""
    if page < 1 or not 10 <= page_size <= 200:
        raise ValueError("page must be at least 1 and page_size between 10 and 200")
    return ordered.offset((page - 1) * page_size).limit(page_size)


def page_after(ledger: DataFrame, last_date: str, last_id: int, page_size: int = 50) -> DataFrame:
    """O2 for deep pages of the date-descending listing: continue behind the last row shown."""
    ts = F.lit(last_date).cast("timestamp_ntz")
    behind = (F.col("transaction_date") < ts) | ((F.col("transaction_date") == ts) & (F.col("id") > last_id))
    return ledger_sort(ledger.filter(behind)).limit(page_size)


def merchant_sort(counted: DataFrame, sort: str = "name", order: str = "asc", q: str = "") -> DataFrame:
    """O3: merchants by name, category, type or count, nulls last both ways."""
    key = {"category": "default_category_id", "type": "type", "transactions": "txn_count"}.get(sort, "name")
    out = counted.filter(_holds("name", q)) if q else counted
    value = F.nullif(F.col(key), F.lit(0)) if key == "txn_count" else F.col(key)
    return out.orderBy(F.desc_nulls_last(value) if order == "desc" else F.asc_nulls_last(value), "id")


def recent(ledger: DataFrame, n: int = 10) -> DataFrame:
    """The newest rows."""
    return ledger.orderBy(F.desc("transaction_date"), F.asc("id")).limit(n)


def largest(ledger: DataFrame, n: int = 5) -> DataFrame:
    """The largest rows."""
    return ledger.orderBy(F.desc("amount"), F.asc("id")).limit(n)


def labelled(ledger: DataFrame) -> DataFrame:
    """Rows with the label of the source they came from."""
    return ledger.withColumn("source_label", source_label(F.col("metadata_json"), F.col("source_type")))


def export_rows(ledger: DataFrame, merchants: DataFrame, categories: DataFrame) -> DataFrame:
    """The columns of the CSV export, ordered by date."""
    return (
        with_names(ledger, merchants, categories)
        .orderBy("transaction_date", "id")
        .select(
            "id",
            iso_text(F.col("transaction_date")).alias("date"),
            F.col("amount").cast("string").alias("amount"),
            "currency",
            first_nonempty(F.col("cleaned_description"), F.col("original_description")).alias("description"),
            F.coalesce("merchant_name", F.lit("")).alias("merchant"),
            F.coalesce("category_name", F.lit("")).alias("category"),
        )
    )
