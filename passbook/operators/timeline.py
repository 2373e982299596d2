"""Running balances and the figures of the balance timeline.

An account can hold a large share of all rows, so nothing here orders a whole
account in one task: rows are ordered within (account, day, hour), and only one
row per such span is ordered per account.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.text import known_balance

SPAN = ["account", "day", "hour"]


def running_balance(
    ledger: DataFrame, source: str = "bank_csv", backward: str = "correct"
) -> DataFrame:
    """Balance after every row of one source, from the balances its statements printed.

    From each known balance forward income adds and everything else subtracts, until the
    next known one.  Rows before the first known balance count back from it; with
    ``backward='compat'`` they undo their own amount instead of the next row's.  Accounts
    without a known balance get null.
    """
    if backward not in ("correct", "compat"):
        raise ValueError("backward is 'correct' or 'compat'")
    ts = F.col("transaction_date")
    rows = ledger.filter(F.col("source_type") == source).select(
        "id", "account", "transaction_date", "transaction_type", "amount", "merchant_id",
        F.to_date(ts).alias("day"),
        F.hour(ts).alias("hour"),
        F.when(F.col("transaction_type") == "income", F.col("amount")).otherwise(-F.col("amount"))
        .cast("decimal(18,2)").alias("signed"),
        known_balance(F.col("metadata_json")).cast("decimal(18,2)").alias("known"),
    )
    # inside a span: running sum, and how far the last known balance lies above it
    inside = Window.partitionBy(*SPAN).orderBy("transaction_date", "id")
    sofar = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("local_sum", F.sum("signed").over(sofar).cast("decimal(18,2)"))
    local = local.withColumn("lift", F.col("known") - F.col("local_sum"))
    local = local.withColumn("local_lift", F.last("lift", ignorenulls=True).over(sofar))

    # one row per span, ordered per account: sums before it and known balances around it
    place = F.struct("transaction_date", "id")
    has_lift = F.col("lift").isNotNull()
    spans = local.groupBy(*SPAN).agg(
        F.sum("signed").cast("decimal(18,2)").alias("total"),
        F.max_by("lift", F.when(has_lift, place)).alias("last_lift"),
        F.min_by("lift", F.when(has_lift, place)).alias("first_lift"),
        F.min_by("signed", F.when(has_lift, place)).alias("first_signed"),
    )
    order = Window.partitionBy("account").orderBy("day", "hour")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offset = F.coalesce(F.sum("total").over(before), F.lit(0)).cast("decimal(18,2)")
    spans = spans.withColumn("sum_before", offset)
    first = F.col("first_lift") - F.col("sum_before")
    if backward == "compat":
        first = first + F.col("first_signed")
    spans = spans.select(
        *SPAN,
        "sum_before",
        F.last(F.col("last_lift") - F.col("sum_before"), ignorenulls=True).over(before).alias("carried_lift"),
        F.first(first, ignorenulls=True).over(everywhere).alias("opening_lift"),
    )
    whole = F.col("sum_before") + F.col("local_sum")
    back = whole + F.col("opening_lift")
    if backward == "compat":
        back = back - F.col("signed")
    balance = F.coalesce(F.col("local_sum") + F.col("local_lift"), whole + F.col("carried_lift"), back)
    return local.join(spans, SPAN).select(
        "id", "account", "transaction_date", "transaction_type", "amount", "merchant_id", "day",
        balance.cast("decimal(14,2)").alias("balance"),
    )


def daily_close(balances: DataFrame) -> DataFrame:
    """The last balance of every day; days without one are left out.

    The day's transactions stay rows of ``balances``; they are not folded into a list.
    """
    last = F.max_by("balance", F.struct("transaction_date", "id"))
    return balances.filter(F.col("balance").isNotNull()).groupBy("account", "day").agg(last.alias("balance"))


def day_change(closes: DataFrame) -> DataFrame:
    """Difference to the account's previous listed day, 0 on the first."""
    order = Window.partitionBy("account").orderBy("day")
    previous = F.lag("balance").over(order)
    return closes.withColumn("change", F.col("balance") - F.coalesce(previous, F.col("balance")))


def timeline_summary(closes: DataFrame) -> DataFrame:
    """Lowest, highest, mean, first and last day balance, change and number of days."""
    zero = F.lit(0.0)

    def dbl(c):
        return F.coalesce(c.cast("double"), zero)

    row = closes.groupBy("account").agg(
        dbl(F.min("balance")).alias("min_balance"),
        dbl(F.max("balance")).alias("max_balance"),
        dbl(F.sum("balance")).alias("total"),
        dbl(F.min_by("balance", "day")).alias("start_balance"),
        dbl(F.max_by("balance", "day")).alias("end_balance"),
        (F.max_by("balance", "day") - F.min_by("balance", "day")).cast("double").alias("change"),
        F.count("*").alias("total_days"),
    )
    return row.withColumn("avg_balance", F.col("total") / F.col("total_days")).drop("total")


def range_in_out(rows: DataFrame) -> DataFrame:
    """Sum and number of income and of all other rows."""
    income = F.col("transaction_type") == "income"
    zero = F.lit(0).cast("decimal(12,2)")
    return rows.agg(
        F.coalesce(F.sum(F.when(income, F.col("amount"))), zero).cast("double").alias("total_in"),
        F.count_if(income).alias("count_in"),
        F.coalesce(F.sum(F.when(~income, F.col("amount"))), zero).cast("double").alias("total_out"),
        F.count_if(~income).alias("count_out"),
    )


def range_extremes(closes: DataFrame) -> DataFrame:
    """Highest and lowest balance per account, each with its first day."""
    return closes.groupBy("account").agg(
        F.max("balance").alias("max_balance"),
        F.min_by("day", F.struct(-F.col("balance"), "day")).alias("max_day"),
        F.min("balance").alias("min_balance"),
        F.min_by("day", F.struct("balance", "day")).alias("min_day"),
    )


def merchant_net(rows: DataFrame, merchants: DataFrame) -> DataFrame:
    """Income less everything else per merchant name, biggest first; no name is 'Unknown'."""
    signed = F.when(F.col("transaction_type") == "income", F.col("amount")).otherwise(-F.col("amount"))
    per_id = rows.groupBy("merchant_id").agg(F.sum(signed).alias("net"), F.count("*").alias("n"))
    names = merchants.select(F.col("id").alias("merchant_id"), "name")
    return (
        per_id.join(names, "merchant_id", "left")
        .groupBy(F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown")).alias("merchant"))
        .agg(F.sum("net").alias("net"), F.sum("n").alias("n"))
        .orderBy(F.desc(F.abs("net")), "merchant")
    )


def day_activity(rows: DataFrame) -> DataFrame:
    """Number, in, out and direction of every day."""
    income = F.col("transaction_type") == "income"
    zero = F.lit(0).cast("decimal(12,2)")
    total_in = F.coalesce(F.sum(F.when(income, F.col("amount"))), zero)
    total_out = F.coalesce(F.sum(F.when(~income, F.col("amount"))), zero)
    days = rows.groupBy(F.to_date("transaction_date").alias("day")).agg(
        F.count("*").alias("n"),
        total_in.cast("double").alias("total_in"),
        total_out.cast("double").alias("total_out"),
        F.when(total_in > total_out, "up").otherwise("down").alias("direction"),
    )
    return days.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
