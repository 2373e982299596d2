"""Backups of a shared-expense ledger: one JSON document per user."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions.text import collapse
from passbook.schemas import SHARED_BACKUP


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    """The documents with a fixed schema; one that is no such backup gives no expenses."""
    docs = spark.read.schema(SHARED_BACKUP).option("multiLine", True).json(path)
    return docs.filter(F.col("user").isNotNull() & F.col("expenses").isNotNull())


def expenses_of(backup: DataFrame) -> DataFrame:
    """The expenses of the documents with their place and the current user."""
    return backup.select(
        F.col("user.id").alias("me"), F.posexplode("expenses").alias("line_no", "expense")
    ).select("me", F.col("line_no").cast("long").alias("line_no"), "expense.*")


def _money(c: Column) -> Column:
    return F.coalesce(c, F.lit("0")).try_cast("decimal(12,2)")


def _utc(text: Column) -> Column:
    """Zone-less time of an ISO text, in UTC where it names an offset, whatever the session zone."""
    at = F.try_to_timestamp(text)
    has_offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(has_offset, F.to_utc_timestamp(at, F.current_timezone())).otherwise(at).cast("timestamp_ntz")


def _sum(items: Column) -> Column:
    zero = F.lit(0).cast("decimal(12,2)")
    return F.aggregate(items, zero, lambda s, x: (s + _money(x["amount"])).cast("decimal(12,2)"))


def owed_share(cost: Column, users: Column, repayments: Column, me: Column) -> Column:
    """What the current user owes of an expense.

    Their own entry says so; else it follows from the repayments: the cost less what others
    owe them, or what they owe others.
    """
    mine = F.get(F.filter(users, lambda u: u["user"]["id"] == me), F.lit(0))
    to_me = _sum(F.filter(repayments, lambda r: r["to"] == me))
    from_me = _sum(F.filter(repayments, lambda r: r["from"] == me))
    return (
        F.when(mine.isNotNull(), _money(mine["owed_share"]))
        .when(_money(cost) == 0, F.lit(0))
        .when(to_me > 0, _money(cost) - to_me)
        .when(from_me > 0, from_me)
        .cast("decimal(12,2)")
    )


def user_paid(users: Column, me: Column) -> Column:
    """Whether the current user paid any part."""
    mine = F.get(F.filter(users, lambda u: u["user"]["id"] == me), F.lit(0))
    return F.coalesce(_money(mine["paid_share"]) > 0, F.lit(False))


def shared_records(expenses: DataFrame) -> DataFrame:
    """One record per expense that was not deleted.

    Payments are of type payment; a negative cost is income and loses its sign.
    """
    users = F.coalesce("users", F.array().cast(expenses.schema["users"].dataType))
    repayments = F.coalesce("repayments", F.array().cast(expenses.schema["repayments"].dataType))
    rows = expenses.filter(F.coalesce("deleted_at", F.lit("")) == "")
    rows = rows.withColumn("users", users).withColumn("repayments", repayments)
    rows = rows.withColumn("value", _money(F.col("cost"))).withColumn("is_payment", F.coalesce("payment", F.lit(False)))
    return rows.select(
        "me",
        "line_no",
        F.col("id").alias("expense_id"),
        _utc(F.col("date")).alias("transaction_date"),
        F.when(~F.col("is_payment"), F.abs("value")).otherwise(F.col("value")).alias("amount"),
        F.when(F.col("is_payment"), "payment").when(F.col("value") < 0, "income").otherwise("expense")
        .alias("transaction_type"),
        F.coalesce("currency_code", F.lit("INR")).alias("currency"),
        F.coalesce("description", F.lit("")).alias("original_description"),
        collapse(F.coalesce("description", F.lit(""))).alias("cleaned_description"),
        F.col("group_id").alias("shared_group_id"),
        "is_payment",
        owed_share(F.col("cost"), F.col("users"), F.col("repayments"), F.col("me")).alias("user_share"),
        user_paid(F.col("users"), F.col("me")).alias("user_paid"),
        "repayments",
        "users",
        "created_by",
    )


def persons(records: DataFrame, user: DataFrame | None = None, friends: DataFrame | None = None) -> DataFrame:
    """X2 person_union: current user, friends, then creators and participants; the first wins.

    ``user`` has the person columns, ``friends`` those and ``pos``; records come from
    ``shared_records``.
    """

    def ranked(df, place, order, pos, sub, who):
        return df.select(
            F.struct(
                F.lit(place).alias("place"), order.cast("long").alias("order"), pos.cast("long").alias("pos"),
                sub.alias("sub"),
                F.coalesce(who["first_name"], F.lit("")).alias("first_name"),
                F.coalesce(who["last_name"], F.lit("")).alias("last_name"),
                F.coalesce(who["email"], F.lit("")).alias("email"),
                F.lit(place == 0).alias("is_current_user"),
            ).alias("p"),
            who["id"].alias("person_id"),
        )

    who = F.struct("id", "first_name", "last_name", "email")
    # creator and participants come from one pass over the records
    creator = F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("sub"), F.col("created_by").alias("who"))
    users = F.transform("users", lambda u, i: F.struct(i.alias("pos"), F.lit(1).alias("sub"), u["user"].alias("who")))
    taking_part = records.select("line_no", F.inline(F.concat(F.array(creator), users)))
    parts = [ranked(taking_part, 2, F.col("line_no"), F.col("pos"), F.col("sub"), F.col("who"))]
    if user is not None:
        parts.append(ranked(user, 0, F.lit(0), F.lit(0), F.lit(0), who))
    if friends is not None:
        parts.append(ranked(friends, 1, F.col("pos"), F.lit(0), F.lit(0), who))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    first = every.filter(F.coalesce("person_id", F.lit(0)) != 0).groupBy("person_id").agg(F.min("p").alias("p"))
    return first.select("person_id", "p.first_name", "p.last_name", "p.email", "p.is_current_user")
