"""Import of shared expenses: the user's part, updates, splits, persons and their merchants."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.compute import settled, shuffled
from passbook.functions.text import dedup_hash


def share_scenario(records: DataFrame) -> DataFrame:
    """Amount, own part and type of every record that concerns the user.

    A settlement has no own part; what the user paid keeps its full amount; what a friend
    paid counts with the user's part and is provisional; the rest is dropped.
    """
    zero = F.lit(0).cast("decimal(12,2)")
    settles, paid = F.col("is_payment"), F.col("user_paid")
    owes = F.coalesce(F.col("user_share") > 0, F.lit(False))
    kept = settled(records, user_share=F.col("user_share"), user_paid=paid).filter(settles | paid | owes)
    by_friend = ~settles & ~paid
    return (
        kept.withColumn(
            "effective_amount",
            F.when(settles, zero).when(paid, F.coalesce("user_share", "amount")).otherwise(F.col("user_share")),
        )
        .withColumn("is_provisional", by_friend)
        .withColumn("amount", F.when(by_friend, F.col("user_share")).otherwise(F.col("amount")))
        .withColumn(
            "transaction_type",
            F.when(settles, "payment").when(by_friend, "expense").otherwise(F.col("transaction_type")),
        )
    )


def existing_expense(scenarios: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of every record: 'created', 'updated' or 'unchanged'.

    An expense known by its id only takes over a changed own part; ``stored`` has
    (expense_id, effective_amount).  Within one import the same id counts in order; ``key``
    tells the records that are the same expense.
    """
    # records without id never meet another one, so each gets a key of its own
    own = F.concat(F.lit("line "), F.col("line_no").cast("string"))
    rows = scenarios.withColumn("key", F.coalesce(F.nullif("expense_id", F.lit(0)).cast("string"), own))
    old = stored.select(
        F.col("expense_id").cast("string").alias("key"), F.col("effective_amount").alias("old_part"), F.lit(True).alias("is_old")
    )
    order = Window.partitionBy("key").orderBy("line_no")
    rows = rows.join(shuffled(old), "key", "left").withColumn("place", F.row_number().over(order))
    before = F.when(F.col("place") == 1, F.col("old_part")).otherwise(F.lag("effective_amount").over(order))
    is_first = (F.col("place") == 1) & F.col("is_old").isNull()
    action = F.when(is_first, "created").when(~before.eqNullSafe(F.col("effective_amount")), "updated")
    return rows.withColumn("action", F.coalesce(action, F.lit("unchanged"))).drop("old_part", "is_old", "place")


def import_counts(actions: DataFrame) -> DataFrame:
    """Created and updated records, and how many of the created a friend had paid."""
    created = F.col("action") == "created"
    return actions.agg(
        F.count_if(created).alias("created"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if(created & F.col("is_provisional")).alias("auto_created"),
    )


def created_rows(actions: DataFrame) -> DataFrame:
    """Ledger rows of the created records, with the last own part the import gave them."""
    last = F.max_by("effective_amount", "line_no").over(Window.partitionBy("key"))
    rows = actions.filter("key IS NOT NULL").withColumn("last_part", last).filter("action = 'created'")
    return rows.select(
        "expense_id", "line_no", F.lit("splitwise").alias("source_type"), "transaction_date", "amount",
        F.col("last_part").alias("effective_amount"), "currency", "transaction_type", "original_description", "cleaned_description",
        "shared_group_id", "is_payment", "is_provisional",
        dedup_hash(
            F.col("transaction_date"), F.col("amount"), F.col("original_description"), F.col("transaction_type")
        ).alias("dedup_hash"),
    )


def updated_parts(actions: DataFrame) -> DataFrame:
    """(expense_id, effective_amount) of stored expenses whose own part changed."""
    changed = actions.filter("action = 'updated'")
    return changed.groupBy("expense_id").agg(F.max_by("effective_amount", "line_no").alias("effective_amount"))


def resolve_parties(actions: DataFrame, persons: DataFrame) -> DataFrame:
    """Splits of the created records whose both parties are known."""
    parts = actions.filter("action = 'created'").select(
        "expense_id", "shared_group_id", F.explode("repayments").alias("r")
    )
    known = persons.select("person_id")
    return (
        parts.select(
            "expense_id", "shared_group_id", F.col("r.from").alias("from_person_id"), F.col("r.to").alias("to_person_id"),
            F.coalesce("r.amount", F.lit("0")).try_cast("decimal(12,2)").alias("amount"),
        )
        .join(known.withColumnRenamed("person_id", "from_person_id"), "from_person_id", "left_semi")
        .join(known.withColumnRenamed("person_id", "to_person_id"), "to_person_id", "left_semi")
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """Stored rows with the ``updated`` columns of their incoming twin, and the new rows."""
    twin = incoming.select(
        key, *[F.col(c).alias(f"in_{c}") for c in incoming.columns if c != key], F.lit(True).alias("is_in")
    )
    rows = stored.withColumn("is_old", F.lit(True)).join(twin, key, "full")
    out = []
    for c in stored.columns:
        if c == key:
            out.append(F.col(c))
        elif c not in incoming.columns:
            out.append(F.col(c))
        elif c in updated:
            out.append(F.when(F.col("is_in"), F.col(f"in_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("is_old"), F.col(c)).otherwise(F.col(f"in_{c}")).alias(c))
    return rows.select(*out)


def upsert_persons(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Names and address follow the backup; who the current user is stays as stored."""
    return upsert(stored, incoming, "person_id", ["first_name", "last_name", "email"])


def upsert_groups(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The name follows the backup; the type stays as stored."""
    return upsert(stored, incoming, "group_id", ["name"])


def person_merchant_match(persons: DataFrame, merchants: DataFrame, me: int | None) -> DataFrame:
    """Merchant of every person but the current user: by link, else by name, else new.

    Result: person_id, full_name, merchant_id (null if new) and how it was found.
    """
    last = F.nullif("last_name", F.lit(""))
    full_name = F.coalesce(F.concat("first_name", F.lit(" "), last), "first_name")
    others = persons.filter(F.col("person_id") != F.lit(me)) if me is not None else persons
    others = others.select("person_id", full_name.alias("full_name"))
    linked = (
        merchants.filter(F.col("shared_person_id").isNotNull())
        .groupBy(F.col("shared_person_id").alias("person_id"))
        .agg(F.min("id").alias("linked_id"))
    )
    by_name = (
        merchants.filter(F.col("type") == "person").groupBy(F.col("name").alias("full_name")).agg(F.min("id").alias("named_id"))
    )
    found = others.join(linked, "person_id", "left").join(by_name, "full_name", "left")
    how = F.when(F.col("linked_id").isNotNull(), "link").when(F.col("named_id").isNotNull(), "name").otherwise("new")
    return found.select("person_id", "full_name", F.coalesce("linked_id", "named_id").alias("merchant_id"), how.alias("found_by"))


def new_person_merchants(matches: DataFrame) -> DataFrame:
    """One merchant of type person per new name, linked to the last person of that name."""
    return (
        matches.filter("found_by = 'new'")
        .groupBy(F.col("full_name").alias("name"))
        .agg(F.max("person_id").alias("shared_person_id"))
        .withColumn("type", F.lit("person"))
    )


def relink_merchants(merchants: DataFrame, matches: DataFrame) -> DataFrame:
    """Merchants found by name point to their person from now on."""
    links = (
        matches.filter("found_by = 'name'")
        .groupBy(F.col("merchant_id").alias("id"))
        .agg(F.max("person_id").alias("new_person_id"))
    )
    rows = merchants.join(links, "id", "left")
    after = F.coalesce("new_person_id", "shared_person_id")
    return rows.select(*[after.alias(c) if c == "shared_person_id" else F.col(c) for c in merchants.columns])
