"""Statements given as extracted tables or as words with positions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.compute import settled, shuffled
from passbook.functions.text import collapse, group1, nonempty, parse_date, strip
from passbook.sources.statement_text import NO_DESCRIPTION

HEADER_ROWS = 3


# ---------------------------------------------------------------- table cells


def with_positions(rows: DataFrame, cells: str, names: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``at``, the place of every column: each cell takes the first name that fits, the last cell wins."""
    rows = settled(rows, lowered=F.transform(cells, lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))))
    rows = settled(rows, labels=F.transform("lowered", lambda c: _first_fit(c, names)))
    places = []
    for name, _ in names:
        last = F.size("labels") - F.array_position(F.reverse("labels"), name)
        places.append(F.when(F.array_contains("labels", name), last).cast("int").alias(name))
    return settled(rows, at=F.struct(*places)).drop("lowered", "labels")


def _first_fit(cell: Column, names) -> Column:
    chain = None
    for name, rule in names:
        chain = F.when(rule(cell), F.lit(name)) if chain is None else chain.when(rule(cell), F.lit(name))
    return chain


# Header words of the two table layouts.
CARD_COLUMNS = [
    ("date", lambda c: c.contains("date") & ~c.contains("value")),
    ("description", lambda c: c.contains("transaction") | c.contains("description")),
    ("rewards", lambda c: c.contains("reward")),
    ("amount", lambda c: c.contains("amount")),
]
ACCOUNT_COLUMNS = [
    ("date", lambda c: c.contains("date") & ~c.contains("value")),
    ("narration", lambda c: c.contains("narration")),
    ("ref", lambda c: c.contains("ref") | c.contains("chq")),
    ("debit", lambda c: c.contains("withdrawal") | c.contains("debit")),
    ("credit", lambda c: c.contains("deposit") | c.contains("credit")),
]


def _cell(cells: Column, at: Column) -> Column:
    return F.when(at < F.size(cells), strip(F.coalesce(F.get(cells, at), F.lit(""))))


def card_table_rows(cells: DataFrame) -> DataFrame:
    """Card transactions from tables (file, page, table_no, row_no, cells); row_no from 0.

    The header is the first of the three top rows that names date, amount and description;
    tables without one are left out.
    """
    text = F.lower(F.array_join(F.filter("cells", lambda c: c != ""), " "))
    is_header = (
        (F.col("row_no") < HEADER_ROWS) & text.contains("date") & text.contains("amount")
        & (text.contains("transaction") | text.contains("description"))
    )
    key = ["file", "page", "table_no"]
    headers = (
        cells.filter(is_header)
        .groupBy(*key)
        .agg(F.min(F.struct("row_no", "cells")).alias("header"))
    )
    headers = with_positions(headers, "header.cells", CARD_COLUMNS)
    headers = headers.filter(F.col("at.date").isNotNull() & F.col("at.amount").isNotNull()).select(
        *key, F.col("header.row_no").alias("header_no"), "at"
    )
    rows = cells.join(shuffled(headers), key).filter(F.col("row_no") > F.col("header_no"))

    def cell(name):
        return F.coalesce(_cell(F.col("cells"), F.col(f"at.{name}")), F.lit(""))

    rows = settled(rows, **{name: cell(name) for name, _ in CARD_COLUMNS})
    return _card_record(rows, *[F.col(name) for name, _ in CARD_COLUMNS]).withColumn(
        "description",
        F.when(F.length("description") >= 2, F.col("description")).otherwise(NO_DESCRIPTION),
    ).select(*key, "row_no", "day", "time", "description", "reward_points", "amount", "transaction_type")


def _card_record(rows: DataFrame, date: Column, description: Column, rewards: Column, amount: Column) -> DataFrame:
    """Reads the four card columns; rows without date or positive amount are dropped."""
    digits = F.replace(F.regexp_replace(amount, r"[^\d.,]", ""), F.lit(","), F.lit(""))
    value = nonempty(digits).try_cast("decimal(12,2)")
    day = F.to_date(F.try_to_timestamp(group1(date, r"(\d{2}/\d{2}/\d{4})"), F.lit("dd/MM/yyyy")))
    done = settled(
        rows,
        day=day,
        time=group1(date, r"(\d{2}:\d{2})"),
        description=clean_description(description),
        reward_points=group1(rewards, r"(\d+)").try_cast("bigint"),
        transaction_type=F.when(F.lower(amount).contains("cr"), "income").otherwise("expense"),
        amount=value,
    )
    return done.filter(F.col("day").isNotNull() & (F.col("amount") > 0))


def clean_description(c: Column) -> Column:
    return F.regexp_replace(collapse(c), r"\s*\(Ref#.*$", "")


def account_table_rows(cells: DataFrame) -> DataFrame:
    """S9, account variant: withdrawal and deposit columns, negative values turn round.

    The header is the first row with the cells 'date' and 'narration'; a table of at least
    six columns without header is read by position.
    """
    key = ["file", "page", "table_no"]
    joined = F.lower(F.array_join("cells", "\n"))
    lowered = F.transform("cells", lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))
    headers = (
        cells.filter(joined.contains("date") & joined.contains("narration"))
        .filter(F.array_contains(lowered, "date") & F.array_contains(lowered, "narration"))
        .groupBy(*key)
        .agg(F.min(F.struct("row_no", "cells")).alias("header"))
    )
    headers = with_positions(headers, "header.cells", ACCOUNT_COLUMNS).select(
        *key, F.col("header.row_no").alias("header_no"), F.col("at").alias("found")
    )
    by_place = F.struct(*[F.lit(i).alias(n) for n, i in (("date", 0), ("narration", 1), ("ref", 2), ("debit", 4), ("credit", 5))])
    tables = (
        cells.filter("row_no = 0")
        .select(*key, F.size("cells").alias("width"))
        .join(shuffled(headers), key, "left")
        .select(
            *key,
            F.coalesce("header_no", F.lit(-1)).alias("header_no"),
            F.coalesce("found", F.when(F.col("width") >= 6, by_place)).alias("at"),
        )
        .filter(F.col("at").isNotNull())
    )
    rows = cells.filter(F.size("cells") >= 5).join(shuffled(tables), key).filter(F.col("row_no") > F.col("header_no"))

    def cell(name):
        return F.coalesce(_cell(F.col("cells"), F.col(f"at.{name}")), F.lit(""))

    rows = settled(rows, **{name: cell(name) for name, _ in ACCOUNT_COLUMNS})
    money = {n: strip(F.replace(F.col(n), F.lit(","), F.lit(""))) for n in ("debit", "credit")}
    rows = settled(rows, day=parse_date(F.col("date")), **money).filter(F.col("day").isNotNull())
    has_debit = ~F.col("debit").isin("", "0.00")
    signed = F.when(has_debit, -F.col("debit").try_cast("decimal(12,2)")).otherwise(
        F.col("credit").try_cast("decimal(12,2)")
    )
    rows = settled(rows, signed=signed).filter(F.col("signed") != 0)
    return rows.select(
        *key,
        "row_no",
        "day",
        F.col("narration").alias("description"),
        F.col("ref").alias("external_id"),
        F.abs("signed").alias("amount"),
        F.when(F.col("signed") > 0, "income").otherwise("expense").alias("transaction_type"),
    )


# ---------------------------------------------------------------- words with positions


def word_rows(words: DataFrame) -> DataFrame:
    """Card transactions from words (file, page, x0, top, text).

    Words within six points of height form a row.  The header row gives the column edges;
    a row whose description is missing or is the tail of a reference takes the one of the row
    above it.
    """
    key = ["file", "page"]
    placed = words.select(*key, "x0", "text", (F.bround(F.col("top") / 6) * 6).alias("y"))
    lines = placed.groupBy(*key, "y").agg(F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("words"))
    header = _column_edges(lines)
    rows = lines.join(shuffled(header), key).filter(F.col("y") > F.col("header_y"))

    def part(low, high):
        inside = F.filter(
            "words",
            lambda w: (F.lit(True) if low is None else w["x0"] >= F.col(low))
            & (F.lit(True) if high is None else w["x0"] < F.col(high)) & (strip(w["text"]) != ""),
        )
        return F.array_join(F.transform(inside, lambda w: strip(w["text"])), " ")

    rows = settled(
        rows,
        date_text=part(None, "desc_start"),
        desc_text=clean_description(part("desc_start", "rewards_start")),
        reward_text=part("rewards_start", "amount_start"),
        amount_text=part("amount_start", None),
    )
    above = F.lag("desc_text").over(Window.partitionBy(*key).orderBy("y"))

    def is_tail(c):
        return c.rlike(r"^[A-Z]{0,2}\d{12,}\)?$")

    borrows = (F.col("desc_text") == "") | is_tail(F.col("desc_text"))
    usable = F.coalesce((F.col("above") != "") & ~is_tail(F.col("above")), F.lit(False))
    rows = rows.withColumn("above", above).withColumn(
        "chosen", F.when(borrows & usable, F.col("above")).otherwise(F.col("desc_text"))
    )
    records = _card_record(rows, F.col("date_text"), F.col("chosen"), F.col("reward_text"), F.col("amount_text"))
    return records.filter((F.length("chosen") >= 2) & ~is_tail(F.col("chosen"))).select(
        *key, "y", "day", "time", "description", "reward_points", "amount", "transaction_type"
    )


def _column_edges(lines: DataFrame) -> DataFrame:
    """Per page, the first row with DATE and AMOUNT and the edges between its columns."""
    text = F.upper(F.array_join(F.transform("words", lambda w: w["text"]), " "))
    named = F.transform("words", lambda w: F.struct(_first_fit(F.lower(strip(w["text"])), CARD_COLUMNS).alias("name"), w["x0"].alias("x0")))

    def x(name):
        hits = F.filter("named", lambda n: n["name"] == name)
        return F.get(hits, F.size(hits) - 1)["x0"]

    heads = settled(lines.filter(text.contains("DATE") & text.contains("AMOUNT")), named=named)
    heads = settled(
        heads, date_x=x("date"), found_x=x("description"), rewards_x=x("rewards"), amount_x=x("amount")
    )
    candidates = heads.filter(F.col("date_x").isNotNull() & F.col("amount_x").isNotNull()).withColumn(
        "desc_x", F.coalesce("found_x", F.col("date_x") + 100)
    )
    edges = F.struct("date_x", "desc_x", "rewards_x", "amount_x")
    first = candidates.groupBy("file", "page").agg(F.min("y").alias("header_y"), F.min_by(edges, "y").alias("e"))
    e = {n: F.col(f"e.{n}") for n in ("date_x", "desc_x", "rewards_x", "amount_x")}
    has_rewards = F.coalesce(e["rewards_x"] < 9999, F.lit(False))
    return first.select(
        "file",
        "page",
        "header_y",
        F.when(e["desc_x"] > e["date_x"], (e["date_x"] + e["desc_x"]) / 2).otherwise(e["date_x"] + 80).alias("desc_start"),
        F.when(has_rewards, (e["desc_x"] + e["rewards_x"]) / 2).otherwise(e["amount_x"] - 60).alias("rewards_start"),
        F.when(has_rewards, (e["rewards_x"] + e["amount_x"]) / 2).otherwise(e["amount_x"] - 30).alias("amount_start"),
    )
