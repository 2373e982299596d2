"""Bank statements as CSV files.

Files differ in their header, so lines are read as text and cut into cells by
an expression; each profile then names the columns it needs by their header.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passbook.functions.compute import settled
from passbook.functions.text import DAY_FIRST_LAYOUTS, any_of, nonempty, parse_date, plain_amount, strip

# A quoted cell with what follows its closing quote, or an unquoted one.
# The quantifiers give nothing back, so a cell may have any length.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
CELL = rf',({QUOTED}[^,]*|[^,]*)'

# Date layouts of the generic profile.
MONTH_FIRST_LAYOUTS = ["yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy", "MM/dd/yy", "dd-MMM-yyyy", "dd MMM yyyy"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of CSV files with their place: line_no 0 is the header.

    A line's number is its place within its block of the file plus the lines of the blocks
    before it, so a large file is numbered block by block in parallel.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.regexp_replace("value", "^﻿", "").alias("line"),
    )
    rows = raw.filter(strip(F.col("line")) != "")
    order = Window.partitionBy("file", "block").orderBy("place")
    rows = rows.withColumn("in_block", F.row_number().over(order))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    return rows.join(offsets, ["file", "block"]).select(
        "file", (F.col("offset") + F.col("in_block") - 1).alias("line_no"), "line"
    )


def cells_of(line: Column) -> Column:
    """The cells of a CSV line; doubled quotes inside a quoted cell are single."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))

    def unquote(cell):
        inner = F.replace(F.regexp_extract(cell, r'^"([^"]*+(?:""[^"]*+)*+)"', 1), F.lit('""'), F.lit('"'))
        rest = F.regexp_replace(cell, f"^{QUOTED}", "")
        return F.when(cell.startswith('"'), F.concat(inner, rest)).otherwise(cell)

    return F.transform(raw, unquote)


def repaired(lines: DataFrame, positions: dict[str, Column] | None = None) -> DataFrame:
    """Data rows with the header of their file and exactly one cell per header.

    Surplus cells go back into the first Narration or Description column, joined with ', ';
    missing ones are empty.  ``positions`` are worked out once per header and come along as
    the struct ``at``.
    """
    header = settled(lines.filter("line_no = 0").select("file", "line"), line=cells_of(F.col("line")))
    header = settled(header, header=F.transform("line", strip)).drop("line")
    at = [c.alias(n) for n, c in (positions or {}).items()]
    if at:
        header = settled(header, at=F.struct(*at))
    rows = settled(lines.filter("line_no > 0").join(header, "file"), cells=cells_of(F.col("line")))
    rows = settled(rows, cells=csv_overflow_repair(F.col("header"), F.col("cells")))
    return rows.select("file", "line_no", "header", "cells", *(["at"] if at else []))


def with_columns(lines: DataFrame, positions: dict[str, Column]) -> DataFrame:
    """Data rows with the cell at each of the positions; null where the header lacks it."""
    rows = repaired(lines, positions)
    return rows.select("file", "line_no", *[F.get("cells", F.col(f"at.{n}")).alias(n) for n in positions])


def csv_overflow_repair(header: Column, cells: Column) -> Column:
    """As many cells as the header has columns."""
    width, n = F.size(header), F.size(cells)
    texty = F.transform(header, lambda h, i: F.when(h.contains("Narration") | h.contains("Description"), i))
    at = F.array_min(texty)
    extra = n - width
    folded = F.concat(
        F.slice(cells, F.lit(1), at),
        F.array(F.array_join(F.slice(cells, at + 1, extra + 1), ", ")),
        F.slice(cells, at + extra + 2, n),
    )
    padded = F.concat(cells, F.array_repeat(F.lit(""), width - n))
    return (
        F.when((n > width) & at.isNotNull(), folded)
        .when(n > width, F.slice(cells, F.lit(1), width))
        .otherwise(padded)
    )


def position(fits: Callable[[Column], Column], last: bool = False) -> Column:
    """Place of the first (or last) header that fits; null if none does."""
    places = F.array_compact(F.transform("header", lambda h, i: F.when(fits(h), i)))
    return F.array_max(places) if last else F.array_min(places)


def named(name: str) -> Column:
    return position(lambda h: h == name, last=True)


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def generic_drcr(lines: DataFrame, has_indicator: bool = True) -> DataFrame:
    """S3 csv_profile_drcr: Date, Description, Amount and a DrCr column.

    CR marks income, anything else an expense.  Without indicator the sign decides and is
    dropped.
    """
    rows = with_columns(
        lines,
        {"date": named("Date"), "text": named("Description"), "value": named("Amount"), "mark": named("DrCr")},
    )
    number = F.coalesce(nonempty(_number(F.coalesce("value", F.lit("0")))), F.lit("0"))
    rows = settled(rows.filter(F.col("date") != ""), number=strip(number).try_cast("decimal(12,2)"), date=strip(F.col("date")))
    rows = settled(rows, day=parse_date(F.col("date"), MONTH_FIRST_LAYOUTS))
    if has_indicator:
        kind = F.when(F.upper(F.coalesce("mark", F.lit(""))).startswith("CR"), "income").otherwise("expense")
    else:
        kind = F.when(F.col("number") < 0, "expense").otherwise("income")
    return rows.select(
        "file",
        "line_no",
        "day",
        (F.col("number") if has_indicator else F.abs("number")).alias("amount"),
        F.coalesce("text", F.lit("")).alias("description"),
        kind.alias("transaction_type"),
        F.lit(None).cast("string").alias("external_id"),
        F.lit(None).cast("string").alias("closing_balance"),
        F.when(F.col("day").isNull(), "bad date").when(F.col("number").isNull(), "bad amount").alias("reject"),
    )


def debit_credit(lines: DataFrame) -> DataFrame:
    """S4 csv_profile_debit_credit: separate debit and credit columns found by header words.

    A negative debit is income and a negative credit an expense; rows without date,
    description or amount are left out.
    """

    def is_ref(h):
        return h.contains("Ref Number") | h.contains("Chq")

    rows = with_columns(
        lines,
        {
            "date": position(lambda h: h.contains("Date") & ~h.contains("Value")),
            "text": position(lambda h: h.contains("Narration")),
            "debit": position(lambda h: h.contains("Debit Amount"), last=True),
            "credit": position(lambda h: h.contains("Credit Amount") & ~h.contains("Debit Amount"), last=True),
            "ref": position(is_ref, last=True),
            "closing": position(
                lambda h: h.contains("Closing Balance") & ~is_ref(h) & ~h.contains("Value Dat"), last=True
            ),
        },
    )
    zero = F.lit(0).cast("decimal(12,2)")

    def money(name):
        return F.when(F.col(name) == "", zero).otherwise(F.col(name).try_cast("decimal(12,2)"))

    trimmed = {n: strip(F.coalesce(n, F.lit(""))) for n in ("date", "text", "ref", "closing")}
    rows = settled(rows, **trimmed, **{n: _number(strip(F.coalesce(n, F.lit("")))) for n in ("debit", "credit")})
    rows = settled(rows, day=parse_date(F.col("date"), ["dd/MM/yy"]), debit=money("debit"), credit=money("credit"))
    rows = rows.filter(F.col("day").isNotNull() & (F.col("text") != ""))
    signed = F.when(F.col("debit") != 0, -F.col("debit")).otherwise(F.col("credit"))
    broken = F.col("debit").isNull() | F.col("credit").isNull()
    rows = rows.withColumn("signed", F.when(~broken, signed)).filter("signed is null or signed != 0")
    return rows.select(
        "file",
        "line_no",
        "day",
        F.abs("signed").alias("amount"),
        F.col("text").alias("description"),
        F.when(F.col("signed") > 0, "income").otherwise("expense").alias("transaction_type"),
        nonempty(F.col("ref")).alias("external_id"),
        nonempty(F.col("closing")).alias("closing_balance"),
        F.when(F.col("signed").isNull(), "bad amount").alias("reject"),
    )


# Header words of the generic reader, tried in this order for every column.
SYNONYMS = [
    ("date", ["date", "txn date", "transaction date"]),
    ("description", ["description", "particulars", "narration", "details", "memo"]),
    ("debit", ["debit", "withdrawal", "dr", "paid out"]),
    ("credit", ["credit", "deposit", "cr", "paid in"]),
    ("amount", ["amount"]),
]


def synonym_columns(header: Column) -> Column:
    """Positions of date, description, debit, credit and amount, by synonyms.

    A header takes the first meaning that fits and is still free.
    """
    empty = F.struct(*[F.lit(None).cast("int").alias(name) for name, _ in SYNONYMS])
    numbered = F.transform(header, lambda h, i: F.struct(F.lower(strip(h)).alias("name"), i.alias("i")))

    def fits(name, synonyms, h):
        found = any_of([h["name"].contains(s) for s in synonyms])
        return found & ~h["name"].contains("balance") if name == "amount" else found

    def place(state, h):
        meaning = None
        for name, synonyms in SYNONYMS:
            free = state[name].isNull() & fits(name, synonyms, h)
            meaning = F.when(free, F.lit(name)) if meaning is None else meaning.when(free, F.lit(name))
        return F.struct(
            *[F.when(meaning == name, h["i"]).otherwise(state[name]).cast("int").alias(name) for name, _ in SYNONYMS]
        )

    return F.aggregate(numbered, empty, place)


def generic_columns(lines: DataFrame) -> DataFrame:
    """S5 csv_generic_columns: any header with known synonyms, seven date layouts."""
    rows = repaired(lines, {"by": synonym_columns(F.col("header"))})
    places = {name: F.col(f"at.by.{name}") for name, _ in SYNONYMS}
    two = places["debit"].isNotNull() & places["credit"].isNotNull()
    cells = {name: strip(F.coalesce(F.get("cells", at), F.lit(""))) for name, at in places.items()}
    rows = settled(rows, two=two, **cells).filter("date != '' and description != ''")
    blank = ["", "-", "0", "0.00"]
    is_debit, is_credit, is_single = [~F.col(c).isin(blank) for c in ("debit", "credit", "amount")]
    text = (
        F.when(F.col("two") & is_debit, F.col("debit"))
        .when(F.col("two") & is_credit, F.col("credit"))
        .when(~F.col("two") & is_single, F.col("amount"))
    )
    kind = (
        F.when(F.col("two"), F.when(is_debit, "expense").otherwise("income"))
        .when(F.col("amount").startswith("-") | F.col("amount").startswith("("), "expense")
        .otherwise("income")
    )
    rows = settled(rows, text=text, day=parse_date(F.col("date"), DAY_FIRST_LAYOUTS))
    rows = settled(rows, value=plain_amount(F.col("text")))
    keep = F.col("day").isNull() | (F.col("text").isNotNull() & (F.col("value").isNull() | (F.col("value") != 0)))
    return rows.filter(keep).select(
        "file",
        "line_no",
        "day",
        F.col("value").alias("amount"),
        "description",
        kind.alias("transaction_type"),
        F.when(F.col("day").isNull(), "bad date").when(F.col("value").isNull(), "bad amount").alias("reject"),
    )


PROFILES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "generic_drcr": generic_drcr,
    "hdfc_bank": debit_credit,
    "by_synonyms": generic_columns,
}


def read_statements(spark: SparkSession, path: str, profile: str = "generic_drcr") -> tuple[DataFrame, DataFrame]:
    """(records, rejected rows) of CSV statements of one profile."""
    if profile not in PROFILES:
        raise ValueError(f"Unknown bank profile {profile}")
    parsed = PROFILES[profile](read_lines(spark, path))
    records = parsed.filter(F.col("reject").isNull()).drop("reject")
    return records, parsed.filter(F.col("reject").isNotNull()).select("file", "line_no", "reject")
