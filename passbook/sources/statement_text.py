"""Card statements given as extracted text: line records, header fields, printed totals.

``lines`` frames have (file, line_no, line) with line numbers from 1 without gaps, and
``before`` where the lines above are at hand;
``statements`` frames have (file, text) with the whole text of a file.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.compute import settled, shuffled
from passbook.functions.text import collapse, group1, mask_identifier, nonempty, once, strip, words

# Shapes of the transaction lines of the two card layouts.
CARD_A_NEW = r"(\d{2}/\d{2}/\d{4})\|\s*(\d{2}:\d{2})\s+(.+?)\s+C\s+([\d,]+\.?\d*)\s+[lI]"
CARD_A_OLD = r"(\d{2}/\d{2}/\d{4})\s+(\d{2}:\d{2}:\d{2})\s+(.+?)\s+([\d,]+\.?\d*)$"
DATED = r"\d{2}/\d{2}/\d{4}"
CARD_B = r"(\d{2}/\d{2}/\d{4})\s+(\d+)\s+(.+?)\s+(IN|US|UK|[A-Z]{2})\s+([\d,]+\.?\d*)\s*(CR)?"

# Headings that end the look back for a description.
HEADINGS = [
    "DATE & TIME", "TRANSACTION DESCRIPTION", "REWARDS AMOUNT", "TRANSACTIONS", "PAGE ", "DOMESTIC", "INTERNATIONAL",
]
NO_DESCRIPTION = "Unknown Transaction"

LOOK_BACK = 3
SPAN = 10_000


def statement_lines(statements: DataFrame) -> DataFrame:
    """Every line of every statement, with ``before``, the lines just above, nearest first.

    The text of a file is one value, so its lines meet those above them without a shuffle.
    """
    shifted = [
        F.concat(F.array_repeat(F.lit(None).cast("string"), i), F.slice("lines", F.lit(1), F.size("lines") - i)).alias(f"up{i}")
        for i in range(1, LOOK_BACK + 1)
    ]
    padded = F.when(F.size("lines") > LOOK_BACK, F.col("lines")).otherwise(
        F.concat("lines", F.array_repeat(F.lit(None).cast("string"), LOOK_BACK + 1))
    )
    rows = statements.select("file", F.split("text", "\n").alias("lines")).withColumn("lines", padded)
    rows = rows.select("file", F.posexplode(F.arrays_zip(F.col("lines").alias("line"), *shifted)).alias("pos", "z"))
    return rows.filter(F.col("z.line").isNotNull()).select(
        "file",
        (F.col("pos") + 1).cast("long").alias("line_no"),
        F.col("z.line").alias("line"),
        F.array(*[F.col(f"z.up{i}") for i in range(1, LOOK_BACK + 1)]).alias("before"),
    )


def with_previous_lines(lines: DataFrame) -> DataFrame:
    """W9 previous_line_lookback: adds ``before`` to lines that come one by one.

    A file is cut into spans, each repeating the last lines of the span above, so that one
    long file is worked on by many tasks.
    """
    span = F.floor((F.col("line_no") - 1) / SPAN)
    own = lines.withColumn("span", span).withColumn("repeated", F.lit(False))
    tail = own.filter((F.col("line_no") - 1) % SPAN >= SPAN - LOOK_BACK)
    tail = tail.withColumn("span", F.col("span") + 1).withColumn("repeated", F.lit(True))
    order = Window.partitionBy("file", "span").orderBy("line_no")
    above = F.array(*[F.lag("line", i).over(order) for i in range(1, LOOK_BACK + 1)])
    return own.unionByName(tail).withColumn("before", above).filter(~F.col("repeated")).drop("span", "repeated")


def description_above(before: Column) -> Column:
    """The description printed above a transaction line, or ''.

    Lines are taken upwards until another transaction, a heading or enough text; short lines
    and reference tails do not start a description.
    """
    def step(state: Column, raw: Column) -> Column:
        line = strip(raw)
        ends = state["done"] | raw.isNull() | line.rlike(r"\d{2}/\d{2}/\d{4}[\|\s]") | F.upper(line).rlike("|".join(HEADINGS))
        unfit = line.startswith("ST") | (F.size(words(line)) <= 2)
        passed = (line == "") | ((state["text"] == "") & unfit)
        joined = F.when(state["text"] == "", line).otherwise(F.concat(line, F.lit(" "), state["text"]))
        text = F.when(ends | passed, state["text"]).otherwise(joined)
        return F.struct(text.alias("text"), (ends | (F.length(text) > 15)).alias("done"))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))
    found = F.aggregate(before, start, lambda s, x: _plain(step(s, x)))["text"]
    return F.regexp_replace(collapse(found), r"\s*\(Ref#.*$", "")


def _plain(state: Column) -> Column:
    """The state with a definite flag: a missing line ends the search."""
    return F.struct(
        F.coalesce(state["text"], F.lit("")).alias("text"), F.coalesce(state["done"], F.lit(True)).alias("done")
    )


def _day(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))


def _money(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(12,2)")


def _parts(line: Column, pattern: str, n: int) -> Column:
    """All n groups of the first match as an array, from one pass of the pattern."""
    groups = "\u0001".join(f"${i}" for i in range(1, n + 1))
    tail = "" if pattern.endswith("$") else ".*$"
    marked = F.regexp_replace(line, f"^.*?{pattern}{tail}", groups)
    return F.split(marked, "\u0001")


def card_a_lines(lines: DataFrame) -> DataFrame:
    """Transactions of the first card layout, whose description may stand above the line.

    Every matching line is returned; ``reject`` tells why a line gives no record.
    """
    is_new = F.col("line").rlike(CARD_A_NEW)
    rows = lines if "before" in lines.columns else with_previous_lines(lines)
    rows = rows.filter(F.col("line").rlike(DATED) & (is_new | F.col("line").rlike(CARD_A_OLD)))
    rows = settled(rows, is_new=is_new)
    parts = F.when(F.col("is_new"), _parts(F.col("line"), CARD_A_NEW, 4)).otherwise(
        _parts(F.col("line"), CARD_A_OLD, 4)
    )
    part = [F.get("parts", F.lit(i)) for i in range(4)]
    inline = collapse(F.regexp_replace(strip(part[2]), r"\s*\+\s*\d+\s*$", ""))
    rows = settled(settled(rows, parts=parts), day=_day(part[0]), amount=_money(part[3]))
    # no filter asks for the description, so it stays a projection and goes where nobody reads it
    rows = rows.withColumn("inline", inline)
    rows = rows.withColumn("above", F.when(F.length("inline") < 3, description_above(F.col("before"))).otherwise(""))
    description = (
        F.when(F.length("inline") >= 3, F.col("inline"))
        .when(F.length("above") >= 3, F.col("above"))
        .otherwise(NO_DESCRIPTION)
    )
    return rows.select(
        "file",
        "line_no",
        "day",
        "amount",
        description.alias("description"),
        F.lit("expense").alias("transaction_type"),
        F.left(part[1], F.lit(5)).alias("time"),
        F.when(F.col("is_new"), "new").otherwise("old").alias("format"),
        _reject(F.col("day"), F.col("amount")).alias("reject"),
    )


def card_b_lines(lines: DataFrame) -> DataFrame:
    """Transactions of the second card layout; a trailing CR marks income."""
    rows = settled(lines.filter(F.col("line").rlike(CARD_B)), parts=_parts(F.col("line"), CARD_B, 6))
    part = [F.get("parts", F.lit(i)) for i in range(6)]
    rows = settled(rows, day=_day(part[0]), amount=_money(part[4]))
    return rows.select(
        "file",
        "line_no",
        "day",
        "amount",
        collapse(part[2]).alias("description"),
        F.when(part[5] == "CR", "income").otherwise("expense").alias("transaction_type"),
        part[1].alias("external_id"),
        part[3].alias("country_code"),
        _reject(F.col("day"), F.col("amount")).alias("reject"),
    )


def _reject(day: Column, amount: Column) -> Column:
    return (
        F.when(day.isNull(), "bad date")
        .when(amount.isNull(), "bad amount")
        .when(amount <= 0, "not positive")
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject").isNull()).drop("reject")


def rejects(parsed: DataFrame) -> DataFrame:
    """Lines that look like records but cannot be read; zero amounts are left out silently."""
    return parsed.filter(F.col("reject").isin("bad date", "bad amount")).select("file", "line_no", "reject")


def first_method(*methods: DataFrame) -> DataFrame:
    """Per file, the records of the first extraction that found any."""
    ranked = None
    for rank, rows in enumerate(methods):
        rows = rows.withColumn("method", F.lit(rank))
        ranked = rows if ranked is None else ranked.unionByName(rows, allowMissingColumns=True)
    best = ranked.groupBy("file").agg(F.min("method").alias("method"))
    return ranked.join(shuffled(best), ["file", "method"])


# ---------------------------------------------------------------- printed totals and header fields

SECTION_TOTAL = r"(?i)(?:Total\s+(?:Domestic|International)\s+Transactions|Grand\s+Total)[:\s]*([\d,]+\.?\d*)"
AMOUNT_DUE = r"(?i)TOTAL\s+AMOUNT\s+DUE\s*(?:[:\-]|\s)*[`₹]?\s*([\d,]+(?:\.\d{2})?)"


def sum_of_section_totals(text: Column) -> Column:
    """All printed section totals added up; null if none is positive."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SECTION_TOTAL), F.lit(1)), _money)
    total = F.aggregate(
        found, F.lit(0).cast("decimal(14,2)"), lambda s, x: (s + F.coalesce(x, F.lit(0))).cast("decimal(14,2)")
    )
    return once(total, lambda t: F.when(t > 0, t))


def _found(text: Column, pattern: str) -> Column:
    """``group1`` that looks through a long text once."""
    return once(F.regexp_extract(text, pattern, 1), nonempty)


def amount_due(text: Column) -> Column:
    """The printed total amount due, or null."""
    return _money(_found(text, AMOUNT_DUE))


def card_number(text: Column) -> Column:
    """The masked card number printed in the header."""
    patterns = [
        r"(?i)(?:Credit\s*Card(?:\s*No\.?|\s*Number)?\s*[:\-]?\s*)([0-9Xx* ]{12,25})",
        r"(?i)(?:Card\s*No\.?\s*[:\-]?\s*)([0-9Xx* ]{12,25})",
    ]

    def clean(raw):
        digits = F.regexp_replace(F.replace(raw, F.lit("*"), F.lit("X")), "[^0-9Xx]", "")
        return mask_identifier(F.upper(digits))

    return F.coalesce(*[clean(_found(text, p)) for p in patterns])


def statement_date(text: Column) -> Column:
    """The statement date, as digits (day first) or with the month's name."""
    named = _found(text, r"(?i)STATEMENT DATE\s+([A-Za-z]+\s+\d{1,2},\s+\d{4})")
    layouts = ("MMMM d, yyyy", "MMM d, yyyy")
    tries = [
        once(
            F.initcap(collapse(named)),
            lambda day: F.coalesce(*[F.to_date(F.try_to_timestamp(day, F.lit(layout))) for layout in layouts]),
        )
    ]
    for pattern in (
        r"(?i)Statement Date[:\s]+(\d{1,2}/\d{1,2}/\d{4})",
        r"(?i)Statement for HDFC Bank Credit Card[^0-9]*(\d{1,2}/\d{1,2}/\d{4})",
    ):
        tries.append(F.to_date(F.try_to_timestamp(_found(text, pattern), F.lit("d/M/yyyy"))))
    return F.coalesce(*tries)


def customer_id(text: Column) -> Column:
    """The customer id of an account statement."""
    return _found(text, r"(?i)\bCust(?:omer)?\s*ID\s*[:\-]?\s*([A-Z0-9]+)")


def account_number(text: Column) -> Column:
    """The masked account number of an account statement."""
    patterns = [
        r"(?i)\b(?:Account|A/c)\s*(?:No\.?|Number)\s*[:\-]?\s*([0-9Xx]{6,24})",
        r"(?i)\bA/c\s*No\.?\s*[:\-]?\s*([0-9Xx]{6,24})",
    ]
    return mask_identifier(F.upper(F.coalesce(*[_found(text, p) for p in patterns])))


# ---------------------------------------------------------------- file names

CARD_A_NAME = r"(?i)^(\d{4}X{4,}[\dX]{4,})_(\d{2})-(\d{2})-(\d{4})_?(.*)\.pdf$"
CARD_B_NAME = r"(?i)^(\d{4}X{4,}[\dX]{4,})_(\d+)_Retail_([A-Za-z]+)_NORM\.pdf$"


def filename_fields(name: Column) -> dict[str, Column]:
    """Card number, statement date, reference and card type in a file name; account token of CSV files."""
    is_a, is_b = name.rlike(CARD_A_NAME), name.rlike(CARD_B_NAME)
    day = F.concat_ws("-", *[F.regexp_extract(name, CARD_A_NAME, i) for i in (4, 3, 2)])
    reference = F.regexp_replace(F.regexp_extract(name, CARD_A_NAME, 5), "^_+|_+$", "")
    account = F.coalesce(
        group1(name, r"(?i)Acct_Statement_([0-9Xx]{8,24})_"), group1(name, r"(?i)Statement_([0-9Xx]{8,24})_")
    )
    return {
        "card_number": F.when(is_a, F.regexp_extract(name, CARD_A_NAME, 1)).when(
            is_b, F.regexp_extract(name, CARD_B_NAME, 1)
        ),
        "statement_date": F.when(is_a, F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))),
        "reference": F.when(is_a, reference).when(is_b, F.regexp_extract(name, CARD_B_NAME, 2)),
        "card_type": F.when(is_b & ~is_a, F.regexp_extract(name, CARD_B_NAME, 3)),
        "account_number": mask_identifier(account, keep_masked=True),
    }
