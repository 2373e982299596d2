"""Text, identifier, amount and date expressions."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the sense of the statements' text: Unicode, plus the ASCII separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Transfer prefixes and filler words of bank descriptions.
TRANSFER_PREFIXES = ["UPI-", "IMPS-", "NEFT-", "RTGS-", "ACH-"]
FILLER_WORDS = ["THE", "AND", "OR", "TO", "FROM", "FOR", "WITH"]
KEYWORD_STOPWORDS = ["UPI", "IMPS", "NEFT", "RTGS"] + FILLER_WORDS
GENERIC_TOKENS = [
    "TRANSFER", "PAYMENT", "CASH", "DEBIT", "CREDIT", "REVERSAL", "REFUND", "SELF",
    "MOBILE", "ONLINE", "INTEREST", "BANK", "CHARGES", "WITHDRAWAL", "DEPOSIT", "ATM",
]

# Date layouts tried in this order for day-first statements.
DAY_FIRST_LAYOUTS = [
    "dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yy", "dd-MM-yy", "dd-MMM-yyyy", "dd-MMM-yy", "yyyy-MM-dd",
]


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Trim and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def squash_upper(c: Column) -> Column:
    """Upper-case with all white space removed; null counts as empty."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", ""))


def words(c: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[nonempty(c) for c in cols], F.lit(""))


def group1(c: Column, pattern: str, idx: int = 1) -> Column:
    """Regex group or null when the pattern does not match or the group is empty."""
    return nonempty(F.regexp_extract(c, pattern, idx))


def external_id_norm(c: Column) -> Column:
    """D3: trimmed reference without leading zeros; blank is null, all zeros is '0'."""
    trimmed = strip(c)
    return F.when(trimmed != "", F.coalesce(nonempty(F.regexp_replace(trimmed, "^0+", "")), F.lit("0")))


def dedup_hash(ts: Column, amount: Column, description: Column, kind: Column) -> Column:
    """SHA-256 of day, amount, first 50 characters of the description and type."""
    prefix = F.substring(collapse(F.coalesce(description, F.lit(""))), 1, 50)
    payload = F.concat_ws(
        "|", F.date_format(ts, "yyyy-MM-dd"), amount.cast("decimal(12,2)").cast("string"), prefix, kind
    )
    return F.sha2(payload, 256)


def payment_handle(c: Column) -> Column:
    """The payee handle after the first ``UPI-`` or ``UPI `` mark, else null."""
    return group1(c, r"(?i)UPI[- ]([A-Z0-9@._]+)")


def merchant_token(c: Column) -> Column:
    """First significant word of a description once its transfer prefix is gone."""
    bare = F.regexp_replace(
        F.upper(F.coalesce(c, F.lit(""))), "^(?:" + "|".join(TRANSFER_PREFIXES) + ")", ""
    )
    ws = words(bare)
    fillers = F.array(*[F.lit(w) for w in FILLER_WORDS])
    strong = F.filter(ws, lambda w: (F.length(w) > 3) & ~F.array_contains(fillers, w))
    return F.coalesce(F.get(strong, F.lit(0)), F.get(ws, F.lit(0)), F.lit(""))


def keyword(c: Column) -> Column:
    """First word longer than three letters that is no stop word, else null."""
    stops = F.array(*[F.lit(w) for w in KEYWORD_STOPWORDS])
    strong = F.filter(words(F.upper(c)), lambda w: (F.length(w) > 3) & ~F.array_contains(stops, w))
    return F.get(strong, F.lit(0))


def mask_identifier(c: Column, keep_masked: bool = False) -> Column:
    """Keep the first and last four characters; ``keep_masked`` leaves values already holding X.

    The masked form is upper-cased in the ``keep_masked`` variant only.
    """
    def shown(compact: Column) -> Column:
        masked = F.concat(
            F.left(compact, F.lit(4)),
            F.repeat(F.lit("X"), F.length(compact) - 8),
            F.right(compact, F.lit(4)),
        )
        untouched = F.length(compact) <= 8
        if keep_masked:
            untouched = untouched | compact.contains("X")
        return F.when(untouched, compact).otherwise(masked)

    def packed(raw: Column) -> Column:
        compact = F.regexp_replace(raw, r"(?U)\s+", "")
        return F.upper(compact) if keep_masked else compact

    return once(c, lambda raw: F.when(raw != "", once(packed(raw), shown)))


def amount_in_text(c: Column) -> Column:
    """First amount in free text; any bracket in the text makes it negative."""
    bare = F.regexp_replace(c, r"[₹$Rs]", "")
    digits = F.replace(group1(bare, r"[\(]?([\d,]+\.?\d*)\)?"), F.lit(","), F.lit(""))
    value = digits.try_cast("decimal(18,2)")
    return F.when(c.contains("("), -value).otherwise(value)


def plain_amount(c: Column) -> Column:
    """Amount of a cell: separators and currency marks gone, brackets read as minus, sign dropped."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"Rs|[,₹$]", ""))
    bare = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return F.abs(bare.try_cast("decimal(12,2)"))


def clean_page_text(c: Column) -> Column:
    """Drop form feeds, 'Page n of m' and blank lines, trim every line."""
    bare = F.regexp_replace(F.replace(c, F.lit("\f"), F.lit("")), r"(?i)Page \d+ of \d+", "")
    lines = F.transform(F.split(bare, "\n"), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def lines_of(c: Column) -> Column:
    """Text cut at every line boundary."""
    return F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def parse_date(c: Column, layouts: list[str] = DAY_FIRST_LAYOUTS) -> Column:
    """First layout that reads the whole text, as DATE; null if none does.

    Two-digit years follow the POSIX pivot (69-99 are the 1900s).
    """
    tries = []
    for layout in layouts:
        shape = (
            layout.replace("dd", r"\d{1,2}").replace("MMM", "[A-Za-z]{3}").replace("MM", r"\d{1,2}")
            .replace("yyyy", r"\d{4}").replace("yy", r"\d{2}")
        )
        relaxed = layout.replace("dd", "d").replace("MMM", "LLL").replace("MM", "M").replace("LLL", "MMM")
        text = F.initcap(c) if "MMM" in layout else c
        day = F.to_date(F.try_to_timestamp(text, F.lit(relaxed)))
        if "yyyy" not in layout:
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        tries.append(F.when(c.rlike(f"^{shape}$"), day))
    return F.coalesce(*tries)


def date_in_text(c: Column) -> Column:
    """First date in free text, by pattern order, read day first."""
    patterns = [
        (r"\d{2}/\d{2}/\d{4}", "d/M/yyyy"),
        (r"\d{2}-\d{2}-\d{4}", "d-M-yyyy"),
        (r"(?U)\d{2}-\w{3}-\d{4}", "d-MMM-yyyy"),
        (r"(?U)\w{3}\s+\d{1,2},\s+\d{4}", "MMM d, yyyy"),
    ]
    branches = None
    for pattern, layout in patterns:
        hit = nonempty(F.regexp_extract(c, pattern, 0))
        day = F.to_date(F.try_to_timestamp(F.initcap(collapse(hit)), F.lit(layout)))
        branches = F.when(hit.isNotNull(), day) if branches is None else branches.when(hit.isNotNull(), day)
    return branches


def source_label(metadata_json: Column, source_type: Column) -> Column:
    """P14: 'Bank · Product' from the parser metadata, else the source type, else 'Unknown'."""
    bank = nonempty(F.get_json_object(metadata_json, "$.parser_metadata.bank"))
    product = nonempty(F.get_json_object(metadata_json, "$.parser_metadata.product"))
    label = F.concat(F.initcap(bank), F.lit(" · "), F.initcap(F.replace(product, F.lit("_"), F.lit(" "))))
    return F.coalesce(label, source_type, F.lit("Unknown"))


def known_balance(metadata_json: Column) -> Column:
    """The closing balance a statement printed, or null."""
    text = F.get_json_object(metadata_json, "$.raw.metadata.closing_balance")
    return strip(F.replace(text, F.lit(","), F.lit(""))).try_cast("decimal(14,2)")


def iso_text(ts: Column) -> Column:
    """ISO 8601 text of a zone-less timestamp; the fraction only where there is one."""
    micros = epoch_micros(ts) % 1000000
    fraction = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def epoch_day(ts: Column) -> Column:
    """Days since 1970-01-01 of a zone-less timestamp."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, whatever the session zone."""
    seconds = epoch_day(ts).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
