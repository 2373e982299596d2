"""J9/W5 for large rule sets: a discrimination index over the rules.

Rules stay rows.  Every condition that needs a literal gives keys: the whole text for equals, the
pieces of up to three characters of the text for contains, starts_with and ends_with, the
buckets of an amount for numbers, the id for a merchant.  A rule is filed under the key that the
fewest ledger rows have (one per condition, where any of them will do).  Ledger rows meet rules by
equality of a key, and only these candidates are evaluated, so neither the plan nor the work
grows with rules times rows.  What has no literal (patterns, not_contains, numbers in texts) goes to
the rest, which ``rules.matching_rules`` evaluates on every row.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.text import first_nonempty
from passbook.operators import rules as ru
from passbook.storage import cut

CONDITIONS = (
    "logic string, merchant_id bigint, pattern string, min_amount string, max_amount string, "
    "rules array<struct<field:string,operator:string,value:string,case_sensitive:boolean>>"
)
TEXT_OPERATORS = ["contains", "starts_with", "ends_with", "equals"]
TEXT_FIELDS = ["description", "original_description", "merchant_name", "source_type", "currency"]
#: Length of the pieces; a shorter text is its own piece.
PIECE = 3
#: Amount buckets per doubling, and the outermost one.
STEPS, OUTER = 4, 4 * 41


def parts(text: Column, n: int) -> Column:
    """All parts of ``n`` characters; none of a shorter text."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))


def pieces(text: Column) -> Column:
    """The distinct pieces of PIECE characters, or the text itself if it is no longer."""
    return F.when(F.length(text) > PIECE, F.array_distinct(parts(text, PIECE))).otherwise(F.array(text))


def probes(text: Column) -> Column:
    """All keys a text can be met by: the whole text, and its pieces of up to PIECE characters."""
    short = F.concat(*[parts(text, n) for n in range(1, PIECE + 1)])
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("="), text)), F.transform(short, lambda p: F.concat(F.lit("~"), p))))


def bucket(amount: Column) -> Column:
    """A number that never falls when ``amount`` rises."""
    size = F.least(F.floor(STEPS * F.log2(F.abs(amount) + 1)), F.lit(OUTER))
    return F.when(amount < 0, -size).when(amount >= 0, size).cast("int")


def parsed(rules: DataFrame) -> DataFrame:
    """(rule_id, priority, merchant, flat, any, conds) of the active rules (id, priority, is_active, conditions, merchant_id)."""
    read = rules.filter(F.coalesce("is_active", F.lit(True))).withColumn("c", F.from_json("conditions", CONDITIONS))
    flat = F.filter(
        F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.lit(o).alias("operator"), F.col(f"c.{v}").cast("string").alias("value"), F.lit(False).alias("exact"))
                for f, o, v in (
                    ("merchant", "equals", "merchant_id"),
                    ("text", "contains", "pattern"),
                    ("amount", "at_least", "min_amount"),
                    ("amount", "at_most", "max_amount"),
                )
            ]
        ),
        lambda x: x["value"].isNotNull() & ((x["field"] == "amount") | ~x["value"].isin("", "0")),
    )
    listed = F.transform(
        "c.rules",
        lambda x: F.struct(
            F.coalesce(x["field"], F.lit("description")).alias("field"),
            F.coalesce(x["operator"], F.lit("contains")).alias("operator"),
            x["value"].alias("value"),
            F.coalesce(x["case_sensitive"], F.lit(False)).alias("exact"),
        ),
    )
    is_flat = F.col("c.rules").isNull()
    any_ = ~is_flat & (F.upper(F.coalesce("c.logic", F.lit("AND"))) == "OR")
    return read.select(
        F.col("id").alias("rule_id"), "priority", F.col("merchant_id").alias("merchant"), is_flat.alias("flat"), any_.alias("any"),
        F.when(is_flat, flat).otherwise(listed).alias("conds"),
    )


def numbers(cond: Column) -> tuple[Column, Column]:
    """The bounds a number condition sets; null where there is none, or the value is no number."""
    value = cond["value"].try_cast("double")
    ends = F.from_json(cond["value"], "array<string>")
    pair = (cond["operator"] == "between") & (F.size(ends) == 2)
    low = F.when(pair, F.get(ends, F.lit(0)).try_cast("double"))
    high = F.when(pair, F.get(ends, F.lit(1)).try_cast("double"))
    low = low.when(cond["operator"].isin("greater_than", "at_least"), value).when(cond["operator"] == "equals_number", value - 0.01)
    high = high.when(cond["operator"].isin("less_than", "at_most"), value).when(cond["operator"] == "equals_number", value + 0.01)
    return low, high


def keys_of(cond: Column) -> Column:
    """Keys of a condition, array<struct<field, key>>: a row it accepts has each one (a number: one of them); empty without a literal."""
    none = F.array().cast("array<struct<field:string,key:string>>")
    upper = F.upper(cond["value"])
    texts = F.when(cond["operator"] == "equals", F.array(F.concat(F.lit("="), upper))).otherwise(
        F.transform(pieces(upper), lambda p: F.concat(F.lit("~"), p))
    )
    is_text = cond["operator"].isin(TEXT_OPERATORS) & cond["field"].isin([*TEXT_FIELDS, "text"]) & (F.length(cond["value"]) > 0)
    low, high = numbers(cond)
    # a bucket more at each end, as logarithms are not exact
    first = F.coalesce(bucket(low) - 1, F.lit(-OUTER - 1))
    last = F.coalesce(bucket(high) + 1, F.lit(OUTER + 1))
    spread = F.when(first <= last, F.transform(F.sequence(first, last), lambda b: b.cast("string")))
    is_number = (cond["field"] == "amount") & (low.isNotNull() | high.isNotNull())
    field = lambda f, ks: F.transform(ks, lambda k: F.struct(f.alias("field"), k.alias("key")))
    return (
        F.when(cond["value"].isNull(), none)
        .when(cond["field"] == "merchant", field(F.lit("merchant"), F.array(cond["value"])))
        .when(is_text, field(cond["field"], texts))
        .when(is_number, field(F.lit("amount"), spread))
        .otherwise(none)
    )


def holds(cond: Column) -> Column:
    """Whether a row (with the columns of ``fields``) fulfils a condition that has keys, or a not_contains."""
    is_merchant, is_amount = cond["field"] == "merchant", cond["field"] == "amount"
    field = F.lit("")
    for name in TEXT_FIELDS:
        field = F.when(cond["field"] == name, F.col(f"f_{name}")).otherwise(field)
    field = F.when(cond["field"] == "text", F.col("f_text")).when(is_amount, F.col("amount").cast("string")).otherwise(field)
    text = F.when(cond["exact"], field).otherwise(F.upper(field))
    value = F.when(cond["exact"], cond["value"]).otherwise(F.upper(cond["value"]))
    op, amount = cond["operator"], F.col("amount").cast("double")
    low, high = numbers(cond)
    decimal = cond["value"].try_cast("decimal(38,6)")
    hit = (
        F.when(is_merchant, F.col("merchant_id").cast("string") == cond["value"])
        .when(op == "contains", F.contains(text, value))
        .when(op == "not_contains", ~F.contains(text, value))
        .when(op == "starts_with", F.startswith(text, value))
        .when(op == "ends_with", F.endswith(text, value))
        .when(op == "equals", text == value)
        .when(op == "at_least", F.col("amount") >= decimal)
        .when(op == "at_most", F.col("amount") <= decimal)
        .when(is_amount & (op == "greater_than"), amount > low)
        .when(is_amount & (op == "less_than"), amount < high)
        .when(is_amount & (op == "between"), amount.between(low, high))
        .when(is_amount & (op == "equals_number"), F.abs(amount - cond["value"].try_cast("double")) < 0.01)
    )
    return F.coalesce(hit & cond["value"].isNotNull(), F.lit(False))


def fields(ledger: DataFrame) -> DataFrame:
    """(id, amount, merchant_id, f_...): what conditions read; ``ledger`` has a merchant_name."""
    text = first_nonempty(F.col("cleaned_description"), F.col("original_description"))
    return ledger.select("id", "amount", "merchant_id", *[ru.rule_field(f).alias(f"f_{f}") for f in TEXT_FIELDS], text.alias("f_text"))


def rule_matches(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule_id, priority, merchant) of every active rule that matches a row.

    ``ledger`` has the columns of ``rules.with_merchant``, and unique ids; ``rules`` those of
    the rules table, conditions as JSON.  The same matches as ``rules.matching_rules`` finds.
    """
    rows = fields(ledger)
    known = ("merchant", "text", *TEXT_FIELDS, "amount")
    book = parsed(rules).withColumn("conds", F.transform("conds", lambda c: F.struct(c["field"], c["operator"], c["value"], c["exact"], keys_of(c).alias("keys"))))
    literal = lambda c: F.size(c["keys"]) > 0
    plain = lambda c: literal(c) | ((c["operator"] == "not_contains") & c["field"].isin(list(known)))
    indexed = F.forall("conds", plain) & F.when(F.col("any"), F.forall("conds", literal)).otherwise(F.exists("conds", literal))
    book = cut(book.withColumn("indexed", F.coalesce(indexed & (F.size("conds") > 0), F.lit(False))))

    # a way a rule can be met: for AND any one condition, for OR every condition is a way of its own
    conds = book.filter("indexed").select("rule_id", "any", F.posexplode("conds").alias("no", "cond"))
    conds = conds.select("rule_id", F.when(F.col("any"), F.col("no")).otherwise(-1).alias("way"), "no", "cond.keys")
    ranged = F.exists("keys", lambda k: k["field"] == "amount")
    split = conds.withColumn("ranged", F.coalesce(ranged, F.lit(False)))
    # pieces are chosen one by one; the buckets of a number belong together
    choice = split.select("rule_id", "way", "no", "ranged", F.posexplode("keys").alias("piece", "k")).select(
        "rule_id", "way", "no", F.when(F.col("ranged"), -1).otherwise(F.col("piece")).alias("piece"), "k.field", "k.key"
    )
    choice = cut(choice)
    wanted = choice.select("field", "key").distinct()

    shown = [F.struct(F.lit(f).alias("field"), F.upper(f"f_{f}").alias("text")) for f in [*TEXT_FIELDS, "text"]]
    said = rows.select("id", F.inline(F.array(*shown)))
    texts = said.groupBy("field", "text").agg(F.count(F.lit(1)).alias("n")).filter("text IS NOT NULL")
    met = cut(texts.withColumn("key", F.explode(probes(F.col("text")))).join(wanted, ["field", "key"]))
    other = rows.select("id", F.inline(F.array(
        F.struct(F.lit("amount").alias("field"), bucket(F.col("amount").cast("double")).cast("string").alias("key")),
        F.struct(F.lit("merchant").alias("field"), F.col("merchant_id").cast("string").alias("key")),
    )))
    other = other.join(wanted, ["field", "key"])
    counts = met.groupBy("field", "key").agg(F.sum("n").alias("n")).union(other.groupBy("field", "key").agg(F.count(F.lit(1))))
    weighed = choice.join(counts, ["field", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = weighed.groupBy("rule_id", "way", "no", "piece").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("rule_id", "way").orderBy("n", "no", "piece"))
    rarest = total.withColumn("rank", rank).filter("rank = 1").select("rule_id", "way", "no", "piece")
    filed = cut(choice.join(rarest, ["rule_id", "way", "no", "piece"]).select("rule_id", "field", "key").distinct())

    by_text = met.join(filed, ["field", "key"]).select("field", "text", "rule_id").distinct()
    pairs = said.join(by_text, ["field", "text"]).select("id", "rule_id")
    pairs = pairs.union(other.join(filed, ["field", "key"]).select("id", "rule_id")).distinct()
    judged = pairs.join(book.select("rule_id", "priority", "merchant", "any", "conds"), "rule_id").join(rows, "id")
    fulfilled = F.when(F.col("any"), F.exists("conds", holds)).otherwise(F.forall("conds", holds))
    found = judged.filter(fulfilled).select("id", "rule_id", "priority", "merchant")

    rest = ru.load_rules(rules.join(book.filter("NOT indexed").select(F.col("rule_id").alias("id")), "id"))
    if not rest:
        return found
    listed = ledger.select("id", F.explode(ru.matching_rules(rest)).alias("rule_id"))
    return found.unionByName(listed.join(book.select("rule_id", "priority", "merchant"), "rule_id"))


def first_rules(matches: DataFrame) -> DataFrame:
    """(id, rule_id) of the first match, by priority and id, that names a merchant."""
    first = matches.filter("merchant IS NOT NULL AND merchant <> 0").groupBy("id").agg(F.min(F.struct("priority", "rule_id")).alias("first"))
    return first.select("id", "first.rule_id")
