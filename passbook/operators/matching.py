"""Alias matching, reversals, and reconciliation of shared against bank rows.

No operator here forms the pairs of a group: amounts and days are condensed to
cells first, and nearest or lowest partners come from running minima.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.compute import shuffled
from passbook.functions.text import any_of, epoch_day, epoch_micros
from passbook.operators.containment import contained
from passbook.operators.ranking import lowest
from passbook.storage import cut

DAY_MICROS = 86400 * 1000000

# Words that mark a reversal.
REVERSAL_KEYWORDS = [
    "reversal", "refund", "cancelled", "canceled", "reversed", "return", "chargeback", "credit adjustment",
]


# ---------------------------------------------------------------- aliases


def first_alias(hints: DataFrame, aliases: DataFrame) -> DataFrame:
    """J4 alias_match, W6 first_alias_wins: lowest alias id whose text holds the hint.

    Case is ignored and ``_``/``%`` in a hint are wildcards.  ``hints`` has one column
    ``hint``; the result is (hint, alias_id, alias, alias_merchant_id).
    """
    listed = aliases.select(
        F.col("id").alias("alias_id"), "alias", F.col("merchant_id").alias("alias_merchant_id"),
        F.lower("alias").alias("text"),
    )
    best = F.min(F.struct("alias_id", "alias", "alias_merchant_id")).alias("best")
    h = hints.filter(F.col("hint") != "").select(F.lower("hint").alias("hint")).distinct()
    h = h.withColumn(
        "pattern",
        F.array_max(
            F.transform(
                F.split("hint", "[%_]+"), lambda p: F.struct(F.length(p).alias("size"), p.alias("piece"))
            )
        )["piece"],
    )
    # One alias per text is enough for literal hints, all are needed behind a wildcard check.
    firsts = listed.groupBy("text").agg(F.min(F.struct("alias_id", "alias", "alias_merchant_id")).alias("first"))
    found = contained(firsts, h).join(shuffled(firsts), "text").join(shuffled(h), "pattern")
    escaped = F.replace(F.col("hint"), F.lit("\\"), F.lit("\\\\"))
    with_literal = (
        found.filter(
            (F.col("hint") == F.col("pattern")) | F.like("text", F.concat(F.lit("%"), escaped, F.lit("%")))
        )
        .groupBy("hint")
        .agg(F.min("first").alias("best"))
    )
    # Hints made of wildcards only ask for a minimal alias length.
    by_length = (
        listed.groupBy(F.length("text").alias("size")).agg(best)
        .withColumn("size", F.explode(F.sequence(F.lit(0), F.col("size"))))
        .groupBy("size").agg(F.min("best").alias("best"))
    )
    only_wild = h.filter(F.col("pattern") == "").withColumn(
        "size", F.length(F.regexp_replace("hint", "[^_]", ""))
    )
    wild = only_wild.join(by_length, "size").select("hint", "best")
    return with_literal.select("hint", "best").unionByName(wild).select("hint", "best.*")


def match_merchants(ledger: DataFrame, aliases: DataFrame) -> DataFrame:
    """Keep a known merchant, else take the first alias that holds the merchant hint.

    ``ledger`` needs (id, merchant_id, merchant_hint); the result is
    (id, new_merchant_id, match_rule).
    """
    open_hint = F.when(F.col("merchant_id").isNull(), F.lower("merchant_hint"))
    rows = ledger.select("id", "merchant_id", open_hint.alias("hint"))
    found = first_alias(rows.select("hint"), aliases)
    rule = (
        F.when(F.col("merchant_id").isNotNull(), "existing")
        .when(F.col("alias_id").isNotNull(), F.concat(F.lit("alias:"), "alias"))
        .otherwise("no-match")
    )
    # rows without a hint get a key of their own, or they would all meet in one task
    rows = rows.withColumn("key", F.coalesce("hint", F.concat(F.lit("\u0001"), F.col("id").cast("string"))))
    return rows.join(shuffled(found.withColumnRenamed("hint", "key")), "key", "left").select(
        "id", F.coalesce("merchant_id", "alias_merchant_id").alias("new_merchant_id"), rule.alias("match_rule")
    )


# ---------------------------------------------------------------- reversals


def reversal_pairs(ledger: DataFrame, days: int = 7, cells_per_day: int = 24) -> DataFrame:
    """Income after an expense (or the reverse) of the same merchant and amount.

    The original is the lowest id that is at most ``days`` older, not linked yet, and of the
    opposite type; it may serve several reversals.  A missing merchant equals a missing one.

    No pairs are formed.  Time is cut into cells (hours); the span before a row is the end
    of one cell, whole cells, and the start of the row's own cell.  Running minima inside
    cells give the two ends, a frame over one row per cell the middle.  A busy merchant is
    thus spread over all its hours.
    """
    width = DAY_MICROS // cells_per_day
    reach = days * cells_per_day
    rows = (
        ledger.filter(F.col("reconciled_with_id").isNull() & F.col("transaction_type").isin("income", "expense"))
        .select(
            "id", "merchant_id", "amount", "transaction_type", "transaction_date",
            epoch_micros(F.col("transaction_date")).alias("at"),
            _says_reversal(F.col("original_description"), F.col("cleaned_description")).alias("says"),
        )
        .withColumn("cell", F.floor(F.col("at") / width))
        .withColumn("offset", F.col("at") - F.col("cell") * width)
    )
    spender = ["merchant_id", "amount"]
    me = F.struct("id", F.col("transaction_date").alias("date"))
    kinds = ("expense", "income")

    def lowest(name, window=None, allowed=None):
        out = []
        for kind in kinds:
            hit = F.col("transaction_type") == kind
            value = F.min(F.when(hit if allowed is None else hit & allowed, me))
            out.append((value.over(window) if window is not None else value).alias(f"{name}_{kind}"))
        return out

    def inside(order):
        w = Window.partitionBy(*spender, "cell").orderBy(order)
        return w.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    # the row's own cell, up to the row itself
    own = rows.select("*", *lowest("own", inside(F.asc("offset"))))
    # the cell where the span begins: its rows move up to the row's cell and are read backwards
    moved = rows.withColumn("cell", F.col("cell") + reach).withColumn("is_moved", F.lit(True))
    both = own.withColumn("is_moved", F.lit(False)).unionByName(moved, allowMissingColumns=True)
    ends = both.select("*", *lowest("begin", inside(F.desc("offset")), F.col("is_moved"))).filter(~F.col("is_moved"))
    # the whole cells in between
    between = Window.partitionBy(*spender).orderBy("cell").rangeBetween(1 - reach, -1)
    cells = rows.groupBy(*spender, "cell").agg(*lowest("cell"))
    cells = cells.select(*spender, "cell", *[F.min(f"cell_{k}").over(between).alias(f"mid_{k}") for k in kinds])
    same = [ends[c].eqNullSafe(cells[c]) for c in spender + ["cell"]]
    seen = ends.join(cells, same).select(ends["*"], *[f"mid_{k}" for k in kinds])

    def first(kind):
        return F.least(*[f"{part}_{kind}" for part in ("begin", "mid", "own")])

    opposite = F.when(F.col("transaction_type") == "income", first("expense")).otherwise(first("income"))
    hits = seen.withColumn("original", opposite).filter(F.col("original").isNotNull())
    reason = (
        F.when(~F.col("says"), "amount_match")
        .when(F.col("transaction_type") == "income", "expense_refund")
        .otherwise("income_clawback")
    )
    apart = F.floor((F.col("at") - epoch_micros(F.col("original.date"))) / DAY_MICROS)
    return hits.select(
        F.col("id").alias("reversal_id"),
        F.col("original.id").alias("original_id"),
        reason.alias("reason"),
        apart.cast("long").alias("days_apart"),
        F.col("transaction_date").alias("reversal_date"),
    )


def _says_reversal(*texts: Column) -> Column:
    return any_of([F.coalesce(F.lower(t).rlike("|".join(REVERSAL_KEYWORDS)), F.lit(False)) for t in texts])


def link_reversals(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reversals point to their originals and both are excluded from reports."""
    links = pairs.select(F.col("reversal_id").alias("id"), "original_id")
    originals = pairs.select(F.col("original_id").alias("id")).distinct().withColumn("is_original", F.lit(True))
    touched = F.col("original_id").isNotNull() | F.col("is_original").isNotNull()
    return (
        ledger.join(links, "id", "left")
        .join(originals, "id", "left")
        .withColumn("reconciled_with_id", F.coalesce("original_id", "reconciled_with_id"))
        .withColumn("is_excluded", F.col("is_excluded") | touched)
        .drop("original_id", "is_original")
    )


def reversal_notes(pairs: DataFrame) -> DataFrame:
    """D18 notes, one row each; a transaction's notes follow ``reversal_date, reversal_id``.

    They stay rows because one original may be reversed any number of times.
    """
    original = pairs.select(
        F.col("original_id").alias("transaction_id"), "reversal_date", "reversal_id",
        F.concat(F.lit("Reversed by transaction #"), F.col("reversal_id").cast("string")).alias("note"),
    )
    reversal = pairs.select(
        F.col("reversal_id").alias("transaction_id"), "reversal_date", "reversal_id",
        F.concat(F.lit("Reversal of transaction #"), F.col("original_id").cast("string")).alias("note"),
    )
    return original.unionByName(reversal)


# ---------------------------------------------------------------- reconciliation


def candidates(ledger: DataFrame) -> DataFrame:
    """Rows that take part, in one pass: (id, amount, day, kind), ``kind`` null on bank rows.

    The shared ledger offers settlements and expenses the user paid; the other side is every
    bank or card row that is still free.
    """
    paid = F.get_json_object("metadata_json", "$.raw.metadata.user_paid") == "true"
    shared = F.col("source_type") == "splitwise"
    kind = F.when(shared, F.when(F.col("is_payment"), "settlement").when(paid, "expense"))
    return (
        ledger.filter(~F.col("is_reconciled") & ~(shared & F.col("is_excluded")))
        .withColumn("kind", kind)
        .filter(~shared | F.col("kind").isNotNull())
        .select("id", "amount", epoch_day(F.col("transaction_date")).alias("day"), "kind")
    )


def reconcile_preview(ledger: DataFrame, tolerance: int = 2) -> DataFrame:
    """The lowest bank id of the same amount within the tolerance, for every shared row.

    The dry run consumes no bank row, so one may serve many.  Banks are condensed to the
    lowest id per amount and day, and a frame over the days of an amount finds the partner.
    """
    rows = candidates(ledger)
    near = Window.partitionBy("amount").orderBy("day").rangeBetween(-tolerance, tolerance)
    partner = (
        rows.groupBy("amount", "day")
        .agg(F.min(F.when(F.col("kind").isNull(), F.col("id"))).alias("lowest"), F.count("kind").alias("n_shared"))
        .withColumn("bank_id", F.min("lowest").over(near))
        .filter((F.col("n_shared") > 0) & F.col("bank_id").isNotNull())
        .select("amount", "day", "bank_id")
    )
    return rows.filter(F.col("kind").isNotNull()).join(partner, ["amount", "day"]).select(
        F.col("kind").alias("type"), F.col("id").alias("shared_id"), "bank_id"
    )


def reconcile_pairs(ledger: DataFrame, tolerance: int = 2, batch: int = 500_000) -> DataFrame:
    """One-to-one pairs; shared rows in id order take the first free bank row in id order.

    Rows only compete within an island: equal amount, and no gap between days wider than the
    tolerance.  Islands of up to ``batch`` shared rows, normally all, are matched in one go.
    The others advance in rounds of ``batch`` shared rows each.  A task never sees more bank
    rows per day than its shared rows could use, so its size is bounded however popular an
    amount is, and the result is the sequential one because ids are always taken in order.
    """
    rows = cut(candidates(ledger))
    cells = _cells(rows, tolerance)
    wide = cut(cells.filter(F.col("island_size") > batch).select("amount", "day", "island"))
    if wide.isEmpty():
        return _greedy(_offered(rows, cells), tolerance)
    narrow = cells.filter(F.col("island_size") <= batch)
    pairs = _greedy(_offered(rows, narrow), tolerance)
    rest = cut(rows.join(wide, ["amount", "day"]))
    while True:
        shared = rest.filter(F.col("kind").isNotNull())
        if shared.isEmpty():
            return pairs
        turn = cut(lowest(shared.withColumn("quota", F.lit(batch)), ["amount", "island"]))
        now = turn.unionByName(rest.filter(F.col("kind").isNull())).drop("island")
        found = cut(_greedy(_offered(now, _cells(now, tolerance)), tolerance))
        pairs = pairs.unionByName(found)
        done = turn.select("id").unionByName(found.select(F.col("bank_id").alias("id")))
        rest = cut(rest.join(done, "id", "left_anti"))


def _cells(rows: DataFrame, tolerance: int) -> DataFrame:
    """Amount and day with the island they belong to and the rows around them.

    One row per amount and day, so the windows over the days of an amount stay small.  Cells
    without a possible partner are left out.
    """
    order = Window.partitionBy("amount").orderBy("day")
    near = order.rangeBetween(-tolerance, tolerance)
    n_shared, n_bank = F.count("kind"), F.count("*") - F.count("kind")
    cells = (
        rows.groupBy("amount", "day")
        .agg(n_shared.alias("n_shared"), n_bank.alias("n_bank"))
        .withColumn("shared_near", F.sum("n_shared").over(near))
        .withColumn("bank_near", F.sum("n_bank").over(near))
        .filter(
            ((F.col("n_shared") > 0) & (F.col("bank_near") > 0)) | ((F.col("n_bank") > 0) & (F.col("shared_near") > 0))
        )
    )
    starts = F.coalesce(F.col("day") - F.lag("day").over(order) > tolerance, F.lit(False)).cast("int")
    numbered = cells.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order))
    size = F.sum("n_shared").over(Window.partitionBy("amount", "island"))
    return numbered.select(
        "amount", "day", "island", "shared_near", "bank_near", size.alias("island_size")
    )


def _offered(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Shared rows with a partner in reach, and the lowest bank rows they could use."""
    placed = rows.join(cells, ["amount", "day"])
    shared = placed.filter(F.col("kind").isNotNull() & (F.col("bank_near") > 0))
    bank = placed.filter(F.col("kind").isNull() & (F.col("shared_near") > 0))
    bank = lowest(bank.withColumn("quota", F.col("shared_near")), ["amount", "day"])
    columns = ["amount", "island", "day", "id", "kind"]
    return shared.select(*columns).unionByName(bank.select(*columns))


def _greedy(offered: DataFrame, tolerance: int) -> DataFrame:
    """The id-ordered assignment inside each island.

    Islands are streamed: sorted partitions bring the bank rows of an island, then its
    shared rows in id order.
    """
    side = F.col("kind").isNotNull().cast("int").alias("side")
    rows = offered.select((F.col("amount") * 100).cast("long").alias("cents"), "island", "day", "id", "kind", side)

    def assign(batches):
        island, banks, used = None, {}, {}
        for pdf in batches:
            out = []
            columns = [pdf[c].tolist() for c in ("cents", "island", "day", "id", "kind", "side")]
            for cents, number, day, row_id, kind, side in zip(*columns):
                if island != (cents, number):
                    island, banks, used = (cents, number), {}, {}
                if side == 0:
                    banks.setdefault(day, []).append(row_id)
                    continue
                free = [
                    (banks[d][used.get(d, 0)], d)
                    for d in range(day - tolerance, day + tolerance + 1)
                    if d in banks and used.get(d, 0) < len(banks[d])
                ]
                if free:
                    bank_id, bank_day = min(free)
                    used[bank_day] = used.get(bank_day, 0) + 1
                    out.append((kind, row_id, bank_id))
            yield pd.DataFrame(out, columns=["type", "shared_id", "bank_id"])

    return (
        rows.repartition("cents", "island")
        .sortWithinPartitions("cents", "island", "side", "id")
        .mapInPandas(assign, "type string, shared_id bigint, bank_id bigint")
    )


def reconcile_summary(pairs: DataFrame) -> DataFrame:
    """A10: number of pairs, in all and per type."""
    return pairs.agg(
        F.count("*").alias("total_pairs"),
        F.count_if(F.col("type") == "expense").alias("expense_pairs"),
        F.count_if(F.col("type") == "settlement").alias("settlement_pairs"),
    )


def reconcile_apply(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cross-link the pairs, carry the user's part to the bank row, exclude the shared row."""
    part = ledger.select(
        F.col("id").alias("shared_id"), F.coalesce("effective_amount", "amount").alias("own_part")
    )
    zero = F.lit(0).cast("decimal(12,2)")
    bank = pairs.join(part, "shared_id").select(
        F.col("bank_id").alias("id"),
        F.col("shared_id").alias("partner_id"),
        F.col("type").alias("pair_type"),
        F.lit(True).alias("as_bank"),
        F.when(F.col("type") == "settlement", zero).otherwise(F.col("own_part")).alias("own_part"),
    )
    shared = pairs.select(
        F.col("shared_id").alias("id"),
        F.col("bank_id").alias("partner_id"),
        F.col("type").alias("pair_type"),
        F.lit(False).alias("as_bank"),
        F.lit(None).cast("decimal(12,2)").alias("own_part"),
    )
    rows = ledger.join(bank.unionByName(shared), "id", "left")
    linked = F.col("partner_id").isNotNull()
    as_bank = F.coalesce("as_bank", F.lit(False))
    after = {
        "is_reconciled": F.col("is_reconciled") | linked,
        "reconciled_with_id": F.coalesce("partner_id", "reconciled_with_id"),
        "is_excluded": F.col("is_excluded") | (linked & ~as_bank),
        "effective_amount": F.when(as_bank, F.col("own_part")).otherwise(F.col("effective_amount")),
        "transaction_type": F.when(as_bank & (F.col("pair_type") == "settlement"), "payment").otherwise(
            F.col("transaction_type")
        ),
    }
    return rows.select(*[after.get(c, F.col(c)).alias(c) for c in ledger.columns])
