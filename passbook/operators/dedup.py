"""Duplicate detection across imports.

Two rows of the same day, amount and type are the same transaction if their
external ids agree, or, where one has none, if their descriptions are equal
without white space or one (of more than ten characters) contains the other.
Rows are taken in order; the first earlier row that matches decides, and rows
that are kept become candidates themselves.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import collapse, dedup_hash, external_id_norm, squash_upper
from passbook.operators.containment import contained
from passbook.operators.ranking import lowest
from passbook.storage import cut

BLOCK = ["day", "amount", "transaction_type"]
MIN_PIECE = 10
DECISION = "seq bigint, status string, matched_kind string, matched_id bigint, upgrades boolean"


def keyed(rows: DataFrame, order: str, *more: Column) -> DataFrame:
    """Block key, normalised id ``e`` and description ``d`` of every row."""
    return rows.select(
        F.to_date("transaction_date").alias("day"),
        "amount",
        "transaction_type",
        F.col(order).cast("long").alias(order),
        external_id_norm(F.col("external_id")).alias("e"),
        squash_upper(F.col("original_description")).alias("d"),
        *more,
    )


def neighbours(*texts: DataFrame) -> DataFrame:
    """(block, d, near): descriptions of a block that count as the same text."""
    every = texts[0].select(*BLOCK, "d")
    for more in texts[1:]:
        every = every.unionByName(more.select(*BLOCK, "d"))
    every = every.distinct()
    long = every.filter(F.length("d") > MIN_PIECE)
    inside = contained(
        long.withColumnRenamed("d", "text"), long.withColumnRenamed("d", "pattern"), BLOCK
    ).filter(F.col("text") != F.col("pattern"))
    down = inside.select(*BLOCK, F.col("text").alias("d"), F.col("pattern").alias("near"))
    up = inside.select(*BLOCK, F.col("pattern").alias("d"), F.col("text").alias("near"))
    return every.withColumn("near", F.col("d")).unionByName(down).unionByName(up)


def first_match(rows: DataFrame, others: DataFrame, near: DataFrame, value: str) -> DataFrame:
    """Adds the lowest ``value`` among the ``others`` that match a row, as ``first``.

    Others are condensed to one value per external id and per description before they meet
    the rows, so a block's pairs are never formed.
    """
    per_id = others.filter(F.col("e").isNotNull()).groupBy(*BLOCK, F.col("e").alias("id_key")).agg(
        F.min(value).alias("same_id")
    )
    per_text = others.groupBy(*BLOCK, F.col("d").alias("near")).agg(
        F.min(value).alias("any_text"), F.min(F.when(F.col("e").isNull(), F.col(value))).alias("open_text")
    )
    around = (
        near.join(per_text, BLOCK + ["near"])
        .groupBy(*BLOCK, "d")
        .agg(F.min("any_text").alias("any_text"), F.min("open_text").alias("open_text"))
    )
    by_text = F.when(F.col("e").isNull(), F.col("any_text")).otherwise(F.col("open_text"))
    # rows without external id are spread by their text; the mark keeps them from any id
    id_key = F.coalesce("e", F.concat(F.lit("\u0001"), "d"))
    return (
        rows.withColumn("id_key", id_key)
        .join(per_id, BLOCK + ["id_key"], "left")
        .join(around, BLOCK + ["d"], "left")
        .withColumn("first", F.least("same_id", by_text))
        .drop("id_key", "same_id", "any_text", "open_text")
    )


def dedup_candidates(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The first stored row every incoming row matches, looking at stored rows only."""
    new, old = keyed(incoming, "seq"), keyed(stored, "id")
    old = old.join(new.select(*BLOCK).distinct(), BLOCK, "left_semi")
    hits = first_match(new, old, neighbours(new, old), "id")
    return hits.filter(F.col("first").isNotNull()).select("seq", F.col("first").alias("stored_id"))


def fuzzy_dedup(
    stored: DataFrame, incoming: DataFrame, source_type: str, max_block: int = 2000
) -> DataFrame:
    """Decision for every incoming row of one import (X4: stored, then staged rows).

    Result: seq, status ('new' or 'duplicate'), matched_kind ('stored' or 'staged'),
    matched_id, and whether the match upgrades a stored row that came from a lesser source.

    Copies within the import collapse to their first row: a copy always meets the same end.
    Blocks with a single row need no work, blocks of up to ``max_block`` rows are streamed
    through tasks, and larger ones are settled by rounds of joins, so no block has to fit
    into a task.
    """
    is_csv = source_type == "bank_csv"
    new = keyed(incoming, "seq")
    first = new.groupBy(*BLOCK, "e", "d").agg(F.min("seq").alias("seq"))
    sizes = first.groupBy(*BLOCK).agg(F.count("*").alias("n_new"))
    upgradeable = (F.lit(is_csv) & (F.col("source_type") != "bank_csv")).alias("upgradeable")
    old = _useful_stored(keyed(stored, "id", upgradeable).join(sizes, BLOCK))
    blocks = cut(
        sizes.join(old.groupBy(*BLOCK).agg(F.count("*").alias("n_old")), BLOCK, "left").withColumn(
            "size", F.col("n_new") + F.coalesce("n_old", F.lit(0))
        ).select(*BLOCK, "size")
    )
    single = blocks.filter(F.col("size") == 1)
    small = blocks.filter((F.col("size") > 1) & (F.col("size") <= max_block))
    large = blocks.filter(F.col("size") > max_block).select(*BLOCK)
    decided = (
        first.join(single, BLOCK, "left_semi")
        .select(
            "seq",
            F.lit("new").alias("status"),
            F.lit(None).cast("string").alias("matched_kind"),
            F.lit(None).cast("bigint").alias("matched_id"),
            F.lit(False).alias("upgrades"),
        )
        .unionByName(_stream(old.join(small, BLOCK, "left_semi"), first.join(small, BLOCK, "left_semi")))
    )
    if not large.isEmpty():
        decided = decided.unionByName(
            _rounds(old.join(large, BLOCK, "left_semi"), first.join(large, BLOCK, "left_semi"))
        )
    return _with_copies(new, first, decided)


def _useful_stored(old: DataFrame) -> DataFrame:
    """Stored copies beyond those the block's incoming rows could upgrade never come first."""
    quota = F.when(F.col("upgradeable"), F.col("n_new")).otherwise(F.lit(1))
    kept = lowest(old.withColumn("quota", quota), BLOCK + ["e", "d", "upgradeable"])
    return kept.drop("n_new")


def _with_copies(new: DataFrame, first: DataFrame, decided: DataFrame) -> DataFrame:
    """Decisions of the first copies carried over to the later ones."""
    lead = first.withColumnRenamed("seq", "lead")
    same = [new[c].eqNullSafe(lead[c]) for c in BLOCK + ["e", "d"]]
    copies = new.join(lead, same).select(new["seq"], "lead")
    outcome = decided.withColumnRenamed("seq", "lead")
    rows = copies.join(outcome, "lead")
    is_lead = F.col("seq") == F.col("lead")
    is_new = F.col("status") == "new"
    return rows.select(
        "seq",
        F.when(is_lead, F.col("status")).otherwise("duplicate").alias("status"),
        F.when(~is_lead & is_new, "staged").otherwise(F.col("matched_kind")).alias("matched_kind"),
        F.when(~is_lead & is_new, F.col("lead")).otherwise(F.col("matched_id")).alias("matched_id"),
        (is_lead & F.col("upgrades")).alias("upgrades"),
    )


def _stream(old: DataFrame, new: DataFrame) -> DataFrame:
    """Small blocks, one after the other, in sorted partitions: stored rows, then incoming ones."""
    block = F.concat_ws("|", *[F.col(c).cast("string") for c in BLOCK]).alias("block")
    rows = old.select(block, F.lit(0).alias("side"), F.col("id").alias("pos"), "e", "d", "upgradeable").unionByName(
        new.select(block, F.lit(1).alias("side"), F.col("seq").alias("pos"), "e", "d", F.lit(False).alias("upgradeable"))
    )

    def same(a_id, a_text, b_id, b_text):
        if a_id and b_id:
            return a_id == b_id
        if a_text == b_text:
            return True
        long = len(a_text) > MIN_PIECE and len(b_text) > MIN_PIECE
        return long and (a_text in b_text or b_text in a_text)

    def decide(batches):
        current, known = None, []
        for pdf in batches:
            out = []
            columns = [pdf[c].tolist() for c in ("block", "side", "pos", "e", "d", "upgradeable")]
            for key, side, pos, e, d, upgradeable in zip(*columns):
                if key != current:
                    current, known = key, []
                if side == 0:
                    known.append([e, d, "stored", pos, upgradeable])
                    continue
                hit = next((k for k in known if same(k[0], k[1], e, d)), None)
                if hit is None:
                    known.append([e, d, "staged", pos, False])
                    out.append((pos, "new", None, None, False))
                    continue
                out.append((pos, "duplicate", hit[2], hit[3], hit[4]))
                if hit[4]:
                    hit[0], hit[1], hit[4] = e or hit[0], d, False
            frame = pd.DataFrame(out, columns=["seq", "status", "matched_kind", "matched_id", "upgrades"])
            yield frame.astype({"matched_id": "Int64"})

    return (
        rows.repartition("block").sortWithinPartitions("block", "side", "pos").mapInPandas(decide, DECISION)
    )


def _rounds(old: DataFrame, new: DataFrame) -> DataFrame:
    """Large blocks: every round settles the rows whose outcome no open earlier row can change.

    That is a row without an open earlier row it matches and, if its first candidate is a
    stored row an import can still upgrade, without an open earlier row matching that one.
    The first open row of a block always qualifies, so the rounds end, and the outcome is
    that of taking the rows in order.
    """
    near = cut(neighbours(old, new))
    # rank sorts candidates as they are scanned: stored by id, then staged by position
    cands = cut(
        old.select(
            *BLOCK, "e", "d", F.struct(F.lit(0).alias("side"), F.col("id").alias("pos")).alias("rank"), "upgradeable"
        )
    )
    open_rows = cut(new.select(*BLOCK, "e", "d", "seq"))
    settled = None
    while not open_rows.isEmpty():
        ranked = cands.withColumn("value", F.struct("rank", "upgradeable", F.col("e").alias("old_e")))
        view = first_match(open_rows, ranked, near, "value").withColumnRenamed("first", "hit")
        view = first_match(view, open_rows, near, "seq").withColumnRenamed("first", "earliest")
        claims = first_match(cands.filter("upgradeable"), open_rows, near, "seq").select(
            F.col("rank").alias("hit_rank"), F.col("first").alias("claim"), *BLOCK
        )
        view = view.withColumn("hit_rank", F.col("hit.rank")).join(claims, BLOCK + ["hit_rank"], "left")
        ready = (F.col("earliest") == F.col("seq")) & (
            ~F.coalesce("hit.upgradeable", F.lit(False)) | (F.col("claim") == F.col("seq"))
        )
        now = cut(view.filter(ready).drop("earliest", "claim"))
        upgrades = F.coalesce("hit.upgradeable", F.lit(False))
        step = now.select(
            "seq",
            F.when(F.col("hit").isNull(), "new").otherwise("duplicate").alias("status"),
            F.when(F.col("hit_rank.side") == 0, "stored").when(F.col("hit_rank.side") == 1, "staged").alias("matched_kind"),
            F.col("hit_rank.pos").alias("matched_id"),
            upgrades.alias("upgrades"),
        )
        settled = step if settled is None else settled.unionByName(step)
        kept = now.filter(F.col("hit").isNull()).select(
            *BLOCK, "e", "d", F.struct(F.lit(1).alias("side"), F.col("seq").alias("pos")).alias("rank"),
            F.lit(False).alias("upgradeable"),
        )
        upgraded = now.filter(upgrades).select(
            *BLOCK, F.coalesce("e", "hit.old_e").alias("e"), "d", F.col("hit_rank").alias("rank"),
            F.lit(False).alias("upgradeable"),
        )
        cands = cut(
            cands.join(upgraded.select(*BLOCK, "rank"), BLOCK + ["rank"], "left_anti")
            .unionByName(upgraded)
            .unionByName(kept)
        )
        open_rows = cut(open_rows.join(now.select("seq"), "seq", "left_anti"))
    return settled


def source_upgrades(decisions: DataFrame, incoming: DataFrame) -> DataFrame:
    """What a better source writes over the stored row it matched."""
    i = incoming.select(
        "seq", "original_description", "external_id",
        dedup_hash(
            F.col("transaction_date"), F.col("amount"), F.col("original_description"), F.col("transaction_type")
        ).alias("dedup_hash"),
    )
    return decisions.filter("upgrades").join(i, "seq").select(
        F.col("matched_id").alias("id"),
        "original_description",
        collapse(F.coalesce("original_description", F.lit(""))).alias("cleaned_description"),
        F.lit("bank_csv").alias("source_type"),
        F.nullif("external_id", F.lit("")).alias("external_id"),
        "dedup_hash",
    )


def apply_upgrades(stored: DataFrame, upgrades: DataFrame) -> DataFrame:
    """The stored rows with their upgrades; a missing external id keeps the old one."""
    changed = ["original_description", "cleaned_description", "source_type", "external_id", "dedup_hash"]
    changed = [c for c in changed if c in stored.columns and c in upgrades.columns]
    u = upgrades.select("id", *[F.col(c).alias(f"new_{c}") for c in changed])
    rows = stored.join(u, "id", "left")
    return rows.select(
        *[F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c) for c in stored.columns]
    )
