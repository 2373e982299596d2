"""Duplicate detection against a plain loop over rows."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from passbook.operators import dedup

DAY = dt.datetime(2026, 1, 15, 9, 30)
STORED = (
    "id long, transaction_date timestamp_ntz, amount decimal(12,2), transaction_type string, "
    "original_description string, external_id string, source_type string"
)
INCOMING = (
    "seq long, transaction_date timestamp_ntz, amount decimal(12,2), transaction_type string, "
    "original_description string, external_id string"
)


def loop(stored, incoming, source_type):
    """Rows in order against stored, then kept rows; the first match decides."""

    def norm(value):
        value = (value or "").strip()
        return (value.lstrip("0") or "0") if value else None

    blocks = {}
    for row in sorted(stored):
        key = (row[1].date(), row[2], row[3])
        blocks.setdefault(key, []).append([norm(row[5]), "".join(row[4].split()).upper(), "stored", row[0], row[6]])
    out = {}
    for row in sorted(incoming):
        known = blocks.setdefault((row[1].date(), row[2], row[3]), [])
        e, d = norm(row[5]), "".join(row[4].split()).upper()
        hit = None
        for k in known:
            if k[0] and e:
                if k[0] == e:
                    hit = k
                    break
                continue
            if k[1] == d or (len(k[1]) > 10 and len(d) > 10 and (d in k[1] or k[1] in d)):
                hit = k
                break
        if hit is None:
            known.append([e, d, "staged", row[0], source_type])
            out[row[0]] = ("new", None, None, False)
            continue
        upgrades = source_type == "bank_csv" and hit[4] != "bank_csv"
        out[row[0]] = ("duplicate", hit[2], hit[3], upgrades)
        if upgrades:
            hit[0], hit[1], hit[4] = e or hit[0], d, "bank_csv"
    return out


def sample(seed, n_blocks):
    """Rows of many small blocks, one per day, with texts that contain each other."""
    rng = random.Random(seed)
    stems = ["UPI PAYMENT SHOP", "UPI PAYMENT", "PAYMENT SHOP AB", "SHORT", "UPI  payment shop AB", "Payment Shop"]

    def row(i, day):
        text = rng.choice(stems) + rng.choice(["", "", " X", " REF 12"])
        ref = rng.choice([None, None, "", "0007", "7", "8", "009"])
        return (i, DAY + dt.timedelta(days=day), Decimal("10.00"), "expense", text, ref)

    stored, incoming = [], []
    for day in range(n_blocks):
        for _ in range(rng.randrange(7)):
            stored.append(row(len(stored) + 1, day) + (rng.choice(["bank_csv", "bank_pdf"]),))
        for _ in range(rng.randrange(1, 14)):
            incoming.append(row(1000 + len(incoming), day))
    return stored, incoming


@pytest.mark.parametrize("source_type", ["bank_csv", "bank_pdf"])
@pytest.mark.parametrize("max_block", [2000, 1])
def test_same_as_loop(spark, source_type, max_block):
    stored, incoming = sample(5, 60)
    got = dedup.fuzzy_dedup(
        spark.createDataFrame(stored, STORED), spark.createDataFrame(incoming, INCOMING), source_type, max_block
    ).collect()
    want = loop(stored, incoming, source_type)
    assert len(got) == len(want)
    kept = {r["seq"] for r in got if r["status"] == "new"}
    assert kept == {s for s, w in want.items() if w[0] == "new"}
    assert {(r["matched_id"], r["seq"]) for r in got if r["upgrades"]} == {(w[2], s) for s, w in want.items() if w[3]}


def test_external_ids_decide(spark):
    stored = spark.createDataFrame([], STORED)
    rows = [
        (1, DAY, Decimal("50.00"), "expense", "ATM WITHDRAWAL MAIN ROAD", "6102"),
        (2, DAY, Decimal("50.00"), "expense", "ATM WITHDRAWAL MAIN ROAD", "6103"),
        (3, DAY, Decimal("50.00"), "expense", "OTHER TEXT", "006102"),
    ]
    got = dedup.fuzzy_dedup(stored, spark.createDataFrame(rows, INCOMING), "bank_csv").collect()
    assert {r["seq"]: (r["status"], r["matched_id"]) for r in got} == {
        1: ("new", None), 2: ("new", None), 3: ("duplicate", 1)
    }


def test_upgrade_overwrites_lesser_source(spark):
    stored = spark.createDataFrame([(7, DAY, Decimal("9.00"), "expense", "CARD SHOP LONDON 12", None, "bank_pdf")], STORED)
    incoming = spark.createDataFrame([(1, DAY, Decimal("9.00"), "expense", "CARD SHOP LONDON", "42")], INCOMING)
    decisions = dedup.fuzzy_dedup(stored, incoming, "bank_csv")
    row = dedup.source_upgrades(decisions, incoming).collect()[0]
    assert (row["id"], row["original_description"], row["external_id"]) == (7, "CARD SHOP LONDON", "42")
