"""Reconciliation, reversals, aliases and contained texts against plain loops."""

import datetime as dt
import json
import random
from decimal import Decimal


from passbook.operators import matching as m
from passbook.operators.containment import contained

LEDGER = (
    "id long, source_type string, transaction_date timestamp_ntz, amount decimal(12,2), effective_amount decimal(12,2), "
    "transaction_type string, is_payment boolean, is_reconciled boolean, is_excluded boolean, reconciled_with_id long, "
    "merchant_id long, original_description string, cleaned_description string, metadata_json string"
)


def row(i, source, day, amount, kind="expense", pay=False, paid=True, merchant=None, text="X", hour=0):
    meta = json.dumps({"raw": {"metadata": {"user_paid": paid}}})
    ts = dt.datetime(2026, 1, 1, hour) + dt.timedelta(days=day)
    return (i, source, ts, Decimal(amount), None, kind, pay, False, False, None, merchant, text, text, meta)


def greedy(rows, tolerance=2):
    shared = sorted(r for r in rows if r[1] == "splitwise")
    bank = sorted(r for r in rows if r[1] != "splitwise")
    used, out = set(), set()
    for s in shared:
        if not (s[6] or json.loads(s[13])["raw"]["metadata"]["user_paid"]):
            continue
        for b in bank:
            if b[0] not in used and b[3] == s[3] and abs((b[2].date() - s[2].date()).days) <= tolerance:
                used.add(b[0])
                out.add(("settlement" if s[6] else "expense", s[0], b[0]))
                break
    return out


def sample(seed, n, days, amounts):
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(1, 10 * n), n):
        source = rng.choice(["splitwise", "bank_csv"])
        rows.append(
            row(i, source, rng.randrange(days), rng.choice(amounts), pay=source == "splitwise" and rng.random() < 0.3,
                paid=rng.random() < 0.8, hour=rng.randrange(24))
        )
    return rows


def test_reconcile_same_as_loop(spark):
    rows = sample(1, 300, 40, ["10.00", "20.00", "30.00"])
    df = spark.createDataFrame(rows, LEDGER)
    got = {tuple(r) for r in m.reconcile_pairs(df).collect()}
    assert got == greedy(rows)


def test_reconcile_in_rounds(spark):
    rows = sample(2, 60, 12, ["10.00"])
    df = spark.createDataFrame(rows, LEDGER)
    got = [tuple(r) for r in m.reconcile_pairs(df, batch=9).collect()]
    assert len(got) == len(set(got))
    assert set(got) == greedy(rows)


def test_reconcile_tolerance_and_apply(spark):
    rows = [row(1, "splitwise", 0, "1000.00"), row(2, "bank_csv", 2, "1000.00"), row(3, "splitwise", 0, "5.00"), row(4, "bank_csv", 5, "5.00")]
    df = spark.createDataFrame(rows, LEDGER)
    pairs = m.reconcile_pairs(df)
    assert [tuple(r) for r in pairs.collect()] == [("expense", 1, 2)]
    done = {r["id"]: r for r in m.reconcile_apply(df, pairs).collect()}
    assert done[2]["effective_amount"] == Decimal("1000.00") and done[2]["is_reconciled"] and not done[2]["is_excluded"]
    assert done[1]["is_excluded"] and done[1]["reconciled_with_id"] == 2
    assert not done[3]["is_reconciled"]


def test_preview_does_not_consume(spark):
    rows = [row(1, "splitwise", 0, "7.00"), row(2, "splitwise", 1, "7.00"), row(9, "bank_csv", 1, "7.00")]
    got = {tuple(r) for r in m.reconcile_preview(spark.createDataFrame(rows, LEDGER)).collect()}
    assert got == {("expense", 1, 9), ("expense", 2, 9)}


def test_reversals_same_as_loop(spark):
    rng = random.Random(4)
    rows = [
        row(i, "bank_csv", rng.randrange(30), rng.choice(["5.00", "6.00"]), rng.choice(["expense", "income", "payment"]),
            merchant=rng.choice([None, 1, 2]), text=rng.choice(["SHOP", "Refund SHOP"]), hour=rng.randrange(3))
        for i in range(200)
    ]
    week = dt.timedelta(days=7)
    want = set()
    for t in rows:
        if t[5] not in ("income", "expense"):
            continue
        hits = [
            o for o in rows
            if o[10] == t[10] and o[3] == t[3] and o[5] in ("income", "expense") and o[5] != t[5] and t[2] - week <= o[2] <= t[2]
        ]
        if hits:
            o = min(hits)
            says = "refund" in t[11].lower()
            reason = ("expense_refund" if t[5] == "income" else "income_clawback") if says else "amount_match"
            want.add((t[0], o[0], reason, (t[2] - o[2]).days))
    got = m.reversal_pairs(spark.createDataFrame(rows, LEDGER)).drop("reversal_date").collect()
    assert {tuple(r) for r in got} == want


def test_first_alias(spark):
    aliases = spark.createDataFrame(
        [(1, 10, "Amazon Pay"), (2, 20, "amazon_in"), (3, 30, "Zomato"), (4, 40, "x")], "id long, merchant_id long, alias string"
    )
    hints = ["AMAZON", "amazon_", "zom", "a_a", "nothing", "_____", "___________", "%", "n_i"]
    got = m.first_alias(spark.createDataFrame([(h,) for h in hints], "hint string"), aliases).collect()
    assert {r["hint"]: r["alias_id"] for r in got} == {
        "amazon": 1, "amazon_": 1, "zom": 3, "a_a": 1, "_____": 1, "%": 1, "n_i": 2
    }


def test_contained_finds_every_piece(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    patterns = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    got = contained(
        spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    )
    assert {tuple(r) for r in got.select("text", "pattern").collect()} == {(t, p) for t in texts for p in patterns if p in t}
