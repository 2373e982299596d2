"""Running balances against a plain walk through the rows."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest

from passbook.operators import timeline as tl

LEDGER = (
    "id long, account long, source_type string, transaction_date timestamp_ntz, amount decimal(12,2), transaction_type string, "
    "merchant_id long, metadata_json string"
)


def walk(rows, backward):
    """Balances of one account; rows are in order."""
    known = [(i, r[1]) for i, r in enumerate(rows) if r[1] is not None]
    out = [None] * len(rows)
    if not known:
        return out
    balance = known[0][1]
    for i in range(known[0][0], -1, -1):
        out[i] = balance
        if i:
            # going down one row undoes the row just left; the compatible form undoes the one arrived at
            balance -= rows[i][0] if backward == "correct" else rows[i - 1][0]
    for i in range(known[0][0] + 1, len(rows)):
        balance = rows[i][1] if rows[i][1] is not None else out[i - 1] + rows[i][0]
        out[i] = balance
    return out


@pytest.mark.parametrize("backward", ["correct", "compat"])
def test_same_as_walk(spark, backward):
    rng = random.Random(6)
    data, want = [], {}
    for account in range(4):
        rows = []
        for _ in range(80):
            ts = dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(200), minutes=rng.randrange(2))
            kind = rng.choice(["income", "expense", "payment"])
            known = rng.randrange(1000) if account and rng.random() < 0.08 else None
            rows.append((ts, len(data), Decimal(rng.randrange(100)), kind, known))
            meta = {"raw": {"metadata": {"closing_balance": f"{known:,}.00"}}} if known is not None else {}
            data.append((rows[-1][1], account, "bank_csv", ts, rows[-1][2], kind, None, json.dumps(meta)))
        rows.sort()
        balances = walk([(a if k == "income" else -a, None if b is None else Decimal(b)) for _, _, a, k, b in rows], backward)
        want.update({r[1]: b for r, b in zip(rows, balances)})
    got = tl.running_balance(spark.createDataFrame(data, LEDGER), backward=backward).collect()
    assert {r["id"]: r["balance"] for r in got} == want


def test_days(spark):
    def row(i, day, amount, kind, known=None):
        meta = {"raw": {"metadata": {"closing_balance": known}}} if known else {}
        return (i, 1, "bank_csv", dt.datetime(2026, 1, day), Decimal(amount), kind, None, json.dumps(meta))

    rows = [row(1, 1, "10", "expense", "1,000.00"), row(2, 1, "50", "income"), row(3, 3, "30", "expense")]
    closes = tl.daily_close(tl.running_balance(spark.createDataFrame(rows, LEDGER)))
    got = [(r["day"].day, r["balance"], r["change"]) for r in tl.day_change(closes).orderBy("day").collect()]
    assert got == [(1, Decimal("1050.00"), 0), (3, Decimal("1020.00"), Decimal("-30.00"))]
    summary = tl.timeline_summary(closes).collect()[0]
    assert (summary["min_balance"], summary["max_balance"], summary["avg_balance"], summary["change"], summary["total_days"]) == (
        1020.0, 1050.0, 1035.0, -30.0, 2
    )
