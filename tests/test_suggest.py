"""Token similarity, the greedy merge and the suggestions built on them."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from passbook.functions.similarity import indel_ratio
from passbook.functions.text import merchant_token
from passbook.operators import suggest


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def alike(a, b):
    total = len(a) + len(b)
    return (total - 2 * lcs(a, b)) * 5 <= total


def vocabulary(seed, n, alphabet):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 11))) for _ in range(n)}
    for w in list(words):
        at = rng.randrange(len(w))
        words.add(w[:at] + rng.choice(alphabet) + w[at + 1 :])
        words.add(w[:at] + rng.choice(alphabet) + w[at:])
    return sorted(words)


def test_indel_ratio(spark):
    rows = [("UBER", "UBERS"), ("AMAZON", "AMAZOM"), ("ABC", "XYZ"), ("SWIGGY", "SWIGGY"), ("ABCD", "DCBA")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", indel_ratio(F.col("a"), F.col("b")).alias("r"))
    for r in got.collect():
        want = 200 * lcs(r["a"], r["b"]) / (len(r["a"]) + len(r["b"]))
        assert abs(r["r"] - want) < 1e-9


def test_similar_pairs_miss_nothing(spark):
    words = vocabulary(3, 120, "ABCD")
    df = spark.createDataFrame([(w,) for w in words], "token string")
    got = {(r["a"], r["b"]) for r in suggest.similar_pairs(df).collect()}
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if alike(a, b)}
    assert got == want


def test_leaders_same_as_loop(spark):
    rng = random.Random(11)
    words = vocabulary(7, 80, "ABCDE")
    groups = [(w, rng.randrange(1, 9), i) for i, w in enumerate(words)]
    df = spark.createDataFrame(groups, "token string, n long, seen long")
    df = df.withColumn("rank", F.struct((-F.col("n")).alias("size"), "seen"))
    got = {r["token"]: r["leader"] for r in suggest.token_leaders(df).collect()}
    want, leaders = {}, []
    for w, _, _ in sorted(groups, key=lambda g: (-g[1], g[2])):
        want[w] = next((x for x in leaders if alike(w, x)), w)
        if want[w] == w:
            leaders.append(w)
    assert got == want


def ledger_of(spark, rows):
    data = [
        (i, dt.datetime(2026, 1, 20) - dt.timedelta(days=i), Decimal(a), k, o, c, None, None)
        for i, (a, k, o, c) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "id long, transaction_date timestamp_ntz, amount decimal(12,2), transaction_type string, "
        "original_description string, cleaned_description string, merchant_id long, category_id long",
    )


def test_token_table(spark):
    cases = {
        "UPI-SWIGGY BANGALORE": "SWIGGY", "IMPS-AMAZON PAY INDIA": "AMAZON", "NEFT-ZOMATO LIMITED": "ZOMATO",
        "THE COFFEE SHOP": "COFFEE", "TO STARBUCKS": "STARBUCKS", "NETFLIX SUBSCRIPTION": "NETFLIX",
        "UBER TRIP": "UBER", "": "", "ABC": "ABC",
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string").select("d", merchant_token(F.col("d")).alias("t"))
    assert {r["d"]: r["t"] for r in df.collect()} == cases


def test_suggestions(spark):
    rows = [
        ("250.00", "expense", "UPI-SWIGGY BANGALORE ORDER1", "SWIGGY BANGALORE ORDER1"),
        ("300.00", "expense", "UPI-SWIGGY BANGALORE ORDER2", "SWIGGY BANGALORE ORDER2"),
        ("400.00", "expense", "UPI-SWIGGY BANGALORE ORDER3", "SWIGGY BANGALORE ORDER3"),
        ("500.00", "expense", "AMAZON INDIA", "AMAZON INDIA"),
        ("600.00", "income", "AMAZOM INDIA", "AMAZOM INDIA"),
        ("700.00", "expense", "AMAZON INDIA", ""),
        ("10.00", "expense", "PAYMENT ONE", "PAYMENT ONE"),
        ("10.00", "expense", "PAYMENT TWO", "PAYMENT TWO"),
        ("10.00", "expense", "PAYMENT TWO", "PAYMENT TWO"),
        ("10.00", "expense", "123456 X", "123456 X"),
    ]
    got = {r["pattern"]: r for r in suggest.suggestions(ledger_of(spark, rows)).collect()}
    assert set(got) == {"SWIGGY", "AMAZON"}
    swiggy, amazon = got["SWIGGY"], got["AMAZON"]
    assert (swiggy["transaction_count"], swiggy["total_amount"]) == (3, 950.0)
    assert abs(swiggy["avg_amount"] - 316.67) < 0.01
    assert len(swiggy["sample_descriptions"]) == 3
    assert (amazon["transaction_count"], amazon["total_amount"]) == (3, 600.0)
    assert amazon["sample_descriptions"] == ["AMAZON INDIA", "AMAZOM INDIA"]


def test_score_beats_count(spark):
    rows = [("20000.00", "expense", "RENT MARCH", "RENT MARCH")] * 3 + [("100.00", "expense", "COFFEE", "COFFEE")] * 5
    got = suggest.suggestions(ledger_of(spark, rows)).collect()
    assert [(r["pattern"], round(r["score"], 4)) for r in got] == [("RENT", 25.8), ("COFFEE", 3.2)]
