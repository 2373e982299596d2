"""Seeds, rule loading, exports and paging."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from passbook.operators import categorize, quality, reports, rules
from passbook.sources import csv_statements, detect, export, seed
from passbook.sources import statement_text as tx

LEDGER = (
    "id long, transaction_date timestamp_ntz, amount decimal(12,2), currency string, source_type string, transaction_type string, "
    "original_description string, cleaned_description string, merchant_id long, category_id long, is_category_auto boolean"
)


def rows(spark, n=6):
    data = [
        (i, dt.datetime(2026, 1 + i % 3, 1, 0, 0, 0, i), Decimal(i), "INR", "bank_csv", "expense", "UPI-SWIGGY", "", 1 if i % 2 else None, None, True)
        for i in range(1, n + 1)
    ]
    return spark.createDataFrame(data, LEDGER)


def dims(spark):
    merchants = spark.createDataFrame([(1, "Shop, Ltd")], "id long, name string")
    categories = spark.createDataFrame([(4, "Food")], "id long, name string")
    return merchants, categories


def test_export(spark, tmp_path):
    export.export_csv(rows(spark, 2), *dims(spark), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [
        ("1", "2026-02-01T00:00:00.000001", "1.00", "INR", "UPI-SWIGGY", "Shop, Ltd", None),
        ("2", "2026-03-01T00:00:00.000002", "2.00", "INR", "UPI-SWIGGY", None, None),
    ]


def test_ledger_by_month(spark, tmp_path):
    export.write_ledger(rows(spark), str(tmp_path / "ledger"))
    back = spark.read.parquet(str(tmp_path / "ledger"))
    assert back.filter("month = '2026-02'").count() == 2


def test_pages(spark):
    ledger = rows(spark, 30)
    ordered = [r["id"] for r in reports.ledger_sort(ledger).collect()]
    page = reports.paginate(reports.ledger_sort(ledger), 2, 10).collect()
    assert [r["id"] for r in page] == ordered[10:20]
    first = reports.paginate(reports.ledger_sort(ledger), 1, 10).collect()[-1]
    behind = reports.page_after(ledger, str(first["transaction_date"]), first["id"], 10).collect()
    assert [r["id"] for r in behind] == ordered[10:20]
    with pytest.raises(ValueError):
        reports.paginate(ledger, 1, 500)


def test_load_rules(spark):
    rows = [(i, "a", json.dumps({"rules": []})) for i in range(5000)]
    table = spark.createDataFrame(rows, "id long, name string, conditions string")
    assert sorted(r["id"] for r in rules.load_rules(table)) == list(range(5000))


def test_odd_rule_values(spark):
    """Patterns only Python knows match nothing; bounds of any size compare."""
    df = spark.createDataFrame([("ab", 5)], "t string, n int").withColumn("n", F.col("n").cast("decimal(12,2)"))
    row = df.select(
        rules.regex_condition(F.col("t"), "(a)?(?(1)b|c)", True).alias("odd"),
        rules.regex_condition(F.col("t"), "^a", True).alias("plain"),
        rules.at_least(F.col("n"), 1e30).alias("huge"),
        rules.at_most(F.col("n"), 1e30).alias("below"),
        rules.at_least(F.col("n"), 5).alias("same"),
    ).first()
    assert tuple(row) == (False, True, False, True, True)


def test_rows_without_merchant_meet_nobody(spark):
    ledger = spark.createDataFrame([(i, None if i else -5, None) for i in range(50)], "id long, merchant_id long, category_id long")
    merchants = spark.createDataFrame([(i, f"m{i}") for i in range(-60, 0)], "id long, name string")
    named = reports.with_names(ledger, merchants, merchants).collect()
    assert {r["id"]: r["merchant_name"] for r in named if r["merchant_name"]} == {0: "m-5"}


def test_quoted_cell_of_any_length(spark):
    cell = "x," * 50_000 + '""y'
    line = spark.createDataFrame([(f'1,"{cell}",2',)], "line string")
    got = line.select(csv_statements.cells_of(F.col("line")).alias("c")).first()["c"]
    assert got == ["1", cell.replace('""', '"'), "2"]


def test_seed_twice(spark):
    wanted = seed.category_tree_frame(spark).withColumn("id", F.monotonically_increasing_id() + 100)
    empty = spark.createDataFrame([(1, "Travel", None)], "id long, name string, parent_id long")
    once = seed.seed_dimension(empty, wanted)
    again = seed.seed_dimension(once, wanted.withColumn("id", F.col("id") + 10**12))
    assert once.count() == len({r["name"] for r in wanted.collect()})
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in again.collect()}
    hotels = once.filter("name = 'Hotels'").collect()[0]
    assert hotels["parent_id"] == 1


def test_starter_rules(spark):
    done = categorize.rule_batch(rows(spark, 1), seed.STARTER_RULES).collect()[0]
    # the transfer rule comes later in the list and overwrites the delivery one
    assert (done["batch_rule"], done["category_id"]) == ("UPI Transfer", 34)


def test_first_method(spark):
    schema = "file string, description string"
    tables = spark.createDataFrame([("a", "table")], schema)
    words = spark.createDataFrame([("a", "word"), ("b", "word")], schema)
    lines = spark.createDataFrame([("a", "line"), ("b", "line"), ("c", "line")], schema)
    got = {(r["file"], r["description"]) for r in tx.first_method(tables, words, lines).collect()}
    assert got == {("a", "table"), ("b", "word"), ("c", "line")}


def test_catalogue_and_values(spark):
    assert detect.catalogue(spark).count() == len(detect.ORDER)
    odd = rows(spark, 3).withColumn("transaction_type", F.when(F.col("id") == 2, "gift").otherwise(F.col("transaction_type")))
    assert [r["id"] for r in quality.unknown_values(odd).collect()] == [2]
