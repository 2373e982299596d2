"""The cases of a shared-expense import."""

from decimal import Decimal

from passbook.operators import shared as sh

RECORDS = (
    "expense_id long, line_no long, transaction_date timestamp_ntz, amount decimal(12,2), transaction_type string, currency string, "
    "original_description string, cleaned_description string, shared_group_id long, is_payment boolean, user_share decimal(12,2), "
    "user_paid boolean, repayments array<struct<`from`:long,`to`:long,amount:string>>"
)


def record(spark, *rows):
    import datetime as dt

    when = dt.datetime(2026, 1, 1)
    return spark.createDataFrame(
        [
            (i, n, when, Decimal(amount), kind, "INR", "Dinner", "Dinner", 1, kind == "payment", None if share is None else Decimal(share), paid,
             [(2, 1, "5.00"), (3, 1, "5.00")])
            for n, (i, amount, kind, share, paid) in enumerate(rows)
        ],
        RECORDS,
    )


def test_scenarios(spark):
    rows = record(
        spark, (1, "1000", "expense", "250", True), (2, "1000", "expense", "250", False), (3, "500", "payment", None, False),
        (4, "1000", "expense", "0", False), (5, "80", "expense", None, True),
    )
    got = {r["expense_id"]: (r["amount"], r["effective_amount"], r["is_provisional"]) for r in sh.share_scenario(rows).collect()}
    assert got == {1: (1000, 250, False), 2: (250, 250, True), 3: (500, 0, False), 5: (80, 80, False)}


def test_import_again(spark):
    rows = sh.share_scenario(record(spark, (1, "1000", "expense", "333.33", True), (2, "50", "expense", "5", True)))
    stored = spark.createDataFrame([(1, Decimal("250.00")), (2, Decimal("5.00"))], "expense_id long, effective_amount decimal(12,2)")
    actions = sh.existing_expense(rows, stored)
    assert tuple(sh.import_counts(actions).collect()[0]) == (0, 1, 0)
    assert [tuple(r) for r in sh.updated_parts(actions).collect()] == [(1, Decimal("333.33"))]


def test_same_id_twice_in_one_import(spark):
    rows = sh.share_scenario(record(spark, (1, "100", "expense", "10", True), (1, "100", "expense", "20", True), (None, "7", "expense", "7", True)))
    stored = spark.createDataFrame([], "expense_id long, effective_amount decimal(12,2)")
    actions = sh.existing_expense(rows, stored)
    assert tuple(sh.import_counts(actions).collect()[0]) == (2, 1, 0)
    got = {r["expense_id"]: r["effective_amount"] for r in sh.created_rows(actions).collect()}
    assert got == {1: Decimal("20.00"), None: Decimal("7.00")}


def test_splits_need_both_persons(spark):
    rows = sh.share_scenario(record(spark, (1, "100", "expense", "10", True)))
    stored = spark.createDataFrame([], "expense_id long, effective_amount decimal(12,2)")
    persons = spark.createDataFrame([(1,), (2,)], "person_id long")
    splits = sh.resolve_parties(sh.existing_expense(rows, stored), persons).collect()
    assert [(r["from_person_id"], r["to_person_id"], r["amount"]) for r in splits] == [(2, 1, Decimal("5.00"))]


def test_person_merchants(spark):
    persons = spark.createDataFrame(
        [(1, "Me", ""), (2, "Al", "B"), (3, "Cy", None), (4, "Cy", ""), (5, "Di", "E")], "person_id long, first_name string, last_name string"
    )
    merchants = spark.createDataFrame(
        [(10, "x", "person", 2), (11, "Di E", "person", None), (12, "Cy", "business", None)],
        "id long, name string, type string, shared_person_id long",
    )
    matches = sh.person_merchant_match(persons, merchants, 1)
    assert {r["person_id"]: (r["merchant_id"], r["found_by"]) for r in matches.collect()} == {
        2: (10, "link"), 3: (None, "new"), 4: (None, "new"), 5: (11, "name")
    }
    assert [(r["name"], r["shared_person_id"]) for r in sh.new_person_merchants(matches).collect()] == [("Cy", 4)]
    assert {r["id"]: r["shared_person_id"] for r in sh.relink_merchants(merchants, matches).collect()} == {10: 2, 11: 5, 12: None}
