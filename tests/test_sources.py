"""Statement sources on literal lines, cells, words and small files."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from passbook.functions import text as t
from passbook.operators import quality as ql
from passbook.sources import csv_statements as cs
from passbook.sources import detect, manifest, shared_backup
from passbook.sources import statement_tables as st
from passbook.sources import statement_text as tx

SAMPLE = """DATE & TIME TRANSACTION DESCRIPTION REWARDS AMOUNT PI
JOHN DOE
BPPY CC PAYMENT BD000000TESTABC001 (Ref#
22/12/2025| 13:33 + C 1,000.00 l
ST000000000000000001)
23/12/2025| 15:48 EMI TITAN COMPANY LIMITEDCHENNAI + 8840 C 2,65,250.00 l
01/01/2026| 23:02 FNP E RETAIL   PRIVATE LIBANGALORE + 20 C 738 l
17/08/2024 22:01:47 M S SMART BELLY FOODS CHENNAI 20 735.00
01/01/2026| 23:02 SOME TRANSACTION C 0.00 l
99/01/2026| 23:02 BAD DATE C 1.00 l"""


def statements(spark, *texts):
    return spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(texts)], "file string, text string")


def test_card_a(spark):
    parsed = tx.card_a_lines(tx.statement_lines(statements(spark, SAMPLE)))
    got = [(r["line_no"], r["day"], r["amount"], r["description"], r["format"]) for r in tx.accepted(parsed).orderBy("line_no").collect()]
    assert got == [
        (4, dt.date(2025, 12, 22), Decimal("1000.00"), "BPPY CC PAYMENT BD000000TESTABC001", "new"),
        (6, dt.date(2025, 12, 23), Decimal("265250.00"), "EMI TITAN COMPANY LIMITEDCHENNAI", "new"),
        (7, dt.date(2026, 1, 1), Decimal("738.00"), "FNP E RETAIL PRIVATE LIBANGALORE", "new"),
        (8, dt.date(2024, 8, 17), Decimal("735.00"), "M S SMART BELLY FOODS CHENNAI 20", "old"),
    ]
    assert [tuple(r) for r in tx.rejects(parsed).collect()] == [("f0", 10, "bad date")]


def test_look_back_across_spans(spark, monkeypatch):
    def shown(rows):
        return {tuple(r) for r in rows.select("file", "line_no", F.to_json("before")).collect()}

    lines = tx.statement_lines(statements(spark, SAMPLE, "one", "one\ntwo\nthree"))
    bare = lines.drop("before")
    assert lines.count() == 14
    assert shown(tx.with_previous_lines(bare)) == shown(lines)
    monkeypatch.setattr(tx, "SPAN", 4)
    assert shown(tx.with_previous_lines(bare)) == shown(lines)


def test_card_b_and_net_total(spark):
    text = "\n".join(
        ["STATEMENT SUMMARY", "Total Amount due", "`800.00 = + + -", "19/11/2025 12366165854 MERCHANT ONE IN 1,000.00",
         "20/11/2025 12366165855 PAYMENT RECEIVED IN 200.00 CR", "21/11/2025 1 ZERO IN 0.00"]
    )
    s = statements(spark, text)
    rows = tx.accepted(tx.card_b_lines(tx.statement_lines(s)))
    got = {(r["external_id"], r["description"], r["transaction_type"], r["country_code"]) for r in rows.collect()}
    assert got == {("12366165854", "MERCHANT ONE", "expense", "IN"), ("12366165855", "PAYMENT RECEIVED", "income", "IN")}
    total = ql.control_totals(rows, s.select("file", tx.amount_due(F.col("text")).alias("expected_total")), net=True)
    assert [(r["actual_total"], r["matches"]) for r in total.collect()] == [(Decimal("800.00"), True)]
    assert ql.control_total_gate(rows, total).count() == 2


def test_no_printed_total_gives_no_verdict(spark):
    s = statements(spark, "19/11/2025 12366165854 MERCHANT ONE IN 1,000.00")
    rows = tx.accepted(tx.card_b_lines(tx.statement_lines(s)))
    total = ql.control_totals(rows, s.select("file", tx.amount_due(F.col("text")).alias("expected_total")), net=True)
    assert total.collect()[0]["matches"] is None
    assert ql.control_total_gate(rows, total).count() == 1


def test_header_fields(spark):
    s = statements(spark, "Credit Card No: 4111 XXXX XXXX 0002\nStatement Date 18/12/2025\nCust ID : 123\nA/c No: 50101234567890")
    text = F.col("text")
    got = s.select(tx.card_number(text), tx.statement_date(text), tx.customer_id(text), tx.account_number(text)).collect()[0]
    assert tuple(got) == ("4111XXXXXXXX0002", dt.date(2025, 12, 18), "123", "5010XXXXXX7890")


def test_filenames(spark):
    names = ["1234XXXXXXXXXX56_18-01-2026_449.pdf", "1234XXXXXXXX5678_99_Retail_Coral_NORM.pdf", "invalid_filename.pdf",
             "Acct_Statement_XXXXXXXX1234_02.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    fields = tx.filename_fields(F.col("n"))
    got = {r["n"]: r for r in df.select("n", *[c.alias(k) for k, c in fields.items()]).collect()}
    assert got[names[0]]["card_number"] == "1234XXXXXXXXXX56" and got[names[0]]["statement_date"] == dt.date(2026, 1, 18)
    assert (got[names[1]]["reference"], got[names[1]]["card_type"]) == ("99", "Coral")
    assert all(got[names[2]][k] is None for k in fields)
    assert got[names[3]]["account_number"] == "XXXXXXXX1234"


def test_detection(spark):
    card = "Diners Black Credit Card Statement\nHDFC Bank Credit Cards GSTIN\nCredit Card No. 1\nStatement Date 18 Dec\nBilling Period :"
    bank = "HDFC BANK LIMITED\nAccount Branch : A\nCust ID : 1\nAccount Number : 5\nDate Narration Withdrawal Amount Deposit"
    legacy = ("Credit Card Statement HDFC Bank Credit Cards\nStatement for HDFC Bank Credit Card\nDate:18\nStatement Card No: 5\n"
              "Payment Due Date Total Dues Minimum Amount Due")
    rows = [("a.pdf", card), ("b.pdf", bank), ("c.pdf", legacy), ("d.pdf", "ICICI Bank STATEMENT DATE PAYMENT DUE DATE Total Amount due"),
            ("e.csv", card), ("f.pdf", "nothing"), ("1234XXXXXXXX5678_9_Retail_Coral_NORM.pdf", "icici statement date")]
    got = detect.detect_source(spark.createDataFrame(rows, "filename string, text string")).collect()
    assert [r["profile"] for r in got] == [
        "hdfc_credit_card", "hdfc_bank_pdf", "hdfc_credit_card_legacy", "icici_credit_card", "hdfc_bank_csv", None, "icici_credit_card"
    ]


def test_csv_file(spark, tmp_path):
    (tmp_path / "Acct_Statement_XXXXXXXX1234_1.csv").write_text(
        "﻿\n  \nDate,Narration,Value Dat,Debit Amount,Credit Amount,Chq/Ref Number,Closing Balance\n"
        '01/02/24,PAY, TO, SHOP,01/02/24,"1,250.50",,000123,"9,000.00"\n'
        "\n"
        "02/02/24,SHORT,02/02/24,,10.00,5\n"
        "03/02/24,REVERSED,03/02/24,-20.00,,6,1.00\n"
        "04/02/24,CHARGED,04/02/24,,-30.00,7,1.00\n"
        "05/02/24,ZERO,05/02/24,0.00,,8,1.00\n"
        "2024-02-06,BAD DATE,x,5.00,,9,1.00\n"
        "07/02/24,BAD AMOUNT,x,five,,9,1.00\n",
        encoding="utf-8",
    )
    records, rejected = cs.read_statements(spark, str(tmp_path), "hdfc_bank")
    got = [(r["line_no"], r["day"].isoformat(), r["amount"], r["description"], r["transaction_type"], r["external_id"], r["closing_balance"])
           for r in records.orderBy("line_no").collect()]
    assert got == [
        (1, "2024-02-01", Decimal("1250.50"), "PAY,  TO,  SHOP", "expense", "000123", "9,000.00"),
        (2, "2024-02-02", Decimal("10.00"), "SHORT", "income", "5", None),
        (3, "2024-02-03", Decimal("20.00"), "REVERSED", "income", "6", "1.00"),
        (4, "2024-02-04", Decimal("30.00"), "CHARGED", "expense", "7", "1.00"),
    ]
    assert [(r["line_no"], r["reject"]) for r in rejected.collect()] == [(7, "bad amount")]


def test_csv_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = ["Date,Description,Amount,DrCr"] + [f"2024-01-01,row {i},1.00,DR" for i in range(1, 3001)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = cs.read_lines(spark, str(tmp_path)).filter("line_no > 0").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3000
    assert all(r["line"].split(",")[1] == f"row {r['line_no']}" for r in got)


def test_csv_synonyms(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Posting Date,Details,Amount\n01-Feb-24,A,(1500.00)\n2024-02-03,B,₹2\n03/02/2024,C,-\nsoon,D,5\n")
    records, rejected = cs.read_statements(spark, str(tmp_path), "by_synonyms")
    got = {(r["description"], r["day"].isoformat(), r["amount"], r["transaction_type"]) for r in records.collect()}
    assert got == {("A", "2024-02-01", Decimal("1500.00"), "expense"), ("B", "2024-02-03", Decimal("2.00"), "income")}
    assert [r["reject"] for r in rejected.collect()] == ["bad date"]
    with pytest.raises(ValueError):
        cs.read_statements(spark, str(tmp_path), "no such profile")


def test_tables(spark):
    rows = [
        ("f", 1, 1, 0, ["Date", "Transaction Description", "Rewards", "Amount"]),
        ("f", 1, 1, 1, ["22/12/2025\n13:33", "SHOP  A (Ref#12)", "20", "1,000.00 Cr"]),
        ("f", 1, 1, 2, ["23/12/2025", "", None, "5.00"]),
        ("f", 1, 1, 3, [None, None, None, None]),
        ("g", 1, 1, 0, ["no", "header"]),
    ]
    df = spark.createDataFrame(rows, "file string, page int, table_no int, row_no int, cells array<string>")
    got = [(r["row_no"], r["time"], r["description"], r["reward_points"], r["transaction_type"]) for r in st.card_table_rows(df).orderBy("row_no").collect()]
    assert got == [(1, "13:33", "SHOP A", 20, "income"), (2, None, "Unknown Transaction", None, "expense")]
    plain = [("h", 1, 1, i, ["01/02/2024", "PAY", "R1", "x", d, c]) for i, (d, c) in enumerate([("5.00", ""), ("", "-7.00"), ("", "0.00")])]
    got = st.account_table_rows(spark.createDataFrame(plain, df.schema)).orderBy("row_no").collect()
    assert [(r["amount"], r["transaction_type"]) for r in got] == [(Decimal("5.00"), "expense"), (Decimal("7.00"), "expense")]


def test_shared_backup_file(spark, tmp_path):
    def users(me_paid, me_owed):
        return [{"user": {"id": 1, "first_name": "Me"}, "paid_share": me_paid, "owed_share": me_owed},
                {"user": {"id": 2, "first_name": "Al", "last_name": "B"}, "paid_share": "0", "owed_share": "1"}]

    base = {"currency_code": "INR", "payment": False, "group_id": 7, "date": "2026-01-05T10:00:00Z", "deleted_at": None, "repayments": []}
    doc = {
        "user": {"id": 1, "first_name": "Me", "last_name": "", "email": "me@example.com"},
        "friends": [{"id": 2, "first_name": "Al", "last_name": "Friend"}],
        "groups": [],
        "expenses": [
            {**base, "id": 11, "description": "Dinner", "cost": "1000.00", "users": users("1000.00", "250.00")},
            {**base, "id": 12, "description": "Gone", "cost": "5.00", "deleted_at": "2026-01-06T00:00:00Z", "users": []},
            {**base, "id": 13, "description": "Settle", "cost": "500.00", "payment": True, "users": []},
        ],
    }
    (tmp_path / "backup.json").write_text(json.dumps(doc, indent=1))
    records = shared_backup.shared_records(shared_backup.expenses_of(shared_backup.read_backup(spark, str(tmp_path))))
    got = {r["expense_id"]: (r["amount"], r["user_share"], r["user_paid"], r["transaction_type"], r["transaction_date"]) for r in records.collect()}
    when = dt.datetime(2026, 1, 5, 10)
    assert got == {
        11: (Decimal("1000.00"), Decimal("250.00"), True, "expense", when),
        13: (Decimal("500.00"), None, False, "payment", when),
    }


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_backup_dates_in_any_session_zone(spark, zone):
    texts = ["2026-01-05T23:30:00Z", "2026-01-05T10:00:00", "2026-01-05T02:00:00+05:30", "2026-01-05"]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(x,) for x in texts], "d string").select(shared_backup._utc(F.col("d")).cast("string"))
        got = [r[0] for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2026-01-05 23:30:00", "2026-01-05 10:00:00", "2026-01-04 20:30:00", "2026-01-05 00:00:00"]


def test_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("one")
    (tmp_path / "a (1).csv").write_text("one")
    (tmp_path / "b.pdf").write_text("two")
    files = manifest.statement_files(spark, str(tmp_path)).collect()
    assert [(r["file_size"], r["file_hash"][:8]) for r in files] == [(3, "7692c3ad")]
    row = "file_hash string, filename string, file_size long, record_count long, metadata map<string,string>"
    old = spark.createDataFrame([("h", "first", 1, 1, {"a": "1", "b": "1"})], row)
    new = spark.createDataFrame([("h", "again", 1, 1, {"b": "2"}), ("n", "new", 2, 2, {})], row)
    got = {r["file_hash"]: (r["filename"], r["metadata"]) for r in manifest.merge_manifest(old, new).collect()}
    assert got == {"h": ("first", {"a": "1", "b": "2"}), "n": ("new", {})}


def test_pii(spark):
    text = "fine\npan ABCDE1234F\nmail a@example.com\nmail x@mail.example.net 1234 5678 9012\npassword = 'hunter22'\npassword='test'\n+91 9876543210"
    got = ql.pii_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {(r["line_no"], r["label"].split()[0]) for r in got} == {(2, "PAN"), (4, "Email"), (4, "Aadhaar"), (5, "Possible"), (7, "Indian")}


def test_scalars(spark):
    c = F.lit
    one = spark.range(1).select(
        t.external_id_norm(c(" 0007 ")), t.external_id_norm(c("000")), t.external_id_norm(c("  ")),
        t.collapse(c("  a  b\tc ")), t.amount_in_text(c("Total: ₹1,234.56")), t.amount_in_text(c("(12.5)")),
        t.plain_amount(c("Rs (1,500.00)")), t.clean_page_text(c("  Line 1\n\n\n  Line 2  \f  Page 1 of 5  ")),
        t.mask_identifier(c("12345678")), t.mask_identifier(c("1234 5678 9012")), t.mask_identifier(c("12xx56789012"), True),
        t.payment_handle(c("paid upi-shop.a@bank x")), t.date_in_text(c("due Jan 31, 2025")),
        t.dedup_hash(c("2026-01-02 03:04:05").cast("timestamp_ntz"), c("5").cast("decimal(12,2)"), c(" A  B "), c("expense")),
    ).collect()[0]
    import hashlib

    assert tuple(one) == (
        "7", "0", None, "a b c", Decimal("1234.56"), Decimal("-12.50"), Decimal("1500.00"), "Line 1\nLine 2", "12345678",
        "1234XXXX9012", "12XX56789012", "shop.a@bank", dt.date(2025, 1, 31), hashlib.sha256(b"2026-01-02|5.00|A B|expense").hexdigest(),
    )
