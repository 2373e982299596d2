"""Statement source queries.

Every order is turned into a small statement, as text, table cells, words or CSV
lines, and read back; the SQL twins state what must come out of it.
"""

from pyspark.sql import functions as F

from passbook.functions import similarity
from passbook.functions import text as t
from passbook.operators import quality as ql
from passbook.plans.registry import register
from passbook.plans.testdata import dealt, spread, table
from passbook.sources import csv_statements as cs
from passbook.sources import detect as dt
from passbook.sources import statement_tables as st
from passbook.sources import statement_text as tx
from passbook.storage import scratch_path



def order_id():
    return F.col("o_orderkey")


def slash_day():
    return F.date_format("o_orderdate", "dd/MM/yyyy")


def price_text():
    return F.format_number("o_totalprice", 2)


def id_text():
    return order_id().cast("string")


def customer():
    return F.col("o_custkey").cast("string")


ORDERS_SQL = """
o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS cust, o_orderdate,
    strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_totalprice AS DECIMAL(12,2)) AS price, o_orderpriority AS prio,
    o_orderstatus AS status FROM orders)"""


def _orders(spark, sf_dir):
    return dealt(table(spark, sf_dir, "orders"))


def _file(df, *lines):
    return df.select(id_text().alias("file"), F.concat_ws("\n", *lines).alias("text"))


def _day(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("amount", F.col("amount").cast("double"))


# ---------------------------------------------------------------- card layout A


def _card_a(spark, sf_dir):
    small = F.format_number(order_id() % 5000 + F.lit(0.5), 2)
    return _file(
        _orders(spark, sf_dir),
        F.lit("DATE & TIME TRANSACTION DESCRIPTION REWARDS AMOUNT PI"),
        F.lit("CARD HOLDER"),
        F.concat("o_orderpriority", F.lit(" ORDER NUMBER "), id_text(), F.lit(" (Ref#")),
        F.concat(slash_day(), F.lit("| 13:33 + C "), price_text(), F.lit(" l")),
        F.lit("ST000000000000000001)"),
        F.concat(slash_day(), F.lit("| 09:05 SHOP   "), customer(), F.lit(" STORE + 20 C "), small, F.lit(" l")),
        F.concat(slash_day(), F.lit(" 22:01:47 OLD STYLE "), customer(), F.lit("  "), (order_id() % 900 + 1).cast("string"), F.lit(".25")),
        F.lit("AB"),
        F.concat(slash_day(), F.lit("| 10:00 + C 5 l")),
        F.concat(slash_day(), F.lit("| 10:01 NOTHING C 0.00 l")),
        F.lit("32/13/2024| 10:00 BAD DAY C 5.00 l"),
        F.concat(F.lit("Total Domestic Transactions: "), F.format_number(F.col("o_totalprice") + (order_id() % 5000 + F.lit(0.5)), 2)),
        F.concat(F.lit("Grand Total "), F.format_number(order_id() % 900 + 1 + F.when(order_id() % 4 == 0, 7).otherwise(5) + F.lit(0.25), 2)),
    )


CARD_A_SQL = (
    ORDERS_SQL
    + """,
rec AS (
  SELECT key AS file, CAST(4 AS BIGINT) AS line_no, day, CAST(price AS DOUBLE) AS amount, prio || ' ORDER NUMBER ' || key AS description,
    '13:33' AS time, 'new' AS format FROM o
  UNION ALL SELECT key, 6, day, k % 5000 + 0.5, 'SHOP ' || cust || ' STORE', '09:05', 'new' FROM o
  UNION ALL SELECT key, 7, day, k % 900 + 1.25, 'OLD STYLE ' || cust, '22:01', 'old' FROM o
  UNION ALL SELECT key, 9, day, 5, 'Unknown Transaction', '10:00', 'new' FROM o)"""
)


@register("statement_lines_card_a", f"WITH {CARD_A_SQL} SELECT *, 'expense' AS transaction_type FROM rec")
def statement_lines_card_a(spark, sf_dir):
    return _day(tx.accepted(tx.card_a_lines(tx.statement_lines(_card_a(spark, sf_dir)))))


@register(
    "statement_rejects",
    f"WITH {ORDERS_SQL} SELECT key AS file, CAST(11 AS BIGINT) AS line_no, 'bad date' AS reject FROM o",
)
def statement_rejects(spark, sf_dir):
    return tx.rejects(tx.card_a_lines(tx.statement_lines(_card_a(spark, sf_dir))))


@register(
    "previous_line_lookback",
    f"""WITH {ORDERS_SQL} SELECT key AS file, CAST(n AS BIGINT) AS line_no,
      CASE n WHEN 4 THEN prio || ' ORDER NUMBER ' || key ELSE '' END AS above
    FROM o, (SELECT unnest(range(1, 14)) AS n) v""",
)
def previous_line_lookback(spark, sf_dir):
    """All thirteen lines: above the others stand headings, transactions, references or too little text."""
    rows = tx.with_previous_lines(tx.statement_lines(_card_a(spark, sf_dir)).drop("before"))
    return rows.select("file", "line_no", tx.description_above(F.col("before")).alias("above"))


@register(
    "statement_control_total",
    f"""WITH {CARD_A_SQL},
    act AS (SELECT file, CAST(sum(CAST(amount AS DECIMAL(14,2))) AS DOUBLE) AS actual_total, count(*) AS actual_count FROM rec GROUP BY 1),
    exp AS (SELECT key AS file, CAST(price + k % 5000 + 0.5 + k % 900 + 1 + CASE WHEN k % 4 = 0 THEN 7 ELSE 5 END + 0.25 AS DOUBLE) AS expected_total FROM o)
    SELECT file, expected_total, actual_total, actual_count, round(abs(actual_total - expected_total), 2) < 1 AS matches FROM exp JOIN act USING (file)""",
)
def statement_control_total(spark, sf_dir):
    statements = _card_a(spark, sf_dir)
    records = tx.accepted(tx.card_a_lines(tx.statement_lines(statements)))
    expected = statements.select("file", tx.sum_of_section_totals(F.col("text")).alias("expected_total"))
    totals = ql.control_totals(records, expected, net=False)
    return totals.select(
        "file",
        F.col("expected_total").cast("double").alias("expected_total"),
        F.col("actual_total").cast("double").alias("actual_total"),
        "actual_count",
        "matches",
    )


@register(
    "control_total_gate",
    f"""WITH {CARD_A_SQL} SELECT r.file, r.line_no FROM rec r JOIN o ON o.key = r.file WHERE k % 4 <> 0""",
)
def control_total_gate(spark, sf_dir):
    statements = _card_a(spark, sf_dir)
    records = tx.accepted(tx.card_a_lines(tx.statement_lines(statements)))
    expected = statements.select("file", tx.sum_of_section_totals(F.col("text")).alias("expected_total"))
    totals = ql.control_totals(records, expected, net=False)
    return ql.control_total_gate(records, totals).select("file", "line_no")


# ---------------------------------------------------------------- card layout B


def _card_b(spark, sf_dir):
    credit = F.when(F.col("o_orderstatus") == "F", " CR").otherwise("")
    net = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    due = net + F.lit(200000000.0) + F.when(order_id() % 5 == 0, 3.0).otherwise(0.25)
    return _file(
        _orders(spark, sf_dir),
        F.lit("STATEMENT SUMMARY"),
        F.lit("Total Amount due"),
        F.concat(F.lit("`"), F.format_number(due, 2), F.lit(" = + + -")),
        F.concat(slash_day(), F.lit(" 7"), F.lpad(id_text(), 10, "0"), F.lit(" MERCHANT  "), customer(), F.lit(" "), F.col("o_orderpriority"),
                 F.lit(" IN "), price_text(), credit),
        F.concat(slash_day(), F.lit(" 8"), F.lpad(id_text(), 10, "0"), F.lit(" BIG ONE US 200,000,000")),
        F.concat(slash_day(), F.lit(" 12366165854 ZERO IN 0.00")),
    )


CARD_B_SQL = (
    ORDERS_SQL
    + """,
rec AS (
  SELECT key AS file, CAST(4 AS BIGINT) AS line_no, day, CAST(price AS DOUBLE) AS amount, 'MERCHANT ' || cust || ' ' || prio AS description,
    CASE WHEN status = 'F' THEN 'income' ELSE 'expense' END AS transaction_type, '7' || lpad(key, 10, '0') AS external_id, 'IN' AS country_code FROM o
  UNION ALL SELECT key, 5, day, 200000000, 'BIG ONE', 'expense', '8' || lpad(key, 10, '0'), 'US' FROM o)"""
)


@register("statement_lines_card_b", f"WITH {CARD_B_SQL} SELECT * FROM rec")
def statement_lines_card_b(spark, sf_dir):
    return _day(tx.accepted(tx.card_b_lines(tx.statement_lines(_card_b(spark, sf_dir)))))


@register(
    "statement_net_total",
    f"""WITH {ORDERS_SQL}, tot AS (SELECT *, CASE WHEN status = 'F' THEN -price ELSE price END + 200000000 AS net,
      CASE WHEN k % 5 = 0 THEN 3.0 ELSE 0.25 END AS off FROM o)
    SELECT key AS file, CAST(net + off AS DOUBLE) AS expected_total, CAST(net AS DOUBLE) AS actual_total,
      CAST(2 AS BIGINT) AS actual_count, k % 5 <> 0 AS matches FROM tot""",
)
def statement_net_total(spark, sf_dir):
    statements = _card_b(spark, sf_dir)
    records = tx.accepted(tx.card_b_lines(tx.statement_lines(statements)))
    expected = statements.select("file", tx.amount_due(F.col("text")).alias("expected_total"))
    totals = ql.control_totals(records, expected, net=True)
    return totals.select(
        "file",
        F.col("expected_total").cast("double").alias("expected_total"),
        F.col("actual_total").cast("double").alias("actual_total"),
        "actual_count",
        "matches",
    )


# ---------------------------------------------------------------- tables and words


def _row(row_no, *cells):
    return F.struct(F.lit(row_no).alias("row_no"), F.array(*cells).alias("cells"))


def _tables(df, *rows):
    place = [id_text().alias("file"), F.lit(1).alias("page"), F.lit(1).alias("table_no")]
    return df.select(*place, F.inline(F.array(*rows)))


@register(
    "statement_table_rows",
    f"""WITH {ORDERS_SQL} SELECT key AS file, CAST(2 AS BIGINT) AS row_no, day, '13:33' AS time, 'STORE ' || cust AS description,
      CAST(k % 50 AS BIGINT) AS reward_points, CAST(price AS DOUBLE) AS amount, CASE WHEN status = 'F' THEN 'income' ELSE 'expense' END AS transaction_type FROM o
    UNION ALL SELECT key, 3, day, NULL, 'Unknown Transaction', NULL, 12.5, 'expense' FROM o""",
)
def statement_table_rows(spark, sf_dir):
    lit = F.lit
    cells = _tables(
        _orders(spark, sf_dir),
        _row(0, lit("Statement"), lit(""), lit(""), lit("")),
        _row(1, lit("Date"), lit("Transaction Description"), lit("Reward Points"), lit("Amount (in Rs.)")),
        _row(
            2, F.concat(slash_day(), lit("\n13:33")), F.concat(lit("STORE  "), customer(), lit(" (Ref# 12)")), (order_id() % 50).cast("string"),
            F.concat(price_text(), F.when(F.col("o_orderstatus") == "F", " Cr").otherwise("")),
        ),
        _row(3, slash_day(), lit("x"), lit(""), lit("Rs 12.50")),
        _row(4, slash_day(), lit("ZERO"), lit("1"), lit("0.00")),
        _row(5, lit("no date"), lit("TEXT"), lit("1"), lit("9.00")),
    )
    rows = _day(st.card_table_rows(cells)).drop("page", "table_no")
    return rows.withColumn("row_no", F.col("row_no").cast("long"))


@register(
    "account_table_rows",
    f"""WITH {ORDERS_SQL} SELECT key AS file, CAST(n AS BIGINT) AS row_no, day, 'PAY ' || cust AS description, CASE n WHEN 4 THEN '' ELSE key END AS external_id,
      CAST(price AS DOUBLE) AS amount, CASE WHEN n IN (1, 4) THEN 'expense' ELSE 'income' END AS transaction_type
    FROM o, (VALUES (1), (2), (3), (4)) v(n)""",
)
def account_table_rows(spark, sf_dir):
    lit, pay = F.lit, F.concat(F.lit("PAY "), customer())
    minus = F.concat(lit("-"), price_text())
    cells = _tables(
        _orders(spark, sf_dir),
        _row(0, *[lit(h) for h in ("Date", "Narration", "Chq./Ref.No.", "Value Dt", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance")]),
        _row(1, slash_day(), pay, id_text(), slash_day(), price_text(), lit(""), lit("1.00")),
        _row(2, slash_day(), pay, id_text(), slash_day(), lit("0.00"), price_text(), lit("1.00")),
        _row(3, slash_day(), pay, id_text(), slash_day(), minus, lit(""), lit("1.00")),
        _row(4, slash_day(), pay, lit(None).cast("string"), slash_day(), lit(""), minus, lit("1.00")),
        _row(5, slash_day(), pay, id_text(), slash_day(), lit("0.00"), lit("0.00"), lit("1.00")),
        _row(6, lit("Total"), pay, id_text(), slash_day(), lit("5.00"), lit(""), lit("1.00")),
    )
    rows = _day(st.account_table_rows(cells)).drop("page", "table_no")
    return rows.withColumn("row_no", F.col("row_no").cast("long"))


@register(
    "statement_word_rows",
    f"""WITH {ORDERS_SQL} SELECT key AS file, 114.0::DOUBLE AS y, day, '13:33' AS time, 'SHOP ' || cust AS description,
      CAST(k % 50 AS BIGINT) AS reward_points, CAST(price AS DOUBLE) AS amount, 'expense' AS transaction_type FROM o
    UNION ALL SELECT key, 138.0::DOUBLE, day, NULL, 'LONG NAME ' || key, NULL, CAST(price AS DOUBLE), 'income' FROM o""",
)
def statement_word_rows(spark, sf_dir):
    lit = F.lit

    def word(x0, top, text):
        return F.struct(lit(float(x0)).alias("x0"), lit(float(top)).alias("top"), text.alias("text"))

    words = _orders(spark, sf_dir).select(
        id_text().alias("file"),
        lit(1).alias("page"),
        F.inline(
            F.array(
                word(10, 100.5, lit("DATE & TIME")), word(120, 101, lit("TRANSACTION DESCRIPTION")),
                word(300, 100, lit("REWARDS")), word(400, 100.9, lit("AMOUNT")),
                # date, description, points and amount in one row
                word(12, 112, F.concat(slash_day(), lit("| 13:33"))), word(200, 112, customer()), word(90, 113, lit("SHOP")),
                word(310, 112, F.concat(lit("+ "), (order_id() % 50).cast("string"))), word(405, 114, price_text()),
                # description in the row above, the row itself holds the tail of a reference
                word(90, 126, F.concat(lit("LONG NAME "), id_text(), lit(" (Ref# 1"))),
                word(11, 138, slash_day()), word(100, 138, lit("ST260050000000000001)")), word(401, 138, F.concat(price_text(), lit(" Cr"))),
                # no description anywhere
                word(11, 162, slash_day()), word(401, 162, lit("5.00")),
            )
        ),
    )
    # the row at 162 follows the one at 138, whose own description is a reference tail
    return _day(st.word_rows(words)).drop("page")


# ---------------------------------------------------------------- header fields, names, detection


@register(
    "header_metadata",
    f"""WITH {ORDERS_SQL} SELECT key AS file, '4111XXXXXXXX' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS card_number, day AS statement_date,
      'C' || cust AS customer_id, '5010XXXXXX' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS account_number, CAST(price AS DOUBLE) AS amount_due FROM o""",
)
def header_metadata(spark, sf_dir):
    last4 = F.lpad((order_id() % 10000).cast("string"), 4, "0")
    named = F.date_format("o_orderdate", "MMMM d, yyyy")
    statements = _file(
        _orders(spark, sf_dir),
        F.concat(F.lit("Credit Card No: 4111 XXXX XXXX "), last4),
        F.when(order_id() % 2 == 0, F.concat(F.lit("STATEMENT DATE "), named)).otherwise(F.concat(F.lit("Statement Date: "), slash_day())),
        F.concat(F.lit("Cust ID : C"), customer(), F.lit(" Account Number : 5010123456"), last4),
        F.concat(F.lit("Total Amount Due\n₹ "), price_text()),
    )
    text = F.col("text")
    return statements.select(
        "file",
        tx.card_number(text).alias("card_number"),
        F.date_format(tx.statement_date(text), "yyyy-MM-dd").alias("statement_date"),
        tx.customer_id(text).alias("customer_id"),
        tx.account_number(text).alias("account_number"),
        tx.amount_due(text).cast("double").alias("amount_due"),
    )


@register(
    "filename_metadata",
    f"""WITH {ORDERS_SQL}, f AS (SELECT k, '1234XXXXXXXX' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS card, * FROM o)
    SELECT k AS id, CASE WHEN k % 4 IN (0, 1) THEN card END AS card_number, CASE WHEN k % 4 = 0 THEN day END AS statement_date,
      CASE k % 4 WHEN 0 THEN key WHEN 1 THEN key END AS reference, CASE WHEN k % 4 = 1 THEN 'Coral' END AS card_type,
      CASE WHEN k % 4 = 2 THEN '5010XXXXXX' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS account_number FROM f""",
)
def filename_metadata(spark, sf_dir):
    last4 = F.lpad((order_id() % 10000).cast("string"), 4, "0")
    card = F.concat(F.lit("1234XXXXXXXX"), last4)
    name = (
        F.when(order_id() % 4 == 0, F.concat(card, F.lit("_"), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit("_"), id_text(), F.lit(".pdf")))
        .when(order_id() % 4 == 1, F.concat(card, F.lit("_"), id_text(), F.lit("_Retail_Coral_NORM.pdf")))
        .when(order_id() % 4 == 2, F.concat(F.lit("Acct_Statement_5010123456"), last4, F.lit("_01.csv")))
        .otherwise(F.concat(F.lit("scan_"), id_text(), F.lit(".pdf")))
    )
    fields = tx.filename_fields(name)
    fields["statement_date"] = F.date_format(fields["statement_date"], "yyyy-MM-dd")
    return _orders(spark, sf_dir).select(order_id().alias("id"), *[c.alias(n) for n, c in fields.items()])


MARKS = {
    0: "HDFC Bank  Credit Cards GSTIN\nStatement Date 18 Dec\nBilling Period\nCredit Card No. 12",
    1: "ICICI Bank\nSTATEMENT DATE May\nPAYMENT DUE DATE June\nTotal Amount due",
    2: "HDFC BANK LIMITED\nAccount  Branch : X\nIFSC : Y\nAccount No 1\nNarration Withdrawal",
    3: "HDFC Bank Credit Cards Credit Card Statement\nStatement for HDFC Bank Credit Card\n Date:18\nStatement Card No: 5\nPayment Due Date Total Dues Minimum Amount Due",
    4: "HDFC Bank Credit Cards Statement Date Billing Period Card No\nICICI Bank Payment due date Total amount due",
}


@register(
    "detect_source",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 'hdfc_bank_csv' ELSE CASE doc_id % 6 WHEN 0 THEN 'hdfc_credit_card' WHEN 1 THEN 'icici_credit_card'
        WHEN 2 THEN 'hdfc_bank_pdf' WHEN 3 THEN 'hdfc_credit_card_legacy' END END AS profile,
      CASE WHEN doc_id % 7 <> 6 AND doc_id % 6 = 4 THEN 'ambiguous_match' END AS error,
      CAST(CASE WHEN doc_id % 7 = 6 THEN 1 ELSE CASE doc_id % 6 WHEN 4 THEN 2 WHEN 5 THEN 0 ELSE 1 END END AS BIGINT) AS n_matches
    FROM documents""",
)
def detect_source(spark, sf_dir):
    found = _detected(spark, sf_dir)
    return found.select("doc_id", "profile", "error", F.size("matches").cast("long").alias("n_matches"))


def _detected(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    mark = None
    for n, marks in MARKS.items():
        hit = F.col("doc_id") % 6 == n
        mark = F.when(hit, marks) if mark is None else mark.when(hit, marks)
    docs = docs.withColumn("text", F.concat(F.col("text"), F.lit("\n"), F.coalesce(mark, F.lit(""))))
    docs = docs.withColumn("filename", F.when(F.col("doc_id") % 7 == 6, "a.csv").otherwise("a.pdf"))
    return dt.detect_source(docs)


@register(
    "layout_catalogue",
    """WITH layouts (profile, bank, product, format, priority, rest) AS (VALUES ('hdfc_credit_card', 'hdfc', 'credit_card', 'pdf', 60, 0),
      ('icici_credit_card', 'icici', 'credit_card', 'pdf', 60, 1), ('hdfc_bank_pdf', 'hdfc', 'bank_statement', 'pdf', 55, 2),
      ('hdfc_credit_card_legacy', 'hdfc', 'credit_card', 'pdf', 59, 3), ('hdfc_bank_csv', 'hdfc', 'bank_statement', 'csv', 40, -1))
    SELECT profile, bank, product, format, priority, count(doc_id) AS n_files FROM layouts LEFT JOIN documents
      ON rest = CASE WHEN doc_id % 7 = 6 THEN -1 ELSE doc_id % 6 END GROUP BY ALL""",
)
def layout_catalogue(spark, sf_dir):
    """The layouts with the number of files each one alone fits."""
    files = _detected(spark, sf_dir).groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    return dt.catalogue(spark).join(files, "profile", "left").select(
        "profile", "bank", "product", "format", "priority", F.coalesce("n", F.lit(0)).cast("long").alias("n_files")
    )


# ---------------------------------------------------------------- CSV


def _csv(df, header, line):
    """Lines of CSV files: a file per customer group, its header as line 0."""
    file = F.concat(F.lit("statement_"), (F.col("o_custkey") % 97).cast("string"))
    rows = df.select(file.alias("file"), (order_id() + 1).alias("line_no"), line.alias("line"))
    heads = rows.select("file").distinct().select("file", F.lit(0).cast("long").alias("line_no"), header.alias("line"))
    return rows.unionByName(heads)


def _quoted(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def _debit_credit_lines(spark, sf_dir):
    day = F.when(order_id() % 11 == 10, "31/02/24").otherwise(F.date_format("o_orderdate", "dd/MM/yy"))
    text = (
        F.when(order_id() % 3 == 0, F.concat(F.lit("PAY TO SHOP, "), customer(), F.lit(" , STREET")))
        .when(order_id() % 3 == 1, F.concat(F.lit('"PAY, ""'), customer(), F.lit('"""')))
        .otherwise(F.concat(F.lit("PLAIN "), customer()))
    )
    debit = F.when(order_id() % 4 == 0, _quoted(price_text())).when(order_id() % 4 == 1, F.concat(F.lit('"-'), price_text(), F.lit('"'))).otherwise("")
    credit = F.when(order_id() % 4 == 2, _quoted(price_text())).otherwise(F.when(order_id() % 4 == 3, "0.00").otherwise(""))
    closing = F.when(order_id() % 5 == 0, "").otherwise(F.concat(F.lit(',"'), price_text(), F.lit('"')))
    # every fifth row is short: its last cell is missing, unless a comma in the text makes up for it
    closing = F.when((order_id() % 5 == 0) & (order_id() % 3 == 0), ",").otherwise(closing)
    line = F.concat(day, F.lit(","), text, F.lit(","), day, F.lit(","), debit, F.lit(","), credit, F.lit(","), id_text(), closing)
    header = F.lit("Date , Narration,Value Dat,Debit Amount,Credit Amount,Chq/Ref Number,Closing Balance")
    return _csv(_orders(spark, sf_dir), header, line)


DEBIT_CREDIT_SQL = (
    ORDERS_SQL
    + """,
csv AS (SELECT *, 'statement_' || CAST(CAST(cust AS BIGINT) % 97 AS VARCHAR) AS file,
    CASE k % 3 WHEN 0 THEN 'PAY TO SHOP,  ' || cust || ' ,  STREET' WHEN 1 THEN 'PAY, "' || cust || '"' ELSE 'PLAIN ' || cust END AS txt,
    CASE WHEN k % 5 = 0 THEN NULL ELSE format('{:,.2f}', CAST(price AS DOUBLE)) END AS closing FROM o)"""
)


@register(
    "csv_profile_debit_credit",
    f"""WITH {DEBIT_CREDIT_SQL} SELECT file, k + 1 AS line_no, day, CAST(price AS DOUBLE) AS amount, txt AS description,
      CASE WHEN k % 4 = 0 THEN 'expense' ELSE 'income' END AS transaction_type, key AS external_id, closing AS closing_balance
    FROM csv WHERE k % 11 <> 10 AND k % 4 <> 3""",
)
def csv_profile_debit_credit(spark, sf_dir):
    return _day(cs.debit_credit(_debit_credit_lines(spark, sf_dir))).drop("reject")


@register(
    "csv_statement_scan",
    f"""WITH {ORDERS_SQL} SELECT day, 'TEXT, "' || key || '"' AS description, CAST(price AS DOUBLE) AS amount,
      CASE WHEN k % 3 = 0 THEN 'income' ELSE 'expense' END AS transaction_type FROM o""",
)
def csv_statement_scan(spark, sf_dir):
    """Writes the orders as CSV files, each with its header, and reads the files back."""
    path = scratch_path(spark, "csv")
    rows = _orders(spark, sf_dir).select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        F.concat(F.lit('TEXT, "'), id_text(), F.lit('"')).alias("Description"),
        price_text().alias("Amount"),
        F.when(order_id() % 3 == 0, "CR").otherwise("DR").alias("DrCr"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    records, _ = cs.read_statements(spark, path, "generic_drcr")
    return _day(records).select("day", "description", "amount", "transaction_type")


@register(
    "csv_overflow_repair",
    f"""WITH {DEBIT_CREDIT_SQL} SELECT file, k + 1 AS line_no, txt AS narration, coalesce(closing, '') AS closing, CAST(7 AS BIGINT) AS n_cells FROM csv""",
)
def csv_overflow_repair(spark, sf_dir):
    rows = cs.repaired(_debit_credit_lines(spark, sf_dir))
    return rows.select(
        "file", "line_no", F.get("cells", F.lit(1)).alias("narration"), F.get("cells", F.lit(6)).alias("closing"),
        F.size("cells").cast("long").alias("n_cells"),
    )


@register(
    "csv_profile_drcr",
    f"""WITH {ORDERS_SQL} SELECT 'statement_' || CAST(CAST(cust AS BIGINT) % 97 AS VARCHAR) AS file, k + 1 AS line_no,
      day, CAST(price AS DOUBLE) AS amount, 'TEXT ' || key AS description,
      CASE WHEN k % 3 = 0 THEN 'income' ELSE 'expense' END AS transaction_type FROM o WHERE k % 7 <> 0""",
)
def csv_profile_drcr(spark, sf_dir):
    day = F.when(order_id() % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    mark = F.when(order_id() % 3 == 0, "cr.").when(order_id() % 3 == 1, "DR").otherwise("")
    line = F.concat(day, F.lit(",TEXT "), id_text(), F.lit(","), _quoted(price_text()), F.lit(","), mark)
    lines = _csv(_orders(spark, sf_dir), F.lit("Date,Description,Amount,DrCr"), line)
    rows = _day(cs.generic_drcr(lines))
    return rows.drop("reject", "external_id", "closing_balance")


@register(
    "csv_generic_columns",
    f"""WITH {ORDERS_SQL} SELECT 'statement_' || CAST(CAST(cust AS BIGINT) % 97 AS VARCHAR) AS file, k + 1 AS line_no,
      day, CAST(price AS DOUBLE) AS amount, 'TEXT ' || key AS description,
      CASE WHEN k % 2 = 0 THEN 'expense' ELSE 'income' END AS transaction_type FROM o WHERE k % 9 <> 0""",
)
def csv_generic_columns(spark, sf_dir):
    layouts = ["dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yy", "dd-MM-yy", "dd-MMM-yyyy", "dd-MMM-yy", "yyyy-MM-dd"]
    day = None
    for i, layout in enumerate(layouts):
        text = F.date_format("o_orderdate", layout)
        day = F.when(order_id() % 7 == i, text) if day is None else day.when(order_id() % 7 == i, text)
    value = F.when(order_id() % 9 == 0, "0.00").otherwise(F.concat(F.when(order_id() % 5 == 0, "₹").otherwise("Rs "), price_text()))
    debit = F.when(order_id() % 2 == 0, F.when((order_id() % 4 == 0) & (order_id() % 9 != 0), F.concat(F.lit("("), price_text(), F.lit(")"))).otherwise(value)).otherwise("-")
    credit = F.when(order_id() % 2 == 1, value).otherwise("")
    line = F.concat(day, F.lit(",TEXT "), id_text(), F.lit(","), _quoted(debit), F.lit(","), _quoted(credit), F.lit(",1.00"))
    lines = _csv(_orders(spark, sf_dir), F.lit("Txn Date,Particulars,Withdrawal Amt,Deposit Amt,Balance"), line)
    return _day(cs.generic_columns(lines)).drop("reject")


# ---------------------------------------------------------------- scalar functions


@register(
    "indel_ratio",
    """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_name AS a, lower(p_type) || ' ' || p_name[1:4] AS b FROM part),
    lcs(id, a, b, i, r) AS (
      SELECT id, a, b, 0, list_transform(range(0, length(b) + 1), lambda j: 0) FROM p
      UNION ALL
      SELECT id, a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: greatest(r[j],
        coalesce(list_max([r[q] + 1 for q in range(1, j) if b[q] = a[i + 1]]), 0)))
      FROM lcs WHERE i < length(a))
    SELECT id, CAST(r[length(b) + 1] AS DOUBLE) * 200.0::DOUBLE / (length(a) + length(b)) AS ratio FROM lcs WHERE i = length(a)""",
)
def indel_ratio(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    other = F.concat(F.lower("p_type"), F.lit(" "), F.substring("p_name", 1, 4))
    return p.select(F.col("p_partkey").alias("id"), similarity.indel_ratio(F.col("p_name"), other).alias("ratio"))


@register(
    "mask_identifier",
    f"""WITH {ORDERS_SQL} SELECT k AS id, CASE WHEN k % 2 = 0 THEN left(key, 8) ELSE '9876XXXXXXXX' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS masked FROM o""",
)
def mask_identifier(spark, sf_dir):
    raw = F.when(order_id() % 2 == 0, F.left(id_text(), F.lit(8))).otherwise(
        F.concat(F.lit("9876 0000 1111 "), F.lpad((order_id() % 10000).cast("string"), 4, "0"))
    )
    return _orders(spark, sf_dir).select(order_id().alias("id"), t.mask_identifier(raw).alias("masked"))


@register(
    "amount_in_text",
    f"""WITH {ORDERS_SQL} SELECT k AS id, CAST(CASE WHEN k % 3 = 0 THEN -price ELSE price END AS DOUBLE) AS amount FROM o""",
)
def amount_in_text(spark, sf_dir):
    raw = F.when(order_id() % 3 == 0, F.concat(F.lit("("), price_text(), F.lit(")"))).when(
        order_id() % 3 == 1, F.concat(F.lit("Total: ₹"), price_text())
    ).otherwise(F.concat(F.lit("Rs "), price_text(), F.lit(" due")))
    return _orders(spark, sf_dir).select(order_id().alias("id"), t.amount_in_text(raw).cast("double").alias("amount"))


@register(
    "date_in_text",
    f"""WITH {ORDERS_SQL} SELECT k AS id, CASE WHEN k % 5 = 4 THEN NULL ELSE day END AS day FROM o""",
)
def date_in_text(spark, sf_dir):
    raw = None
    for i, layout in enumerate(["dd/MM/yyyy", "dd-MM-yyyy", "dd-MMM-yyyy", "MMM d, yyyy"]):
        text = F.concat(F.lit("Statement Date: "), F.date_format("o_orderdate", layout), F.lit(" page 1"))
        raw = F.when(order_id() % 5 == i, text) if raw is None else raw.when(order_id() % 5 == i, text)
    raw = raw.otherwise("none")
    return _orders(spark, sf_dir).select(
        order_id().alias("id"), F.date_format(t.date_in_text(raw), "yyyy-MM-dd").alias("day")
    )


@register(
    "clean_page_text",
    """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(
      regexp_replace(replace('Page 1 of 5' || chr(10) || text, chr(12), ''), '(?i)Page \\d+ of \\d+', '', 'g'), chr(10)),
      lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents""",
)
def clean_page_text(spark, sf_dir):
    text = F.concat(F.lit("Page 1 of 5\n"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.clean_page_text(text).alias("text"))
