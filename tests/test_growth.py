"""What grows with the input is neither broadcast nor left to a few tasks, nor parsed again for every use."""

import datetime

from passbook.operators import matching as m
from passbook.operators import quality as ql
from passbook.operators import shared as sh
from passbook.plans import testdata
from passbook.plans.queries import shared as shared_queries
from passbook.sources import shared_backup as sb
from passbook.sources import statement_tables as st
from passbook.sources import statement_text as tx

CELLS = "file string, page int, table_no int, row_no int, cells array<string>"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_headers_of_account_tables_are_not_broadcast(spark):
    head = ["Date", "Narration", "Chq./Ref.No.", "Value Dt", "Withdrawal Amt.", "Deposit Amt."]
    cells = spark.createDataFrame(
        [("a", 1, 1, 0, head), ("a", 1, 1, 1, ["01/02/2024", "PAY", "7", "01/02/2024", "3.00", ""])], CELLS
    )
    rows = st.account_table_rows(cells)
    assert "Broadcast" not in _plan(rows)
    assert [(r.row_no, str(r.amount), r.transaction_type) for r in rows.collect()] == [(1, "3.00", "expense")]


def test_column_edges_of_word_rows_are_not_broadcast(spark):
    words = [
        ("a", 1, 10.0, 100.0, "DATE"), ("a", 1, 100.0, 100.0, "DESCRIPTION"), ("a", 1, 300.0, 100.0, "AMOUNT"),
        ("a", 1, 10.0, 120.0, "01/02/2024"), ("a", 1, 110.0, 120.0, "SHOP"), ("a", 1, 300.0, 120.0, "3.00"),
    ]
    rows = st.word_rows(spark.createDataFrame(words, "file string, page int, x0 double, top double, text string"))
    assert "Broadcast" not in _plan(rows)
    assert [(r.description, str(r.amount)) for r in rows.collect()] == [("SHOP", "3.00")]


def test_only_heads_and_lengths_of_aliases_are_broadcast(spark):
    aliases = spark.createDataFrame([(1, "Corner Store 5", 3), (2, "Store", 4)], "id long, alias string, merchant_id long")
    rows = spark.createDataFrame(
        [(1, None, "STORE"), (2, 9, "STORE"), (3, None, None)], "id long, merchant_id long, merchant_hint string"
    )
    done = m.match_merchants(rows, aliases)
    joins = [line for line in _plan(done).splitlines() if "BroadcastHashJoin" in line or "NestedLoop" in line]
    assert all("[head#" in line and "BuildRight" in line or "[size#" in line for line in joins), joins
    assert sorted(map(tuple, done.collect())) == [(1, 3, "alias:Corner Store 5"), (2, 9, "existing"), (3, None, "no-match")]


def test_totals_of_statements_are_not_broadcast(spark):
    records = spark.createDataFrame([("a", 1, 2.0, "expense"), ("b", 1, 9.0, "expense")], "file string, line_no long, amount double, transaction_type string")
    records = records.withColumn("amount", records.amount.cast("decimal(12,2)"))
    expected = spark.createDataFrame([("a", 2), ("b", 2)], "file string, expected_total long")
    totals = ql.control_totals(records, expected, net=False)
    for policy in ("reject", "warn"):
        assert "Broadcast" not in _plan(ql.control_total_gate(records, totals, policy))
    assert [r.file for r in ql.control_total_gate(records, totals).collect()] == ["a"]


def test_tasks_stay_equally_large(spark, tmp_path):
    n = 6 * testdata.ROWS_A_TASK
    # one row group among several files: most splits hold no rows
    spark.range(n).coalesce(1).write.parquet(str(tmp_path / "rows"))
    for _ in range(7):
        spark.range(0).write.mode("append").parquet(str(tmp_path / "rows"))
    parts = testdata.dealt(spark.read.parquet(str(tmp_path / "rows"))).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(parts) == n
    assert max(parts) <= 1.1 * testdata.ROWS_A_TASK


def _orders(spark, folder):
    rows = [(k, k % 3, "F", 100.0 + k, datetime.date(2024, 1, 1 + k % 20), "1-URGENT") for k in range(48)]
    spark.createDataFrame(
        rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
    ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(0, "Ann"), (1, "Bob")], "c_custkey long, c_name string").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_shared_expenses_are_read_once(spark, tmp_path):
    folder = _orders(spark, tmp_path)
    # once for the import, once for what is stored
    plan = _plan(shared_queries.import_shared(spark, folder))
    assert plan.count("from_json") == 2
    assert plan.count("FileScan") == 2
    # creators and participants of one pass, and the customers
    plan = _plan(shared_queries.person_union(spark, folder))
    assert plan.count("from_json") == 1


def test_first_creator_or_participant_wins(spark):
    person = "struct<id:long,first_name:string,last_name:string,email:string>"
    records = spark.createDataFrame(
        [
            (1, (5, "Cre", None, None), [((5, "Part", "x", ""),), ((6, "Six", "", ""),)]),
            (2, (7, "Late", "", ""), [((6, "Other", "", ""),), ((None, "Nobody", "", ""),)]),
            (0, None, [((7, "Early", "", ""),)]),
        ],
        f"line_no long, created_by {person}, users array<struct<user:{person}>>",
    )
    found = {r.person_id: r.first_name for r in sb.persons(records).collect()}
    assert found == {5: "Cre", 6: "Six", 7: "Early"}


def test_created_rows_take_the_last_part(spark):
    rows = [(5, 1, 2.0, "created", "5"), (5, 2, 3.0, "updated", "5"), (None, 3, 4.0, "created", "line 3"), (0, None, 4.0, "created", None)]
    actions = spark.createDataFrame(
        [(*r, datetime.datetime(2024, 1, 1), 9.0, "EUR", "expense", "a", "a", 1, False, False) for r in rows],
        "expense_id long, line_no long, effective_amount double, action string, key string, transaction_date timestamp_ntz, "
        "amount double, currency string, transaction_type string, original_description string, cleaned_description string, "
        "shared_group_id long, is_payment boolean, is_provisional boolean",
    )
    done = sh.created_rows(actions)
    assert "Join" not in _plan(done)
    assert sorted((r.line_no, r.effective_amount) for r in done.collect()) == [(1, 3.0), (3, 4.0)]


def test_header_fields_look_through_the_text_once(spark):
    texts = ["Credit Card No: 4111 XXXX XXXX 1234\nSTATEMENT DATE May 7, 2024", "Card No: 12\nStatement Date: 7/5/2024", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    fields = rows.select(tx.card_number(rows.text).alias("card"), tx.statement_date(rows.text).alias("day"))
    assert _plan(fields.select("card")).count("regexp_extract") == 2
    assert _plan(fields.select("day")).count("regexp_extract") == 3
    day = datetime.date(2024, 5, 7)
    assert list(map(tuple, fields.collect())) == [("4111XXXXXXXX1234", day), (None, day), (None, None), (None, None)]


def test_control_totals_read_a_statement_once(spark):
    text = "01/02/2024| 09:05 SHOP + 2 C 5.00 l\nGrand Total 5.00"
    statements = spark.createDataFrame([("a", text), ("b", text.replace("C 5", "C 9"))], "file string, text string").repartition(2)
    records = tx.accepted(tx.card_a_lines(tx.statement_lines(statements)))
    expected = statements.select("file", tx.sum_of_section_totals(statements.text).alias("expected_total"))
    kept = ql.control_total_gate(records, ql.control_totals(records, expected, net=False)).select("file", "line_no")
    plan = _plan(kept)
    assert plan.count("regexp_extract_all") == 1
    assert "Ref#" not in plan  # descriptions are not worked out where only amounts count
    assert list(map(tuple, kept.collect())) == [("a", 1)]
