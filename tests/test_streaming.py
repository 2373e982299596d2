"""The incremental import over several batches, and the stateful duplicate filter."""

import datetime as dt
from decimal import Decimal

import pytest

from passbook.streaming import incremental as inc

SCHEMA = (
    "seq long, transaction_date timestamp_ntz, amount decimal(12,2), transaction_type string, "
    "original_description string, external_id string"
)


def record(seq, day, text, ref=None):
    return (seq, dt.datetime(2026, 1, day), Decimal("10.00"), "expense", text, ref)


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, folder, store, source, state):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = inc.read_records(spark, folder, schema, per_batch=1)
    inc.incremental_import(stream, store, source, state).awaitTermination()


def test_incremental_import(spark, tmp_path):
    store = str(tmp_path / "store")
    pdf = str(tmp_path / "pdf")
    write(spark, pdf, [record(1, 1, "CARD SHOP LONDON 12"), record(2, 1, "card shop  london 12"), record(3, 2, "OTHER")])
    run(spark, pdf, store, "bank_pdf", str(tmp_path / "state1"))
    assert {r["id"] for r in inc.read_store(spark, store).collect()} == {1, 3}
    write(spark, pdf, [record(4, 2, "OTHER"), record(5, 3, "THIRD")])
    run(spark, pdf, store, "bank_pdf", str(tmp_path / "state1"))
    assert {r["id"] for r in inc.read_store(spark, store).collect()} == {1, 3, 5}
    # a better source writes over the row it matches
    csv = str(tmp_path / "csv")
    write(spark, csv, [record(6, 1, "CARD SHOP LONDON", "0042"), record(7, 4, "FOURTH")])
    run(spark, csv, store, "bank_csv", str(tmp_path / "state2"))
    rows = {r["id"]: r for r in inc.read_store(spark, store).collect()}
    assert set(rows) == {1, 3, 5, 7}
    assert (rows[1]["original_description"], rows[1]["source_type"], rows[1]["external_id"]) == (
        "CARD SHOP LONDON", "bank_csv", "0042"
    )


def test_import_opens_only_the_days_of_a_batch(spark, tmp_path):
    """Files of other days are spoilt: a batch still runs, with duplicates and an upgrade of its own day."""
    store, pdf, csv = (str(tmp_path / n) for n in ("store", "pdf", "csv"))
    write(spark, pdf, [record(1, 1, "CARD SHOP LONDON 12"), record(2, 2, "OTHER SHOP PARIS"), record(3, 3, "THIRD SHOP ROME")])
    run(spark, pdf, store, "bank_pdf", str(tmp_path / "state1"))
    write(spark, csv, [record(4, 2, "OTHER SHOP PARIS", "0007")])
    run(spark, csv, store, "bank_csv", str(tmp_path / "state2"))
    of_two = inc.read_store(spark, store, days=[dt.date(2026, 1, 2)]).collect()
    assert [(r["id"], r["source_type"], r["external_id"]) for r in of_two] == [(2, "bank_csv", "0007")]
    spoilt = [f for f in (tmp_path / "store").glob("*/batch=*/day=2026-01-02/*.parquet")]
    assert len(spoilt) == 2
    for f in spoilt:
        f.write_bytes(b"no parquet")
        (f.parent / f".{f.name}.crc").unlink()
    write(spark, csv, [record(5, 1, "CARD SHOP LONDON", "0042"), record(6, 3, "THIRD  SHOP ROME"), record(7, 4, "FOURTH")])
    run(spark, csv, store, "bank_csv", str(tmp_path / "state2"))
    days = [dt.date(2026, 1, d) for d in (1, 3, 4)]
    rows = {r["id"]: (r["source_type"], r["external_id"]) for r in inc.read_store(spark, store, days=days).collect()}
    assert rows == {1: ("bank_csv", "0042"), 3: ("bank_csv", None), 7: ("bank_csv", None)}
    with pytest.raises(Exception, match="parquet"):
        inc.read_store(spark, store).collect()


def test_stream_exact_dedup(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, [record(1, 1, "A B"), record(2, 1, "A  B"), record(3, 2, "A B")])
    stream = inc.read_records(spark, source, spark.createDataFrame([], SCHEMA).schema)
    inc.write_once(inc.exact_dedup(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2
    assert out.select("dedup_hash").distinct().count() == 2


def test_deduplicated_keeps_late_records_once(spark, tmp_path):
    """Three batches, the last one a month late; a restart; one batch run again after its rows were written."""
    source, store, state = (str(tmp_path / n) for n in ("in", "rows", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def run_all():
        stream = inc.read_records(spark, source, schema, per_batch=1)
        inc.deduplicated(stream, store, state).awaitTermination()

    def kept():
        return sorted(r["seq"] for r in inc.read_deduplicated(spark, store, schema).collect())

    undated = (9, None, Decimal("1.00"), "expense", "NO DAY", None)
    write(spark, source, [record(1, 5, "A B"), record(2, 5, "A  B"), undated])
    write(spark, source, [(3, dt.datetime(2026, 2, 20), Decimal("10.00"), "expense", "A B", None), record(4, 6, "C"), (10, *undated[1:])])
    run_all()
    assert kept() == [1, 3, 4, 9]
    write(spark, source, [record(5, 5, "A B"), record(6, 1, "LATE  ROW"), record(7, 1, "LATE ROW"), record(8, 6, "D")])
    run_all()
    assert kept() == [1, 3, 4, 6, 8, 9]
    run_all()
    assert kept() == [1, 3, 4, 6, 8, 9]
    stored = inc.read_deduplicated(spark, store, schema)
    assert stored.select("dedup_hash").distinct().count() == stored.count()
    # only the days asked for are opened
    files = stored.filter("day = date '2026-01-05'").inputFiles()
    assert len(stored.inputFiles()) > 3
    read = stored.filter("day = date '2026-01-05'")
    assert "PartitionFilters: [isnotnull(day" in read._jdf.queryExecution().toString() and files
