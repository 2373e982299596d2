"""Registered queries against their SQL twins on the smallest tables.

The quick ones run by default; PASSBOOK_ALL_QUERIES=1 runs all of them.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from passbook.plans.queries import reports
from passbook.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
QUICK = [n for n, fn in entry.queries().items() if fn.__module__ == reports.__name__]
NAMES = list(entry.queries()) if os.environ.get("PASSBOOK_ALL_QUERIES") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, message = compare(spark, connect(SF_DIR), SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_every_query_has_a_twin():
    own = {n for n, fn in QUERIES.items() if ".llm." not in fn.__module__}
    assert own == own & set(entry.oracle_sql())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows == sorted(rows)
