"""Every registered query with SQL agrees with it; the others return rows."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

LLM = re.compile(r"op\d+_|pipeline$")  # tested beside their package


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not LLM.match(n)))
def test_against_sql(spark, con, data, name):
    ok, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], data)
    assert ok, message


@pytest.mark.parametrize("name", sorted(n for n in entry.queries()
                                        if n not in entry.oracle_sql() and not LLM.match(n)))
def test_returns_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
