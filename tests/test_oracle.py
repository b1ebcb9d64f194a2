"""Every query with SQL agrees with it, whole tables, at the smallest size."""

import compare as K
import pytest

import __spark_entry__ as entry_points
from galley.functions import fixed_values as fx

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return K.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, tables, name):
    n_spark, n_sql, only_spark, only_sql = K.compare(QUERIES[name](spark, SF), tables, ORACLE[name])
    assert (only_spark[:3], only_sql[:3]) == ([], [])
    assert n_spark == n_sql


def test_all_checks_match_sql_on_more_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = K.compare(QUERIES["run_checks"](spark, sf), K.connect(sf), ORACLE["run_checks"])
    assert found[2:] == ([], []) and found[0] == found[1]


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 5


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_every_rule_has_rows(spark):
    """Rules over lines, rare words and whole documents all meet the seeds."""
    sf = "/root/testdata/sf0.01"
    rules = lambda name: {r[0] for r in QUERIES[name](spark, sf).select("rule").distinct().collect()}
    lines = rules("gut_line_rules")
    assert "paragraph ends in comma" in lines
    assert {name for name, *_ in fx.SPECIAL_LINE_RULES} <= lines
    odd = rules("gut_odd_words")
    assert {f"query word ending with {e}" for e in fx.RARE_ENDINGS} <= odd
    assert {f"query word starting with {e}" for e in fx.RARE_BEGINNINGS} <= odd
    whole = rules("book_level")
    assert {f'both "{a}" and "{b}"' for a, b in [*fx.SPELLING_PAIRS, *fx.TITLE_PAIRS]} <= whole
