"""Registered queries against DuckDB on the smallest test data.

A cross-section by default; set CASETIDE_ALL=1 for every query.
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracle  # noqa: E402

from casetide import catalog  # noqa: E402
from casetide.oracle import statements  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = (
    "read_raw skip_bad_lines capture_drift clean_demo clean_drug clean_ther resolve_generic "
    "demo_outc_left pair_self_join_seq disproportionality dedup_versions mv_drug_reaction_pairs "
    "mv_death_by_drug mv_reports_by_country mv_age_sex_distribution top_drugs drug_signal "
    "db_summary drug_trend ex_class_signals ex_reporter_type share_of_max log_route log_sql_audit"
).split()
NAMES = list(catalog.queries()) if os.environ.get("CASETIDE_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees(spark, duck, name):
    assert check_oracle.compare(spark, duck, SF, name) == ""


def test_every_query_has_a_statement():
    assert set(catalog.queries()) == set(statements.oracle_sql())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
