"""Queries against DuckDB.  STALLWISE_FULL=1 runs all of them, else every third and the ones named."""

from __future__ import annotations

import os

import pytest
from compare import differences, duck

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
ALWAYS = {"top_trends", "score_apps", "agg_price_percentiles", "join_competitors", "stat_spearman", "stat_auc", "tbl_upsert_posts", "st_posts_upsert",
          "st_dedupe", "st_run_ingest", "page_refs", "page_cards", "label_checkin", "score_viability", "agg_wedges", "tbl_surrogate_id"}
NAMES = [n for i, n in enumerate(sorted(ORACLES)) if os.environ.get("STALLWISE_FULL") or i % 4 == 0 or n in ALWAYS]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, sf, con, name):
    assert differences(entry.queries()[name](spark, sf), con, ORACLES[name]) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["app_key", "display_name", "author", "trend_score", "opportunity_score"]
    assert df.count() == 20
