from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stallwise.session import get_spark

    session = get_spark("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def listing(spark):
    """Build listings from short dicts; every unnamed field gets a default."""
    ddl = ("run_id string, app_key string, version string, tech_name string, display_name string, summary string, author string, price_cents bigint,"
           "rating_stars double, review_count bigint, total_purchases bigint, last_month_purchases bigint, file_pos bigint")
    names = [f.strip().split(" ")[0] for f in ddl.split(",")]

    def build(*rows):
        full = []
        for i, r in enumerate(rows):
            base = {"run_id": "r", "app_key": f"k{i:04d}", "version": "17.0", "tech_name": f"t{i}", "display_name": f"name {i}", "author": "a", "file_pos": i, **r}
            full.append(tuple(base.get(n) for n in names))
        return spark.createDataFrame(full, ddl)
    return build
