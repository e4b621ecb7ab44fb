"""Threshold ladders at their edges, on hand-computed rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stallwise.functions import columns as C
from stallwise.operators import backtest as B, checkin as H, niches as N, partners as P, scoring as S, validate as X


def one(spark, column, **values):
    """Evaluate a column over one literal row."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("cents,label9,label8", [
    (None, "Unknown", "$500+"), (-1, "Unknown", "$1-9"), (0, "Free", "Free"), (1, "$1-9", "$1-9"), (999, "$1-9", "$1-9"), (1000, "$10-19", "$10-19"),
    (9999, "$50-99", "$50-99"), (10000, "$100-199", "$100-199"), (49999, "$200-499", "$200-499"), (50000, "$500+", "$500+")])
def test_price_tiers(spark, cents, label9, label8):
    df = spark.createDataFrame([(cents,)], "price_cents bigint")
    assert df.select(C.price_tier("Unknown"), C.price_tier()).first()[:] == (label9, label8)


@pytest.mark.parametrize("usd,label", [(0, None), (10, "$1-10"), (10.01, "$11-20"), (20, "$11-20"), (500, "$201-500"), (500.01, "$500+")])
def test_price_bins_close_on_the_right(spark, usd, label):
    assert spark.createDataFrame([(round(usd * 100),)], "price_cents bigint").select(C.price_bin()).first()[0] == label


@pytest.mark.parametrize("n,label", [(0, "ZERO"), (1, "THIN"), (3, "THIN"), (4, "OK"), (15, "OK"), (16, "CROWDED")])
def test_signal(spark, n, label):
    assert one(spark, N.signal_label(F.col("n")), n=n) == label


@pytest.mark.parametrize("n,last,price,label", [(0, 0, 0.0, "BUILD"), (4, 99, 999.0, "BUILD"), (5, 0, 999.0, "SKIP"), (5, 2, 999.0, "SKIP"), (5, 3, 300.0, "UNDERCUT"),
                                                (5, 3, 299.0, "WATCH"), (5, 4, 0.0, "WATCH"), (5, 5, 0.0, "UNDERCUT")])
def test_decision(spark, n, last, price, label):
    assert one(spark, N.decision(F.col("n"), F.col("l"), F.col("p")), n=n, l=last, p=price) == label


@pytest.mark.parametrize("v,label", [(41, "SCREEN OUT"), (42, "INVESTIGATE"), (46, "INVESTIGATE"), (47, "CONSIDER"), (51, "CONSIDER"), (52, "LAUNCH CANDIDATE")])
def test_verdict(spark, v, label):
    assert one(spark, X.verdict(F.col("v")), v=v) == label


def viability(spark, text="plain", **facts):
    base = {"n": 10, "total": 0, "velocity": 0, "dead": 0, "active": 0, "avg_rating": 0.0, **facts}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in base.items()], F.lit(text).alias("text"))
    return X.sub_scores(df, F.col("text")).first()


@pytest.mark.parametrize("n,sat", [(3, 90), (4, 75), (8, 75), (9, 55), (20, 55), (21, 35), (50, 35), (51, 15)])
def test_saturation(spark, n, sat):
    assert viability(spark, n=n)["sat"] == sat


def test_graveyard_caps_saturation_only_above_three(spark):
    assert viability(spark, n=5, dead=4)["sat"] == 35
    assert viability(spark, n=5, dead=3)["sat"] == 75
    assert viability(spark, n=3, dead=3)["sat"] == 90


@pytest.mark.parametrize("total,demand", [(5, 10), (6, 25), (20, 25), (21, 40), (80, 40), (81, 60), (200, 60), (201, 75), (500, 75), (501, 90)])
def test_demand_per_active_listing(spark, total, demand):
    assert viability(spark, total=total)["demand"] == demand  # no active listing counts as one


def test_words_override(spark):
    r = viability(spark, "peppol from tally", total=1, velocity=0)
    assert (r["forced_buyer"], r["demand"], r["momentum"], r["is_migrator"]) == (90, 80, 70, True)
    assert viability(spark, "wave accounting")["demand"] == 50
    assert viability(spark, "zoho books")["forced_buyer"] == 10


def test_viability_is_cut_not_rounded(spark):
    r = viability(spark, n=10, total=100, velocity=5, active=5, dead=1, avg_rating=4.0)
    # sat 55, demand 25 (20 a listing is not above 20), dead_health 85, momentum 45 + 10, forced 10, rating 80
    assert (r["sat"], r["demand"], r["dead_health"], r["momentum"], r["forced_buyer"], r["rating_score"]) == (55, 25, 85, 55, 10, 80)
    assert r["viability"] == int(5.5 + 5.0 + 10.2 + 15.4 + 1.3 + 13.6)


@pytest.mark.parametrize("paid,low,stale,share,gap,moat", [(0, 0, 0, 0.0, 50, 85), (5, 0, 0, 20.0, 80, 85), (5, 3, 0, 20.1, 60, 65), (9, 8, 0, 40.1, 40, 45),
                                                         (9, 9, 4, 60.1, 20, 20), (4, 4, 2, 10.0, 40, 95), (4, 4, 2, 61.0, 40, 35)])
def test_gap_and_moat(spark, paid, low, stale, share, gap, moat):
    df = spark.createDataFrame([(paid, low, stale, share)], "paid int, low int, stale int, top_share double")
    r = X.gap_moat(df).first()
    assert (r["gap"], r["moat"]) == (gap, moat)


CHECK = dict(week=2, installs_total=0, listing_visitors=0, refunds_total=0, reviews_count=0, bug_reviews=0, installs_weeks_1_2=0, installs_weeks_7_8=0,
             revenue=0.0, trend="flat", hours=5, motivation=8)


@pytest.mark.parametrize("label,row", [
    ("LISTING CRISIS", dict(listing_visitors=200)), ("DISTRIBUTION CRISIS", dict(listing_visitors=49)), ("REVIEW MANUALLY", dict(listing_visitors=50)),
    ("SLOW START", dict(installs_total=2)), ("HEALTHY START", dict(installs_total=3)), ("STRONG LAUNCH", dict(installs_total=8)),
    ("QUALITY CRISIS", dict(week=4, installs_total=9, refunds_total=2)), ("ENGAGEMENT CRISIS", dict(week=4, installs_total=10, refunds_total=2)),
    ("STABLE", dict(week=4)), ("UNDER-SPECCED V1", dict(week=4, installs_total=4, bug_reviews=2)),
    ("SILENT QUITTERS", dict(week=4, installs_total=30, refunds_total=1, reviews_count=1)),
    ("GROWING", dict(week=8, installs_weeks_1_2=2, installs_weeks_7_8=3)), ("FLAT", dict(week=8, installs_weeks_1_2=10, installs_weeks_7_8=8)),
    ("DECLINING", dict(week=8, installs_weeks_1_2=10, installs_weeks_7_8=7)), ("STALL", dict(week=8)),
    ("CONTINUE", dict(week=12, revenue=301.0, trend="growing")), ("CONTINUE + PLAN APP #2", dict(week=12, revenue=300.0, trend="Growing")),
    ("MAINTAIN MODE", dict(week=12, revenue=100.0)), ("ONE MORE MONTH", dict(week=12, revenue=99.0, trend="growing")), ("KILL", dict(week=12, revenue=99.0)),
    ("KILL OR PIVOT", dict(week=12, revenue=999.0, trend="declining")), ("REVIEW MANUALLY", dict(week=12, revenue=999.0, trend="growing", hours=13))])
def test_checkin(spark, label, row):
    assert one(spark, H.verdict(), **{**CHECK, **row}) == label


def test_scores_of_unknown_values(listing):
    rows = {r["app_key"]: r for r in S.score_apps(listing(
        {"price_cents": None, "total_purchases": None, "last_month_purchases": None, "review_count": None},
        {"price_cents": 50000, "total_purchases": 100, "last_month_purchases": 10, "review_count": 10, "rating_stars": 5.0})).collect()}
    # Unknown: only the default price (0.3 * 0.1) and the empty saturation term (0.1).
    assert (rows["k0000"]["trend_score"], rows["k0000"]["opportunity_score"]) == (0.0, 13.0)
    # Pace 0.1: bonus min(1, ln 3) = 1; saturation min(0.4, 0.5) = 0.4.
    assert (rows["k0001"]["trend_score"], rows["k0001"]["opportunity_score"]) == (100.0, 96.0)


def test_tiers(listing):
    df = listing({"price_cents": 1, "total_purchases": 100}, {"price_cents": 1, "total_purchases": 99}, {"price_cents": 1, "total_purchases": 4},
                 {"price_cents": 1, "total_purchases": None}, {"price_cents": 0, "total_purchases": 500})
    assert [r[0] for r in df.orderBy("app_key").select(B.tier()).collect()] == ["WINNER", "MID", None, "LOSER", None]


def test_certification_and_employees(spark):
    df = spark.createDataFrame([("Gold Partner", "20-200"), ("Silver", "x"), ("Bronze Certification", None), (None, "1 - 19"), ("Ready", "5")], "grade string, employees string")
    assert [tuple(r) for r in df.select(P.level(), P.employees_mid()).collect()] == [(3, 110.0), (2, None), (1, None), (0, 10.0), (0, None)]


def test_region(spark):
    df = spark.createDataFrame([("Acme GmbH", ""), ("Acme AG Holding", ""), ("Stage", ""), ("Acme", "based in Lyon"), ("Acme (DE)", ""), ("idea", "")], "name string, note string")
    plain = [r[0] for r in df.select(P.in_region("name", ["note"])).collect()]
    coded = [r[0] for r in df.select(P.in_region("name", ["note"], codes=P.REGION_CODES)).collect()]
    assert plain == [True, True, False, True, False, False] and coded == [True, True, False, True, True, False]
