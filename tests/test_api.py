from __future__ import annotations

import json

import pytest

from stallwise import api
from stallwise.functions.match import niche
from stallwise.plans import views as V


@pytest.fixture(scope="module")
def snaps(spark, sf):
    return V.snapshots(spark, sf)


def test_trends_use_the_newest_run(snaps):
    rows = api.trends(snaps, 5).collect()
    assert len(rows) == 5 and {r["run_id"] for r in rows} == {"run-3"}
    assert {r["run_id"] for r in api.trends(snaps, 3, "run-1").collect()} == {"run-1"}


def test_reports_have_all_sections(snaps, spark, sf):
    plan = api.planning_stats(snaps, "17.0", ["brand#1"])
    assert all(df.count() > 0 for df in plan.values()) and plan["sizing"].first()["listings"] == 200
    assert api.planning_stats(snaps, "17.0", [], all_runs=True)["sizing"].first()["listings"] == 800
    assert all(df.count() > 0 for df in api.leaderboard(snaps, {"bolts": "display_name LIKE '%bolt%'"}).values())
    report = api.forum_report(V.posts(spark, sf), {"the": "the"}, V.AS_OF, 30, 3)
    assert report["by_signal"].count() == 3 and report["words"].count() == 40


def test_niche_card_and_recommend(snaps):
    got = api.niche(snaps, "bolt", 5)
    assert got["apps"].count() == 5 and got["gate"].first()["verdict"] in ("PASS", "FAIL") and got["totals"].first()["listings"] > 5
    card = api.card(snaps, 2).collect()
    assert len(card) == 2 and all(len(c["competitors"]) == 3 for c in card)
    assert api.niches(snaps, 3, 5).count() == 5
    rec = api.recommend(snaps, [niche("b", "bolt", category="crm", complexity="L"), niche("r", "ring", category="x", complexity="S")], only="b").collect()
    assert [r["label"] for r in rec] == ["b"] and rec[0]["risks"][:2] == ["platform owner competes", "scope too large"]


def test_validate_is_one_row_per_idea(snaps):
    rows = {r["label"]: r for r in api.validate(snaps, [niche("bolts", "bolt"), niche("none", "zeppelin"), niche("wide", "small", "promo")]).collect()}
    assert set(rows) == {"bolts", "wide"} and 0 <= rows["bolts"]["viability"] <= 100 and len(rows["bolts"]["actions"]) == 5


def test_partner_fit_ranks(spark, sf):
    rows = api.partner_fit(V.partners(spark, sf), 10, 3, V.client_refs(spark, sf)).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and rows[0]["fit"] >= rows[2]["fit"]


def test_load_all_is_idempotent(spark, tmp_path):
    for day, run, n in (("2026-05-01", "a", 2), ("2026-05-08", "b", 3)):
        d = tmp_path / "snapshots" / day / run
        d.mkdir(parents=True)
        (d / "run.json").write_text(json.dumps({"run_id": run, "started_at": f"{day}T00:00:00Z"}))
        (d / "apps.json").write_text(json.dumps([{"version": "17.0", "tech_name": f"t{i}", "summary": f"s{i}"} for i in range(n)] + [{"version": "17.0", "tech_name": "t0", "summary": "dup"}]))
    facts = str(tmp_path / "facts")
    for _ in range(2):
        assert api.load_all(spark, str(tmp_path / "snapshots"), facts) == ["a", "b"]
    rows = spark.read.parquet(facts).collect()
    assert sorted((r["run_id"], r["tech_name"], r["summary"]) for r in rows) == [("a", "t0", "s0"), ("a", "t1", "s1"), ("b", "t0", "s0"), ("b", "t1", "s1"), ("b", "t2", "s2")]


def _crawl(root, day, run, names, started=True):
    d = root / day / run
    d.mkdir(parents=True, exist_ok=True)
    meta = {"run_id": run, "started_at": f"{day}T00:00:00+00:00" if started else None, "finished_at": None, "pages_scraped": 2, "total_cards": len(names)}
    (d / "run.json").write_text(json.dumps(meta, indent=2))
    cards = [{"version": "17.0", "tech_name": n, "summary": f"{run} {{{i}"} for i, n in enumerate(names)] + [{"version": "17.0", "tech_name": names[0], "summary": "dup"}, {"version": None, "tech_name": "x"}]
    (d / "apps.json").write_text(json.dumps(cards, indent=2))


def test_load_tables_twice_gives_equal_tables(spark, tmp_path):
    root, tables = tmp_path / "snapshots", str(tmp_path / "tables")
    _crawl(root, "2026-05-08", "b", ["t0", "t2"])
    api.load_tables(spark, str(root), tables)
    _crawl(root, "2026-05-01", "a", ["t0", "t1"])
    seen = []
    for _ in range(2):
        api.load_tables(spark, str(root), tables)
        seen.append({t: sorted(map(str, spark.read.parquet(f"{tables}/{t}").collect())) for t in ("runs", "apps", "snapshots")})
    assert seen[0] == seen[1]
    facts = spark.read.parquet(f"{tables}/snapshots").collect()
    assert sorted((r["run_id"], r["app_key"], r["summary"]) for r in facts) == [("a", "17.0/t0", "a {0"), ("a", "17.0/t1", "a {1"), ("b", "17.0/t0", "b {0"), ("b", "17.0/t2", "b {1")]
    assert sorted(r["snapshot_id"] for r in facts) == [1, 2, 3, 4]
    apps = {r["tech_name"]: (str(r["first_seen"])[:10], str(r["last_seen"])[:10]) for r in spark.read.parquet(f"{tables}/apps").collect()}
    assert apps == {"t0": ("2026-05-01", "2026-05-08"), "t1": ("2026-05-01", "2026-05-01"), "t2": ("2026-05-08", "2026-05-08")}
    assert {(r["run_id"], r["page_count"], r["app_count"]) for r in spark.read.parquet(f"{tables}/runs").collect()} == {("a", 2, 2), ("b", 2, 2)}
    _crawl(root, "2026-05-09", "c", ["t0"], started=False)
    with pytest.raises(ValueError):
        api.load_tables(spark, str(root), tables)
