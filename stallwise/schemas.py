"""Explicit schemas of the tables the operators consume, as DDL text."""

from __future__ import annotations

import re


def fields(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    return re.findall(r"(\w+) (?:string|bigint|double|timestamp|boolean|array<string>)", ddl)


RUN = (
    "run_id string, started_at timestamp, finished_at timestamp, page_count bigint, app_count bigint, note string"
)
CARD = (
    "tech_name string, version string, detail_url string, display_name string, summary string, author string,"
    "price_cents bigint, currency string, rating_stars double, review_count bigint, total_purchases bigint,"
    "last_month_purchases bigint, image_url string"
)
APP = ("app_key string, tech_name string, version string, first_seen timestamp, last_seen timestamp")
SNAPSHOT = (
    "snapshot_id bigint, run_id string, app_key string, captured_at timestamp, display_name string, summary string,"
    "author string, price_cents bigint, currency string, rating_stars double, review_count bigint,"
    "total_purchases bigint, last_month_purchases bigint, image_url string, detail_url string"
)
SCORE = ("run_id string, app_key string, trend_score double, opportunity_score double")
POST = (
    "id string, fullname string, community string, title string, selftext string, author string, score bigint,"
    "num_comments bigint, created_utc bigint, permalink string, url string, flair string, is_self boolean,"
    "over_18 boolean, signals array<string>, fetched_via string, first_seen_utc bigint, last_seen_utc bigint"
)
EXPORT_ITEM = (
    "id string, kind string, created_utc double, community string, title string, link_title string, url string,"
    "permalink string, score bigint, num_comments bigint, selftext string, body string"
)
LISTING_PAGE = (
    "data struct<children: array<struct<kind: string, data: struct<id: string, community: string, title: string,"
    "selftext: string, author: string, score: bigint, num_comments: bigint>>>>"
)
PARTNER = (
    "partner_id string, name string, grade string, country string, country_slug string, industries string,"
    "employees string, url string, crawled_at string"
)
CLIENT_REF = (
    "partner_id string, partner_name string, partner_country string, client_name string, client_industry string,"
    "description string, crawled_at string"
)
PARTNER_PROFILE = (
    "partner_name string, location string, website string, email string, phone string, certification string,"
    "employees string, industries array<string>, clients array<string>, join_date string, description string"
)
VIDEO = ("title string, id string, views bigint, duration_s bigint, upload_date string, url string")
