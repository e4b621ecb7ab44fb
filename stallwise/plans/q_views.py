"""The fixture views themselves, as checks of the shared base."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.operators import partners as P
from stallwise.plans import views as V
from stallwise.plans.registry import query

_STR = lambda c: F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


@query("view_runs", "SELECT run_id, strftime(started_at, '%Y-%m-%d') AS started_at FROM runs")
def view_runs(spark, sf):
    return V.runs(spark, sf).select("run_id", _STR("started_at"))


@query("view_snapshots", """SELECT run_id, strftime(captured_at, '%Y-%m-%d') AS captured_at, app_key, price_cents, rating_stars,
    review_count, total_purchases, last_month_purchases FROM snapshots""")
def view_snapshots(spark, sf):
    return V.snapshots(spark, sf).select("run_id", _STR("captured_at"), "app_key", "price_cents", "rating_stars",
                                         "review_count", "total_purchases", "last_month_purchases")


@query("view_partners", """SELECT partner_id, name, country, grade, array_to_string(industries, ',') AS industries, len(clients) AS n_clients,
    array_to_string(clients[1:3], ',') AS clients, employees, email, phone, website FROM partners""")
def view_partners(spark, sf):
    known = V.partners(spark, sf).join(P.first_clients(V.client_refs(spark, sf)), F.col("partner_id") == F.col("_partner"), "left")
    return known.select("partner_id", "name", "country", "grade", F.array_join("industries", ",").alias("industries"), F.coalesce("n_clients", F.lit(0).cast("long")).alias("n_clients"),
                        F.coalesce(F.array_join("clients", ","), F.lit("")).alias("clients"), "employees", "email", "phone", "website")


@query("view_checkins", "SELECT * FROM checkins")
def view_checkins(spark, sf):
    return V.checkins(spark, sf)
