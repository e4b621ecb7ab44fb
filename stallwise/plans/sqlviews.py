"""DuckDB text of the same views, as CTEs an oracle query can name."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "caps": """SELECT k::INT AS k, m - k * INTERVAL 90 DAY AS cap
        FROM (SELECT max(l_shipdate) AS m FROM lineitem), range(4) t(k)""",
    "runs": "SELECT 'run-' || (3 - k) AS run_id, cap AS started_at FROM caps",
    "facts": """SELECT p_partkey, k, any_value(cap) AS cap, count(l_partkey) AS n, coalesce(sum(l_quantity), 0)::BIGINT AS q,
        count_if(l_shipdate > cap - INTERVAL 30 DAY) AS m,
        coalesce(sum(CASE WHEN l_shipdate > cap - INTERVAL 30 DAY THEN l_quantity END), 0)::BIGINT AS mq,
        count_if(l_returnflag = 'R') AS r, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS rq
        FROM part CROSS JOIN caps LEFT JOIN lineitem ON l_partkey = p_partkey AND l_shipdate <= cap GROUP BY p_partkey, k""",
    "snapshots": """SELECT 'run-' || (3 - k) AS run_id, cap AS captured_at,
        (16 + p_partkey % 4) || '.0/' || replace(p_name, ' ', '_') || '/' || p_partkey AS app_key,
        (16 + p_partkey % 4) || '.0' AS version, replace(p_name, ' ', '_') AS tech_name,
        p_name AS display_name, p_type || ' ' || p_brand AS summary, p_brand AS author,
        (CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 17 = 0 THEN NULL
              ELSE floor(p_retailprice * 100 / (1 + p_size)) END)::BIGINT AS price_cents,
        '$' AS currency,
        CASE WHEN p_partkey % 7 = 0 OR r = 0 THEN NULL
             ELSE least(5e0, greatest(1e0, floor(rq / 5e0))) END AS rating_stars,
        (CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE r END)::BIGINT AS review_count,
        (CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN q ELSE n END)::BIGINT AS total_purchases,
        (CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN mq ELSE m END)::BIGINT AS last_month_purchases,
        '/apps/' || (16 + p_partkey % 4) || '.0/' || replace(p_name, ' ', '_') || '/' || p_partkey AS detail_url,
        NULL::VARCHAR AS image_url, p_partkey AS file_pos, r AS return_lines
        FROM facts JOIN part USING (p_partkey)""",
    "listings": "SELECT * FROM snapshots WHERE run_id = 'run-3'",
    "apps": """SELECT app_key, tech_name, version, min(captured_at) AS first_seen, max(captured_at) AS last_seen
        FROM snapshots GROUP BY ALL""",
    "posts": """SELECT doc_id AS id, source AS community, split_part(text, chr(10), 1) AS title, text AS selftext,
        'u' || doc_id % 50 AS author, n_chars % 100 AS score, n_chars % 17 AS num_comments,
        DATE '2024-01-01' + (doc_id % 30)::INT AS first_seen, '/p/' || doc_id AS permalink FROM documents""",
    "comments": """SELECT conv_id * 1000 + turn AS id, role AS author, 'c' || conv_id % 20 AS community,
        conv_id AS link_title, text AS body, (length(text) % 100)::BIGINT AS score,
        DATE '2024-01-01' + (conv_id % 400)::INT AS created FROM conversations""",
    "videos": """SELECT conv_id * 1000 + turn AS id, text AS title, (conv_id * 1000 + turn) * 37 % 10007 AS views,
        (conv_id * 1000 + turn) % 1800 AS duration_s,
        strftime(DATE '2024-01-01' + (conv_id % 400)::INT, '%Y%m%d') AS upload_date FROM conversations""",
    "client_refs": """SELECT DISTINCT l_suppkey AS partner_id, c_custkey AS client_id, c_name AS client_name,
        c_mktsegment AS client_industry
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "partners": """SELECT s_suppkey AS partner_id, s_name AS name, n_name AS country,
        CASE WHEN s_acctbal > 7500 THEN 'Gold' WHEN s_acctbal > 4000 THEN 'Silver' WHEN s_acctbal > 0 THEN 'Ready' ELSE 'Unknown' END AS grade,
        coalesce((SELECT list_sort(list(DISTINCT p_type)) FROM part WHERE p_partkey % (SELECT count(*) FROM supplier) = s_suppkey), []::VARCHAR[]) AS industries,
        coalesce((SELECT list_sort(list(client_name)) FROM client_refs r WHERE r.partner_id = s_suppkey), []::VARCHAR[]) AS clients,
        (s_suppkey % 50) || '-' || (s_suppkey % 50 + 10 * (s_suppkey % 40)) AS employees,
        CASE WHEN s_suppkey % 2 = 0 THEN 'p' || s_suppkey || '@example.com' END AS email,
        CASE WHEN s_suppkey % 3 = 0 THEN '+1 555 ' || s_suppkey END AS phone,
        CASE WHEN s_suppkey % 5 = 0 THEN 'https://p' || s_suppkey || '.example.com' END AS website,
        'serves ' || lower(n_name) AS description, s_acctbal / 100 AS balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "checkins": """SELECT app_key, CASE run_id WHEN 'run-0' THEN 2 WHEN 'run-1' THEN 4 WHEN 'run-2' THEN 8 ELSE 12 END AS week,
        total_purchases AS installs_total, return_lines % 5 AS refunds_total, review_count AS reviews_count,
        total_purchases * 10 AS listing_visitors, file_pos % 4 AS bug_reviews, before AS installs_weeks_1_2,
        last AS installs_weeks_7_8, coalesce(price_cents, 0) / 1e2 * last AS revenue,
        CASE WHEN last > before THEN 'growing' WHEN last = before THEN 'flat' ELSE 'declining' END AS trend,
        file_pos % 25 AS hours, 1 + file_pos % 10 AS motivation
        FROM (SELECT *, coalesce(last_month_purchases, 0) AS last, coalesce(lag(coalesce(last_month_purchases, 0))
              OVER (PARTITION BY app_key ORDER BY captured_at), 0) AS before FROM snapshots)""",
}

# Scores per listing: 90th percentiles of the run, then the two weighted sums.
VIEWS["scored"] = """SELECT *,
        floor(1e2 * (0.6e0 * nl + 0.3e0 * nr + 0.1e0 * bonus) * 1e2 + 0.5) / 1e2 AS trend_score,
        floor(1e2 * (0.4e0 * nt + 0.3e0 * price + 0.2e0 * stars + 0.1e0 * (1e0 - sat)) * 1e2 + 0.5) / 1e2 AS opportunity_score
        FROM (SELECT l.*,
            CASE WHEN last_month_purchases IS NULL OR coalesce(pl, 0) = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, last_month_purchases / pl)) END AS nl,
            CASE WHEN review_count IS NULL OR coalesce(pr, 0) = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, review_count / pr)) END AS nr,
            CASE WHEN total_purchases IS NULL OR coalesce(pt, 0) = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, total_purchases / pt)) END AS nt,
            CASE WHEN last_month_purchases > 0 AND total_purchases > 0 AND last_month_purchases / total_purchases > 0.05e0
                 THEN least(1e0, ln(1e0 + 20e0 * (last_month_purchases / total_purchases))) ELSE 0e0 END AS bonus,
            CASE WHEN price_cents IS NULL THEN 0.1e0 ELSE least(1e0, price_cents / 1e2 / 5e2) END AS price,
            coalesce(rating_stars, 0e0) / 5e0 AS stars,
            CASE WHEN review_count > 0 AND total_purchases > 0 THEN least(0.4e0, 5e0 * (review_count / total_purchases)) ELSE 0e0 END AS sat
            FROM listings l, (SELECT quantile_cont(last_month_purchases, 0.9) AS pl, quantile_cont(review_count, 0.9) AS pr,
                                     quantile_cont(total_purchases, 0.9) AS pt FROM listings))"""


def rnd(expr: str, places: int = 0) -> str:
    return f"(floor(({expr})::DOUBLE * 1e{places} + 0.5e0) / 1e{places})"


def long_counts(sql: str) -> str:
    """Conditional counts as BIGINT; DuckDB counts them in 128 bits."""
    out = []
    for m in re.finditer(r"\bcount_if\(", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(end)
    for end in sorted(out, reverse=True):
        tail = re.match(r" (OVER|FILTER) \(", sql[end:])
        if not tail:
            sql = sql[:end] + "::BIGINT" + sql[end:]
    return sql


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it names, dependencies first."""
    views = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for name in views:
            if name not in order and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b(?!\.)", text) and text is not views[name]:
                need(views[name])
                order.append(name)

    need(sql)
    if not order:
        return long_counts(sql)
    return long_counts("WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in order) + "\n" + sql)
