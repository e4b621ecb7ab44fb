"""Posts, comments, videos and their words."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import columns as C, match as M, tokens as T
from stallwise.functions.match import niche
from stallwise.operators import forum as P, market as K
from stallwise.plans import views as V
from stallwise.plans.registry import query
from stallwise.plans.sqlviews import rnd

_W = lambda w: f"(^|[^a-z0-9_])({w})($|[^a-z0-9_])"
SIGNALS = {"licence": _W("licen[sc]ed?|license"), "contact": r"[a-z0-9.]@[a-z0-9.]", "german": _W("nicht|und|sich"), "french": _W("dans|pour|avec"),
           "english": _W("this|that|with"), "worth": "worth(less)?", "phone": r"\(?[0-9]{3}\)? [0-9]{3}-[0-9]{4}"}
NEEDS = {"licence": ["licen"], "contact": ["@"], "german": ["nicht", "und", "sich"], "french": ["dans", "pour", "avec"],
         "english": ["this", "that", "with"], "worth": ["worth"]}
TOPICS = ["the", "ing ", "tion", "nicht", "pour", "license", "thin", "mail", "er er", "zeppelin"]
THEMES = [niche("mail", "@", "mail"), niche("german", "nicht", " und "), niche("french", "dans", "avec"), niche("tion", "tion"), niche("none", "zeppelin")]
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
TAG = {"tagged": "SELECT *, list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(title || chr(10) || selftext), '{p}') THEN '{n}' END" for n, p in SIGNALS.items()) + "], lambda x: x IS NOT NULL) AS signals FROM posts"}


def tagged(spark, sf):
    return P.tag_signals(V.posts(spark, sf), SIGNALS, NEEDS)


@query("tag_signals", "SELECT id, array_to_string(signals, ',') AS signals FROM tagged", TAG)
def tag_signals(spark, sf):
    return tagged(spark, sf).select("id", F.array_join("signals", ",").alias("signals"))


@query("agg_signal_counts", "SELECT signal, count(*) AS n FROM (SELECT unnest(signals) AS signal FROM tagged) GROUP BY 1", TAG)
def agg_signal_counts(spark, sf):
    return P.signal_counts(tagged(spark, sf))


@query("flt_relevant_posts", "SELECT id FROM posts WHERE community IN ('src1', 'src2') OR contains(lower(title), 'license') OR contains(lower(selftext), 'license')")
def flt_relevant_posts(spark, sf):
    return P.relevant(V.posts(spark, sf), ["src1", "src2"], ["license"]).select("id")


@query("flt_recent_window", "SELECT id FROM posts WHERE first_seen >= DATE '2024-01-31' - 7")
def flt_recent_window(spark, sf):
    return P.recent(V.posts(spark, sf), V.AS_OF, 7).select("id")


@query("flt_has_signal", "SELECT id FROM tagged WHERE list_contains(signals, 'contact')", TAG)
def flt_has_signal(spark, sf):
    return P.with_signal(tagged(spark, sf), "contact").select("id")


@query("flt_signal_isin", "SELECT signal, count(*) AS n FROM (SELECT unnest(signals) AS signal FROM tagged) WHERE signal IN ('licence', 'german') GROUP BY 1", TAG)
def flt_signal_isin(spark, sf):
    return P.signal_counts(tagged(spark, sf)).filter(F.col("signal").isin("licence", "german"))


@query("flt_repeat_authors", "SELECT author, count(*) AS n FROM posts WHERE author NOT IN ('', '[deleted]') GROUP BY 1 HAVING count(*) > 1")
def flt_repeat_authors(spark, sf):
    named = V.posts(spark, sf).filter(~F.col("author").isin("", "[deleted]"))
    return named.groupBy("author").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("agg_posts_by_sub", "SELECT community, count(*) AS posts, sum(score)::BIGINT AS score, sum(num_comments)::BIGINT AS comments FROM posts GROUP BY 1 ORDER BY posts DESC, community LIMIT 20")
def agg_posts_by_sub(spark, sf):
    return P.by_community(V.posts(spark, sf))


@query("agg_repeat_authors", """SELECT author, count(*) AS n, string_agg(DISTINCT community, ', ' ORDER BY community) AS communities FROM posts
    GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, author LIMIT 15""")
def agg_repeat_authors(spark, sf):
    return P.repeat_authors(V.posts(spark, sf))


@query("agg_window_totals", "SELECT count(*) AS all_posts, count_if(first_seen >= DATE '2024-01-31' - 7) AS in_window FROM posts")
def agg_window_totals(spark, sf):
    return P.window_totals(V.posts(spark, sf), V.AS_OF, 7)


@query("top_posts_by_signal", """SELECT signal, rank, id, engagement, strftime(first_seen, '%Y-%m-%d') AS day, array_to_string(list_filter(signals, lambda x: x <> signal), ',') AS also
    FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY engagement DESC, id) AS rank FROM (SELECT *, score + 2 * num_comments AS engagement, unnest(signals) AS signal
    FROM tagged WHERE first_seen >= DATE '2024-01-31' - 14)) WHERE rank <= 10""", TAG)
def top_posts_by_signal(spark, sf):
    return P.top_by_signal(tagged(spark, sf), V.AS_OF, 14, 10)


@query("top_posts", "SELECT id, score FROM posts ORDER BY score DESC, id LIMIT 15")
def top_posts(spark, sf):
    return K.top(V.posts(spark, sf).select("id", "score"), [K.desc("score"), F.col("id")], 15)


@query("top_comments", "SELECT id, score, substring(replace(body, chr(10), ' '), 1, 300) AS body FROM comments ORDER BY score DESC, id LIMIT 25")
def top_comments(spark, sf):
    best = K.top(V.comments(spark, sf), [K.desc("score"), F.col("id")], 25)
    return best.select("id", "score", F.substring(F.replace("body", F.lit("\n"), F.lit(" ")), 1, 300).alias("body"))


@query("longest_comments", "SELECT id, length(body) AS chars FROM comments ORDER BY chars DESC, id LIMIT 15")
def longest_comments(spark, sf):
    return K.top(V.comments(spark, sf).select("id", F.length("body").alias("chars")), [K.desc("chars"), F.col("id")], 15)


@query("agg_activity_window", f"""SELECT strftime(a, '%Y-%m-%d') AS first, strftime(b, '%Y-%m-%d') AS last, d AS span_days, n, {rnd('n * 30e0 / d', 2)} AS per_30_days FROM (
    SELECT min(created) AS a, max(created) AS b, greatest(1, max(created) - min(created)) AS d, count(*) AS n FROM comments)""")
def agg_activity_window(spark, sf):
    return P.activity_window(V.comments(spark, sf), "created")


@query("agg_subreddit_counts", """SELECT * FROM (SELECT 'posts' AS kind, community, count(*) AS n FROM posts GROUP BY 2 ORDER BY n DESC, community LIMIT 15) UNION ALL
    SELECT * FROM (SELECT 'comments', community, count(*) AS n FROM comments GROUP BY 2 ORDER BY n DESC, community LIMIT 15)""")
def agg_subreddit_counts(spark, sf):
    count = lambda df, kind: K.top(df.groupBy("community").agg(F.count(F.lit(1)).alias("n")), [K.desc("n"), F.col("community")], 15).select(F.lit(kind).alias("kind"), "community", "n")
    return count(V.posts(spark, sf), "posts").unionByName(count(V.comments(spark, sf), "comments"))


_COND = lambda words: " OR ".join(f"contains(lower(body), '{w}')" for w in words)


@query("flt_themes", "SELECT theme, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY score DESC, id) AS rank FROM ("
       + " UNION ALL ".join(f"SELECT '{t.label}' AS theme, id, score FROM comments WHERE {_COND(t.keywords)}" for t in THEMES)
       + " UNION ALL SELECT 'recent', id, score FROM comments WHERE created > DATE '2024-10-01')) WHERE rank <= 8")
def flt_themes(spark, sf):
    recent = {"recent": F.col("created") > F.lit("2024-10-01").cast("date")}
    return P.themes(V.comments(spark, sf), "body", THEMES, K.desc("score"), 8, recent).select("theme", "id", "rank")


@query("set_dedupe_posts", """SELECT id, CASE WHEN score > 60 THEN 'hot' ELSE 'new' END AS via, array_to_string(list_sort(list_distinct(list_concat(signals,
    CASE WHEN score > 60 THEN ['hot'] ELSE []::VARCHAR[] END, CASE WHEN num_comments > 8 THEN ['talk'] ELSE []::VARCHAR[] END))), ',') AS signals FROM tagged""", TAG)
def set_dedupe_posts(spark, sf):
    t = tagged(spark, sf).select("id", "score", "num_comments", "signals")
    copy = lambda df, via, pos, tag: df.select("id", F.lit(via).alias("via"), F.lit(pos).alias("pos"), (F.array_append("signals", F.lit(tag)) if tag else F.col("signals")).alias("signals"))
    copies = copy(t.filter("score > 60"), "hot", 0, "hot").unionByName(copy(t, "new", 1, None)).unionByName(copy(t.filter("num_comments > 8"), "search", 2, "talk"))
    return P.dedupe_posts(copies, "pos").select("id", "via", F.array_join("signals", ",").alias("signals"))


@query("agg_token_freq", f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(title || ' ' || selftext), '{T.POST_TOKEN}')) AS token FROM posts)
    WHERE NOT list_contains({_LIST(T.FORUM_STOPWORDS)}, token) GROUP BY 1 ORDER BY n DESC, token LIMIT 40""")
def agg_token_freq(spark, sf):
    return P.token_freq(V.posts(spark, sf))


@query("agg_terms_bigrams", f"""SELECT term, n FROM (SELECT kind, term, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, term) AS r FROM (
    SELECT 0 AS kind, unnest(w) AS term FROM clean UNION ALL SELECT 1, unnest(list_transform(list_zip(w[1:len(w)-1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2])) FROM clean WHERE len(w) > 1)
    GROUP BY 1, 2) WHERE r <= 40 AND n >= 2 ORDER BY n DESC, term LIMIT 50""",
       {"clean": f"""SELECT list_filter(list_transform(regexp_extract_all(title, '{T.NAME_TOKEN}'), lambda t: lower(t)),
        lambda t: length(t) > 2 AND NOT list_contains({_LIST(T.TITLE_STOPWORDS)}, t)) AS w FROM videos"""})
def agg_terms_bigrams(spark, sf):
    return P.terms_bigrams(V.videos(spark, sf))


_CAP = lambda e: f"upper({e}[1]) || substring({e}, 2)"
_PAIR_TITLE = f"{_CAP('split_part(display_name, chr(32), 1)')} || ' to ' || {_CAP('split_part(display_name, chr(32), 2)')} || ', ' || author || ' with Old and New'"


@query("agg_pair_patterns", f"""SELECT source, target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '{P.PAIR}', 1)) AS source, unnest(regexp_extract_all(t, '{P.PAIR}', 2)) AS target
    FROM (SELECT {_PAIR_TITLE} AS t FROM listings)) WHERE length(source) >= 3 AND length(target) >= 3 AND NOT list_contains({_LIST(T.TITLE_STOPWORDS)}, lower(source))
    AND NOT list_contains({_LIST(T.TITLE_STOPWORDS)}, lower(target)) GROUP BY 1, 2 ORDER BY n DESC, source, target LIMIT 30""")
def agg_pair_patterns(spark, sf):
    word = lambda i: F.initcap(F.split_part("display_name", F.lit(" "), F.lit(i)))
    titles = V.listings(spark, sf).select(F.concat(word(1), F.lit(" to "), word(2), F.lit(", "), F.col("author"), F.lit(" with Old and New")).alias("title"))
    return P.pair_patterns(titles)


@query("agg_topic_counts", "SELECT topic, n FROM (SELECT topic, sum((length(lower(body)) - length(replace(lower(body), topic, ''))) // length(topic))::BIGINT AS n FROM comments, (VALUES "
       + ", ".join(f"('{t}')" for t in TOPICS) + ") t(topic) GROUP BY 1) WHERE n >= 3 ORDER BY n DESC, topic LIMIT 40")
def agg_topic_counts(spark, sf):
    return P.topic_counts(V.comments(spark, sf), "body", TOPICS)


@query("agg_channel_summary", f"SELECT count(*) AS videos, sum(views)::BIGINT AS views, {rnd('avg(duration_s) / 60e0', 2)} AS mean_minutes, min(upload_date) AS first, max(upload_date) AS last FROM videos")
def agg_channel_summary(spark, sf):
    return P.channel_summary(V.videos(spark, sf))


@query("top_videos", "SELECT id, views, duration_s // 60 AS minutes FROM videos ORDER BY views DESC, id LIMIT 30")
def top_videos(spark, sf):
    return P.top_videos(V.videos(spark, sf))
