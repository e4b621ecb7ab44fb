"""Registered queries of this folder and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import ann, chat, cosine_dups, html_text, language, packing, pieces, quality, repair, simhash, spelling, token_orc, toxicity
from stallwise.llm.common import held_out, table, written
from stallwise.session import fresh_path

#: Where every machine has the files of the public tokenizers.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOXIC_FROM, GOOD_FROM = 0.5, 0.3


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts are full of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    chats = chat.format_chats(chat.from_turns(rows.unionByName(extra)))
    return chat.digests(chats).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "layout")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.cut(table(spark, sf_dir, "documents"), BYTE_BPE, ids=False)
    return packing.place(cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_path(spark, "tokens.orc")
    token_orc.write(table(spark, sf_dir, "documents"), target, BYTE_BPE)
    tokens = token_orc.read(spark, target)
    sums = token_orc.checksums(tokens).withColumnRenamed("n_read", "n_tokens")
    return sums.join(token_orc.starts(tokens), ["part", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = pieces.encode(table(spark, sf_dir, "documents"), PIECES, decoded="decoded", keep=["doc_id"])
    return read.select("doc_id", (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"), F.sha2("piece_ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op9_cosine_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_dups.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 7


def misspelled_words(docs: DataFrame) -> DataFrame:
    """Words of at least seven letters and their number, some occurrences with a letter taken out by a checksum of document and word.

    Shorter runs can't become long enough, so the pattern leaves them out.  A null id reads as ``null``.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc"),
                       F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\u00C0-\u00FF]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    low = runs.select("doc", F.translate("run", CAPITALS, SMALL).alias("low"))
    marked = low.select("low", F.crc32(F.encode(F.concat_ws(":", "doc", "low"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("low")).cast("int")
    cut = F.concat(F.substring("low", F.lit(1), at), F.substring("low", at + 2, F.length("low")))
    words = marked.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("low")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written(misspelled_words(table(spark, sf_dir, "documents")), "words")
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults dealt by a checksum of conversation and turn; nulls become one space."""
    space = F.lit(" ")
    named = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    dealt = named.withColumn("fault", F.crc32(key.cast("binary")) % 20).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    return dealt.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    fixed = repair.repair(damaged(rows))
    found = fixed.summary.withColumnRenamed("conv_id", "c")
    lines = repair.digests(fixed.turns).withColumnRenamed("conv_id", "d")
    all_ids = rows.select("conv_id").distinct()
    joined = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(lines, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_toxicity, op3_packing, op4_nearest, op5_token_orc, op6_sentence_pieces, op7_quality, op8_simhash, op9_cosine_dups, op10_html_text, op11_spelling, op12_repair, op13_language, pipeline)}

#: The same conversations read turn by turn; the template adds 20 characters to a turn, an escape one for each control string.
CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')::VARCHAR[]) AS shown,
         length(role) + length(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')::VARCHAR[]) AS shown_role FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(shown + shown_role + 20)::BIGINT AS formatted_chars, 'messages' AS layout
FROM sized GROUP BY conv_id
"""

#: Brute force over all pairs of one label, and the closure over their links.
COSINE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id, e.vec_id <= coalesce(l.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

#: CRC-32 of a list of byte values ``b``, by a table that is made from its polynomial.
CRC_TABLE = """
crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) AS r(i)))"""
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256)), 4294967295)"

#: The damage, and the cheapest edits by a fold over each conversation's rows that keeps the best (cost, audit) of the four states.
REPAIR_SQL = r"""
WITH """ + CRC_TABLE + r""",
dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, """ + CRC + r""" % 20 AS fault
  FROM (SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS b FROM conversations), crc_table),
rows AS (
  SELECT conv_id, turn, copy, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE fault <> 0)),
placed AS (
  SELECT *, row_number() OVER w AS nth, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS same,
    left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN same > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
lists AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE nth > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list({'ch': initial, 'gone': CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE 0 END, 'e': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END,
          'n': {'c': 0, 'a': ''}, 's': {'c': 0, 'a': ''}, 'u': {'c': 0, 'a': ''}, 'z': {'c': 0, 'a': ''}} ORDER BY nth) AS l
  FROM faulty GROUP BY conv_id),
folded AS (
  SELECT *, list_reduce(list_concat([{'ch': '', 'gone': 0, 'e': 0, 'n': {'c': 0, 'a': ''}, 's': {'c': 1000000, 'a': ''}, 'u': {'c': 3, 'a': 'I'}, 'z': {'c': 6, 'a': 'II'}}], l),
    lambda p, r: list_transform(list_transform([{
      'n': {'c': p.n.c + 4, 'a': p.n.a || 'D'},
      's': list_sort([{'c': p.s.c + 4, 'a': p.s.a || 'D'}, {'c': p.n.c + r.e + r.gone + CASE WHEN r.ch = 's' THEN 0 ELSE 1000000 END, 'a': p.n.a || 'K'}])[1],
      'u': list_sort(list_concat([{'c': p.u.c + 4, 'a': p.u.a || 'D'}], list_concat(
        list_transform([p.n, p.s, p.z], lambda f: {'c': f.c + r.e + r.gone + CASE WHEN r.ch = 'u' THEN 0 ELSE 1000000 END, 'a': f.a || 'K'}),
        list_transform([p.n, p.s, p.z], lambda f: {'c': f.c + r.e + r.gone + 3, 'a': f.a || 'R'}))))[1],
      'z': list_sort([{'c': p.z.c + 4, 'a': p.z.a || 'D'}, {'c': p.u.c + r.e + r.gone + CASE WHEN r.ch = 'a' THEN 0 ELSE 1000000 END, 'a': p.u.a || 'K'},
                      {'c': p.u.c + r.e + r.gone + 3, 'a': p.u.a || 'R'}])[1]}],
      lambda q: {'n': q.n, 's': q.s, 'z': q.z, 'u': list_sort([q.u, {'c': q.n.c + 3, 'a': q.n.a || 'I'}, {'c': q.s.c + 3, 'a': q.s.a || 'I'}, {'c': q.z.c + 3, 'a': q.z.a || 'I'}])[1]}),
      lambda q: {'ch': '', 'gone': 0, 'e': 0, 'n': q.n, 's': q.s, 'u': q.u, 'z': list_sort([q.z, {'c': q.u.c + 3, 'a': q.u.a || 'I'}])[1]})[1]) AS f
  FROM lists),
best AS (SELECT *, list_sort([f.n, f.z])[1] AS b FROM folded),
letters AS (
  SELECT conv_id, length(b.a) - length(replace(b.a, 'D', '')) AS gone, b.a AS audit, unnest(range(1, length(b.a) + 1)) AS i, substr(b.a, i, 1) AS letter FROM best),
walked AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS nth, count(*) FILTER (WHERE letter <> 'D') OVER w - 1 - (length(audit) - gone) % 2 AS said
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
said AS (
  SELECT w.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN p.role WHEN said % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE p.text END, chr(10) ORDER BY i)) AS h
  FROM walked w LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.nth = w.nth WHERE letter <> 'D' GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.b.c, 0)::BIGINT AS cost, coalesce(best.b.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM o.conv_id
"""

#: Near words share what is left after one letter is masked, or is the other word after one letter is taken out.
SPELLING_SQL = r"""
WITH RECURSIVE """ + CRC_TABLE + r""",
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
lows AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT low, times, """ + CRC + r""" AS h FROM (
    SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, 'null') || ':' || low, ''),
      lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS b FROM lows), crc_table),
spelt AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(low, 1, h % length(low)) || substr(low, h % length(low) + 2) ELSE low END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
places AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS masked, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM places a JOIN places b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT p.word, w.word, w.n FROM places p JOIN words w ON p.cut = w.word
  UNION SELECT w.word, p.word, p.n FROM places p JOIN words w ON p.cut = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top_n, arg_min(near, (-near_n, near)) AS top FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form, CASE WHEN top_n >= 10 * n THEN top_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, word AS last, 0 AS step FROM forms
  UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON f.word = walk.last WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, step) AS root FROM walk GROUP BY word)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms f JOIN ends e ON e.word = f.word
"""

ORACLES: dict[str, str] = {"op1_chat_format": CHAT_SQL, "op9_cosine_dups": COSINE_SQL, "op11_spelling": SPELLING_SQL, "op12_repair": REPAIR_SQL}
