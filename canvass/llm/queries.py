"""The operators as queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.bpe import bpe
from canvass.llm.chats import format_chats
from canvass.llm.decontaminate import benchmark_hits
from canvass.llm.language import language_id
from canvass.llm.near_dedup import near_duplicates
from canvass.llm.near_vectors import near_vectors
from canvass.llm.phrases import collocations
from canvass.llm.quality import quality_rules
from canvass.llm.repair import damaged, repaired
from canvass.llm.substring_dedup import substring_dedup
from canvass.llm.suffix_dedup import suffix_dedup
from canvass.llm.toxicity import toxicity
from canvass.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sha2(F.col("kept").cast("binary"), 256)
    return substring_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", kept).drop("kept")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


def op6_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = format_chats(table(spark, sf_dir, "conversations"))
    return chats.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repaired(conversations, damaged(conversations))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("word_distance", "class_distance")


# islands of covered tokens from the starts f(doc_id, p) of covered windows
ISLANDS = """
 g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {w} THEN 0 ELSE 1 END AS opens FROM f),
 i AS (SELECT doc_id, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS island, p FROM g),
 s AS (SELECT doc_id, min(p) AS b, max(p) + {w} AS e FROM i GROUP BY doc_id, island),
 n AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM s)"""

OP1_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 c AS (SELECT doc_id, k, substr(h, 2000 * k + 1, 2098) AS part
       FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM d)),
 w AS (SELECT doc_id, 1000 * k + q AS p, substr(part, 2 * q + 1, 100) AS t
       FROM (SELECT doc_id, k, part, unnest(range(0, least(1000, len(part) // 2 - 49))) AS q FROM c)),
 f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY t) AS m FROM w) WHERE m < doc_id),
""" + ISLANDS.format(w=50) + """,
 k AS (SELECT n.doc_id, sum(e - b) AS removed, count(*) AS spans, max(e) AS last,
              string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (b - before))::BIGINT), '' ORDER BY b) AS kept
       FROM n JOIN d USING (doc_id) GROUP BY n.doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

OP3_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS h FROM documents),
 w AS (SELECT doc_id, p, array_to_string(h[p + 1:p + 20], ' ') AS t
       FROM (SELECT doc_id, h, unnest(range(0, len(h) - 19)) AS p FROM d)),
 f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
""" + ISLANDS.format(w=20) + """,
 k AS (SELECT n.doc_id, sum(e - b) AS removed, max(e) AS last,
              flatten(list(h[(before + 1)::BIGINT:b] ORDER BY b)) AS kept
       FROM n JOIN d USING (doc_id) GROUP BY n.doc_id)
SELECT doc_id, CAST(len(h) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_concat(coalesce(kept, []), h[(coalesce(last, 0) + 1)::BIGINT:]), ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

OP5_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
 d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
 v AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS fives FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(flatten(list_transform(fives, lambda v: list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> s) & 31) + 1 AS BIGINT), 1)))), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM v"""

OP6_SQL = """WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
 c AS (SELECT conv_id, count(*) AS n, list(md5(turn || ' ' || role || ' ' || text) ORDER BY turn, role, text) AS steps,
              string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
       FROM t GROUP BY conv_id),
 p AS (SELECT DISTINCT array_to_string(steps[1:k], ' ') AS prefix
       FROM (SELECT steps, unnest(range(1, n)) AS k FROM c)),
 w AS (SELECT *, row_number() OVER (PARTITION BY steps ORDER BY conv_id) AS r, count(*) OVER (PARTITION BY steps) AS copies FROM c)
SELECT conv_id, n AS n_turns, copies, sha256(text) AS text_sha256 FROM w
WHERE r = 1 AND array_to_string(steps, ' ') NOT IN (SELECT prefix FROM p)"""

OP9_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 s AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a, s b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
 r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
 n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)"""

# forward over the turns: the cheapest edits to each state, least initials first; up to two inserts stand between turns
OP11_SQL = r"""WITH RECURSIVE crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)),
   lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
   FROM conversations),
 h AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS damage FROM o, crc),
 m AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
   CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
   unnest(range(0, CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE damage <> 0),
 p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j FROM m),
 r AS (SELECT conv_id, turn, role, text, left(role, 1) AS x, j, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY j) AS before,
   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'd'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault
   FROM p),
 ins(q, p, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
 after(x, p, z) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
 edit AS (SELECT 'D' AS e, NULL AS x, p, p AS z, 4 AS c FROM range(0, 4) s(p)
   UNION ALL SELECT 'K', x, p, z, 0 FROM after UNION ALL SELECT 'R', NULL, p, z, 3 FROM after WHERE x <> 's'),
 step AS (SELECT q, z, e, x, k, 3 * k + c AS c, repeat('I', CAST(k AS BIGINT)) || e AS a FROM ins JOIN edit USING (p)),
 dp AS (SELECT conv_id, 0::BIGINT AS j, 0::BIGINT AS q, {'c': 0::BIGINT, 'a': ''} AS best FROM (SELECT DISTINCT conv_id FROM r)
   UNION ALL SELECT dp.conv_id, dp.j + 1, CAST(step.z AS BIGINT), min({'c': best.c + step.c + CASE WHEN fault = 't' AND e <> 'D' THEN 3 ELSE 0 END, 'a': best.a || step.a})
   FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.j = dp.j + 1 JOIN step ON step.q = dp.q
   WHERE (fault NOT IN ('b', 'd') OR e = 'D') AND (e <> 'K' OR step.x = r.x) GROUP BY dp.conv_id, dp.j, step.z),
 s AS (SELECT conv_id, max(j) AS n, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
   count(*) FILTER (j > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal,
   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv_id),
 f AS (SELECT dp.conv_id, min({'c': best.c + [0, 6, 3, 0][q + 1], 'a': best.a || ['', 'II', 'I', ''][q + 1]}) AS best
   FROM dp JOIN s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.j GROUP BY dp.conv_id),
 l AS (SELECT conv_id, i, best.a[i] AS e, len(replace(best.a, 'D', '')) % 2 AS shift, len(replace(best.a[1:i], 'I', '')) AS j, len(replace(best.a[1:i], 'D', '')) - 1 AS seq
   FROM (SELECT conv_id, best, unnest(range(1, len(best.a) + 1)) AS i FROM f)),
 t AS (SELECT l.conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (seq - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' ||
     CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS h
   FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.j = l.j WHERE e <> 'D' GROUP BY l.conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
   CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
   coalesce(best.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM i.conv_id"""

OP12_SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS h FROM d),
 n AS (SELECT lang, sum(len(h)) AS n FROM w GROUP BY lang),
 g AS (SELECT lang, size, array_to_string(h[i:i + size - 1], ' ') AS phrase
       FROM (SELECT lang, h, size, unnest(range(1, len(h) - size + 2)) AS i FROM w, range(1, 5) s(size))),
 f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
 c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS h, size, unnest(range(1, size)) AS k FROM f WHERE size > 1),
 s AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
       FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(h[1:k], ' ')
              JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(h[k + 1:], ' ')),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 i AS (SELECT lang, array_to_string(string_split(phrase, ' ')[j:j + many - 1], ' ') AS phrase, max(f) AS longer
       FROM (SELECT lang, phrase, f, many, unnest(range(1, size - many + 2)) AS j FROM f, range(2, 4) m(many) WHERE size > many) GROUP BY ALL)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank,
   phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM b JOIN n USING (lang) LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a
QUALIFY rank <= 2000"""

# a histogram's distance from its language's: shares p and q side by side
DISTANCE = "sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)))"
CLASS_COUNT = "len(regexp_replace({}, '{}', '', 'g'))"
CLASS_LIST = ", ".join(CLASS_COUNT.format("w", p) for p in (
    "[^a-z]+", "[^A-Z]+", "[\\P{L}A-Za-z]+", "[^0-9]+", "[^.,;:!?]+", "[^#*$%&|<>]+"))

OP13_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t,
   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS h FROM documents),
 win AS (SELECT r, p, array_to_string(h[p:p + 4], ' ') AS g FROM (SELECT r, h, unnest(range(1, len(h) - 3)) AS p FROM d)),
 rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
 cov AS (SELECT r, count(DISTINCT p + i) AS n FROM rep, range(0, 5) x(i) GROUP BY r),
 lin AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 m AS (SELECT d.r, doc_id, lang, t, h, CAST(len(h) AS BIGINT) AS n_words,
   CAST(len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
   CAST(len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
   FROM d JOIN lin USING (r) LEFT JOIN cov USING (r)),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
 wd AS (SELECT r, lang, w, count(*) AS n FROM (SELECT r, lang, unnest(h) AS w FROM d) GROUP BY ALL),
 tot AS (SELECT lang, sum(n) AS n FROM wd GROUP BY lang HAVING sum(n) >= 2000),
 com AS (SELECT lang, w, c / tot.n AS q FROM (SELECT lang, lower(w) AS w, sum(n) AS c,
   row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, lower(w)) AS k FROM wd GROUP BY lang, lower(w)) JOIN tot USING (lang) WHERE k <= 64),
 j AS (SELECT r, lang, n_words FROM b JOIN tot USING (lang) WHERE NOT base_failed AND n_words >= 50),
 seen AS (SELECT r, lower(w) AS w, sum(n) AS c FROM wd GROUP BY r, lower(w)),
 ws AS (SELECT j.r, coalesce(c, 0) / n_words AS p, q FROM j JOIN com USING (lang) LEFT JOIN seen ON seen.r = j.r AND seen.w = com.w),
 wr AS (SELECT * FROM ws UNION ALL SELECT r, 1 - sum(p), 1 - sum(q) FROM ws GROUP BY r),
 wdist AS (SELECT r, {DISTANCE} AS far FROM wr GROUP BY r),
 known AS (SELECT r, lang, n, len(w) AS chars, [{CLASS_LIST}] AS f FROM wd),
 cc AS (SELECT r, lang, k, CASE WHEN k < 7 THEN sum(n * f[k]) ELSE sum(n * (chars - list_sum(f))) END AS c FROM known, range(1, 8) x(k) GROUP BY r, lang, k),
 cl AS (SELECT lang, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM cc GROUP BY lang, k),
 cdist AS (SELECT r, {DISTANCE} AS far FROM (SELECT cc.r, cc.c / sum(cc.c) OVER (PARTITION BY cc.r) AS p, q FROM cc JOIN cl USING (lang, k))
   WHERE r IN (SELECT r FROM j) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
   NOT base_failed AND coalesce(wdist.far <= 0.54 AND cdist.far <= 0.28, true) AS kept
FROM b LEFT JOIN wdist USING (r) LEFT JOIN cdist USING (r)"""

QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_bpe, op3_substring_dedup, op4_near_dedup, op5_warc, op6_chats, op7_toxicity, op8_language,
    op9_near_vectors, op10_decontaminate, op11_repair, op12_collocations, op13_quality_rules)}
ORACLES = {"op1_suffix_dedup": OP1_SQL, "op11_repair": OP11_SQL, "op3_substring_dedup": OP3_SQL, "op5_warc": OP5_SQL, "op6_chats": OP6_SQL,
           "op9_near_vectors": OP9_SQL, "op12_collocations": OP12_SQL, "op13_quality_rules": OP13_SQL}
