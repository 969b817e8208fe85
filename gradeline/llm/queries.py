"""The registered queries of the training-data operators, one for each, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm.alignment import align_documents
from gradeline.llm.common import cut, held_out, join_copies, read
from gradeline.llm.conversations import repair_report
from gradeline.llm.digest_index import exact_groups
from gradeline.llm.grid_join import near_vectors
from gradeline.llm.mixing import mix_plan
from gradeline.llm.ngram_join import jaccard_classes
from gradeline.llm.packing import pack, pieces_of
from gradeline.llm.pitman_yor import score_texts
from gradeline.llm.quality import fit_quality, labelled_texts, score_quality
from gradeline.llm.rules import DEFAULT_RULES, STOP_WORDS, quality_rules
from gradeline.llm.substring import repeated_words
from gradeline.llm.token_files import read_token_files, write_token_files
from gradeline.llm.url_filter import url_filter

#: Score from which a document counts as good.
GOOD = 0.7


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "log_odds")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(labelled_texts(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4)))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces_of(read(spark, sf_dir, "documents")))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 7)
    scores = score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), ~out)
    return scores.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(spark, write_token_files(docs), docs.schema["doc_id"].dataType.simpleString())


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_words(docs).select("text_key", "copies", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    found = cut(found)
    keyed = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_key"))
    zero = F.lit(0).cast("long")
    return join_copies(keyed, found, "text_key", "copies", "left").select("doc_id", F.coalesce("n_words", zero).alias("n_words"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("kept_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("kept_sha256"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_quality, op4_ngram_join, op5_packing, op6_pitman_yor, op7_grid_join, op8_token_files, op9_substring, op10_rules, op11_exact_dedup, op12_token_alignment, op13_conversation_repair)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _add(state: str, cost: int | str, letter: str) -> str:
    """SQL: a conversation's state (twelve digits of cost, then the audit) after one more edit."""
    return f"printf('%012d', CAST({state}[1:12] AS BIGINT) + {cost}) || {state}[13:] || '{letter}'"


def _state(z0: str, z1: str, z2: str, z3: str) -> str:
    """SQL: the best way to each state (nothing, system, user, assistant), insertions included."""
    user = f"least(y2, {_add('y0', 5, 'I')}, {_add('y1', 5, 'I')}, {_add('y3', 5, 'I')})"
    return f"y0 AS z0, y1 AS z1, {user} AS z2, least(y3, {_add(f'({user})', 5, 'I')}) AS z3".replace("y0", f"({z0})").replace("y1", f"({z1})").replace("y2", f"({z2})").replace("y3", f"({z3})")


ORACLE_SQL: dict[str, str] = {
    "op2_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ssize FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, (sum(ssize) OVER () - 3.0::DOUBLE * coalesce(sum(ssize) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS lev FROM w WINDOW r AS (ORDER BY ssize / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT min_by(lev, (ssize / weight, coalesce(source, chr(1114111)))) FILTER (3.0::DOUBLE * ssize > lev * weight) AS lev FROM l),
t AS (SELECT l.source, l.ssize, CASE WHEN 3.0::DOUBLE * ssize <= l.lev * weight THEN 3.0::DOUBLE * ssize ELSE o.lev * weight END AS target FROM l, o),
r AS (SELECT *, CASE WHEN ssize = 0 THEN 0.0 ELSE least(3.0::DOUBLE, target / ssize) END AS rate FROM t),
b AS (SELECT source, CAST(floor(u * 1024) AS INT) AS step, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY ALL),
g AS (SELECT r.source, ssize, rate - floor(rate) AS part, k FROM r, (SELECT unnest(range(2049)) AS k)),
c AS (SELECT g.*, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY g.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM g LEFT JOIN b ON g.source IS NOT DISTINCT FROM b.source AND k % 1024 = step),
p AS (SELECT a.source, a.k AS shift, abs(z.upto - a.upto - a.part * a.ssize) AS gap FROM c a JOIN c z ON a.source IS NOT DISTINCT FROM z.source AND z.k = a.k + CAST(round(a.part * 1024) AS INT) WHERE a.k < 1024),
q AS (SELECT source, min(row(gap, shift)) AS best FROM p GROUP BY 1),
x AS (SELECT d.*, r.ssize, r.target, rate, floor(rate) AS whole, u - q.best[2] / 1024.0::DOUBLE AS turned FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, ssize AS source_size, target, CAST((whole + CASE WHEN turned + CASE WHEN turned < 0 THEN 1 ELSE 0 END < rate - whole THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x""",
    "op9_substring": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
g AS (SELECT doc_id, k, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h, count(*) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM w),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY h) AS c FROM g WHERE n = 35) WHERE c > 1),
m AS (SELECT w.doc_id, w.k, word, r.k IS NOT NULL AS s FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.k = r.k),
f AS (SELECT doc_id, k, word, bool_or(s) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op4_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda k: list_aggregate(ws[k:k + 4], 'string_agg', ' ')) END) AS gram FROM d WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE c.n >= 0.8 * (x.n + y.n - c.n) - 1e-9),
reach AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT doc_id, b FROM reach JOIN links ON seen = a),
m AS (SELECT doc_id, min(seen) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM m""",
    "op10_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
g AS (SELECT doc_id, k, string_agg(word, ' ') OVER v AS h, count(*) OVER v AS n FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g WHERE n = 8) WHERE c > 1),
f AS (SELECT w.doc_id, bool_or(r.k IS NOT NULL) OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS twice FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.k = r.k),
a AS (SELECT doc_id, count(*) FILTER (twice) AS n_repeat_words FROM f GROUP BY 1),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_shouts, len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(x)))) AS n_stop_words, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet_lines FROM d),
b AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN a USING (doc_id)),
e AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(f"coalesce({r.ratio.split(' / ')[0]}::DOUBLE / nullif({r.ratio.split(' / ')[1]}, 0) BETWEEN {-1 if r.low is None else r.low} AND {1e9 if r.high is None else r.high}, true)" for r in DEFAULT_RULES)} AS kept FROM e""",
    "op7_grid_join": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS seen FROM v UNION SELECT vec_id, b FROM reach JOIN links ON seen = a),
c AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id)""",
    "op11_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op13_conversation_repair": rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, (SELECT unnest([0, 1]) AS again) WHERE kind <> 0 AND (again = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS prev, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS short FROM o),
r AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN short THEN 5 ELSE 0 END AS more FROM f),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (short AND NOT gone) AS truncated, count(*) FILTER (k > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM r GROUP BY 1),
s AS (SELECT conv_id, 0::BIGINT AS k, {_state("'000000000000'", *["CAST(NULL AS VARCHAR)"] * 3)} FROM m UNION ALL
  SELECT i.conv_id, i.k, {_state(_add("z0", 2, "D"), f"least({_add('z1', 2, 'D')}, CASE WHEN NOT gone AND ini = 's' THEN {_add('z0', 'more', 'K')} END)", f"least({_add('z2', 2, 'D')}, CASE WHEN NOT gone AND ini = 'u' THEN least({', '.join(_add(z, 'more', 'K') for z in ('z0', 'z1', 'z3'))}) END, CASE WHEN NOT gone THEN least({', '.join(_add(z, 'more + 1', 'R') for z in ('z0', 'z1', 'z3'))}) END)", f"least({_add('z3', 2, 'D')}, CASE WHEN NOT gone AND ini = 'a' THEN {_add('z2', 'more', 'K')} END, CASE WHEN NOT gone THEN {_add('z2', 'more + 1', 'R')} END)")} FROM (SELECT r.conv_id, r.k, ini, gone, more, z0, z1, z2, z3 FROM s JOIN r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = s.k + 1) i),
e AS (SELECT s.conv_id, least(z0, z3) AS best FROM s JOIN m ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.k = n),
a AS (SELECT conv_id, CAST(best[1:12] AS BIGINT) AS cost, best[13:] AS audit FROM e),
l AS (SELECT conv_id, i, audit[i] AS c, i - len(replace(audit[1:i], 'I', '')) AS inserted, len(replace(audit[1:i], 'I', '')) AS k, len(replace(audit[1:i], 'D', '')) - 1 AS place FROM a, (SELECT unnest(range(1, (SELECT max(len(audit)) + 1 FROM a))) AS i) WHERE i <= len(audit)),
g AS (SELECT l.*, r.role, r.text, max(CASE WHEN c = 'K' AND place = 0 AND r.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS lead FROM l LEFT JOIN r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.k = r.k),
w AS (SELECT conv_id, string_agg(CASE WHEN c = 'K' THEN role ELSE CASE WHEN (place - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN c = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS told FROM g WHERE c <> 'D' GROUP BY 1),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM c LEFT JOIN m ON c.conv_id IS NOT DISTINCT FROM m.conv_id LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id""",
}
