"""The registered queries of the training-data operators, at production parameters, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, hard_negatives, html_extract, line_dedup, ngram_join, packing, personal_data, quality_model, quality_rules, sharding, token_counts, token_files
from .common import read, stage_root

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary())
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(read(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"].isin(*personal_data.BASE))
    counts = (F.size(of(k)).cast("long").alias(f"n_{k}") for k in personal_data.BASE)
    return found.select("doc_id", *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{stage_root(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(read(spark, sf_dir, "documents"), path, vocabulary())
    return token_files.token_digests(token_files.read_tokens(spark, path))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_bitmaps(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary(), end_id=1)
    return packed.withColumn("ids_crc32", F.crc32("ids"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", noisy))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return assigned.select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        sharding.checksum(F.col("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_token_counts, op3_quality_rules, op4_decontaminate, op5_personal_data, op6_ngram_join, op7_token_files, op8_line_dedup, op9_packing, op10_quality_model, op11_hard_negatives, op12_filter_audit, op13_sharding)}

#: A-Z lower-cased.
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _statistics() -> str:
    """The rules' statistics of a row of counts, as an SQL list."""
    ratios = [(f"({over} * {scale} // greatest(1, {under}))", high) for over, under, scale, high in quality_rules.RULES.values()]
    values = [(f"{r} // (1::BIGINT << greatest(0, length(bin({r})) - {quality_rules.DIGITS})) * (1::BIGINT << greatest(0, length(bin({r})) - {quality_rules.DIGITS}))", high) for r, high in ratios]
    return f"[{', '.join(v if high else f'-({v})' for v, high in values)}]"


_RULES, _ALLOWED, _RISK = list(quality_rules.RULES), quality_rules.LEVELS, quality_rules.RISK
_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT r, i, w[i:i + 4] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
n AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS k FROM g) WHERE k > 1),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM n) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) FILTER (rn > 1) AS n_dup_lines FROM (
  SELECT r, row_number() OVER (PARTITION BY r, line) AS rn FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]')) GROUP BY r),
c AS (SELECT d.r, doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ 	-
]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
  len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x)) AS n_doubles, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN p ON p.r = d.r LEFT JOIN l ON l.r = d.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_statistics()} AS vals FROM c),
told AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT row_number() OVER () AS id, lang, any_value(vals) AS vals, bool_and(good) AS good, substr(md5(t), 1, 1) < '8' AS first FROM b JOIN told USING (doc_id) WHERE NOT base_failed GROUP BY lang, t),
e AS (SELECT lang, rule, vals[rule] AS v, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM h, (SELECT unnest(range(1, {len(_RULES) + 1})) AS rule) WHERE first GROUP BY ALL),
o AS (SELECT *, coalesce(sum(g) OVER above, 0) AS lost, coalesce(sum(b) OVER above, 0) AS caught, sum(g) OVER whole AS ng, sum(b) OVER whole AS nb FROM e
  WINDOW whole AS (PARTITION BY lang, rule), above AS (PARTITION BY lang, rule ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT unnest(range(1, {len(_ALLOWED) + 1})) AS level, unnest({[a for a, _ in _ALLOWED]}) AS allowed, unnest({[p for _, p in _ALLOWED]}) AS percent),
q AS (SELECT lang, rule, level, max(v) AS cut FROM (
  SELECT *, caught * ng - lost * nb AS gain, max(caught * ng - lost * nb) OVER (PARTITION BY lang, rule, level) AS best FROM o, levels WHERE lost * 1000 <= ng * allowed)
  WHERE gain > 0 AND 100 * gain >= percent * best GROUP BY ALL),
k AS (SELECT lang, level, count(*) AS n, count(*) FILTER (hit) AS k FROM (
  SELECT id, h.lang, levels.level, coalesce(bool_or(vals[rule] > cut), false) AS hit
  FROM h CROSS JOIN levels LEFT JOIN q ON q.lang IS NOT DISTINCT FROM h.lang AND q.level = levels.level WHERE good AND NOT first GROUP BY ALL) GROUP BY ALL),
f AS (SELECT lang, level, CASE WHEN any_value(k) > any_value(n) * {_RISK} THEN 1 ELSE sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RISK}) + (n - j) * ln(1 - {_RISK}))) END AS tail
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM k) GROUP BY ALL),
s AS (SELECT lang, coalesce(min(level) FILTER (tail > {quality_rules.DELTA} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM f))), {len(_ALLOWED) + 1}) - 1 AS level FROM f GROUP BY lang),
x AS (SELECT b.r, string_agg([{', '.join(f"'{r}'" for r in _RULES)}][rule], ',' ORDER BY rule) AS broken
  FROM b JOIN s ON s.lang IS NOT DISTINCT FROM b.lang JOIN q ON q.lang IS NOT DISTINCT FROM b.lang AND q.level = s.level WHERE vals[rule] > cut GROUP BY b.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken IS NULL AS kept, coalesce(broken, '') AS broken FROM b LEFT JOIN x USING (r)"""

ORACLE_SQL = {
    "op3_quality_rules": _QUALITY,
    "op4_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
windows AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hits AS (SELECT r, i, windows.n, item_id FROM windows JOIN grams USING (n, gram)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op8_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line, {_FOLD.format("trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT r, l.doc_id, i, line, coalesce(l.doc_id <> keeper, false) AS gone FROM l LEFT JOIN k ON l.key = k.key),
u AS (SELECT r, concat(min(i) - 1, ':', count(*)) AS run, min(i) AS i FROM (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS island FROM f WHERE NOT gone) GROUP BY r, island),
b AS (SELECT r, string_agg(run, ',' ORDER BY i) AS runs FROM u GROUP BY r)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(any_value(runs), '') AS keep_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f LEFT JOIN b USING (r) GROUP BY r""",
    "op6_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT x, y FROM p JOIN n AS a ON a.r = x JOIN n AS b ON b.r = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
c AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
m AS (SELECT c.x AS r, min(d.doc_id) AS least FROM c JOIN d ON d.r = c.y GROUP BY c.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)""",
    "op11_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) AS k FROM s WHERE alike) WHERE k <= 5),
n AS (SELECT p.a, p.b, p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id, s.b) AS rank
  FROM p JOIN s ON s.a = p.a WHERE NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_filter_audit": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, f, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x AS a, x AS b, x AS c, x AS d, x AS e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS own, o[1:i - 1] AS before FROM o, x),
e AS (SELECT part, o, step, own, n, good, toxic, f, f[own] AS fails, list_bool_or(list_transform(before, lambda b: f[b])) AS gone FROM s, c),
g AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT coalesce(gone, false)), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false)), 0) AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND len(list_filter(f, lambda y: y)) = 1), 0) AS unique_fails,
  coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false) AND good), 0) AS good_lost, coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false) AND toxic), 0) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda y: 'ABCDE'[y]), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g""",
    "op13_sharding": rf"""
WITH nibble AS (SELECT list_transform(range(16), lambda v: list_reduce([v, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS t),
d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
  list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda x: strpos('123456789ABCDEF', x)) AS h FROM documents),
v AS (SELECT doc_id, size, list_transform(range(2 * (size - 1)), lambda i: h[i + 2 - 2 * (i % 2)]) AS v FROM d),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(v, lambda a, b: xor(a >> 4, t[(xor(a, b) & 15) + 1]), 4294967295)) AS text_crc32 FROM v, nibble),
p AS (SELECT *, sum(size) OVER before - size AS upto, sum(size) OVER () AS total FROM c WINDOW before AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least({sharding.SHARDS - 1}, (2 * upto + size) * {sharding.SHARDS} // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
}
