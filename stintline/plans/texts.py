"""Registered queries of questions, answers, corpora, scores and conversation state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import metrics
from ..functions import text as X
from ..operators import corpus, ivf, knn
from ..sources.fixtures import run_sql, spread
from ..sources.store import shared_root
from ..streaming import state
from .stats import rounded

#: Questions made from orders: one of sixteen wordings, with numbers of the order.
MESSAGES = """
SELECT o_orderkey AS id, concat('s', CAST(o_custkey % 97 AS STRING)) AS sid, CASE o_orderkey % 16
  WHEN 0 THEN concat('Compare VER vs HAM at Monza in ', y, ' qualifying, lap ', n) WHEN 1 THEN concat('Show me the lap times of Leclerc at Spa ', y)
  WHEN 2 THEN concat('Should we undercut at Silverstone on lap ', n, '? The mediums are near the cliff') WHEN 3 THEN 'You are wrong, check again'
  WHEN 4 THEN concat('What was the fastest lap by nor in the race at Suzuka ', y, '?') WHEN 5 THEN concat('average race pace of Sainz in Abu Dhabi ', y)
  WHEN 6 THEN concat('How fast was PIA in FP2 at Imola in ', y, '? speed trap please') WHEN 7 THEN 'Does rain change the braking at this corner?'
  WHEN 8 THEN concat('Sector 2 of the ', n, 'th lap at Zandvoort, Alonso or Stroll') WHEN 9 THEN 'That is not right, verify that'
  WHEN 10 THEN concat('Do we stay out or box? Hards are ', n, ' laps old in Bahrain') WHEN 11 THEN concat('mean pace at the Las Vegas grand prix ', y)
  WHEN 12 THEN concat('Telemetry of the pole lap at Monaco in ', y) WHEN 13 THEN concat('Are you sure? In ', y, ' it was ', n, ' laps')
  WHEN 14 THEN 'How does fuel weight change the driving style?' ELSE concat('lap ', n, ' in Singapore, the race of ', y) END AS text
FROM (SELECT *, CAST(2018 + o_orderkey % 9 AS STRING) AS y, CAST(1 + o_custkey % 60 AS STRING) AS n FROM orders) AS o"""

#: Pairs of a reference and a generated answer, made from orders, with right and wrong numbers.
ANSWERS = """
SELECT o_orderkey AS id, concat('In ', y, ' the lap took 1:', s, '.', m, ' and deg was 0.0', m, 's/lap, cliff lap ', n, ', P', n, ' of the ', n, 'th race') AS reference,
  CASE o_orderkey % 6 WHEN 0 THEN concat('In ', y, ' the lap took 1:', s, '.', m, ' and deg was 0.0', m, 's/lap, cliff lap ', n, ', P', n, ' of the ', n, 'th race')
    WHEN 1 THEN concat('The lap took 1:', s, '.', m, ', a gain of -', n, '.5 s') WHEN 2 THEN 'No numbers here at all'
    WHEN 3 THEN concat('Cliff lap ', n, ' and max viable stint around ', s, ' laps, degradation rate -0.', m, 's/lap')
    WHEN 4 THEN concat('The cliff comes on lap ', CAST(o_custkey % 400 AS STRING), ' with 3 slow corners, averages ', m, '.5 km/h minimum speed, 4.2 km/h above the field')
    ELSE concat('Hamilton is 0.', m, 's ahead of Norris in Sector 2, and the lap took 1:', s, '.', m) END AS generated
FROM (SELECT *, CAST(2019 + o_orderkey % 7 AS STRING) AS y, CAST(1 + o_custkey % 60 AS STRING) AS n, lpad(CAST(10 + o_orderkey % 49 AS STRING), 2, '0') AS s, lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') AS m FROM orders) AS o"""


def _orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run_sql(spark, sql, {"orders": spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, MESSAGES)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, ANSWERS)


def intent_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return messages(spark, sf_dir).select("id", X.mode(t).alias("mode"), X.pushback(t).alias("pushback"))


def intent_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    parts = {"circuit": X.circuit(t), "stored": X.stored_circuit(X.circuit(t)), "year": X.year(t), "session": X.session(t), "lap_number": X.lap_number(t), "lap_fastest": X.lap_fastest(t), "wants_average": X.wants_average(t)}
    return messages(spark, sf_dir).select("id", *(c.alias(n) for n, c in parts.items()))


def intent_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", F.array_join(X.drivers(F.col("text")), ",").alias("drivers"))


def intent_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", F.array_join(X.topics(F.col("text")), ",").alias("topics"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.numbers(F.col("generated"))
    return answers(spark, sf_dir).select("id", F.size(n).cast("long").alias("n"), F.array_join(F.transform(F.array_sort(n), lambda x: F.round(x, 3).cast("decimal(12,3)").cast("string")), ",").alias("numbers"))


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = F.col("reference"), F.col("generated")
    told = answers(spark, sf_dir).select("id", metrics.grounded(r, p).alias("g"))
    return told.select("id", "g.factual", F.round("g.halluc", 9).alias("halluc"), "g.fails_guard")


def redacted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("id", X.redacted(F.col("generated")).alias("text"))


def degradation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, bad = corpus.clean(answers(spark, sf_dir), "generated")
    # the counter that the filter logs
    reasons = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return reasons.unionByName(kept.agg(F.lit(None).cast("string").alias("reason"), F.count(F.lit(1)).alias("n")))


def sector_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("generated")
    return answers(spark, sf_dir).select("id", X.sector_wording(g).alias("text"), X.sector_rewrites(g).cast("long").alias("n"))


def grounding_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("id") % 3 == 0, "What is the strategy?").when(F.col("id") % 3 == 1, "Which corner profile?").otherwise("Why?")
    return answers(spark, sf_dir).select("id", X.grounding_prefix(asked, F.col("generated")).alias("text"))


def vacuous_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, k = F.col("generated"), F.col("id") % 5
    reply = F.concat(g, F.when(k == 0, " and is behind").when(k == 1, ". Struggling there").when(k == 2, " by the slowest").otherwise(""), F.when(F.col("id") % 11 == 0, F.repeat(F.lit(" padding of a reply"), 20)).otherwise(""))
    return answers(spark, sf_dir).select("id", X.vacuous(reply).alias("vacuous"), X.misread_sign(F.col("id") % 7 < 3, reply).alias("misread"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("id", F.round(metrics.rouge_l(F.col("reference"), F.col("generated")), 9).alias("rouge_l"))


def bleu4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("id", F.round(metrics.bleu4(F.col("reference"), F.col("generated")), 9).alias("bleu"))


def bleu_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(bleu4(spark, sf_dir), "bleu")


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.report(metrics.score(answers(spark, sf_dir))))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_wins(messages(spark, sf_dir).select("text", "id"), "text", ["id"])


def split_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tagged(dedup_first(spark, sf_dir), "text").select("id", "circuit", "split")


def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in two splits, where the split is drawn by id instead of by circuit."""
    drawn = messages(spark, sf_dir).withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("train"))
    return corpus.leakage(drawn, "text")


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample with a quota for each mode and a total: the operator's own limits."""
    asked = dedup_first(spark, sf_dir).withColumn("mode", X.mode(F.col("text")))
    return corpus.sample_per_category(asked, "mode", "text", 75, 120, 84).select("id", "text", "mode")


def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id IS NOT NULL")
    return corpus.conversation_examples(turns, "You are a race engineer.")


def history_last50(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    return state.last_messages(events, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question means after those before it; some questions clear their conversation."""
    t = F.col("text")
    lap = F.coalesce(X.lap_number(t).cast("string"), F.when(X.lap_fastest(t), F.lit("fastest")))
    parts = {"circuit": X.circuit(t), "year": X.year(t), "session": X.session(t), "lap": lap, "drivers": X.drivers(t), "telemetry": (X.mode(t) == "telemetry") | X.pushback(t), "clear": F.col("id") % 41 == 0}
    turns = messages(spark, sf_dir).select("sid", F.col("id").alias("turn"), *(c.alias(n) for n, c in parts.items()))
    return state.carry_intent(turns, "sid", ["turn"]).withColumn("drivers", F.array_join("drivers", ",")).drop("telemetry", "clear")


def doubted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = answers(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"), F.col("generated").alias("content"))
    return state.model_messages(history, F.col("id") % 5 < 3)


def cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return knn.nearest(vectors, vectors.where("vec_id % 20 = 0"), 5)


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the vectors whose id isn't divisible by 9, with the others put in later and searched for the five
    nearest of every id divisible by 20: whether at least nine in ten of those are found that a search of all lists finds."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = ivf.Index(spark, f"{shared_root(spark)}/ivf-{uuid.uuid4().hex}")
    index.build(vectors.where("vec_id % 9 <> 0"))
    index.upsert(vectors.where("vec_id % 9 = 0 OR vec_id % 11 = 0"))
    asked = vectors.where("vec_id % 20 = 0")
    found = index.search(asked, 5).select("query_id", "id", F.lit(1).alias("hit"))
    told = index.search(asked, 5, probe=ivf.LISTS).select("query_id", "id").join(found, ["query_id", "id"], "left")
    return told.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose hallucination score, once found without tolerance, fell."""
    saved = answers(spark, sf_dir).withColumn("halluc", F.when(X.fails_guard(F.col("reference"), F.col("generated")), 1.0).otherwise(0.5))
    return metrics.rescored(saved).select("id", F.round("new_halluc", 9).alias("new_halluc"), "new_factual", F.round("improvement", 9).alias("improvement"))


def worst_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty lowest scores, for the report."""
    return metrics.extremes(bleu4(spark, sf_dir), "bleu", "id", 20)


def recovered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.when(F.col("id") % 3 == 0, F.format_string('Here: ```json\n{"user": "u%d", "n": %d}\n```', "id", "id")).when(F.col("id") % 3 == 1, F.format_string('say {"user": "u%d", "n": %d} ok', "id", "id")).otherwise(F.lit("none"))
    return answers(spark, sf_dir).select("id", X.recovered_json(wrapped, "user STRING, n BIGINT").alias("j")).select("id", "j.user", "j.n")


def cleaned_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("id") % 2 == 0, F.concat(F.lit(' "'), "generated", F.lit('" '))).otherwise(F.concat(F.lit("a \\"), F.lit('"'), "generated"))
    return answers(spark, sf_dir).select("id", X.clean_response(said).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (rescored, worst_bleu, recovered_json, cleaned_responses, intent_mode, intent_fields, intent_drivers, intent_topics, numbers, grounding, redacted_claims, degradation_claims, sector_rewrites, grounding_prefix, vacuous_replies, rouge_l, bleu4, bleu_histogram, score_report, dedup_first, split_by_tag, leakage, quota_sample, chat_examples, history_last50, carry_forward, doubted_history, cosine_knn, ivf_recall)
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _has(pattern: str, column: str = "text") -> str:
    return f"regexp_matches({column}, {_q(pattern)}, 'i')"


def _get(pattern: str, group: int = 1, column: str = "text") -> str:
    return f"nullif(regexp_extract({column}, {_q(pattern)}, {group}, 'i'), '')"


def _alias(aliases: list[tuple[str, str]], column: str = "text") -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains(lower({column}), {_q(a)}) THEN {_q(c)} END" for a, c in aliases) + ")"


_M, _A = f"WITH m AS ({MESSAGES})", f"WITH a AS ({ANSWERS})"
_MODE = f"CASE WHEN NOT ({_has(K.STRATEGY)} AND NOT {_has(K.DATA_ASKED)}) AND {_has(K.LAP_DATA)} THEN 'telemetry' ELSE 'general' END"
_SESSION = f"CASE WHEN {_has(K.QUALIFYING)} THEN 'Q' WHEN {_has(K.PRACTICE)} THEN coalesce(upper({_get(r'(FP[123])')}), 'FP2') WHEN {_has(K.RACING)} THEN 'Race' END"
_LAP = f"TRY_CAST(coalesce({_get(K.LAP_NUMBER, 1)}, {_get(K.LAP_NUMBER, 2)}) AS INTEGER)"
_YEAR, _AVERAGE, _DOUBT = f"CAST({_get(K.YEAR)} AS INTEGER)", _has(K.AVERAGE), _has(K.PUSHBACK, "lower(text)")
_CIRCUIT, _TAG = _alias(K.question_aliases()), _alias(K.corpus_aliases())


def _numbers(column: str) -> str:
    value = "CASE WHEN contains(t, ':') THEN (CASE WHEN t LIKE '-%' THEN -1 ELSE 1 END) * round(60 * CAST(ltrim(split_part(t, ':', 1), '-') AS DOUBLE) + CAST(split_part(t, ':', 2) AS DOUBLE), 3) ELSE CAST(t AS DOUBLE) END"
    tokens = f"list_filter(regexp_extract_all({column}, {_q('(' + K.NUMBER + ')')}, 1), lambda t: NOT list_contains(regexp_extract_all({column}, {_q('(?i)' + K.ORDINAL)}, 1), t))"
    return f"list_sort(list_distinct(list_filter(list_transform({tokens}, lambda t: {value}), lambda v: NOT (v = floor(v) AND v BETWEEN 2018 AND 2027))))"


_CLOSE = "CASE WHEN r = 0 THEN abs(p) < 1.0 ELSE abs(p - r) <= 0.15 * abs(r) OR abs(p - r) <= 1.0 END"
_LONE = f"len(list_filter(pn, lambda p: len(list_filter(rn, lambda r: {_CLOSE})) = 0))"
_AN = f"{_A}, n AS (SELECT *, {_numbers('reference')} AS rn, {_numbers('generated')} AS pn FROM a)"
_BLEU = f"""{_A}, t AS (SELECT id, string_split(lower(reference), ' ') AS r, string_split(lower(generated), ' ') AS p FROM a),
g AS (SELECT id, n, 'r' AS side, array_to_string(r[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM t, (SELECT unnest([1, 2, 3, 4]) AS n))
  UNION ALL SELECT id, n, 'p', array_to_string(p[i:i + n - 1], ' ') FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM t, (SELECT unnest([1, 2, 3, 4]) AS n))),
c AS (SELECT id, n, gram, count(*) FILTER (side = 'r') AS cr, count(*) FILTER (side = 'p') AS cp FROM g GROUP BY ALL),
o AS (SELECT id, n, sum(least(cr, cp)) AS hit, sum(cp) AS total FROM c GROUP BY ALL),
b AS (SELECT id, count(*) FILTER (hit > 0) AS orders, sum(CASE WHEN hit > 0 THEN ln(hit / total) END) AS logs FROM o GROUP BY ALL),
s AS (SELECT t.id, round(CASE WHEN len(p) > 3 AND orders = 4 THEN (CASE WHEN len(p) >= len(r) THEN 1.0 ELSE exp(1 - len(r) / len(p)) END) * exp(logs / 4) ELSE 0.0 END, 9) AS bleu FROM t JOIN b USING (id))"""
_REWRITE = "a.generated"
for _pattern, _new in K.SECTOR_WORDING:
    _REWRITE = f"regexp_replace({_REWRITE}, {_q(_pattern)}, {_q(_new.replace('$', chr(92)))}, 'gi')"
_ANCHOR = "concat_ws(', ', 'deg ' || {deg} || 's/lap', 'cliff lap ' || {cliff}, 'max viable ' || {viable} || ' laps', 'top speed benchmark ' || {speed} || ' km/h')".format(
    deg=_get(K.ANCHOR_DEG, 1, "generated"), cliff=_get(K.ANCHOR_CLIFF, 1, "generated"), viable=_get(K.ANCHOR_VIABLE, 1, "generated"), speed=_get(K.ANCHOR_SPEED, 1, "generated")
)
_CORNERS = "concat_ws(', ', {count} || ' ' || {kind} || '-speed corners', 'avg min speed ' || {least} || ' km/h', coalesce({gap} || ' km/h ' || {side} || ' field', 'reference speed ' || {speed} || ' km/h'))".format(
    count=_get(K.ANCHOR_COUNT, 1, "generated"), kind=_get(K.ANCHOR_COUNT, 2, "generated"), least=_get(K.ANCHOR_MIN, 1, "generated"), gap=_get(K.ANCHOR_DELTA, 1, "generated"), side=_get(K.ANCHOR_DELTA, 2, "generated"), speed=_get(K.ANCHOR_SPEED, 1, "generated")
)
_BAD = "coalesce('deg_rate=' || CAST(list_filter(list_transform(regexp_extract_all(generated, {d}, 1), lambda x: CAST(x AS DOUBLE)), lambda x: x < 0)[1] AS VARCHAR), 'max_viable_laps=' || CAST(list_filter(list_transform(regexp_extract_all(generated, {v}, 1), lambda x: CAST(x AS INTEGER)), lambda x: x < 8 OR x > 50)[1] AS VARCHAR))".format(
    d=_q("(?i)" + K.DEGRADATION), v=_q("(?i)" + K.VIABLE)
)

ORACLE_SQL = {
    "rescored": f"{_AN}, x AS (SELECT id, CASE WHEN len(rn) = 0 OR len(pn) = 0 THEN 0.0 ELSE {_LONE} / len(pn) END AS h, len(rn) = 0 OR len(list_filter(rn, lambda r: len(list_filter(pn, lambda p: {_CLOSE})) > 0)) > 0 AS f, CASE WHEN {_LONE} > 0 THEN 1.0 ELSE 0.5 END AS o FROM n) SELECT id, round(h, 9) AS new_halluc, f AS new_factual, round(o - h, 9) AS improvement FROM x",
    "worst_bleu": f"{_BLEU} SELECT id, bleu FROM s ORDER BY bleu, id LIMIT 20",
    "recovered_json": f"{_A} SELECT id, CASE WHEN id % 3 < 2 THEN 'u' || CAST(id AS VARCHAR) END AS user, CASE WHEN id % 3 < 2 THEN id END AS n FROM a",
    "cleaned_responses": f"{_A} SELECT id, CASE WHEN id % 2 = 0 THEN generated ELSE 'a ' || chr(34) || generated END AS text FROM a",
    "intent_mode": f"{_M} SELECT id, {_MODE} AS mode, {_has(K.PUSHBACK, 'lower(text)')} AS pushback FROM m",
    "intent_fields": f"{_M}, i AS (SELECT *, {_CIRCUIT} AS circuit, {_LAP} AS lap_number FROM m) SELECT id, circuit, coalesce(map_extract(MAP {{{', '.join(f'{_q(a)}: {_q(b)}' for a, b in K.STORED_NAMES.items())}}}, circuit)[1], circuit) AS stored, CAST({_get(K.YEAR)} AS INTEGER) AS year, {_SESSION} AS session, lap_number, lap_number IS NULL AND {_has(K.FASTEST)} AS lap_fastest, {_has(K.AVERAGE)} AS wants_average FROM i",
    "intent_drivers": f"""{_M}, c AS (SELECT id, list_filter(list_transform(regexp_extract_all(text, '\\b([A-Za-z]{{3}})\\b', 1), lambda x: upper(x)), lambda x: list_contains([{', '.join(map(_q, K.DRIVERS))}], x))
  || list_filter([{', '.join(f"CASE WHEN contains(lower(text), {_q(n)}) THEN {_q(d)} END" for n, d in K.SURNAMES.items())}], lambda x: x IS NOT NULL) AS l FROM m)
SELECT id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS drivers FROM c""",
    "intent_topics": f"""{_M} SELECT id, concat_ws(',', l[1], l[2], l[3], l[4]) AS topics FROM (SELECT id, list_filter([{', '.join(f"CASE WHEN {_has(p)} THEN {_q(t)} END" for t, p in K.TOPICS.items())}], lambda x: x IS NOT NULL) AS l FROM m)""",
    "numbers": f"{_AN} SELECT id, len(pn) AS n, coalesce(array_to_string(list_transform(pn, lambda x: CAST(CAST(round(x, 3) AS DECIMAL(12, 3)) AS VARCHAR)), ','), '') AS numbers FROM n",
    "grounding": f"{_AN} SELECT id, len(rn) = 0 OR len(list_filter(rn, lambda r: len(list_filter(pn, lambda p: {_CLOSE})) > 0)) > 0 AS factual, round(CASE WHEN len(rn) = 0 OR len(pn) = 0 THEN 0.0 ELSE {_LONE} / len(pn) END, 9) AS halluc, {_LONE} > 0 AS fails_guard FROM n",
    "redacted_claims": f"{_A} SELECT id, regexp_replace(generated, {_q(K.CLAIM)}, {_q(K.REDACTED)}, 'gi') AS text FROM a",
    "degradation_claims": f"{_A} SELECT reason, count(*) AS n FROM (SELECT {_BAD} AS reason FROM a) GROUP BY reason",
    "sector_rewrites": f"{_A} SELECT id, {_REWRITE} AS text, CAST(len(regexp_extract_all(generated, {_q('(?i)' + K.SECTOR_WORDING[0][0])})) AS BIGINT) AS n FROM a",
    "grounding_prefix": f"{_A} SELECT id, CASE WHEN facts IS NOT NULL AND facts <> '' THEN concat('Key facts: ', facts, '. ', generated) ELSE generated END AS text FROM (SELECT id, generated, CASE id % 3 WHEN 0 THEN {_ANCHOR} WHEN 1 THEN {_CORNERS} END AS facts FROM a)",
    "vacuous_replies": f"{_A}, b AS (SELECT id, generated || ['and is behind', 'Struggling', 'slowest', '', ''][id % 5 + 1] AS said, length(generated) + [14, 18, 15, 0, 0][id % 5 + 1] + CASE WHEN id % 11 = 0 THEN 380 ELSE 0 END AS n, len(regexp_extract_all(generated, '\\b(?:\\d+:\\d\\d|\\d{{2,3}})[.]\\d{{3}}\\b')) AS times FROM a) SELECT id, n < 200 OR (n < 500 AND times < 2) AS vacuous, id % 7 < 3 AND (regexp_matches(said, 'is behind$|Struggling$') OR contains(said, 'slower')) AS misread FROM b",
    "bleu4": f"{_BLEU} SELECT id, bleu FROM s",
    "bleu_histogram": f"{_BLEU} SELECT CAST(least(floor(bleu * 5), 4) AS INTEGER) AS bucket, count(*) AS n FROM s GROUP BY ALL",
    "dedup_first": f"{_M} SELECT text, min(id) AS id FROM m GROUP BY text",
    "split_by_tag": f"{_M} SELECT id, circuit, CASE WHEN circuit IN ('Italy', 'Monaco', 'Bahrain') THEN 'test' WHEN circuit IN ('Belgium', 'Singapore', 'Hungary') THEN 'val' ELSE 'train' END AS split FROM (SELECT min(id) AS id, {_TAG} AS circuit FROM m GROUP BY text)",
    "leakage": f"{_M} SELECT text, count(DISTINCT id % 3 = 0) AS splits FROM m GROUP BY text HAVING count(DISTINCT id % 3 = 0) > 1",
    "quota_sample": f"{_M}, d AS (SELECT min(id) AS id, text, {_MODE} AS mode, md5(concat_ws('|', '84', text)) AS draw FROM m GROUP BY text) SELECT id, text, mode FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY mode ORDER BY draw, text) <= 75) ORDER BY draw, text LIMIT 120",
    "chat_examples": "SELECT conv_id, count(*) + 1 - CAST(arg_min(role, turn) = 'system' AS BIGINT) AS n, 'You are a race engineer.' AS system, arg_min(text, turn) FILTER (role = 'user') AS question, arg_max(text, turn) FILTER (role = 'assistant') AS answer, length(string_agg(text, ' ' ORDER BY turn) FILTER (role IN ('user', 'assistant'))) AS chars FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id",
    "history_last50": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50",
    "carry_forward": f"""{_M}, i AS (SELECT sid, id AS turn, {_CIRCUIT} AS circuit, CAST({_get(K.YEAR)} AS INTEGER) AS year, {_SESSION} AS session, coalesce(CAST({_LAP} AS VARCHAR), CASE WHEN {_has(K.FASTEST)} THEN 'fastest' END) AS lap,
  {_MODE} = 'telemetry' OR {_has(K.PUSHBACK, 'lower(text)')} AS told, sum(CAST(id % 41 = 0 AS INTEGER)) OVER (PARTITION BY sid ORDER BY id) AS since FROM m),
j AS (SELECT i.*, nullif(drivers, '') AS d FROM i JOIN ({{drivers}}) AS n ON n.id = i.turn)
SELECT sid, turn, {', '.join(f"coalesce({c}, last_value(CASE WHEN told THEN {c} END IGNORE NULLS) OVER w) AS {c}" for c in ('circuit', 'year', 'session', 'lap'))}, coalesce(d, last_value(CASE WHEN told THEN d END IGNORE NULLS) OVER w) AS drivers
FROM j WINDOW w AS (PARTITION BY sid, since ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "doubted_history": f"{_A} SELECT id, CASE WHEN id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role, CASE WHEN id % 2 = 0 AND id % 5 < 3 THEN regexp_replace(generated, {_q(K.CLAIM)}, {_q(K.REDACTED)}, 'gi') ELSE generated END AS content FROM a",
    "ivf_recall": "WITH q AS (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) SELECT count(*) AS queries, CAST(sum(least(5, (SELECT count(*) FROM embeddings) - 1)) AS BIGINT) AS neighbours, true AS enough FROM q",
    "cosine_knn": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT query_id, id, similarity, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 9) AS similarity FROM v JOIN v AS q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)) WHERE rn <= 5""",
}

ORACLE_SQL["carry_forward"] = ORACLE_SQL["carry_forward"].replace("{drivers}", ORACLE_SQL["intent_drivers"])

#: ROUGE-L by rows of the table of common subsequences: a row is the running maximum of what each place offers.
_ROUGE = f"""WITH RECURSIVE a AS ({ANSWERS}), u AS (SELECT id, list_filter(string_split(lower(reference), ' '), lambda x: x <> '') AS r, list_filter(string_split(lower(generated), ' '), lambda x: x <> '') AS p FROM a),
w AS (SELECT id, 0 AS i, list_transform(range(0, len(p) + 1), lambda x: 0) AS row FROM u
  UNION ALL SELECT id, i + 1, list_transform(offers, lambda x, j: list_max(offers[1:j])) FROM (
    SELECT w.id, i, list_transform(range(1, len(p) + 2), lambda j: CASE WHEN j = 1 THEN 0 WHEN p[j - 1] = r[i + 1] THEN row[j - 1] + 1 ELSE row[j] END) AS offers FROM w JOIN u ON u.id = w.id WHERE i < len(r))),
rouge AS (SELECT u.id, CASE WHEN len(r) = 0 OR len(p) = 0 THEN 0.0 ELSE 2.0 * row[-1] / (len(r) + len(p)) END AS rouge_l FROM u JOIN w ON w.id = u.id AND w.i = len(r))"""
#: Every score of every pair, found without the engine.
SCORED = f"""{_ROUGE}, {_BLEU[len(_A) + 2 :]}, nn AS (SELECT *, {_numbers('reference')} AS rn, {_numbers('generated')} AS pn FROM a),
gg AS (SELECT id, len(rn) = 0 OR len(list_filter(rn, lambda r: len(list_filter(pn, lambda p: {_CLOSE})) > 0)) > 0 AS factual, CASE WHEN len(rn) = 0 OR len(pn) = 0 THEN 0.0 ELSE {_LONE} / len(pn) END AS halluc FROM nn),
scored AS (SELECT id, rouge_l, coalesce(bleu, 0.0) AS bleu, factual, halluc FROM rouge LEFT JOIN s USING (id) JOIN gg USING (id))"""
ORACLE_SQL["rouge_l"] = f"{_ROUGE} SELECT id, round(rouge_l, 9) AS rouge_l FROM rouge"
ORACLE_SQL["score_report"] = f"{SCORED} SELECT count(*) AS n, round(avg(rouge_l), 9) AS rouge_l, round(avg(bleu), 9) AS bleu, round(avg(CAST(factual AS INTEGER)), 9) AS factual, round(avg(halluc), 9) AS halluc FROM scored"
