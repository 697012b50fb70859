"""Text functions over columns: intents of questions, numbers of answers, rewrites. Built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside of a lambda a plain column is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    hit = F.regexp_extract(text, f"(?i){pattern}", group)
    return F.when(hit != "", hit)


def lap_time_text(seconds: Column) -> Column:
    """M:SS.mmm, S.mmm under a minute, N/A for null."""
    ms = F.round(seconds * 1000).cast("long")
    rest = F.format_string("%02d.%03d", (ms % 60000 / 1000).cast("int"), ms % 1000)
    short = F.format_string("%d.%03d", (ms / 1000).cast("int"), ms % 1000)
    return F.when(seconds.isNull(), "N/A").when(ms >= 60000, F.concat((ms / 60000).cast("int").cast("string"), F.lit(":"), rest)).otherwise(short)


def lap_time_seconds(text: Column) -> Column:
    """Seconds of M:SS.mmm or of a decimal; null for anything else."""
    minutes, seconds = F.regexp_extract(text, r"^\s*(\d+):(\d{2}(?:\.\d+)?)\s*$", 1), F.regexp_extract(text, r"^\s*(\d+):(\d{2}(?:\.\d+)?)\s*$", 2)
    return F.when(minutes != "", minutes.try_cast("double") * 60 + seconds.try_cast("double")).otherwise(F.trim(text).try_cast("double"))


def signed_seconds(value: Column, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}fs", value)


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def mode(text: Column) -> Column:
    """telemetry for a question about stored laps, else general; strategy scenes are general unless data is asked for."""
    t = F.trim(text)
    scene = matches(t, K.STRATEGY) & ~matches(t, K.DATA_ASKED)
    return F.when(~scene & matches(t, K.LAP_DATA), "telemetry").otherwise("general")


def pushback(text: Column) -> Column:
    return matches(F.lower(text), K.PUSHBACK)


def drivers(text: Column) -> Column:
    """Codes in the text in their order, then those of surnames in the order of the list; each once."""
    codes = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]{3})\b"), 1), F.upper)
    known = F.filter(codes, lambda c: c.isin(*K.DRIVERS))
    named = let(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(low.contains(name), F.lit(code)) for name, code in K.SURNAMES.items()))))
    return F.array_distinct(F.concat(known, named))


def _alias_in(low: Column, aliases: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(low.contains(alias), F.lit(name)) for alias, name in aliases))


def _first_alias(text: Column, aliases: list[tuple[str, str]]) -> Column:
    return let(F.lower(text), lambda low: _alias_in(low, aliases))


def circuit(text: Column) -> Column:
    """The circuit of the longest alias in the text."""
    return _first_alias(text, K.question_aliases())


def corpus_circuit(text: Column) -> Column:
    """The circuit of the longest official name in the text, else of the longest alias."""
    return _first_alias(text, K.corpus_aliases())


def corpus_circuit_of(low: Column) -> Column:
    """corpus_circuit() of a column of texts in lower case: compiled, where a text bound by let() is interpreted."""
    return _alias_in(low, K.corpus_aliases())


def stored_circuit(name: Column) -> Column:
    pairs = [F.lit(x) for pair in K.STORED_NAMES.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), name)


def year(text: Column) -> Column:
    return found(text, K.YEAR).cast("int")


def session(text: Column) -> Column:
    """Q, a practice session, Race or null, in this precedence."""
    practice = F.coalesce(F.upper(found(text, r"\b(FP1|FP2|FP3)\b")), F.lit("FP2"))
    return F.when(matches(text, K.QUALIFYING), "Q").when(matches(text, K.PRACTICE), practice).when(matches(text, K.RACING), "Race")


def lap_number(text: Column) -> Column:
    return F.coalesce(found(text, K.LAP_NUMBER, 1), found(text, K.LAP_NUMBER, 2)).try_cast("int")


def lap_fastest(text: Column) -> Column:
    return lap_number(text).isNull() & matches(text, K.FASTEST)


def wants_average(text: Column) -> Column:
    return matches(text, K.AVERAGE)


def intent(text: Column) -> Column:
    """All that a question names, as one struct."""
    parts = {"drivers": drivers(text), "circuit": circuit(text), "year": year(text), "session": session(text), "lap_number": lap_number(text), "lap_fastest": lap_fastest(text), "wants_average": wants_average(text)}
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def topics(text: Column, most: int = 4) -> Column:
    return F.slice(F.array_compact(F.array(*(F.when(matches(text, p), F.lit(t)) for t, p in K.TOPICS.items()))), 1, most)


def numbers(text: Column) -> Column:
    """Distinct numbers of a text in order: lap times in seconds, without years and ordinals."""
    tokens = F.regexp_extract_all(text, F.lit(f"({K.NUMBER})"), 1)
    ordinals = F.regexp_extract_all(text, F.lit(f"(?i){K.ORDINAL}"), 1)

    def value(token):
        split = F.split(F.regexp_replace(token, "^-", ""), ":")
        timed = F.round(split[0].cast("double") * 60 + F.get(split, F.lit(1)).cast("double"), 3)
        return F.when(token.contains(":"), F.when(token.startswith("-"), -timed).otherwise(timed)).otherwise(token.cast("double"))

    kept = let(ordinals, lambda known: F.filter(tokens, lambda t: ~F.array_contains(known, t)))
    year = lambda v: (v == F.floor(v)) & v.between(*K.YEARS)
    return F.array_distinct(F.filter(F.transform(kept, value), lambda v: ~year(v)))


def close(value: Column, reference: Column, relative: float = 0.15, absolute: float = 1.0) -> Column:
    """Within the relative or the absolute tolerance; of a zero reference, strictly within the absolute one."""
    gap = F.abs(value - reference)
    return F.when(reference == 0, F.abs(value) < absolute).otherwise((gap <= relative * F.abs(reference)) | (gap <= absolute))


def ungrounded(values: Column, references: Column) -> Column:
    """The values that no reference is close to."""
    return let(references, lambda known: F.filter(values, lambda v: ~F.exists(known, lambda r: close(v, r))))


def fails_guard(facts: Column, response: Column) -> Column:
    """Whether a response states any number that the facts don't ground; without facts, any number at all."""
    return F.size(ungrounded(numbers(response), numbers(facts))) > 0


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, f"(?i){K.CLAIM}", K.REDACTED)


def bad_degradation(text: Column) -> Column:
    """Why a text's tyre claims can't be true, or null: a negative rate first, then a stint out of 8 to 50 laps."""
    rates = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){K.DEGRADATION}"), 1), lambda x: x.cast("double"))
    stints = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){K.VIABLE}"), 1), lambda x: x.cast("int"))
    rate, stint = F.get(F.filter(rates, lambda x: x < 0), F.lit(0)), F.get(F.filter(stints, lambda x: ~x.between(8, 50)), F.lit(0))
    return F.coalesce(F.concat(F.lit("deg_rate="), rate.cast("string")), F.concat(F.lit("max_viable_laps="), stint.cast("string")))


def sector_wording(text: Column) -> Column:
    """The text with misleading sector comparisons reworded."""
    return reduce(lambda t, p: F.regexp_replace(t, f"(?i){p[0]}", p[1]), K.SECTOR_WORDING, text)


def sector_rewrites(text: Column) -> Column:
    """How many comparisons sector_wording() changes."""
    total, t = F.lit(0), text
    for pattern, new in K.SECTOR_WORDING:
        total = total + F.regexp_count(t, F.lit(f"(?i){pattern}"))
        t = F.regexp_replace(t, f"(?i){pattern}", new)
    return total


def grounding_prefix(question: Column, answer: Column) -> Column:
    """The answer, led by its key facts if the question is one of strategy (first) or corners."""
    label = lambda before, value, after="": F.concat(F.lit(before), value, F.lit(after))
    speed = found(answer, K.ANCHOR_SPEED)
    tyres = F.concat_ws(", ", label("deg ", found(answer, K.ANCHOR_DEG), "s/lap"), label("cliff lap ", found(answer, K.ANCHOR_CLIFF)), label("max viable ", found(answer, K.ANCHOR_VIABLE), " laps"), label("top speed benchmark ", speed, " km/h"))
    counts, kinds = F.regexp_extract_all(answer, F.lit(f"(?i){K.ANCHOR_COUNT}"), 1), F.regexp_extract_all(answer, F.lit(f"(?i){K.ANCHOR_COUNT}"), 2)
    counted = F.slice(F.transform(F.arrays_zip(counts.alias("n"), kinds.alias("k")), lambda x: F.concat(x["n"], F.lit(" "), x["k"], F.lit("-speed corners"))), 1, 3)
    delta = F.concat(found(answer, K.ANCHOR_DELTA), F.lit(" km/h "), found(answer, K.ANCHOR_DELTA, 2), F.lit(" field"))
    corners = F.concat_ws(", ", counted, label("avg min speed ", found(answer, K.ANCHOR_MIN), " km/h"), F.coalesce(delta, label("reference speed ", speed, " km/h")))
    facts = F.when(matches(question, K.ANCHOR_STRATEGY), tyres).when(matches(question, K.ANCHOR_CORNER), corners)
    wanted = facts.isNotNull() & (facts != "") & ~answer.startswith(K.KEY_FACTS)
    return F.when(wanted, F.concat(F.lit(K.KEY_FACTS), facts, F.lit(". "), answer)).otherwise(answer)


def dialogue(text: Column) -> Column:
    """Turns of an ENG:/DRV: script as messages; null for fewer than four."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    spoken = F.filter(lines, lambda x: x.startswith("ENG:") | x.startswith("DRV:"))
    turns = F.transform(spoken, lambda x: F.struct(F.when(x.startswith("ENG:"), "user").otherwise("assistant").alias("role"), F.trim(F.substring(x, 5, 1 << 30)).alias("content")))
    return F.when(F.size(turns) >= 4, turns)


def dialogue_facts(text: Column) -> Column:
    """Lap, tyre age, compound, degradation, cliff and viable stint that a dialogue names."""
    kinds = {"lap_number": "int", "tyre_age": "int", "compound": "string", "deg_rate": "double", "cliff_lap": "int", "max_viable_laps": "int"}
    facts = {n: F.lower(found(text, K.SPOKEN[n])).try_cast(kind) for n, kind in kinds.items()}
    return F.struct(F.get(drivers(text), F.lit(0)).alias("driver"), *(c.alias(n) for n, c in facts.items()))


def rewrite_is_valid(text: Column) -> Column:
    """Whether a rewritten question names lap, tyre, gap and track temperature."""
    t = F.lower(text)
    return t.contains("lap") & (t.contains("tyre") | t.contains("tire")) & t.contains("gap") & t.contains("track temp")


def vacuous(reply: Column) -> Column:
    """Whether a reply says too little of laps: empty, under 200 characters, or under 500 with fewer than two times."""
    times = F.regexp_count(reply, F.lit(K.STATED_TIME))
    return reply.isNull() | (F.length(F.trim(reply)) == 0) | ((F.length(reply) < 500) & (times < 2)) | (F.length(reply) < 200)


def misread_sign(negative_delta: Column, reply: Column) -> Column:
    """Whether a reply calls a driver slower although the data has a negative (faster) sector delta."""
    return negative_delta & matches(reply, K.SLOWER)


def plausible_times(lap_time: Column, *sectors: Column) -> Column:
    """Laps of 60 to 145 s, sectors of 10 to 60 s; missing values don't count against a row."""
    ok = F.coalesce(lap_time.between(60, 145), F.lit(True))
    return reduce(lambda a, s: a & F.coalesce(s.between(10, 60), F.lit(True)), sectors, ok)


def driver_name(code: Column) -> Column:
    """A driver's full name; a code that isn't known stands for itself."""
    pairs = [F.lit(x) for pair in K.FULL_NAMES.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), code)


def implausible(text: Column) -> Column:
    """What a block of telemetry states that can't be: an array of field and value, empty for a sound block.

    In lines of a table, the first four times are a lap and its sectors; lines in brackets and headings are
    passed over. Elsewhere labelled values count. A block that says that nothing was left by the filters is sound.
    """
    of = "array<struct<field:string,value:double>>"

    def out(field, value, low, high):
        return F.when(~value.between(low, high), F.struct(F.lit(field).alias("field"), value.alias("value")))

    def cells(line):
        times = F.regexp_extract_all(line, F.lit(K.TIME_CELL), F.lit(0))
        bad = lambda t: F.array(*(out(f, lap_time_seconds(F.get(t, F.lit(i))), low, high) for i, (f, low, high) in enumerate(K.CELL_BOUNDS)))
        table = ~F.trim(line).startswith("(") & ~line.contains("===")
        return let(times, lambda t: F.when(table & (F.size(t) >= 4), F.array_compact(bad(t))).otherwise(F.array().cast(of)))

    def labelled(field, pattern, low, high):
        values = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), 1)
        return F.array_compact(F.transform(values, lambda v: out(field, v.try_cast("double"), low, high))).cast(of)

    found = [F.flatten(F.transform(F.split(text, "\n"), cells)).cast(of)]
    for field, pattern, low, high in K.LABELLED:
        found.append(labelled(field, pattern, low, high))
    empty = text.isNull() | (F.trim(text) == "") | (F.lower(text).contains("no valid lap") & F.lower(text).contains("after filters"))
    return F.when(empty, F.array().cast(of)).otherwise(F.concat(*found))


def clean_response(text: Column) -> Column:
    """A model's reply without quotes around it and with its escapes undone."""
    t = F.trim(text)
    quoted = (F.length(t) >= 2) & (t.rlike(r'(?s)^".*"$') | t.rlike(r"(?s)^'.*'$"))
    t = F.when(quoted, F.trim(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)
    return F.replace(F.replace(t, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))


def recovered_json(text: Column, schema: str) -> Column:
    """The object that a reply holds: alone, in a fenced block, or inside of other text; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    inside = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(inside), schema)


def delta_lines(drivers_shown: Column, wanted: Column) -> Column:
    """Drivers whose delta lines a reply shows: the wanted ones, or all if none is named."""
    return F.when(F.size(wanted) == 0, drivers_shown).otherwise(F.array_intersect(drivers_shown, wanted))
