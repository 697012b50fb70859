"""Operator 8, line dedup: lines that many documents repeat, found by sorted hashes. DataFrame functions only.

The hashes of all keys are range-partitioned by hash and document, and each partition is sorted by hash,
document and position, so the occurrences of a key stream past in order and the first of each document
is counted. A key that a third of all documents hold spreads over many ranges, since the document is part
of the range; each range counts its own documents, the ranges' counts are put together, and the verdict
goes back to each range. What returns to a document is its keep bitmap, coded as runs of kept lines, not
a text; it is made from the table of keys alone. Texts are only read again to apply the bitmaps. All
joins are by shuffle, so that the plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, release

LEAST_CHARS, LEAST_DOCS = 40, 5
#: The white space that keys lose at both ends, and the letters that they fold.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case.

    lower() is faster than translate() and folds the same letters where all characters are ASCII.
    """
    line = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def key_hash(line: Column, least_chars: int) -> Column:
    """A 128-bit hash of the line's key as two longs, or null if the key is too short.

    Two hashes of different kinds; among 10^12 keys a collision has a chance of about 10^-15.
    """
    key = line_key(line)
    return F.when(F.char_length(key) >= least_chars, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(0x5BD1E995), F.reverse(key)).alias("g")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_mark(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(text)


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (not null), mark (its text's) and drop, the ascending positions of the lines that it loses; a
    row for each document and text that loses any."""
    lines = docs.where(F.col(id_col).isNotNull() & (F.char_length(text_col) >= least_chars))
    lines = lines.select(F.col(id_col).alias("doc"), text_mark(F.col(text_col)).alias("mark"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keys = lines.select("doc", "mark", "pos", key_hash(F.col("line"), least_chars).alias("key")).where("key IS NOT NULL").select("key.h", "key.g", "doc", "mark", "pos")
    keys = durable(keys, "line-keys")
    place = F.row_number().over(Window.partitionBy("h", "g", "doc").orderBy("pos"))  # on the ranges and their sort
    ordered = keys.repartitionByRange("h", "g", "doc").withColumns({"first": place == 1, "part": F.spark_partition_id()})
    ordered = durable(ordered, "line-ordered")
    release(keys)
    parts = ordered.where("first").groupBy("h", "g", "part").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("doc"))
    by_key = Window.partitionBy("h", "g")  # a row for each range that holds the key
    common = parts.withColumns({"n": F.sum("n").over(by_key), "keeper": F.max("doc").over(by_key)}).where(F.col("n") >= least_docs)
    lost = ordered.join(common.select("h", "g", "part", "keeper"), ["h", "g", "part"]).where(F.col("doc") != F.col("keeper"))
    return lost.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def keep_runs(drop: Column, n_lines: Column) -> Column:
    """The keep bitmap as runs of kept lines, {first, n}: what lies between the ascending positions dropped."""
    before = F.transform(drop, lambda p, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(drop, i - 1) + 1).alias("first"), p.alias("end")))
    last = F.struct((F.element_at(drop, -1) + 1).alias("first"), n_lines.alias("end"))
    runs = F.transform(F.concat(before, F.array(last)), lambda r: F.struct(r["first"].alias("first"), (r["end"] - r["first"]).alias("n")))
    return F.filter(runs, lambda r: r["n"] > 0)


def runs_text(runs: Column) -> Column:
    """Runs as text: first:n, in order, comma-joined."""
    return F.array_join(F.transform(runs, lambda r: F.concat_ws(":", r["first"], r["n"])), ",")


def runs_decode(text: str, n_lines: int) -> list[bool]:
    """The keep bitmap that runs_text() wrote, a flag for each line."""
    keep = [False] * n_lines
    for run in text.split(",") if text else []:
        first, n = map(int, run.split(":"))
        keep[first : first + n] = [True] * n
    return keep


def kept_text(text: Column, runs: Column) -> Column:
    """The lines of the runs, joined; each run is cut out at once."""
    cut = lambda lines: F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["first"] + 1, r["n"]))), "\n")
    return F.get(F.transform(F.array(lines_of(text)), cut), F.lit(0))


def with_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _lines, their number, and _runs, the keep bitmap, null where all lines stay.

    A null text is one empty line. Rows with a null id are not counted as documents and lose
    nothing. Rows that share an id are one document: a key is lost from all of them or from none.
    A document may lose any number of lines; the work is in proportion to its lines.
    """
    lost = durable(dropped_lines(docs, least_chars, least_docs, id_col, text_col), "line-lost")
    lost = lost.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), F.col("drop").alias("_drop")).hint("shuffle_hash")
    same = (F.col(id_col) == F.col("_doc")) & (text_mark(F.col(text_col)) == F.col("_mark"))
    found = docs.join(lost, same, "left").withColumn("_lines", F.size(lines_of(F.col(text_col))))
    runs = F.when(F.col("_drop").isNotNull(), keep_runs(F.col("_drop"), F.col("_lines")))
    return found.withColumn("_runs", runs).drop("_doc", "_mark", "_drop")


def line_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_runs (the keep bitmap, as in runs_text()) and kept_sha256 of every row.

    The number of dropped lines and the hash are those of the bitmap.
    Other columns of docs are not read; an empty table gives an empty one; cases as in with_bitmaps().
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_bitmaps(slim, least_chars, least_docs)
    all_lines = F.array(F.struct(F.lit(0).alias("first"), F.col("_lines").alias("n")))
    kept = F.when(F.col("_runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept_text(F.col("text"), F.col("_runs")))
    n_kept = F.aggregate("_all", F.lit(0), lambda n, r: n + r["n"])
    return found.withColumn("_all", F.coalesce("_runs", all_lines)).select(
        "doc_id",
        F.col("_lines").cast("long").alias("n_lines"),
        (F.col("_lines") - n_kept).cast("long").alias("n_dropped"),
        runs_text(F.col("_all")).alias("keep_runs"),
        F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs without the lines that they lose; chars_col, if there, is counted again where lines went.

    Rows stay, even if all of their lines go; null texts stay null. All columns as they were.
    """
    columns = docs.columns
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*(c for c in columns if c != text_col)).alias("_row"))
    found = with_bitmaps(packed, least_chars, least_docs)
    some = F.col("_runs").isNotNull()
    found = found.withColumn("_new", F.when(some, kept_text(F.col("text"), F.col("_runs"))).otherwise(F.col("text")))
    out = []
    for c in columns:
        old = F.col("_new") if c == text_col else F.col("_row")[c]
        if c == chars_col:
            old = F.when(some, F.char_length("_new").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return found.select(*out)
