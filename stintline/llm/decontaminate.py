"""Operator 4, benchmark decontamination: a broadcast hash set of the benchmark's n-grams.

Benchmark texts are normalised to words; each run of `size` words (or the whole of a shorter item) is a
gram. What goes to every executor is a set of 64-bit hashes, with the place of each gram in the
benchmark's texts, which go along: some 24 bytes a gram. Documents are only mapped, in one pass: windows are
hashed in bulk, looked up, and hits are verified word for word. A gram names its items by the number of
their list, so a passage that many items share costs its hits no more than another; lists join later,
and only to the documents that hit. A benchmark beyond BLOCK_BYTES is scanned in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE, durable
from .hashing import window_hashes, word_hashes

SIZE = 10
#: Bytes of one broadcast: hashes, places and list numbers of grams, and the texts that hold them.
BLOCK_BYTES = 64 << 20
GRAM_BYTES = 18
#: Parts over which the join of a hot list of items is dealt.
PARTS = 32
#: A-Z lower-cased; ASCII other than letters and digits separates words.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Grams:
    """A hash set of grams, by number of words; finds verified grams in texts."""

    def __init__(self, texts: bytes, tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], lists: np.ndarray):
        """texts: normalised, each ended by a newline. tables: for each number of words the ascending
        hashes, the places in texts, and the numbers of the lists of items; lists: what these stand for."""
        self.texts, self.tables, self.lists = texts, tables, lists
        self.seen = {}
        for n, (hashes, _, _) in tables.items():
            bits = max(10, int(len(hashes) * 8).bit_length())
            known = np.zeros(1 << bits, bool)
            known[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.seen[n] = known, np.uint64(64 - bits)

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
        """The number of words; (first word, number of words) of each occurrence; the lists of its grams."""
        if not text:
            return 0, [], []
        data = text.encode().translate(FOLD)
        hashed = word_hashes(data)
        found, lists, words = [], set(), None
        for n, (hashes, places, numbers) in self.tables.items():
            if len(hashed) < n:
                continue
            h = window_hashes(hashed, n)
            known, shift = self.seen[n]
            at = np.flatnonzero(known[(h >> shift).astype(np.int64)])
            if not len(at):
                continue
            left = np.searchsorted(hashes, h[at])
            right = np.searchsorted(hashes, h[at], "right")
            for i, a, b in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
                if a == b:
                    continue
                words = words or data.split()
                gram = b" ".join(words[i : i + n])
                for k in range(a, b):  # two grams of one hash, if ever, both count
                    end = int(places[k]) + len(gram)
                    if self.texts[int(places[k]) : end] == gram and self.texts[end] <= 0x20:
                        found.append((i, n))
                        lists.add(int(self.lists[numbers[k]]))
        return len(hashed), sorted(found), sorted(lists)


def benchmark_grams(benchmark: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts: text, words; grams: hash, n, text, place, list; lists: list, item_ids) of the benchmark.

    A text is told by the hash of its words, a gram by its own; place is where it begins in its text. A
    list holds the ids of the items with a gram, distinct and sorted as strings.
    """
    schema = "item string, text long, words binary, hash long, n int, gram binary, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    if not words:
                        continue
                    n, whole = min(size, len(words)), b" ".join(words)
                    mark = xxh3_64_intdigest(whole) - (1 << 63)
                    hashes = window_hashes(word_hashes(whole), n).view(np.int64)
                    places = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
                    grams = [whole[places[i] : places[i + n] - 1] for i in range(len(hashes))]
                    k = len(grams)
                    columns = [[item] * k, [mark] * k, [whole, *[None] * (k - 1)], hashes, [n] * k, grams, places[:k]]
                    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "text", "words", "hash", "n", "gram", "place"])

    named = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    rows = durable(named.mapInArrow(run, schema), "benchmark-rows")
    grams = rows.groupBy("gram", "hash", "n").agg(F.min(F.struct("text", "place")).alias("at"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    grams = durable(grams.select("hash", "n", "at.*", "item_ids", F.xxhash64("item_ids").alias("list")), "benchmark-grams")
    texts = rows.where("words IS NOT NULL").groupBy("text").agg(F.first("words").alias("words"))
    return texts, grams.drop("item_ids"), grams.groupBy("list").agg(F.first("item_ids").alias("item_ids"))


def _block(texts: DataFrame, grams: DataFrame) -> tuple:
    """The arguments of Grams for a block, whose size was checked."""
    held, rows = texts.orderBy("text").toArrow(), grams.toArrow()
    words = held["words"].to_pylist()
    begins = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).astype(np.int64)
    text = np.searchsorted(held["text"].to_numpy(), rows["text"].to_numpy())
    place, hashes, n = begins[text] + rows["place"].to_numpy(), rows["hash"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    lists, number = np.unique(rows["list"].to_numpy(), return_inverse=True)
    tables = {}
    for size in np.unique(n).tolist():
        mine = np.flatnonzero(n == size)
        mine = mine[np.argsort(hashes[mine], kind="stable")]
        tables[size] = hashes[mine], place[mine].astype(np.uint32), number[mine].astype(np.uint32)
    return b"".join(w + b"\n" for w in words), tables, lists


FOUND = T.StructType([T.StructField("words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())]))), T.StructField("lists", T.ArrayType(T.LongType()))])


def _scan(docs: DataFrame, block: tuple, columns: list[str], text_col: str, hits: str) -> DataFrame:
    """The named columns, and under hits what a block of grams finds beside what blocks before it found."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(hits, FOUND)])
    arrow = to_arrow_schema(schema)
    more = hits in docs.columns
    read = [*columns, *([] if text_col in columns else [text_col]), *([hits] if more else [])]
    at_text = read.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(*sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part, rows = batch.slice(start, SLICE), []
                before = part.column(len(read) - 1).to_pylist() if more else [None] * part.num_rows
                for text, old in zip(part.column(at_text).to_pylist(), before, strict=True):
                    n, spans, lists = grams.find(text)
                    if old and old["spans"]:
                        spans, lists = sorted({*spans, *((h["at"], h["n"]) for h in old["spans"])}), sorted({*lists, *old["lists"]})
                    rows.append({"words": n, "n_hit": hit_words(spans), "spans": [{"at": a, "n": k} for a, k in spans], "lists": lists})
                kept = [part.column(i).cast(arrow.field(i).type) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, arrow.field(hits).type)], schema=arrow)

    return docs.select(*read).mapInArrow(run, schema)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, columns: list[str], size: int = SIZE, text_col: str = "text", hits: str = "_hits", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, lists). rows: the named columns of docs and, as hits, the number of words, the number of
    words inside any hit, each occurrence of a gram of the benchmark (spans: first word, words), and the lists
    of the grams that occur. lists: list, item_ids.

    Texts and items that are null or have no words hit nothing. An item without id still hits but is
    named nowhere; repeated items, texts and ids are no different from others; ties between grams
    can't arise, as all hits are returned. Without benchmark or docs, no hits or no rows.
    """
    texts, grams, lists = benchmark_grams(benchmark, size)
    texts = durable(texts, "benchmark-texts")
    total = GRAM_BYTES * grams.count() + (texts.agg(F.sum(F.octet_length("words") + 1)).first()[0] or 0)
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        return _scan(docs, _block(texts, grams), columns, text_col, hits), lists
    blocks *= 2  # so that uneven blocks stay within the bound
    out = docs.select(*{*columns, text_col})
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("text"), F.lit(blocks)) == b
        last = b == blocks - 1
        keep = [*columns, *([] if last or text_col in columns else [text_col])]
        out = durable(_scan(out, _block(texts.where(mine), grams.where(mine)), keep, text_col, hits), "benchmark-hits")
    return out, lists


def hit_words(spans: list[tuple[int, int]]) -> int:
    """Words inside any span of (first word, words)."""
    n = end = 0
    for at, size in sorted(spans):
        n += max(0, at + size - max(at, end))
        end = max(end, at + size)
    return n


def cut_spans(text: str, hits: list[dict]) -> str:
    """The text without its hit words; what separates words outside of hits stays."""
    data = text.encode()
    folded, spans, at = data.translate(FOLD), [], 0
    for w in folded.split():
        at = folded.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    out, end = [], 0
    for h in sorted(hits, key=lambda h: h["at"]):
        start, stop = spans[h["at"]][0], spans[h["at"] + h["n"] - 1][1]
        if start > end:
            out.append(data[end:start])
        end = max(end, stop)
    return b"".join([*out, data[end:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = SIZE, text_col: str = "text") -> DataFrame:
    """docs without contaminated rows (remove="documents"), or with the hit spans cut out of
    their texts (remove="spans"); all columns as they were. Cases as in benchmark_hits()."""
    columns = docs.columns
    packed = docs.select(F.col(text_col).alias("_text"), F.struct(*columns).alias("_row"))
    if remove == "documents":
        found, _ = benchmark_hits(packed, benchmark, ["_row"], size, "_text")
        return found.where("_hits.n_hit = 0").select("_row.*")
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    found, _ = benchmark_hits(packed, benchmark, ["_text", "_row"], size, "_text")
    cut = F.udf(lambda text, hits: cut_spans(text, [h.asDict() for h in hits]) if hits else text, T.StringType(), useArrow=True)
    return found.select(*(cut("_text", "_hits.spans").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in columns))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit and items (ids, distinct, sorted as strings) of every row of docs.

    The rows that hit, and they alone, fetch the lists of their grams; a list that many of them want is
    dealt to PARTS tasks.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    found, lists = benchmark_hits(slim, benchmark, ["doc_id"], size, "_text", block_bytes=block_bytes)
    found = found.select("doc_id", F.col("_hits.words").alias("n_words"), F.col("_hits.n_hit").alias("n_hit"), F.col("_hits.lists").alias("_lists"))
    found = durable(found.withColumn("_row", F.monotonically_increasing_id()), "benchmark-found")
    columns = ["doc_id", "n_words", "n_hit"]
    clean = found.where("n_hit = 0").select(*columns, F.array().cast("array<string>").alias("items"))
    lists = lists.select(F.col("list").alias("_list"), "item_ids", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    wanted = found.where("n_hit > 0").select("_row", *columns, F.explode("_lists").alias("_list"), F.pmod("_row", F.lit(PARTS)).cast("int").alias("_part"))
    hit = wanted.join(lists, ["_list", "_part"]).groupBy("_row", *columns).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("items"))
    return clean.unionByName(hit.select(*columns, "items"))
