"""Operator 6, n-gram Jaccard join: T-occurrence search with DivideSkip, in blocks.

1. Documents with equal shingle sets become one class; classes are what is joined.
2. A class posts the tokens (shingle hashes) of its prefix: the prefixes of linked sets share several tokens,
   in any common order of tokens. The order puts tokens that many classes hold last, so that lists are
   short; the counts behind it only choose the order, so they may leave out rare tokens. The list of a
   token known to be frequent is dealt to several tasks. A class whose posted tokens are mostly its own
   has no link and drops out.
3. Linked sets lie in one band of sizes or in two that follow each other. In each pair of bands, classes that
   share posted tokens, directly or over others, form blocks. Inside a block, in one task, the T-occurrence search finds for each set the smaller sets with at least T common tokens: short inverted
   lists are merged with a heap, long ones probed by binary search (DivideSkip), and sets that are
   already known to be connected are passed over.
4. Blocks too large for a task are cut into random shards; what these link is contracted. Then a few members
   of each component meet; then the classes that still share enough tokens with other components, and
   only those, are searched in full, each pair of shards in a task. So a large group of copies costs about
   its own size, and no link is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from .common import SLICE, durable, release
from .components import components
from .hashing import mixed, window_hashes, word_hashes

#: Classes and tokens that one task searches at a time.
BLOCK_SETS, BLOCK_TOKENS = 512, 300_000
#: Tokens that the common order knows to be frequent: those counted at least so often, at most so many.
FREQUENT, MOST_FREQUENT = 32, 400_000
#: Tokens counted together in a task before their counts are passed on.
CHUNK = 1 << 20
#: Members of a component that meet those of others.
MEMBERS = 8
#: DivideSkip's weight of a probe against a merge step.
MU = 0.01
#: A linked set shares at least 1 + SHARE of the tokens that it may miss with each other posted set.
SHARE = 0.5
#: Latest members of a component that a set meets before the others.
RECENT = 3
#: Postings of a token, by its known count, beyond which its list is dealt to several tasks.
HOT = 256
#: Words of 64 bits in the filter of wanted classes: 8 MB, whatever the input.
FILTER_WORDS = 1 << 20


def shingle_set(text: bytes | str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; of its whole sequence if it is shorter."""
    data = text.encode() if isinstance(text, str) else bytes(text or b"")
    w = word_hashes(data.lower())  # bytes: ASCII letters and white space alone
    return np.unique(window_hashes(w, min(size, len(w))).view(np.int64)) if len(w) else np.zeros(0, np.int64)


def class_of(tokens: np.ndarray) -> int | None:
    """A 64-bit number for a set, the same for equal sets; among 10^9 different sets, two agree with a
    chance of 3 %. None for the empty set."""
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(tokens.tobytes())
    return (h - (1 << 64) if h >> 63 else h) if len(tokens) else None


def must_share(n: int, num: int, den: int) -> int:
    """Tokens that the prefixes of two linked sets share, if the smaller has n: 1 and SHARE of what a
    set of n may miss. It doesn't fall as n grows."""
    return 1 + int(SHARE * (n - -(-num * n // den)))


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens that a set of n posts. Sets with T common tokens share k of their first n - T + k ones."""
    return n - -(-num * n // den) + must_share(n, num, den)


def size_band(n: int, num: int, den: int) -> int:
    """A band of sizes: linked sets lie in one band, or in two that follow each other."""
    return int(log(n) / max(1e-6, 1.0001 * log(den / num)))


def known_counts(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each token was counted; 0 for those not known to be frequent."""
    if not len(frequent):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    return np.where(frequent[at] == tokens, counts[at], 0)


def t_occurrence(sets: list[np.ndarray], labels: list[int], num: int, den: int, mu: float = MU, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) between sets with den * intersection >= num * union that join all sets which links
    connect; sets of one label count as connected from the start, and sets of one side, if sides are
    given, needn't be compared. Sets must be in order of size.

    Each set first meets the latest members of each component, then all sets of the components that
    it didn't join; so a family of copies is merged by a few lists of a few members.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    apart = len(set(labels))
    if apart < 2:
        return []
    part = np.unique(np.array(labels, np.int64), return_inverse=True)[1]  # each set's component
    recent: dict[int, list[int]] = {}
    shown = np.zeros(len(sets), bool)
    tokens, place, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")  # inverted lists, one after another, each ascending
    posted, begins = owner[order], np.cumsum(df) - df
    place = np.split(place, np.cumsum(sizes)[:-1])
    links = []

    def join(c: int, q: int):
        a, b = int(part[c]), int(part[q])
        part[part == b] = a
        both = sorted(recent.pop(a, []) + recent.pop(b, []))
        shown[both[:-RECENT]] = False
        recent[a] = both[-RECENT:]
        links.append((c, q))

    def skip(q: int, who: np.ndarray, of: np.ndarray, need: int):
        """DivideSkip over the lists (of) of earlier sets (who): merge the short ones, probe the long ones."""
        cuts = np.flatnonzero(np.diff(of)) + 1
        if len(who) == 0 or len(cuts) + 1 < need:
            return
        found = sorted((x.tolist() for x in np.split(who, cuts)), key=len)
        n_long = min(need - 1, int(need / (mu * log2(len(found[-1]) + 1) + 1)))
        short, long = found[: len(found) - n_long], found[len(found) - n_long :]
        for c, run in groupby(merge(*short)):
            count = sum(1 for _ in run)
            if count < need - n_long or part[c] == part[q]:
                continue
            wanted = -(-num * (len(sets[q]) + len(sets[c])) // (num + den))
            for k in range(len(long) - 1, -1, -1):
                if count >= wanted or count + k + 1 < wanted:
                    break
                at = bisect_left(long[k], c)
                count += at < len(long[k]) and long[k][at] == c
            if count >= wanted:
                join(c, q)

    for q in range(len(sets)):
        n = len(sets[q])
        low = -(-num * n // den)
        first = int(np.searchsorted(sizes[:q], low))
        need = -(-num * (n + low) // (num + den))
        mine = place[q][df[place[q]] > 1]
        if first < q and len(mine) >= need:
            lens = df[mine]
            who = posted[np.repeat(begins[mine] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
            of = np.repeat(np.arange(len(mine)), lens)
            here = (who >= first) & (who < q) & (part[who] != part[q])
            if sides is not None:
                here &= sides[who] != sides[q]
            who, of = who[here], of[here]
            met = shown[who]
            skip(q, who[met], of[met], need)
            here = ~met & (part[who] != part[q])
            skip(q, who[here], of[here], need)
            if len(links) >= apart - 1:
                return links
        mates = recent.setdefault(int(part[q]), [])
        mates.append(q)
        shown[q] = True
        if len(mates) > RECENT:
            shown[mates.pop(0)] = False
    return links


_DOCS = [T.StructField(n, T.LongType()) for n in ("cls", "n", "token", "times")]


def _read_sets(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """A row (id, cls, n) for each document, and rows (token, times) of tokens that classes of one
    task share."""
    kind = docs.schema["_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *_DOCS, T.StructField("is_doc", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, seen = [], 0, set()

        def counted():
            t, k = np.unique(np.concatenate(waiting), return_counts=True)
            t, k = t[k > 1], k[k > 1]
            none = pa.nulls
            return pa.RecordBatch.from_arrays([none(len(t), arrow.field(0).type), none(len(t), pa.int64()), none(len(t), pa.int64()), pa.array(t), pa.array(k.astype(np.int64)), pa.array([False] * len(t))], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                classes, sizes = [], []
                for text in part.column(1).to_pylist():
                    tokens = shingle_set(text, size)
                    classes.append(class_of(tokens))
                    sizes.append(len(tokens))
                    if len(tokens) and classes[-1] not in seen:
                        seen.add(classes[-1])
                        waiting.append(tokens)
                        held += len(waiting[-1])
                k = len(classes)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([True] * k)], schema=arrow)
                if held >= CHUNK:
                    yield counted()
                    waiting.clear()
                    seen.clear()
                    held = 0
        if waiting:
            yield counted()

    return docs.mapInArrow(run, schema)


def _postings(docs: DataFrame, size: int, num: int, den: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """The prefix of each class, in the common order: tokens by known count, then by hash.

    Columns: token, cls; need, how many posted tokens a linked set would share; own, the band of its size;
    salts, in how many parts a frequent token's list is dealt, and salt, the part of this class.
    Copies within a task post once.
    """
    sent = docs.sparkSession.sparkContext.broadcast((frequent, counts))  # MOST_FREQUENT rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        frequent, counts = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out, often, of, need, band = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [], []
                for text in batch.column(0).slice(at, SLICE).to_pylist():
                    tokens = shingle_set(text, size)
                    cls = class_of(tokens)
                    if cls is None or cls in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(cls)
                    n, times = len(tokens), known_counts(tokens, frequent, counts)
                    chosen = np.argsort(times, kind="stable")[: prefix_length(n, num, den)]
                    out.append(tokens[chosen])
                    often.append(times[chosen])
                    k = len(chosen)
                    of += [cls] * k
                    need += [must_share(-(-num * n // den), num, den)] * k
                    band += [size_band(n, num, den)] * k
                salts = 1 + np.concatenate(often) // HOT
                classes = np.array(of, np.int64)
                salt = (mixed(classes.view(np.uint64)) % salts.astype(np.uint64)).astype(np.int32)
                columns = [pa.array(np.concatenate(out)), pa.array(classes), pa.array(need, pa.int32()), pa.array(band, pa.int32()), pa.array(salts.astype(np.int32)), pa.array(salt)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "cls", "need", "own", "salts", "salt"])

    return docs.select("_text").mapInArrow(run, "token long, cls long, need int, own int, salts int, salt int")


def _needed(posts: DataFrame, of: list[str]) -> DataFrame:
    """The posts of classes (of) that keep as many as they need."""
    return posts.withColumn("_kept", F.count(F.lit(1)).over(Window.partitionBy(*of))).where("_kept >= need").drop("_kept")


def _posted_twice(posts: DataFrame) -> DataFrame:
    """The posts of tokens that two classes hold, of classes that keep as many as they need.

    A list in parts isn't looked at, as its token is known to be frequent. A class posts each token once
    for each task that read a copy of it; this can only keep a class that could go.
    """
    w = Window.partitionBy("token", "salt")
    told = (F.col("salts") > 1) | (F.min("cls").over(w) < F.max("cls").over(w))
    return _needed(posts.withColumn("_told", told).where("_told").drop("_told"), ["cls"])


def _shared(posts: DataFrame, member: str = "cls") -> DataFrame:
    """The posts of lists (token, band) that hold two members, of classes that keep as many as they need.

    In a pair of bands, a list counts only if it holds a set of the lower band, since the others also
    meet in the next pair. Of a list in parts, the parts' minima and maxima are put together.
    """
    by = ["token", "band"]
    w = Window.partitionBy(*by)
    told = (F.min(member).over(w) < F.max(member).over(w)) & (F.min("own").over(w) == F.col("band"))
    cold = posts.where("salts = 1").withColumn("_told", told).where("_told").drop("_told")
    hot = posts.where("salts > 1")
    lists = hot.groupBy(*by, "salts").agg(F.min(member).alias("_lo"), F.max(member).alias("_hi"), F.min("own").alias("_own")).where("_lo < _hi AND _own = band")
    lists = lists.select(*by, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return _needed(cold.unionByName(hot.join(lists, [*by, "salt"], "left_semi")), ["cls", "band"])


def _edges(active: DataFrame) -> DataFrame:
    """Edges (a, b) that join all labels of each list (token, band), within the band: each label to the
    smallest of its part, and these to the smallest of all parts."""
    by = ["token", "band"]
    near = active.withColumn("hub", F.min("label").over(Window.partitionBy(*by, "salt"))).where("label <> hub").select("label", "hub", "band")
    parts = active.where("salts > 1").groupBy(*by, "salt").agg(F.min("label").alias("label"))
    far = parts.withColumn("hub", F.min("label").over(Window.partitionBy(*by))).where("label <> hub").select("label", "hub", "band")
    return near.unionByName(far).select(F.xxhash64("label", "band").alias("a"), F.xxhash64("hub", "band").alias("b")).distinct()


def _filter_of(wanted: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_WORDS words, put together on the executors, with a bit for each class (cls)."""
    at = F.col("cls").bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """uid, cls, n and tokens (64-bit integers, as bytes) of the wanted classes (cls), and of some others.

    A class comes once from each task that holds a copy; uid tells these apart. Classes are let through
    by a filter of fixed size; later steps pick theirs by uid, so one that is let through in vain only takes space.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, held, uid = set(), sent.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out, of = [], []
                for text in batch.column(0).slice(at, SLICE).to_pylist():
                    tokens = shingle_set(text, size)
                    cls = class_of(tokens)
                    if cls is None or cls in seen:
                        continue
                    place = cls & (FILTER_WORDS * 64 - 1)
                    if not int(held[place >> 6]) >> (place & 63) & 1:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(cls)
                    out.append(tokens.tobytes())
                    of.append(cls)
                uids, uid = range(uid, uid + len(of)), uid + len(of)
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(of, pa.int64()), pa.array([len(t) // 8 for t in out], pa.int64()), pa.array(out, pa.binary())], names=["uid", "cls", "n", "tokens"])

    return docs.select("_text").mapInArrow(run, "uid long, cls long, n long, tokens binary")


def _search(units: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) within each unit of rows (unit, label, side, cls, tokens), one unit in memory at a
    time; of a unit with two sides, between them alone."""

    def links(label, side, cls, tokens):
        order = sorted(range(len(cls)), key=lambda i: (len(tokens[i]), cls[i]))
        sets = [np.frombuffer(tokens[i], np.int64) for i in order]
        sides = np.array([side[i] for i in order]) if any(x >= 0 for x in side) else None
        found = t_occurrence(sets, [label[i] for i in order], num, den, sides=sides)
        return [(cls[order[i]], cls[order[j]]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, ([], [], [], [])
        out: list = []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                columns = [c.to_pylist() for c in batch.slice(at, SLICE).columns]
                for u, *row in zip(*columns, strict=True):
                    if u != unit:
                        out += links(*rows)
                        unit, rows = u, ([], [], [], [])
                    for held, x in zip(rows, row, strict=True):
                        held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out = []
        out = links(*rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as the work isn't in the bytes
    ordered = units.select("unit", "label", "side", "cls", "tokens").repartition(tasks, "unit").sortWithinPartitions("unit")
    return ordered.mapInArrow(run, "a long, b long")


def _labelled(table: DataFrame, labels: DataFrame | None, column: str = "cls") -> DataFrame:
    """table with label: the component of the class, itself if it has none."""
    if labels is None:
        return table.withColumn("label", F.col(column))
    named = labels.select(F.col("node").alias(column), F.col("label").alias("_label"))
    return table.join(named, column, "left").withColumn("label", F.coalesce("_label", column)).drop("_label")


def _sized(rows: DataFrame, by: list[str], block_sets: int, block_tokens: int) -> DataFrame:
    """rows with shards: in how many parts a task each must take the rows of a group."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_sets"), F.sum("n").alias("_tokens"))
    shards = F.greatest(F.ceil(F.col("_sets") / block_sets), F.ceil(F.col("_tokens") / block_tokens))
    return rows.join(sizes.select(*by, shards.alias("shards")), by)


def _units(held: DataFrame, step: str, block_sets: int, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(rows with unit, what one task searches at a time; cls and band of those whose links are then known).

    A block that a task can take is a unit. A larger one is cut by step: into random shards, or into
    a few members of each component, or into all pairs of shards. A unit of two shards has two sides,
    as each shard also meets itself; other units have none (-1).
    """
    if step == "members":
        members = held.groupBy("block", "label").agg(F.count(F.lit(1)).alias("_members"))
        some = F.pmod(F.xxhash64("cls", F.lit(29)), F.ceil(F.col("_members") / MEMBERS)) == 0
        held = held.join(members, ["block", "label"]).where(some).drop("_members")
    held = _sized(held, ["block"], block_sets, block_tokens)
    shard = F.pmod(F.xxhash64("cls", F.lit(17)), F.col("shards"))
    if step == "pairs":
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
        units = held.withColumn("_mine", shard).withColumn("_other", other)
        units = units.withColumn("unit", F.xxhash64("block", F.least("_mine", "_other"), F.greatest("_mine", "_other")))
        units = units.withColumn("side", F.when(F.col("_mine") == F.col("_other"), -1).otherwise(F.col("_mine")))
    else:
        units = held.withColumn("unit", F.xxhash64("block", shard)).withColumn("side", F.lit(-1))
    settled = held.where(F.lit(False) if step == "members" else F.col("shards") == 1).select("cls", "band").distinct()
    return units.select("unit", "label", "side", "uid"), settled


def class_components(docs: DataFrame, size: int, num: int, den: int, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, cls, n) of every row of docs (_id, _text), and node, label: the classes that links join.

    The second is None if there is no link.
    """
    read = durable(_read_sets(docs, size, num, den), "join-sets")
    rows = read.where("is_doc").select("doc_id", "cls", "n")
    often = read.where("NOT is_doc").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    often = often.orderBy(F.col("times").desc(), "token").limit(MOST_FREQUENT).toArrow()
    order = np.argsort(often["token"].to_numpy())
    frequent, counts = often["token"].to_numpy()[order], often["times"].to_numpy()[order]
    posts = durable(_posted_twice(_postings(docs, size, num, den, frequent, counts)), "join-posts")
    # each set joins those of its band and of the one before
    banded = durable(_shared(posts.withColumn("band", F.explode(F.array("own", F.col("own") - 1)))), "join-posts")
    release(posts)
    posts = durable(_shared(banded), "join-posts")  # as classes drop out, lists shrink
    release(banded)
    wanted = durable(posts.select("cls").distinct(), "join-wanted")
    sets = durable(_sets_of(docs, wanted, size), "join-classes", compression="none")
    picked = durable(sets.join(wanted, "cls", "left_semi").groupBy("cls", "n").agg(F.min("uid").alias("uid")), "join-picked")
    labels = links = None
    for step in ("shards", "members", "pairs"):
        # a link yet to be found shares enough tokens, and all of these are in lists of two components
        active = durable(_shared(_labelled(posts, labels), "label"), "join-active")
        if active.isEmpty():
            break
        node = F.xxhash64("label", "band")
        blocks = components(_edges(active))
        blocks = durable(blocks.select(F.col("node").alias("_node"), F.col("label").alias("_block")), "join-blocks")
        held = active.select("cls", "label", "band").distinct().withColumn("node", node).join(blocks, F.col("node") == F.col("_node"), "left")
        held = durable(held.select("cls", "label", "band", F.coalesce("_block", "node").alias("block")).join(picked, "cls"), "join-held")
        units, settled = _units(held, step, block_sets, block_tokens)
        units = durable(units, "join-units")
        # the first step has about as many units as candidates, and one plan for every size; what is left after it is little
        sent = units.hint("shuffle_hash") if step == "shards" else units
        found = durable(_search(sets.join(sent, "uid"), num, den), "join-links")
        left = durable(posts.join(settled, ["cls", "band"], "left_anti"), "join-posts")
        release(posts, active, blocks, held, units)
        posts = left
        links = found if links is None else links.unionByName(found)
        labels = durable(components(links), "join-labels")
    release(posts, wanted, sets, picked)
    return rows, labels


def ngram_join(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest id that links lead to.

    Rows link when den * intersection >= num * union of their shingle sets. Texts without words, and
    null texts, have no shingles and link with nothing. Each row is a document of its own, also if its id
    is null or repeated; a null id is never the smallest. Equal sets always link. Other columns of
    docs are not read, and an empty table gives an empty one. Long texts cost in proportion.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    joined = _with_component(slim, size, num, den, block_sets, block_tokens)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _with_component(slim: DataFrame, size: int, num: int, den: int, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n and component_id, the smallest doc_id that is not null, of every row of slim (_id, _text)."""
    rows, labels = class_components(slim, size, num, den, block_sets, block_tokens)
    least = _labelled(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least")), labels)
    least = durable(least, "join-least")
    best = least.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = durable(least.join(best, "label").select(F.col("cls").alias("_cls"), "component_id"), "join-components")
    joined = rows.join(classes, F.col("cls") == F.col("_cls"), "left")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n", own.alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs with one row of each component: the first row of its smallest id. All columns as they were.

    Rows are told apart by a number that is written with them, so that rows of one id, with one text or
    several, are decided one by one. Rows with a null id stay, as nothing tells which of them would be
    first; so do rows without words.
    """
    columns = docs.columns
    row = "_row" + "_" * max(map(len, columns))  # longer than any name in docs
    held = durable(docs.withColumn(row, F.monotonically_increasing_id()), "join-rows")
    place = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.col(row).alias("row")))
    found = _with_component(held.select(place.alias("_id"), F.col(text_col).cast("binary").alias("_text")), size, num, den, block_sets, block_tokens)
    gone = durable(found.where("doc_id.row <> component_id.row").select(F.col("doc_id.row").alias(row)), "join-gone")
    # one plan for every size: rows are dealt by their numbers, and those that go are a task's hash table
    return held.join(gone.hint("shuffle_hash"), row, "left_anti").select(*columns)
