"""The filter audit and its scan of Arrow buffers against plain versions."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from stintline.llm import byte_scan, filter_audit

WORD = re.compile("[^ \t\n\v\f\r]+")


def facts(text):
    words = WORD.findall(text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text)), len(text)


def plain(docs, labels):
    """The contract, one order after the other."""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    failed = []
    for d, text, lang in docs:
        t = text or ""
        n, distinct, capitals, symbols, chars = facts(t)
        fails = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * chars, "D": symbols > 0, "E": d is not None and d > first[t]}
        failed.append((lang or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in failed}:
        mine, shapley = [x[1:] for x in failed if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in mine[i][0]]
                left = [i for i in left if f not in mine[i][0]]
                shapley[f] += len(gone)
                earlier = sum(f in x[0] and bool(x[0] & set(order[: step - 1])) for x in mine)
                out[part, "".join(order), step] = [len(left), len(gone), earlier, sum(x[0] == {f} for x in mine), sum(mine[i][1] for i in gone), sum(mine[i][2] for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels, parts=3):
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'x' AS part", "2 AS n").repartition(parts)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' AS lang")
    rows = filter_audit.filter_audit(docs, labels).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}


def some_docs(n, rng):
    pool = ["".join(rng.choice("abcdeABC") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["#tag", "é", "日本", "x" * 90]
    texts = [rng.choice((" ", "\n", "\t ")).join(rng.choices(pool if rng.random() < 0.6 else pool[:60], k=rng.choice((0, 3, 99, 100, 101, 300)))) for _ in range(n // 2)]
    texts += ["x " * 99 + "y", "word " * 100, "", " \t", " ".join(map(str, range(100))), " ".join(map(str, range(99)))]
    return [(i, rng.choice([*texts, None]), rng.choice(["en", "de", None, ""])) for i in range(n)]


def test_agrees_with_every_order(spark):
    rng = random.Random(8)
    docs = some_docs(150, rng)
    docs += [(3, docs[3][1], docs[3][2])] * 2 + [(None, docs[5][1], "en"), (None, docs[5][1], None), (7, "another text of the same id", "fr"), (0, docs[9][1], "en")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    got = audited(spark, docs, labels)
    assert got == plain(docs, labels) and len(got) == 600 * len({d[2] or "" for d in docs})


def test_copies_that_most_rows_are(spark):
    docs = [(i, "the very same text", "en" if i % 3 else "de") for i in range(400, 0, -1)]
    got = audited(spark, docs, [(1, 1, 0), (2, 1, 1)], parts=7)
    assert got == plain(docs, [(1, 1, 0), (2, 1, 1)])
    assert got["en", "EABCD", 1][:2] == [1, 266] and got["de", "EABCD", 1][:2] == [0, 133]


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    docs = [(None, None, None)]
    assert audited(spark, docs, []) == plain(docs, [])


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_scan_of_buffers(kind, monkeypatch):
    rng = random.Random(2)
    texts = [t for _, t, _ in some_docs(80, rng)] + ["a" * 300 + " " + "a" * 300 + "b", "İ ß Ⅷ", "A\x1fB \x85c", " lead", "trail ", None]
    for size in (1 << 20, 50, 1):
        monkeypatch.setattr(byte_scan, "PIECE", size)
        for column, want in ((pa.array(texts, kind), texts), (pa.array(["skip", *texts, "x"], kind).slice(1, len(texts)), texts), (pa.array([], kind), [])):
            got = byte_scan.scan(column)
            assert list(zip(*(got[c].tolist() for c in ("words", "distinct", "capitals", "symbols", "chars")))) == [facts(t or "") for t in want]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(byte_scan, "span_hashes", lambda data, starts, sizes: (sizes % 2).astype(np.uint64))
    texts = ["a b c a b", "aa bb aa", "one", "x" * 70 + " " + "y" * 70 + " " + "x" * 70, ""]
    assert byte_scan.scan(pa.array(texts))["distinct"].tolist() == [3, 2, 1, 2, 0]


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(600_000)) + " " + "z" * 2_000_000
    docs = [(1, text, "en"), (2, "tiny", "en")]
    assert audited(spark, docs, []) == plain(docs, [])
