"""Each operator on small tables: defined cases, and agreement with plain versions of the contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from stintline.llm import decontaminate, html_extract, line_dedup, ngram_join, packing, personal_data, quality_model, quality_rules, token_counts, token_files
from stintline.llm.common import stage_root
from stintline.llm.components import Union, components
from stintline.llm.html_blocks import leaf_blocks
from stintline.llm.html_pages import labelled_pages
from stintline.llm.tokens import Ids

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WHITE = " \t\n\v\f\r"
RNG = random.Random(11)
WORDS = ["The", "quick", "brown", "fox,", "jumps", "über", "ein", "lazy", "dog.", "Ñandú", "one", "two", "three"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


def fold(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


LONG = prose(30_000)
LINE = "This very line is repeated by a number of documents, as it is."
COPY = prose(120)
#: (doc_id, text, lang): nulls in every column, empty and blank and very long texts, repeats, ties.
ROWS = [
    (1, COPY, "en"),
    (2, COPY, "en"),
    (3, COPY + " tail", "en"),
    (4, None, "en"),
    (5, "", "fr"),
    (6, " \t\n ", None),
    (None, "A text without an id, of ten words or a few more of them.", "en"),
    (7, LONG, "de"),
    (8, f"{LINE}\nfirst own line", "en"),
    (9, f"  {LINE.upper()}\t\nsecond own line\n{LINE}", "en"),
    (10, f"{LINE}\r\nthird", "en"),
    (11, f"{LINE}\nfourth", "en"),
    (12, f"x\n{LINE}\n{LINE}\n", "en"),
    (12, f"x\n{LINE}\n{LINE}\n", "en"),
    (13, "Write to a.b@c.example.org or +1 (212) 555-0100, 10.0.0.1 and 4111 1111 1111 1111.", "en"),
    (14, "<|endoftext|> İstanbul Σίσυφος 日本 naïve don't ½ ''s", "en"),
    (15, "one two three", "en"),
    (16, "One TWO three", "en"),
    (17, "Uno dos tres cuatro", None),
    (18, "!!! ### " * 40, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns beside the contract's whose names clash with those that operators make."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, label string, tokens string, unit int, _text string, keys string"
    rows = [(i, t, g, "s", None if t is None else len(t), -1, "x", "y", 3, "z", "k") for i, t, g in ROWS]
    return spark.createDataFrame(rows, schema).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def whole_ids(text):
    return Ids(VOCABULARY).library.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, none):
    got = rows_of(token_counts.token_counts(docs, VOCABULARY), "doc_id", "n_bytes", "n_tokens")
    assert got == Counter((i, len((t or "").encode()), len(whole_ids(t))) for i, t, _ in ROWS)
    assert token_counts.token_counts(none, VOCABULARY).count() == 0
    named = token_counts.token_counts(docs.withColumn("doc_id", docs["doc_id"].cast("string")), VOCABULARY)
    assert rows_of(named, "doc_id") == Counter((None if i is None else str(i),) for i, _, _ in ROWS)


def test_merging_is_the_librarys(spark):
    counts, ids, rng = token_counts.MergeCounts(VOCABULARY), Ids(VOCABULARY), random.Random(2)
    letters = "abAB'stvel ,.!\n9²éÉßœΣ<|>́\x85日"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        want = ids.whole(text)
        assert ids.encode(text) == want and counts.count(text) * 4 == len(want), text
    for text in ("<|startoftext|>a<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|", "x" * 3000):
        assert counts.count(text) == len(whole_ids(text))


def plain_counts(text):
    words = re.findall(f"[^{WHITE}]+", text or "")
    windows = Counter(zip(*(words[i:] for i in range(5)), strict=False))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        copies += bool(re.search(f"[^{WHITE}]", line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(inside)


def test_quality_counts():
    rng = random.Random(3)
    for text in [t for _, t, _ in ROWS] + ["a b c d e " * 4, "x\nx\n \n ", *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(300))]:
        assert quality_rules.text_counts(text)[:5] == plain_counts(text)


def labelled(spark, n=600):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join(w + ("***" if bad else "") for w in prose(30, rng).split())
        rows.append((i, text, "en" if i % 3 else "de", "s", len(text), 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")


def test_quality_rules_certify(spark, docs, none):
    table = labelled(spark, 2400)
    labels = table.select("doc_id", "quality")
    out = quality_rules.quality_rules(table, labels).join(labels, "doc_id")
    got = Counter((r["quality"], r["kept"]) for r in out.collect())
    assert got[0, True] == 0 and 0.97 * 1800 <= got[1, True] <= 1800 == got[1, True] + got[1, False]
    kept = quality_rules.keep_good(table, labels)
    assert kept.columns == table.columns and kept.where("quality = 0").count() == 0 and kept.count() == got[1, True]
    # without labels nothing is certified, and only the base rejects
    bare = quality_rules.quality_rules(docs, labels.where("1 = 0"))
    for r in bare.collect():
        assert r["kept"] == (not r["base_failed"]) and r["broken"] == []
    assert Counter(r["doc_id"] for r in bare.collect()) == Counter(i for i, _, _ in ROWS)
    assert quality_rules.quality_rules(none, labels).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (3, 1), (3, 0)], "doc_id long, quality int")
    assert quality_rules.quality_rules(docs, odd).count() == len(ROWS)


def test_binomial_tail_is_exact():
    from fractions import Fraction
    from math import comb, exp

    for n, k in ((5, 0), (40, 3), (200, 11)):
        risk = Fraction(3, 100)
        exact = sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1))
        assert exp(quality_rules.log_tail(n, k, 0.03)) == pytest.approx(float(exact), rel=1e-9)


def judged(rng, stratum, n, shift, base=0):
    """Labelled statistics (stratum, good, first, v): bad texts are higher in the first two rules."""
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        v = [base + rng.randint(0, 40) + (0 if good else shift) for _ in range(2)] + [rng.randint(0, 5) for _ in range(len(quality_rules.RULES) - 2)]
        rows.append((stratum, good, i % 2 == 0, v))
    return rows


def plain_certify(rows):
    from fractions import Fraction
    from math import comb

    cuts, out = {}, {}
    strata = {r[0] for r in rows}
    for s in strata:
        half = [r for r in rows if r[0] == s and r[2]]
        ng, nb = sum(r[1] for r in half), sum(not r[1] for r in half)
        for i, (allowed, percent) in enumerate(quality_rules.LEVELS):
            cuts[s, i] = []
            for k in range(len(quality_rules.RULES)):
                gains = {}
                for v in {r[3][k] for r in half}:
                    lost, caught = sum(r[1] and r[3][k] > v for r in half), sum(not r[1] and r[3][k] > v for r in half)
                    if lost * 1000 <= ng * allowed and caught * ng > lost * nb:
                        gains[v] = caught * ng - lost * nb
                cuts[s, i].append(max((v for v, g in gains.items() if 100 * g >= percent * max(gains.values())), default=None))
    risk = Fraction(str(quality_rules.RISK))
    tests = len({r[0] for r in rows if r[1] and not r[2]})
    for s in strata:
        second = [r[3] for r in rows if r[0] == s and r[1] and not r[2]]
        n, level = len(second), 0
        for i in range(len(quality_rules.LEVELS)):
            k = sum(any(c is not None and x > c for x, c in zip(v, cuts[s, i])) for v in second)
            if not n or sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)) > Fraction("0.05") / tests:
                break
            level = i + 1
        if n:
            out[s] = n, level, cuts[s, level - 1] if level else None
    return out


def test_cutoffs_follow_their_definition(spark):
    rng = random.Random(12)
    rows = judged(rng, "a", 1400, 30) + judged(rng, "b", 900, 60, 25) + judged(rng, None, 700, 500) + judged(rng, "few", 40, 90) + judged(rng, "none", 500, 0)
    table = spark.createDataFrame(rows, "stratum string, good boolean, first boolean, v array<int>")
    got = {r["stratum"]: (r["n"], r["level"], r["cuts"]) for r in quality_rules.certify(table).collect()}
    assert got == plain_certify(rows)
    assert got["few"][1] == 0 and got["a"][1] > 0 and got["b"][1] > 0 and got["a"][2] != got["b"][2]
    # other labels, other cutoffs
    moved = [(s, g, f, [x * 2 for x in v]) for s, g, f, v in rows if s == "a"]
    again = {r["stratum"]: r["cuts"] for r in quality_rules.certify(spark.createDataFrame(moved, table.schema)).collect()}
    assert again["a"][0] != got["a"][2][0]
    assert quality_rules.certify(table.where("1 = 0")).count() == 0


def test_the_tail_of_many_texts_is_quick():
    assert quality_rules.certified(10**9, [10**9, 0], 4, 0.03, 0.05) == 0
    assert quality_rules.certified(10**9, [29_900_000, 29_999_000], 4, 0.03, 0.05) == 1


BENCH = [(100, prose(25)), (101, "short item here"), (102, None), (103, "  ,, "), (None, "also short words"), (104, "SHORT item, here")]


def plain_contamination(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))
    hit, items = set(), set()
    for item, body in BENCH:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(body or ""))
        n = min(10, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                items |= {str(item)} if item is not None else set()
    return len(words), len(hit), tuple(sorted(items))


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 250])
def test_decontamination(spark, docs, none, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate.benchmark_hits, "__defaults__", (*decontaminate.benchmark_hits.__defaults__[:-1], block_bytes))
    monkeypatch.setattr(decontaminate.contamination, "__defaults__", (*decontaminate.contamination.__defaults__[:-1], block_bytes))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    words = BENCH[0][1].split()
    extra = [(50, "intro " + " ".join(words[3:18]).replace("t", "T") + " end", "en"), (51, " ".join(words[:4]), "en"), (52, "a Short-Item; here! also short words b", "en")]
    more = spark.createDataFrame([(i, t, g, "s", 1, -1, "x", "y", 3, "z", "k") for i, t, g in extra], docs.schema)
    table = docs.unionByName(more)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(table, bench).collect())
    assert got == Counter((i, *plain_contamination(t)) for i, t, _ in ROWS + extra)
    kept = decontaminate.decontaminate(table, bench)
    assert kept.columns == table.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _, _ in ROWS) + Counter([51])
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(more, bench, "spans").collect()}
    assert cut[50] == "intro  end" and cut[51] == extra[1][1]
    assert "Short" not in cut[52] and cut[52].startswith("a ") and cut[52].endswith(" b")
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("1 = 0")).where("n_hit > 0").count() == 0


PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and personal_data.luhn(digits), 9 <= len(digits) <= 15)
            if good[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_personal_data_finds_what_the_patterns_find():
    anchors, rng = personal_data.automaton(), random.Random(7)
    for letters in ("ab@.-+ 1", "0123 -", "1234.+() -", "+12@a.b-% é"):
        for _ in range(4000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 34)))
            assert [s for s in personal_data.find_spans(text, anchors) if s[1] < 4] == plain_spans(text), text


def test_personal_data_adds_cued_kinds(spark, docs, none):
    anchors = personal_data.automaton()
    text = 'IBAN: GB82 WEST 1234 5698 7654 32, https://bob:pw@host.example/x, token = "9b0b3c6a43eb78aa99cbd704", token of thanks'
    found = {personal_data.KINDS[k]: text[a:b] for a, k, b in personal_data.find_spans(text, anchors)}
    assert found["account"] == "GB82 WEST 1234 5698 7654 32" and found["link"] == "bob:pw" and found["secret"] == "9b0b3c6a43eb78aa99cbd704"
    spans = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(docs).collect()}
    assert [s["kind"] for s in spans[13]] == ["email", "phone", "ip", "card"] and spans[4] == [] and spans[5] == []
    clean = {r["doc_id"]: r["text"] for r in personal_data.redact(docs).collect()}
    assert clean[13] == "Write to [EMAIL] or [PHONE], [IP] and [CARD]." and clean[4] is None and clean[7] == LONG
    assert personal_data.personal_data(none).count() == 0


def plain_components(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(f"[^{WHITE}]+", fold(t or ""))
        sets.append(frozenset(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    u = Union()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and den * len(a & sets[j]) >= num * len(a | sets[j]):
                u.join(i, j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[u.root(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in least[u.root(i)] if x is not None), default=None)) if sets[i] else (d, 0, d) for i, (d, _) in enumerate(rows))


def near_copies(rng, groups=6, each=25, words=60):
    rows = []
    for g in range(groups):
        base = [f"w{g}x{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
            if rng.random() < 0.3:
                w = w + [f"t{rng.randint(0, 5)}"] * rng.randint(1, 6)
            rows.append((len(rows) + 1000, " ".join(w)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"block_sets": 8, "block_tokens": 700}])
def test_ngram_join(spark, docs, none, limits):
    rows = [(i, t) for i, t, _ in ROWS] + near_copies(random.Random(9))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size, num in ((4, 85), (5, 80)):
        got = rows_of(ngram_join.ngram_join(table, size, num, 100, **limits), "doc_id", "n_shingles", "component_id")
        assert got == plain_components(rows, size, num, 100)
    if not limits:
        kept = ngram_join.keep_one(docs)
        assert kept.columns == docs.columns
        ids = Counter(r["doc_id"] for r in kept.collect())
        assert ids[1] == 1 and not {2, 3} & set(ids) and ids[4] == 1 and ids[None] == 1 and ids[15] == 1 and 16 not in ids
        assert ngram_join.ngram_join(none).count() == 0


def test_t_occurrence_against_all_pairs():
    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        sets = sorted(({rng.randint(0, 40) for _ in range(rng.randint(1, 30))} for _ in range(25)), key=len)
        found, want = Union(), Union()
        for i, j in ngram_join.t_occurrence([np.array(sorted(s), np.int64) for s in sets], list(range(25)), 3, 5):
            assert 5 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])
            found.join(i, j)
        for i in range(25):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                    want.join(i, j)
        assert [found.root(i) for i in range(25)] == [want.root(i) for i in range(25)]


@pytest.mark.parametrize("local", [0, 30, 1 << 17])
def test_components(spark, local):
    rng = random.Random(local)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), local).collect()}
    assert got == {x: u.root(x) for e in edges for x in e if u.root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), local).count() == 0


def ordered_rows():
    return sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_files_round_trip(spark, docs, none):
    path = f"{stage_root(spark)}/test-token-files"
    token_files.write_tokens(docs, path, VOCABULARY)
    files = token_files.read_tokens(spark, path)
    got = token_files.token_digests(files).orderBy("start").collect()
    at = 0
    for r, (i, text, _) in zip(got, ordered_rows(), strict=True):
        ids = [*whole_ids(text), 1]
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(data))
        at += len(ids)
    one = files.where("doc_id = 15").select("ids").first()["ids"]
    assert one == [*whole_ids("one two three"), 1]
    empty = f"{stage_root(spark)}/test-token-files-empty"
    token_files.write_tokens(none, empty, VOCABULARY)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_token_files_have_their_layout(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = f"{stage_root(spark)}/test-token-layout"
    token_files.write_tokens(docs, path, VOCABULARY)
    group = pq.ParquetFile(max(glob.glob(path.removeprefix("file://") + "/*.parquet"))).metadata.row_group(0)
    ids, size = group.column(4), group.column(3)
    assert ids.has_dictionary_page and ids.has_column_index and ids.has_offset_index
    assert "DELTA_BINARY_PACKED" in size.encodings


def plain_lines(rows):
    holders = defaultdict(set)
    key = lambda line: fold(line.strip(WHITE))
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders[key(line)].add(i)
    out = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [not (i is not None and len(holders[key(x)]) >= 5 and i != max(holders[key(x)])) for x in lines]
        kept = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
        out[i, len(lines), keep.count(False), hashlib.sha256(kept.encode()).hexdigest(), tuple(keep)] += 1
    return out


def test_line_dedup(docs, none):
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"], tuple(line_dedup.runs_decode(r["keep_runs"], r["n_lines"]))) for r in line_dedup.line_bitmaps(docs).collect())
    assert got == plain_lines(ROWS)
    assert line_dedup.line_bitmaps(none).count() == 0
    cut = line_dedup.drop_lines(docs)
    assert cut.columns == docs.columns
    by_id = {r["doc_id"]: r for r in cut.collect()}
    assert by_id[8]["text"] == "first own line" and by_id[8]["n_chars"] == 14 and by_id[4]["text"] is None and by_id[12]["text"].count(LINE) == 2


def test_line_dedup_is_native(docs):
    plan = line_dedup.line_bitmaps(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_packing(docs, none):
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and 4 * r["length"] == len(r["ids"])
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
    for i, text, _ in ROWS:
        ids = b"".join(x.to_bytes(4, "little") for x in [*whole_ids(text), 1])
        if i != 12:  # twice there
            assert b"".join(p[1] for p in sorted(pieces[i])) == ids and {p[2] for p in pieces[i]} == {len(ids) // 4}
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padded += at & (at - 1) != 0
    assert padded <= 4  # the last of each partition
    assert packing.pack_documents(none, VOCABULARY).count() == 0


def test_packing_loses_nothing():
    rng = random.Random(8)
    for trial in range(200):
        given = [(rng.randint(1, 2047), (i, 0)) for i in range(rng.randint(0, 50))]
        windows, rest = packing.pack(list(given), last=trial % 2 == 0)
        cover = defaultdict(list)
        for k, (tier, inside) in enumerate(windows):
            size = sum(p[2] for p in inside)
            assert size == tier or trial % 2 == 0 and k == len(windows) - 1
            for doc, start, n in inside:
                cover[doc].append((start, n))
        for n, (doc, start) in rest:
            cover[doc].append((start, n))
        assert sum(n for n, _ in rest) < 256
        for n, (doc, _) in given:
            at = 0
            for start, k in sorted(cover[doc]):
                assert start == at
                at += k
            assert at == n


def test_step_groups_are_balanced():
    lengths = [2048] * 64 + [1024] * 60 + [256] * 100
    groups, cost = packing.steps(lengths, 32 * 2048), Counter()
    for n, g in zip(lengths, groups, strict=True):
        cost[g] += n * (n + 4096)
    assert max(cost.values()) < 1.05 * min(cost.values())


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav><!-- no --><div class="ad">Buy this now</div>
<article><h1>A &amp; B</h1><p><b>First&nbsp;part<br>of   it.<br><p>Second &lt;x&gt; part of the article.<p>Short.</article>
<section class="comments"><p>Great post! I liked it.</p></section><form><label>E-mail</label><button>Send</button></form><footer>&copy; site</footer>"""


def test_html_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>"), (4, "x", "no markup < at all & more"), (5, "y", "<article>" + "<p>Words of a long page.</p>" * 5000), (1, "u", PAGE)]
    out = html_extract.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string"))
    got = Counter((r["page_id"], r["url"], r["text"]) for r in out.collect())
    assert got[1, "u", "A & B\nFirst part of it.\nSecond <x> part of the article.\nShort."] == 2
    assert got[2, None, ""] == 1 and got[None, "v", ""] == 1 and sum(got.values()) == len(rows)
    assert got[5, "y", "\n".join(["Words of a long page."] * 5000)] == 1
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_field_on_held_out_pages():
    field, wrong, total = html_extract.default_field(), 0, 0
    for html, marked in labelled_pages(150, seed=77):
        blocks = leaf_blocks(html)
        if [b.text for b in blocks] == [" ".join(t.split()) for t, _ in marked]:
            wrong += sum(a != b for a, (_, b) in zip(field.viterbi(blocks), marked, strict=True))
            total += len(blocks)
    assert total > 2000 and wrong < 0.01 * total


def test_viterbi_is_the_best_path():
    from itertools import product

    field = html_extract.Field({"always": 0.3, "in:p": 0.4, "in:li": -1.1, "digit": 0.9}, [[0.5, -0.6], [-0.4, 0.7]], [0.2, -0.1])
    for html in ("<p>a 1<li>b<p>c<li>d 2", "<li>a<li>b 3<p>c", "<p>x"):
        blocks = leaf_blocks(html)
        emit = [sum(field.weights.get(f, 0) for f in html_extract.block_features(b)) for b in blocks]

        def total(path, emit=emit):
            return field.start[path[0]] + sum(e for e, y in zip(emit, path, strict=True) if y) + sum(field.move[a][b] for a, b in zip(path, path[1:]))

        assert tuple(field.viterbi(blocks)) == max(product((0, 1), repeat=len(blocks)), key=total)


def test_quality_model(spark, docs, none):
    table = labelled(spark)
    labels = table.select("doc_id", "quality")
    out = quality_model.classify(table, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 80 and {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == r["quality"] for r in held) > 0.97 * len(held)
    machine = quality_model.train(table, labels)
    scores = {r["doc_id"]: r["score"] for r in quality_model.score(docs, machine).collect()}
    assert len(scores) == len({i for i, _, _ in ROWS}) and all(0 <= s <= 1 for s in scores.values()) and scores[4] == scores[5]
    assert quality_model.score(none, machine).count() == 0
    assert all(0 <= r["score"] <= 1 for r in quality_model.classify(docs, labels.where("1 = 0")).collect())


def test_quality_model_learns_from_no_held_out_row(spark):
    table = labelled(spark)
    labels = table.select("doc_id", "quality")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_model.train(table, labels), quality_model.train(table, flipped)
    assert (a.w == b.w).all() and (a.v == b.v).all() and a.w0 == b.w0


def test_machine_identity():
    """The linear-time pair sum equals the sum over pairs."""
    import numpy as np

    m = quality_model.Machine(3)
    m.w = np.random.default_rng(1).normal(size=m.w.shape).astype(np.float32)
    index, x = np.array([1, 5, 9, 20]), np.array([0.5, 1.0, 0.2, 0.7], np.float32)
    pairs = sum(float(m.v[index[i]] @ m.v[index[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    y = m.w0 + float(m.w[index] @ x) + pairs
    assert m.predict([(index, x)])[0] == pytest.approx(1 / (1 + np.exp(-y)), abs=1e-6)
