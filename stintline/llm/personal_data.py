"""Operator 5, personal data: Aho-Corasick anchors, expanded by deterministic local parsers.

One automaton finds every anchor of a text in a single pass: at-signs, scheme separators, plus signs
before a digit, dots and separators between digits, and cue words of accounts and secrets. At each anchor a
parser walks left and right over the characters that its kind allows, settles the boundaries and
validates what lies between. Four kinds follow fixed patterns (BASE); the parsers walk instead of
matching, but find what the patterns find, leftmost and non-overlapping. The cues add three kinds more:
accounts (IBAN, by their check digits), secrets (given to a named key, or told by a known prefix), and
user information in links. Cues count in any case.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE, map_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "link")
#: The characters of the base patterns.
DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
GAPS = frozenset(" -")
DIALLED = frozenset(" ().-" + string.digits)
#: Cues and the least length of a secret.
ACCOUNT_CUES = ("iban", "account")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key", "bearer")
SECRET = frozenset(string.ascii_letters + string.digits + "_+/=-.~")
LEAST_SECRET = 16
#: Letters and digits of an account number at most, as its standard says.
MOST_CODE = 34
#: Prefixes of widely used access keys, the characters after them, and how many of these there are (at least, at most).
NO_END = 1 << 62
_UPPER, _WORD = frozenset(string.ascii_uppercase + string.digits), frozenset(string.ascii_letters + string.digits + "_-")
KEY_PREFIXES = {"AKIA": (_UPPER, 16, 16), "ASIA": (_UPPER, 16, 16), "AIza": (_WORD, 35, 35), "ghp_": (_WORD, 36, NO_END), "gho_": (_WORD, 36, NO_END), "ghs_": (_WORD, 36, NO_END), "sk_live_": (_WORD, 16, NO_END), "xoxb-": (_WORD, 20, NO_END), "xoxp-": (_WORD, 20, NO_END)}
_FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def iban(code: str) -> bool:
    if not (15 <= len(code) <= MOST_CODE and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def automaton():
    from ahocorasick import Automaton

    found = Automaton()
    for a in string.digits:
        found.add_word(f"+{a}", ("phone", 2))
        for b in string.digits:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for gap in ("", " ", "-"):
                found.add_word(f"{a}{gap}{b}", ("card", 2 + len(gap)))
    found.add_word("@", ("email", 1))
    found.add_word("://", ("link", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    for prefix in KEY_PREFIXES:
        found.add_word(prefix.lower(), ("prefix", len(prefix)))
    found.make_automaton()
    return found


def _folded(text: str) -> str:
    """The text in lower case, character by character: what anchors are looked for in."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


def _right(text: str, at: int, allowed: frozenset) -> int:
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def _email(text: str, sign: int, last: int) -> tuple[int, int, bool]:
    start = sign
    while start > last and text[start - 1] in LOCAL:
        start -= 1
    end = _right(text, sign + 1, LABEL)
    labels = 0
    while end > sign + 1 and end < len(text) and text[end] == "." and (after := _right(text, end + 1, LABEL)) > end + 1:
        labels, end = labels + 1, after
    return (start, end, True) if start < sign and labels else (sign, last, False)


def _chain(text: str, at: int, gaps: frozenset | set, last: int) -> tuple[int, int]:
    """The longest run of digits with at most one gap between two of them around the digit at `at`."""
    start = at
    while start > last and (text[start - 1] in DIGITS or text[start - 1] in gaps and start - 1 > last and text[start - 2] in DIGITS):
        start -= 1 if text[start - 1] in DIGITS else 2
    end, n = at + 1, len(text)
    while end < n and (text[end] in DIGITS or text[end] in gaps and end + 1 < n and text[end + 1] in DIGITS):
        end += 1 if text[end] in DIGITS else 2
    return start, end


_DOT = frozenset(".")


def _phone(text: str, plus: int) -> int:
    """The end of the number that begins at the plus sign, or 0."""
    end = _right(text, plus + 2, DIALLED)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > plus + 3 else 0


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The longest valid account number that begins here: up to MOST_CODE letters and digits, however they are spaced."""
    while at < len(text) and text[at] in " :=#.\"'":
        at += 1
    code, end, i = "", at, at
    while i < len(text) and len(code) < MOST_CODE:
        c = text[i]
        i += 1
        if c in DIGITS or "A" <= c <= "Z":
            code += c
            if iban(code):
                end = i
        elif c not in " -":
            break
    return (at, end) if end > at else None


class Runs:
    """The run of secret characters around a place: each run of a text is walked once, however many cues it holds."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.digit = text, 0, 0, -1

    def value(self, at: int) -> int:
        """The end of the secret that begins at a place, or 0: long enough, with a digit, without dots at its end."""
        text = self.text
        if not self.start <= at < self.end:
            self.start, self.end = at, _right(text, at, SECRET)
            while self.end > at and text[self.end - 1] == ".":
                self.end -= 1
            self.digit = next((i for i in range(self.end - 1, at - 1, -1) if text[i] in DIGITS), -1)
        return self.end if self.end - at >= LEAST_SECRET and self.digit >= at else 0


def _secret(text: str, at: int, runs: Runs) -> tuple[int, int] | None:
    """The value given to a key that ends here, after an equals sign or a colon, in quotes or not."""
    n = len(text)
    while at < n and text[at] in "\"' ":
        at += 1
    if at >= n or text[at] not in "=:":
        return None
    at += 1
    while at < n and text[at] in "\"' ":
        at += 1
    end = runs.value(at)
    return (at, end) if end else None


def _prefixed(text: str, at: int, length: int) -> tuple[int, int] | None:
    """A key that its prefix tells, alone between other characters."""
    rule = KEY_PREFIXES.get(text[at : at + length])
    if rule is None or at and text[at - 1] in _WORD:
        return None
    allowed, least, most = rule
    start, end = at + length, at + length
    while end < len(text) and end - start <= most and text[end] in allowed:
        end += 1
    alone = end == len(text) or text[end] not in _WORD
    return (at, end) if alone and least <= end - start <= most else None


def _link(text: str, at: int) -> tuple[int, int] | None:
    """User information after a scheme: name:password before an at-sign."""
    end = at
    while end < len(text) and text[end] not in " \t\n\r\v\f/?#@<>\"'":
        end += 1
    return (at, end) if end < len(text) and text[end] == "@" and ":" in text[at:end] else None


def find_spans(text: str | None, anchors) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every span, sorted; code points, end exclusive."""
    if not text:
        return []
    spans = []
    last = dict.fromkeys(KINDS, 0)
    runs = Runs(text)
    for stop, (kind, length) in anchors.iter(_folded(text)):
        at = stop + 1 - length
        if kind == "prefix":
            if at >= last["secret"] and (found := _prefixed(text, at, length)):
                spans.append((at, KINDS.index("secret"), found[1]))
                last["secret"] = found[1]
            continue
        if at < last[kind]:
            continue  # inside what was walked before
        if kind == "email":
            start, end, ok = _email(text, at, last[kind])
            if ok:
                spans.append((start, 0, end))
                last[kind] = end
        elif kind == "ip":
            start, end = _chain(text, at, _DOT, last[kind])
            last[kind] = end
            parts, begin = text[start:end].split("."), start
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    spans.append((begin, 1, begin + size))
                begin += size + 1
        elif kind == "card":
            start, end = _chain(text, at, GAPS, last[kind])
            last[kind] = end
            digits = text[start:end].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((start, 2, end))
        elif kind == "phone":
            end = _phone(text, at)
            if end:
                last[kind] = end
                if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    spans.append((at, 3, end))
        else:
            found = _secret(text, stop + 1, runs) if kind == "secret" else {"account": _account, "link": _link}[kind](text, stop + 1)
            if found:
                spans.append((found[0], KINDS.index(kind), found[1]))
                last[kind] = found[1]
    return sorted(set(spans))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end; sorted by start and the order of KINDS) of every row.

    Null and empty texts have no spans; ids may be null or repeated, as each row is looked at alone; other
    columns are not read; an empty table gives an empty one. Long texts cost one pass, and a run of
    digits, address or secret characters of any length is walked once for each of its kinds.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(span))])

    def make():
        anchors = automaton()

        def fn(ids, texts):
            return ids, [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t, anchors)] for t in texts]

        return fn

    return map_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id", "_text"], make, schema)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stands for all."""
    out, end = [], 0
    for start, kind, stop in spans:
        if start >= end:
            out += [text[end:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data replaced in text_col; all columns as they were, null texts null."""
    columns, schema = docs.columns, docs.schema
    arrow, at = to_arrow_schema(schema), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [redact_text(t, find_spans(t, anchors)) if t else t for t in part.column(at).to_pylist()]
                arrays = [part.column(i).cast(arrow.field(i).type) if i != at else pa.array(texts, arrow.field(at).type) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return docs.mapInArrow(run, schema)
