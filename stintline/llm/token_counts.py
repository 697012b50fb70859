"""Operator 2, token counts: byte-pair merging with a heap over a linked list of symbols.

A pre-token's symbols are its bytes, the last one marked as a word's end. The adjacent pair of the
lowest rank (the leftmost among equals) is merged again and again, so the number of tokens is the
number of symbols at the start less the number of merges; no identifier is ever looked up or kept.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Recent, kept, map_rows
from .tokens import WORDS, byte_letters, plain


class MergeCounts(Recent):
    """Pre-token -> its number of tokens, found by merging; kept in a cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.known = model["vocab"].keys()
        self.end = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        specials = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(sorted(specials, key=len, reverse=True)) or r"(?!)")
        self.library = Tokenizer.from_file(path)  # its normaliser and splitter, for unusual characters

    def merged(self, letters: str) -> int:
        """Tokens of one pre-token, given in byte letters."""
        text = [*letters[:-1], letters[-1] + self.end]
        text = [s for s in text if s in self.known]
        count = len(text)
        after = [*range(1, count), -1]
        before = [*range(-1, count - 1)]
        ranks = self.ranks
        heap = [(r, i) for i in range(count - 1) if (r := ranks.get((text[i], text[i + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if text[i] is None or j < 0 or ranks.get((text[i], text[j])) != rank:
                continue  # one of the two was merged since
            text[i] += text[j]
            text[j] = None
            k = after[i] = after[j]
            count -= 1
            if k >= 0:
                before[k] = i
                if (r := ranks.get((text[i], text[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((text[h], text[i]))) is not None:
                heappush(heap, (r, h))
        return count

    def make(self, word: str) -> int:
        return self.merged("".join(map(self.letters.__getitem__, word.encode())))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if plain(text):
            return sum(map(self.__getitem__, WORDS.findall(text.lower())))
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += 1 + self.split(text[at : m.start()])
            at = m.end()
        return total + self.split(text[at:])

    def split(self, text: str) -> int:
        text = self.library.normalizer.normalize_str(text)
        return sum(self.merged(piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if piece)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text: doc_id, n_bytes, n_tokens. One row for each row of docs.

    Null or empty text: 0 and 0. Ids may be of any type; a null id stays null, repeated rows are each counted, an empty table
    gives an empty one, and columns other than the two named are neither read nor returned. Very long
    texts are handled a pre-token at a time. No shuffle; a lost task is simply run again.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def make():
        counts = kept(("merges", path), lambda: MergeCounts(path))

        def fn(ids, texts):
            return ids, [len(t.encode()) if t else 0 for t in texts], [counts.count(t) for t in texts]

        return fn

    return map_rows(docs, [id_col, text_col], make, out)
