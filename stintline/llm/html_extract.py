"""Operator 1, HTML extraction: a linear-chain conditional random field over a page's leaf blocks.

A block's features are its ancestors' tags and names and its text's form. The field has two labels, article
and other, a weight for each feature and label, and one for each pair of neighbouring labels. It is
trained to the maximum of the penalised likelihood (forward-backward, AdaGrad over whole pages) on the
labelled pages of html_pages, once a process, and decoded by Viterbi. Pages are only mapped.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows
from .html_blocks import Block, leaf_blocks
from .html_pages import labelled_pages

PAGES, EPOCHS, BATCH = 600, 12, 20
_WORD = re.compile(r"[^\W\d_]+")
#: Longest text whose words are features.
SHORT = 60


def _bucket(n: int) -> int:
    return min(n, 3) if n < 4 else min(3 + n.bit_length(), 12)


def own_features(block: Block) -> list[str]:
    """Features of a block's text and of the element that holds it."""
    node, text = block.node, block.text
    out = ["always", f"in:{node.tag if node else ''}", f"size:{_bucket(len(text) // 8)}", f"links:{10 * block.linked // max(1, len(text)) if block.linked else -1}"]
    out.append(f"section:{node.section if node else 'none'}")
    out += (f"nearest:{w}" for w in (node.nearest if node else ()))
    out.append(f"end:{'.' if text[-1] in '.!?…:' else 'w' if text[-1].isalnum() else 's'}")
    out += (f"inline:{t}" for t in block.inline)
    if any(c.isdigit() for c in text):
        out.append("digit")
    if "©" in text or "·" in text or "|" in text:
        out.append("mark")
    if len(text) <= SHORT:
        out += {f"word:{w.lower()}" for w in _WORD.findall(text)}
    return out


def block_features(block: Block) -> list[str]:
    """All features of a block, those of its ancestors included."""
    out, node = own_features(block), block.node
    while node is not None:
        out += node.fresh
        node = node.parent
    return out


class Field:
    """Feature weights (for article against other), transitions, and the chain's start."""

    def __init__(self, weights: dict[str, float], move: list[list[float]], start: list[float]):
        self.weights, self.move, self.start = weights, move, start

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels; of equally likely ones, other."""
        get, back, paths = self.weights.get, [], {}

        def of_path(node):
            """The weight of a node and its ancestors; each node of a page is added up once."""
            chain = []
            while node is not None and node not in paths:
                chain.append(node)
                node = node.parent
            total = paths[node] if node is not None else 0.0
            for node in reversed(chain):
                paths[node] = total = total + sum(get(f, 0.0) for f in node.fresh)
            return total

        a0, a1 = self.start
        (m00, m01), (m10, m11) = self.move
        for i, block in enumerate(blocks):
            e = sum(get(f, 0.0) for f in own_features(block)) + of_path(block.node)
            if i:
                to0, to1 = (0, a0 + m00) if a0 + m00 >= a1 + m10 else (1, a1 + m10), (0, a0 + m01) if a0 + m01 >= a1 + m11 else (1, a1 + m11)
                back.append((to0[0], to1[0]))
                a0, a1 = to0[1], to1[1]
            a1 += e
        labels = [int(a1 > a0)] if blocks else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def _align(html: str, marked: list[tuple[str, int]]) -> tuple[list[Block], list[int]] | None:
    """Blocks and their labels, if the parser finds the page's blocks as they were written."""
    blocks = leaf_blocks(html)
    texts = [" ".join(t.split()) for t, _ in marked]
    if [b.text for b in blocks] != texts:
        return None
    return blocks, [label for _, label in marked]


def fit(pages: list[tuple[str, list[tuple[str, int]]]], epochs: int = EPOCHS, rate: float = 0.3, penalty: float = 2e-3, seed: int = 5) -> Field:
    """Maximise the penalised conditional likelihood of the pages' labels."""
    chains = [x for x in (_align(*p) for p in pages) if x and x[0]]
    names: dict[str, int] = {}
    rows = [([[names.setdefault(f, len(names)) for f in block_features(b)] for b in blocks], np.array(labels)) for blocks, labels in chains]
    w, move, start = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    gw, gm, gs = np.full(len(names), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for take in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            dw, dm, ds = -penalty * w, -penalty * move, -penalty * start
            for k in take:
                feats, y = rows[k]
                n = len(feats)
                emit = np.zeros((n, 2))
                emit[:, 1] = [w[f].sum() for f in feats]
                alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
                alpha[0] = start + emit[0]
                for i in range(1, n):
                    alpha[i] = emit[i] + np.logaddexp(alpha[i - 1][0] + move[0], alpha[i - 1][1] + move[1])
                for i in range(n - 2, -1, -1):
                    nxt = emit[i + 1] + beta[i + 1]
                    beta[i] = np.logaddexp(move[:, 0] + nxt[0], move[:, 1] + nxt[1])
                z = np.logaddexp(*alpha[-1])
                p1 = np.exp(alpha[:, 1] + beta[:, 1] - z)
                for f, d in zip(feats, (y - p1).tolist(), strict=True):
                    dw[f] += d
                ds += np.eye(2)[y[0]] - [1 - p1[0], p1[0]]
                if n > 1:
                    pair = np.exp(alpha[:-1, :, None] + move + (emit[1:] + beta[1:])[:, None, :] - z)
                    dm -= pair.sum(0)
                    np.add.at(dm, (y[:-1], y[1:]), 1)
            for x, g, d in ((w, gw, dw), (move, gm, dm), (start, gs, ds)):
                d /= len(take)
                g += d * d
                x += rate * d / np.sqrt(g)
    return Field({f: float(w[i]) for f, i in names.items() if w[i]}, move.tolist(), start.tolist())


@lru_cache(maxsize=4)
def default_field(pages: int = PAGES, seed: int = 1) -> Field:
    return fit(labelled_pages(pages, seed))


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, label in zip(blocks, field.viterbi(blocks), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page; text is empty for a null or empty page or one without article.

    Ids and urls may be null or repeated: each row is read alone. Long pages, and broken ones however deep
    their elements nest, are read in one linear pass. Other columns are not read; an empty table gives
    an empty one.
    """
    field = field or default_field()
    sent = pages.sparkSession.sparkContext.broadcast((field.weights, field.move, field.start))  # some thousand features
    types = pages.schema
    schema = T.StructType([T.StructField("page_id", types[id_col].dataType), T.StructField("url", types[url_col].dataType), T.StructField("text", T.StringType())])

    def make():
        field = Field(*sent.value)

        def fn(ids, urls, htmls):
            return ids, urls, [main_text(h, field) for h in htmls]

        return fn

    return map_rows(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")), ["_id", "_url", "_html"], make, schema)
