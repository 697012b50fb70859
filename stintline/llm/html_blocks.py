"""Leaf blocks of an HTML page: runs of text between block-level boundaries, with their ancestors.

The parser is forgiving and linear: it reads tags, comments and text in one pass, closes what HTML closes
implicitly, ignores stray end tags, and passes over scripts, styles and other raw text. It keeps the places
of the open elements of each tag, so that no tag walks over elements that stay open, and blocks share the
nodes of their ancestors.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from html import unescape

#: White space in tags, and an attribute by the states of the HTML standard: a value in quotes runs to the same
#: quote, any other to white space or the tag's end, and quotes elsewhere are characters like any other.
_GAP = r"[\t\n\f\r ]"
_VALUE = rf"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\t\n\f\r "'>][^\t\n\f\r >]*)"""
_NAME = r"[^\t\n\f\r />][^\t\n\f\r />=]*+"
#: Comments (which may end at once), other declarations, and tags.
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|{_NAME}(?:{_GAP}*+={_GAP}*+{_VALUE}?+)?+)*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_GAP}*+={_GAP}*+({_VALUE})?+)?+")
#: Attributes whose words name an element.
_NAMING = frozenset("class id role itemprop aria-label".split())
_SPLIT = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"(?<![\w-])display\s*:\s*none|(?<![\w-])(?:content-)?visibility\s*:\s*hidden", re.I)
#: Elements whose content is not markup, and the end of each; without one, the page's rest is their content.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I | re.A) for t in "script style title textarea iframe noembed noframes xmp".split()}
#: Elements whose content is markup that is not shown, and their tags.
UNSEEN = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^<>]*", re.I | re.A) for t in "template noscript svg math object select datalist canvas audio video".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Block starts that end an open paragraph; starts that end an open sibling; and where that search stops.
_ENDS_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


#: Inline elements that are told of a block.
INLINE = frozenset("a abbr b bdi bdo big button cite code data del dfn em font i ins kbd label mark nobr output q ruby s samp small span strike strong sub sup time tt u var".split())
_CELL_ENDS = frozenset("tr table tbody thead tfoot td th body html".split())
SECTIONS = frozenset("article aside footer form header main nav section dialog details".split())


class Node:
    """A block element above some text: its tag, the words of its class, id and role, and its parent.

    fresh are the features of tag and words that no ancestor has; section and nearest are the tag of the
    nearest sectioning element and the words of the nearest element with any.
    """

    __slots__ = ("parent", "tag", "names", "fresh", "section", "nearest")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...], held: set[str]):
        self.parent, self.tag, self.names = parent, tag, names
        told = [f"under:{tag}", *(f"name:{w}" for w in names), *(f"names:{tag}:{w}" for w in names)]
        self.fresh = tuple(f for f in dict.fromkeys(told) if f not in held)
        self.section = tag if tag in SECTIONS else parent.section if parent else "none"
        self.nearest = names or (parent.nearest if parent else ())


@dataclass
class Block:
    text: str
    #: The element that holds the text, or None.
    node: Node | None
    linked: int = 0  # characters inside links
    inline: frozenset[str] = field(default_factory=frozenset)  # inline tags around or in the text

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """(tag, words of class, id and role) from the root to the element that holds the text."""
        out, node = [], self.node
        while node is not None:
            out.append((node.tag, node.names))
            node = node.parent
        return tuple(reversed(out))


def _names(attributes: str) -> tuple[str, ...] | None:
    """Words of the naming attributes; None if the element is hidden."""
    words: list[str] = []
    seen = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if value[:1] in ("'", '"'):
            value = value[1:].removesuffix(value[0])
        if name in seen:  # the first of a name counts
            continue
        seen.add(name)
        if name == "hidden" or name == "style" and _HIDDEN.search(value):
            return None
        if name in _NAMING:
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
            words += (w for w in _SPLIT.split(value.lower()) if w)
    return tuple(words)


def _ended(html: str, tag: str) -> set[int]:
    """Where those elements of an unseen kind start that have an end tag of their own."""
    starts, ended = [], set()
    for m in UNSEEN[tag].finditer(html):
        if not m[1]:
            if not m[0].endswith("/"):
                starts.append(m.start())
        elif starts:
            ended.add(starts.pop())
    return ended


class _Open:
    """The open elements of a page."""

    def __init__(self):
        self.stack: list[tuple[str, bool, Node | None]] = []  # tag, hidden, node
        self.places: dict[str, list[int]] = {}  # tag -> where it is open, ascending
        self.barriers: list[int] = []  # places of block and unseen elements
        self.blocks: list[int] = []  # places of block elements
        self.cells: list[int] = []
        self.frames: list[dict[str, int]] = [{}]  # open inline elements since the last block element
        self.held: set[str] = set()  # features of the open block elements

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def first_from(self, tag: str, low: int) -> int | None:
        places = self.places.get(tag, [])
        at = bisect_left(places, low)
        return places[at] if at < len(places) else None

    def node_below(self, top: int) -> Node | None:
        """The node of the innermost block element below a place."""
        at = bisect_left(self.blocks, top) - 1
        return self.stack[self.blocks[at]][2] if at >= 0 else None

    def push(self, tag: str, names: tuple[str, ...], hidden: bool) -> None:
        at, node = len(self.stack), None
        if tag in BLOCK:
            if not hidden:
                node = Node(self.node_below(at), tag, names, self.held)
                self.held.update(node.fresh)
            self.blocks.append(at)
            self.frames.append({})
            if tag in ("td", "th"):
                self.cells.append(at)
        elif tag in INLINE:
            self.frames[-1][tag] = self.frames[-1].get(tag, 0) + 1
        if tag in BLOCK or tag in UNSEEN:
            self.barriers.append(at)
        self.places.setdefault(tag, []).append(at)
        self.stack.append((tag, hidden, node))

    def _forget(self, tag: str) -> None:
        self.places[tag].pop()
        if tag in INLINE:
            frame = self.frames[-1]
            frame[tag] -= 1
            if not frame[tag]:
                del frame[tag]

    def cut(self, depth: int) -> None:
        """Close all from a place on."""
        while len(self.stack) > depth:
            tag, _, node = self.stack.pop()
            if not tag:
                continue
            if tag in BLOCK:
                self.blocks.pop()
                self.frames.pop()
                if tag in ("td", "th"):
                    self.cells.pop()
                if node is not None:
                    self.held.difference_update(node.fresh)
            if tag in BLOCK or tag in UNSEEN:
                self.barriers.pop()
            self._forget(tag)

    def end_link(self) -> None:
        """Links don't nest: one that is open since the last block element ends, what it holds stays open."""
        at = self.last("a")
        if at > (self.barriers[-1] if self.barriers else -1):
            self._forget("a")
            self.stack[at] = ("", at > 0 and self.stack[at - 1][1], None)


def leaf_blocks(html: str | None) -> list[Block]:
    """The blocks of a page in page order; those without text are left out. Null: none."""
    if not html:
        return []
    blocks: list[Block] = []
    page = _Open()
    stack = page.stack
    parts: list[str] = []
    inline: set[str] = set()
    linked, at, n = 0, 0, len(html)
    unseen: list[tuple[int, bool]] = []  # places of unseen elements on the stack; whether they have an end tag
    ended: dict[str, set[int]] = {}

    def flush(top: int):
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, page.node_below(top), min(linked, len(text)), frozenset(inline)))
        parts.clear()
        inline.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        if not text or (stack and stack[-1][1]):
            return
        text = unescape(text)
        parts.append(text)
        frame = page.frames[-1]
        if frame:
            inline.update(frame)
            if "a" in frame:
                linked += len(text.strip())

    def close(depth: int):
        top = len(stack)
        while unseen and unseen[-1][0] >= depth:
            top = unseen.pop()[0]
        if not unseen and any(stack[i][0] in BLOCK for i in range(depth, top)):
            flush(top)
        page.cut(depth)

    def start_block(tag: str) -> int:
        """Where on the stack the elements lie that a block may close; unseen ones without an end tag end here."""
        while unseen and not unseen[-1][1] and tag not in ("option", "optgroup"):
            close(unseen[-1][0])
        return unseen[-1][0] + 1 if unseen else 0

    def implied(tag: str, least: int) -> int | None:
        """The place from which a block's start tag closes what is open."""
        ends = _SIBLINGS.get(tag)
        if ends is None:
            inner = page.blocks[-1] if page.blocks else -1
            return inner if inner >= least and stack[inner][0] == "p" and tag in _ENDS_P else None
        low = max(least, 1 + max(map(page.last, _SCOPES[tag])))
        if tag == "tr":
            return min((i for e in ends if (i := page.first_from(e, low)) is not None), default=None)
        sibling = max(map(page.last, ends))
        if sibling >= low:
            return sibling
        return page.first_from("p", low) if tag in _ENDS_P else None

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in VOID:
                if tag == "br":
                    parts.append(" ")
                continue
            if tag in BLOCK or tag in UNSEEN:  # a cell keeps its content
                barrier = page.cells[-1] if page.cells and tag not in _CELL_ENDS else -1
            else:  # an inline end tag stays in its block
                barrier = page.barriers[-1] if page.barriers else -1
            i = page.last(tag)
            if i >= 0 and i > barrier:
                close(i)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = RAW[tag].search(html, at)
                at = end.end() if end else n
            parts.append(" ")
            continue
        if tag in UNSEEN:
            parts.append(" ")
            if not m[3].endswith("/"):
                if tag not in ended:
                    ended[tag] = _ended(html, tag)
                unseen.append((len(stack), m.start() in ended[tag]))
                page.push(tag, (), True)
            continue
        if tag in VOID:
            if tag in BLOCK:
                start_block(tag)
                if not unseen:
                    flush(len(stack))
            else:
                parts.append(" " if tag != "wbr" else "")
            continue
        if tag in BLOCK:
            depth = implied(tag, start_block(tag))
            if depth is not None:
                close(depth)
            if not unseen:
                flush(len(stack))
        elif tag == "a":
            page.end_link()
        names = _names(m[3]) if m[3] else ()
        page.push(tag, names or (), names is None or bool(stack and stack[-1][1]))
    flush(len(stack))
    return blocks
