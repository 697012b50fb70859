"""Exact token ids of a pre-token BPE vocabulary, with a cache of pre-tokens.

The library is asked for each distinct pre-token once a task (until the cache is full), and a text's ids
are those of its pre-tokens in order. That is what the library returns for the whole text, because its
merges never cross a pre-token. Texts that the fast splitter can't be sure of (characters beyond
Latin-1, unusual white space or special strings) go through the library whole.
"""

from __future__ import annotations

import re
from array import array

from .common import Recent, kept

#: The pre-token pattern of word_bpe_49k.json, restated for lower-case Latin-1 text.
WORDS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^ \t\n\r\f\v0-9a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+"
)
#: Characters whose normal form, lower case and class are the same in all Unicode versions.
PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7e\xa1-\xff]*")
SPECIAL = "<|"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def plain(text: str) -> bool:
    """Whether WORDS over text.lower() splits text as the library does."""
    return PLAIN.fullmatch(text) is not None and SPECIAL not in text


class Ids(Recent):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cap: int = 100_000):
        from tokenizers import Tokenizer

        super().__init__(cap)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.letters = self.library.model, byte_letters()

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def make(self, word: str) -> bytes:
        """A pre-token goes to the library's model directly, in byte letters."""
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, text: str | None, end: bytes = b"") -> bytes:
        """Ids of a text (null: none), then end."""
        if not text:
            return end
        if plain(text):
            return b"".join(map(self.__getitem__, WORDS.findall(text.lower()))) + end
        return self.whole(text) + end


def shared_ids(path: str, cap: int = 100_000) -> Ids:
    """The encoder, with a cache of this size, that all tasks of this process use."""
    return kept(("ids", path, cap), lambda: Ids(path, cap))
