"""Byte-level BPE vocabularies and the way their text is split before merging."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import public_tokenizers
from tokenizers import Tokenizer

#: Text apart from this is cut in the same places by every Unicode version that is in use.
SETTLED = 0x250
#: A run of white space and what follows it. Between two of these the split always has a boundary.
CHUNK = re.compile(r"\s*\S+|\s+")
#: White space for Python's re but not for the split: texts that hold any of them are not cut.
_UNSURE = re.compile(r"[\x1c-\x1f]")


def settled_pattern(pattern: str) -> re.Pattern:
    """A pattern of the tokenizers library for settled text, with its classes spelled out for
    Python's re: several times as fast."""
    settled = [chr(c) for c in range(SETTLED)]
    letters = "".join(c for c in settled if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in settled if unicodedata.category(c)[0] == "N")
    space = r"\t-\r \x85\xa0"
    for held, plain in (
        (r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]"),
        (r"[\p{L}]", f"[{letters}]"),
        (r"[\p{N}]", f"[{numbers}]"),
        (r"\p{L}", f"[{letters}]"),
        (r"\p{N}", f"[{numbers}]"),
        (r"\s", f"[{space}]"),
        (r"\S", f"[^{space}]"),
    ):
        pattern = pattern.replace(held, plain)
    return re.compile(pattern)


def is_settled(text: str) -> bool:
    if text.isascii():
        return True
    try:  # the quickest way to look at all characters
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ord(max(text)) < SETTLED
    return True


_SETTLED_WORDS = settled_pattern(public_tokenizers.PATTERN)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 for itself, the other
    bytes in order from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Tokens as bytes, merges as pairs of ids in order, and the split of texts into words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in held["model"]["vocab"].items()}
        self.merges = [tuple(self.ids[as_bytes(part)] for part in (pair.split(" ") if isinstance(pair, str) else pair)) for pair in held["model"]["merges"]]
        #: Each beginning of a token, with the id where it is one itself and -1 where not.
        self.beginnings = {token[:n]: -1 for token in self.ids for n in range(1, len(token))} | self.ids
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        if any(re.search(r"\s", x) for x in self.special):
            raise ValueError("special strings with white space can't be told apart in chunks")
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.labels = [b""] * self.size
        for token, i in self.ids.items():
            self.labels[i] = token
        for content, i in self.special.items():
            self.labels[i] = content.encode()
        self._specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._path, self._library = path, None

    def chunks(self, text: str) -> list[str]:
        """text in pieces that are tokenised alone as they are within it."""
        return CHUNK.findall(text) if _UNSURE.search(text) is None else [text]

    def words(self, chunk: str) -> list[bytes | int]:
        """The chunk's words as bytes, and the ids of special strings, in order."""
        found: list[bytes | int] = []
        at = 0
        for match in self._specials.finditer(chunk) if self._specials else ():
            found += self._split(chunk[at : match.start()])
            found.append(self.special[match[0]])
            at = match.end()
        return found + self._split(chunk[at:])

    def _split(self, text: str) -> list[bytes]:
        if not text:
            return []
        if is_settled(text):
            return [word.encode() for word in _SETTLED_WORDS.findall(text)]
        if self._library is None:
            self._library = Tokenizer.from_file(self._path)
        return [text[a:b].encode() for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
