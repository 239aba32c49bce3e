"""Pre-splitting of texts into the words that a word-level BPE vocabulary encodes.

The tokenizer file names a normalizer (NFC, white space, lower case) and a split
pattern.  Texts made only of characters whose handling no Unicode version
changes take a short regular-expression path; any other text goes through the
tokenizer file's own normalizer and pre-tokenizer, so exotic scripts, combining
marks and odd white space come out exactly as the file says.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

# Settings of the tokenizer file that the short path stands for.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

_SHORT_LAST = 0x24F  # last code point of the short path: the Latin blocks
_DOTTED_I = 0x130  # its lower case is two code points


def _short_chars() -> list[str]:
    """Characters of the short path: tab, newline, printable ASCII and the Latin blocks."""
    own = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F))]
    return own + [chr(c) for c in range(0xA1, _SHORT_LAST + 1) if c not in (_DOTTED_I, 0xAD)]


def _class_of(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


class WordSplitter:
    """Words of a text, with the special strings of the tokenizer file set apart.

    ``pieces(text)`` yields ``("words", [...])`` and ``("special", id)`` in text
    order.  Words are plain text (not yet byte symbols).
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        config = json.loads(spec)
        library = Tokenizer.from_str(spec)
        self._normalizer, self._pre = library.normalizer, library.pre_tokenizer
        self.special = {}
        for token in config["added_tokens"]:
            if token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise NotImplementedError(f"added token with stripping rules: {token['content']!r}")
            self.special[token["content"]] = token["id"]
        by_length = sorted(self.special, key=len, reverse=True)
        self._special_rx = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None

        steps = config["pre_tokenizer"]["pretokenizers"]
        known = (config["normalizer"]["normalizers"] == NORMALIZERS and len(steps) == 2
                 and steps[0]["pattern"] == {"Regex": SPLIT_PATTERN} and steps[0]["invert"]
                 and steps[0]["behavior"] == "Removed" and steps[1]["type"] == "ByteLevel"
                 and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"])
        chars = _short_chars()
        kind = {c: unicodedata.category(c)[0] for c in "".join(chars).lower()}
        letters = _class_of([c for c in kind if kind[c] == "L"])
        numbers = _class_of([c for c in kind if kind[c] == "N"])
        others = _class_of([c for c in kind if kind[c] not in "LN" and not c.isspace()])
        self._short = re.compile(_class_of(chars) + "*") if known else None
        contractions = SPLIT_PATTERN.split("|[", 1)[0]
        self._words = re.compile(f"{contractions}|{letters}+|{numbers}|{others}+")
        self._to_byte = {ord(s): b for b, s in enumerate(byte_symbols())}

    def _split(self, text: str) -> list[str]:
        if self._short is not None and self._short.fullmatch(text):
            return self._words.findall(text.lower())
        mapped = self._pre.pre_tokenize_str(self._normalizer.normalize_str(text)) if text else []
        return [bytes(map(self._to_byte.__getitem__, map(ord, word))).decode() for word, _ in mapped]

    def pieces(self, text: str) -> Iterator[tuple[str, list[str] | int]]:
        if self._special_rx is None or "<" not in text:
            yield "words", self._split(text)
            return
        for k, part in enumerate(self._special_rx.split(text)):
            if k % 2:
                yield "special", self.special[part]
            elif part:
                yield "words", self._split(part)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others take the code points from
    256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class WordCache(dict):
    """Results by word, in two generations of bounded size; long words are not kept.

    When the young generation is full it becomes the old one, so frequent words
    survive and memory stays bounded whatever the input holds.
    """

    def __init__(self, make, size: int = 120_000, longest: int = 64):
        super().__init__()
        self._make, self._size, self._longest, self._old = make, size, longest, {}

    def __missing__(self, word):
        value = self._old.get(word)
        if value is None:
            value = self._make(word)
        if len(word) <= self._longest:
            if len(self) >= self._size:
                self._old = dict(self)
                self.clear()
            self[word] = value
        return value
