"""Whole texts to token ids through pre-tokens: each distinct pre-token is encoded once per Python worker.

Byte-pair merges never cross a pre-token, so a text's ids are the concatenation of its pre-tokens' ids.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterable

import regex

#: Texts that hold nothing but these characters split alike under ``re`` and under the Unicode classes.
_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ɏ]")
# Fixed value: the split pattern that the public word vocabulary was made with.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The same language over plain characters; alternatives that cannot start alike are put in order of frequency.
_WORDS_PLAIN = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")


def split_words(text: str) -> list[str]:
    """NFC, lower case, then words, single digits and runs of other characters; white space is dropped."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased char by char: no final sigma
    text = text.lower()
    return (_WORDS if _PLAIN.search(text) else _WORDS_PLAIN).findall(text)


@functools.cache
def _unsettled() -> re.Pattern:
    """Code points whose letter or digit class depends on the Unicode version at hand."""
    letter_or_digit, points = regex.compile(r"[\p{L}\p{N}]"), []
    for c in map(chr, range(0x250, 0x110000)):
        if bool(letter_or_digit.match(c)) != (unicodedata.category(c)[0] in "LN"):
            points.append(ord(c))
    spans = [[p, p] for p in points[:1]]
    for p in points[1:]:
        if p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]") if spans else re.compile(r"(?!)")


def unsettled(text: str) -> bool:
    """Whether libraries of different Unicode versions may split the text differently."""
    return bool(_PLAIN.search(text)) and bool(_unsettled().search(text))


class PretokenCoder:
    """Ids of whole texts, as little-endian bytes, with a bounded memo of pre-tokens.

    ``encode_many`` gets new pre-tokens and returns the id bytes of each. Those over ``LONG`` characters are held for the
    current batch only; when the memo passes ``limit`` it is cut back to the pre-tokens of the current batch. So its
    memory is bounded, and frequent ones stay.
    """

    LONG = 256

    def __init__(self, split: Callable[[str], list[str]], encode_many: Callable[[list[str]], Iterable[bytes]],
                 special: dict[str, bytes], limit: int = 600_000):
        self.split, self.encode_many, self.special, self.limit = split, encode_many, special, limit
        self.memo: dict[str, bytes] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _pieces(self, text: str) -> list[str]:
        if not self.cut or not any(x in text for x in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.cut.split(text):
            # a special string is looked up under a key that no split yields
            out += ["\0special" + part] if part in self.special else self.split(part)
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        pieces = [self._pieces(x or "") for x in texts]
        seen = set().union(*pieces) if pieces else set()
        memo = self.memo
        new = [x for x in seen if x not in memo]
        if new:
            plain = [x for x in new if not x.startswith("\0special")]
            memo.update(zip(plain, self.encode_many(plain), strict=True))
            memo.update((x, self.special[x[8:]]) for x in new if x.startswith("\0special"))
        get = memo.__getitem__
        out = [b"".join(map(get, p)) for p in pieces]
        for x in new:
            if len(x) > self.LONG:
                del memo[x]
        if len(memo) > self.limit:
            self.memo = {x: memo[x] for x in seen if x in memo}
        return out
