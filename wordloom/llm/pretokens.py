"""The pre-tokens of word_bpe_49k.json: runs of letters, single digits, runs of other characters, in lower case."""

from __future__ import annotations

import re
import unicodedata

import regex

SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: The contractions and classes of the vocabulary file's own pattern, and Unicode's white space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_ANY = regex.compile(rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: For texts of characters on which Python's own classes agree with Unicode's.
_PLAIN = re.compile(rf"{_CONTRACTIONS}|[^\W\d_]+|\d|(?:_|[^\s\w])+")
_NOT_PLAIN = re.compile(r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]|<\|")
_SPLIT = re.compile("|".join(map(re.escape, SPECIAL)))


def is_plain(text: str) -> bool:
    return _NOT_PLAIN.search(text) is None


def pretokens(text: str) -> tuple[list[str], int]:
    """The pre-tokens of a text, and how many special strings stood between them (one token each)."""
    if is_plain(text):
        return _PLAIN.findall(text.lower()), 0
    parts, out = _SPLIT.split(text), []
    for part in parts:
        part = unicodedata.normalize("NFC", part)
        out += _ANY.findall("".join(map(str.lower, part)))  # each character by itself: no final sigma
    return out, len(parts) - 1


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


_LETTERS = byte_letters()


def as_letters(word: str) -> str:
    return word if word.isascii() and word.isprintable() else "".join([_LETTERS[b] for b in word.encode()])
