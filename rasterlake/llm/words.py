"""Word splitting on UTF-8 bytes, shared by the operators that run in Python."""

from __future__ import annotations

import string

import numpy as np
import xxhash

_WORD = set(string.digits + string.ascii_letters)
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z; all others become spaces.
WORD_BYTES = bytes((ord(chr(b).lower()) if b < 128 else b) if b > 127 or chr(b) in _WORD else 32 for b in range(256))
#: The bytes of [\x20\x09-\x0D]; bytes.split() splits at exactly these.
BLANKS = b" \t\n\x0b\x0c\r"


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Runs without blanks, unchanged."""
    return text.encode().split() if text else []


def lower_blank_words(text: str | None) -> list[bytes]:
    """Runs without blanks, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


CACHED_WORDS = 200_000
#: Words at a time: what the cache holds beyond its bound for a moment.
_CHUNK = 50_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class WordHashes:
    """64-bit hashes of words, the same in every process; up to ``max_words`` are remembered, also within a text."""

    def __init__(self, max_words: int = CACHED_WORDS):
        self.max_words, self.known = max_words, _Hashes()

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words), np.uint64)
        for at in range(0, len(words), _CHUNK):
            some = words[at : at + _CHUNK]
            if len(self.known) > self.max_words:
                self.known.clear()
            out[at : at + len(some)] = np.fromiter(map(self.known.__getitem__, some), np.uint64, len(some))
        return out


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of a public hash function)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
