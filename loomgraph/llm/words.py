"""Words of texts in several scripts and spellings."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence

import numpy as np

WORD = re.compile(r"[^\W_]+")
#: Invisible format characters (general category Cf) to nothing.
INVISIBLE = {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"}


def plain(text: str) -> str:
    """Compatibility normalisation, no invisible format characters, case folded."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).translate(INVISIBLE).casefold()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits (underscores separate) of the plain text; none for null."""
    return WORD.findall(plain(text)) if text else []


_KINDS: np.ndarray | None = None


def _kind(c: int) -> int:
    ch = chr(c)
    return 1 if ch.isalnum() else 2 if unicodedata.category(ch) == "Cf" else 0


def _kinds(code: np.ndarray) -> np.ndarray:
    """1 for letters and digits, 2 for invisible format characters, by code point."""
    global _KINDS
    if _KINDS is None:
        _KINDS = np.array([_kind(c) for c in range(0x10000)], np.uint8)
    out = _KINDS[np.minimum(code, 0xFFFF)]
    far = np.flatnonzero(code > 0xFFFF)
    if len(far):
        points, at = np.unique(code[far], return_inverse=True)
        out[far] = np.array([_kind(int(c)) for c in points], np.uint8)[at]
    return out


def hash_words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in order, never 0; number of words of each text): as :func:`words`, but
    over all texts at once as flat arrays of code points."""
    flat = [t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold() for t in (t or "" for t in texts)]
    size = np.array([len(t) + 1 for t in flat], np.int64)
    code = np.frombuffer("".join(t + "\n" for t in flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, owner = _kinds(code), np.repeat(np.arange(len(flat)), size)
    if (kind == 2).any():
        seen = kind != 2
        code, kind, owner = code[seen], kind[seen], owner[seen]
    letter = kind == 1
    start = letter & ~np.r_[False, letter[:-1]] if len(letter) else letter
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(flat), np.int64)
    first = np.flatnonzero(start[at])
    length = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, length)
    powers = np.ones(int(length.max()), np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((code[at].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    h = (h ^ (h >> np.uint64(32)) ^ length.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return np.where(h == 0, np.uint64(1), h), np.bincount(owner[at[first]], minlength=len(flat))
