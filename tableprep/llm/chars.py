"""Letter streams of texts for the character models (language and toxicity)."""

from __future__ import annotations

import numpy as np

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter (a table of 1.1 million flags, made once a process)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letter_stream(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, every other run as one space, a space at both ends; no letter: empty."""
    if not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a space
    out = np.where(letter, codes, 32).astype(np.uint32)[keep]
    head = [] if out[0] == 32 else [32]
    tail = [] if out[-1] == 32 else [32]
    return np.concatenate((np.array(head, np.uint32), out, np.array(tail, np.uint32)))
