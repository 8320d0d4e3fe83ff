"""Cutting text where byte-level BPE pre-tokenisation is sure to cut it, and a bounded memo of what pieces encode to.

A space that is followed by a character other than white space always starts a new pre-token: the
pre-token before it either ends in a non-space character, which never takes a following space, or is a
run of white space, of which the pattern leaves the last space to the next word. So text may be cut
before each such space, and the parts encoded one by one give the tokens of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: A space that must stay with what precedes it: at the end, or before more white space.
_GLUED = re.compile(r" (?:\s|\Z)").search
_CUT = re.compile(r" (?=\S)").split

#: Marks that may be taken off the end of a part after a letter: a letter and one of these never share a
#: pre-token, a run of them at the end is one pre-token, and no special string of the public vocabularies ends in them.
TAIL = ".,;:!?#*$%&()[]{}+-=/@^~"


def parts(text: str) -> list[str]:
    """``text`` cut before each space that a non-space character follows.

    The space is left out of every part but the first, which stands as it is: ``parts(t)`` joined by
    spaces is ``t``. Empty text gives one empty part.
    """
    return _CUT(text) if _GLUED(text) else text.split(" ")


def windows(text: str, size: int) -> Iterator[str]:
    """``text`` in windows of about ``size`` characters that end before a safe space; a window without one grows on."""
    start, n = 0, len(text)
    while n - start > size:
        at = start + size
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= n:
                at = -1
                break
            if not text[at + 1].isspace():
                break
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


class Memo(dict):
    """What a part encodes to, kept for at most ``limit`` parts; later parts are encoded anew each time."""

    def __init__(self, encode: Callable[[str], tuple], limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, part: str):
        out = self.encode(part)
        if len(self) < self.limit:
            self[part] = out
        return out


def split_tail(part: str) -> tuple[str, str]:
    """A part and the run of closing marks after its last letter, which is a pre-token of its own."""
    stem = part.rstrip(TAIL)
    if len(stem) < len(part) and stem and stem[-1].isalpha():
        return stem, part[len(stem) :]
    return part, ""
