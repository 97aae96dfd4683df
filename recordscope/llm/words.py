"""Cutting texts where the pre-tokenizer surely cuts, so that words can be remembered.

The public pre-tokenizer pattern joins a word to one space before it and to
nothing else across white space. At a single space between two characters
that are not white space it therefore always starts a match at that space.
Pieces between such spaces can be encoded apart, and most are seen again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pieces above this many characters are not remembered.
LONG = 64
_RUN = re.compile(r"\s\s")


def pieces(text: str) -> list[str]:
    """The text is ``" ".join(pieces(text))``; each but the first is encoded with one space before it."""
    if _RUN.search(text) is None and not text[:1].isspace() and not text[-1:].isspace():
        return text.split(" ")
    return _CUT.split(text)


class Memo(dict):
    """Encodes texts piece by piece, remembering at most about ``most`` pieces before it starts anew.

    ``make`` encodes a list of strings; what it gives for each is bytes, and a
    text's encoding is those of its pieces one after the other. A first piece
    is kept under a key with a space before it, which no later piece has.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int = 800_000):
        super().__init__()
        self.make, self.most = make, most

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = []
        for text in texts:
            parts.append(pieces(text))
            parts[-1][0] = " " + parts[-1][0]
        missing = [w for w in set().union(*parts) if w not in self]
        if missing:
            if len(self) + len(missing) > self.most:
                self.clear()
                missing = list(set().union(*parts))
            self.update(zip(missing, self.make([w[1:] if w[:1] == " " else " " + w for w in missing]), strict=True))
        out = [b"".join(map(self.__getitem__, p)) for p in parts]
        for w in missing:
            if len(w) > LONG:
                del self[w]
        return out
