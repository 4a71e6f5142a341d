"""Looking up recurring stretches of text, for work that gives each stretch the same result wherever it stands."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

ENTRIES = 300_000
LONGEST = 48
_WIDE = "\x85\xa0  -     　"
_ODD = ["  ", *(f" {c}" for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f"), *(f"{c} " for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f")]
_ODD_WIDE = re.compile(f" [{_WIDE}]|[{_WIDE}] ")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def chunks(text: str) -> list[str]:
    """Cut before each blank that stands between two visible characters; the parts joined are the text.

    No piece of a tokenizer that takes at most one blank along with what follows it crosses such a cut.
    """
    if "\0" in text or text[:1] == " " or text[-1:] == " " or any(map(text.__contains__, _ODD)) or (not text.isascii() and _ODD_WIDE.search(text)):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").split("\0")


class ChunkMemo:
    """Results per chunk, computed for all unknown chunks of a slice at once.

    Emptied when it holds ``ENTRIES`` results, so that its size does not depend on the vocabulary of the corpus; long chunks are not kept.
    """

    def __init__(self, compute: Callable[[list[str]], Sequence]):
        self.compute, self.known = compute, {}

    def lookup(self, texts: Sequence[str]) -> list[list]:
        """For each text the results of its chunks, in order; an empty text has none."""
        if len(self.known) >= ENTRIES:
            self.known.clear()
        cut = [chunks(t) if t else [] for t in texts]
        new = list(set().union(*cut) - self.known.keys())
        here = self.known
        if new:
            results = self.compute(new)
            here.update(zip(new, results))
        out = [list(map(here.__getitem__, c)) for c in cut]
        for c in new:
            if len(c) > LONGEST:
                del here[c]
        return out
