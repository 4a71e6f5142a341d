"""Identifiers of whole texts from a tokenizers file, with recurring stretches of text looked up instead of encoded again."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .bpe_count import _byte_symbols
from .chunks import chunks

CHUNK_ENTRIES, PIECE_ENTRIES, LONGEST = 50_000, 400_000, 48
# The cutting patterns of the two vocabulary layouts, for texts of the first 256 characters.
LETTER, FIGURE, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t\\n\\v\\f\\r \\x85\\xa0"
BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{FIGURE}]+| ?[^{SPACE}{LETTER}{FIGURE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{FIGURE}]|[^{SPACE}{LETTER}{FIGURE}]+")
PROBE = "It's  a Test, née ¼½ 12.5!!\n\n  they'LL <b>go\tÀ la «carte»\xa0x\x85 y\x1c z'd  "


class Memo(dict):
    """Results for short keys, emptied when full, so that its size does not depend on the vocabulary of the corpus."""

    def __init__(self, compute, entries: int):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key: str):
        value = self.compute(key)
        if len(key) <= LONGEST:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """``encode`` gives the identifiers of each text as little-endian 32-bit integers, without begin, end or added special tokens.

    A text is cut into pieces, which are looked up or given to the library's model. Texts with characters beyond the first 256 or with
    special strings are first cut into chunks; such a chunk, and every one of a vocabulary of another layout, goes through the whole
    library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        self.marker = os.path.commonprefix([t["content"] for t in layout["added_tokens"]])
        self.symbols = dict(enumerate(_byte_symbols()))
        self.model = self.tokenizer.model
        self.pieces = Memo(self._piece, PIECE_ENTRIES)
        self.chunks = Memo(self._chunk, CHUNK_ENTRIES)
        self.pattern, self.lower = None, False
        if self.marker or not layout["added_tokens"]:
            for self.pattern, self.lower in ((BYTE_PIECES, False), (WORD_PIECES, True)):
                if self._plain(PROBE) == self._whole(PROBE):
                    break
            else:
                self.pattern = None
        self.pieces.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode("utf-8").decode("latin-1").translate(self.symbols)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))

    def _simple(self, text: str) -> bool:
        if self.pattern is None or (self.marker and self.marker in text):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _chunk(self, text: str) -> bytes:
        return self._plain(text) if self._simple(text) else self._whole(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        lookup = self.chunks.__getitem__
        return [self._plain(t) if self._simple(t) else b"".join(map(lookup, chunks(t))) if t else b"" for t in texts]

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
