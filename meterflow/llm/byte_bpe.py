"""Byte-level BPE ids for whole texts, with each distinct piece encoded once a worker.

Texts are cut into pieces by the vocabulary's own split pattern and each piece
is encoded by the tokenizers library the first time a worker meets it.  Texts
that hold an added token's string, or a character outside the long-settled
Unicode blocks (where two libraries' character tables might differ), go to the
library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array


#: Letters of the blocks below U+0250, whose tables are the same everywhere.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Fixed value: the split pattern of the byte-level vocabulary, for those blocks.
PIECES = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+"
          r"|\s+(?!\S)|\s+")
#: Other characters, other digits, and the control characters that two
#: libraries might not both count as white space.
UNSETTLED = "[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]|[\x1c-\x1f\x85\u00b2\u00b3\u00b9\u00bc-\u00be]"


#: Pieces that an encoder keeps: some 200 MB of a Python worker.
CACHE_ENTRIES = 900_000


@functools.lru_cache(2)
def shared(path: str, cache_entries: int) -> "ByteBpe":
    """One encoder a Python worker, kept from task to task."""
    return ByteBpe(path, cache_entries)


class ByteBpe:
    """Encoder with a bounded cache of pieces."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        special = "|".join(map(re.escape, added))
        self.whole = re.compile(f"{UNSETTLED}|{special}" if special else UNSETTLED)
        self.pieces = re.compile(PIECES)
        self.cache: dict[str, bytes] = {}
        self.limit = cache_entries

    def _library(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in out]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.whole.search(text):
            return self._library([text])[0]
        pieces, cache = self.pieces.findall(text), self.cache
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            new = [p for p in set(pieces) if p not in cache]
        found = dict(zip(new, self._library(new)))
        if len(cache) + len(new) <= self.limit:
            cache.update(found)
            found = cache
        else:
            found = {p: cache[p] for p in set(pieces) if p in cache} | found
        return b"".join(map(found.__getitem__, pieces))
