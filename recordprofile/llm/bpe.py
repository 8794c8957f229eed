"""Byte-level BPE ids of whole texts, as packed little-endian unsigned 32-bit ids.

The vocabulary exists in two forms with the same ids: the one ``tokenizers``
reads, which defines the result, and its ranks, which ``tiktoken`` encodes several
times faster.  Texts of the Latin blocks take the ranked form; the others, and
texts that spell an added token, take the defining one, as splitting rules there
depend on the Unicode version of the regular-expression engine.  So do texts with a
very long run of white space, for which the engine of the ranked form has no stack.
The tests hold both to the same ids.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_ID = 2
#: A text with a block of so much white space takes the defining form; a run of twice as much holds one.
BLANK_BLOCK = 5000


def _has_blank_block(text: str) -> bool:
    """Looks at the first character that isn't white space of each block, so at few."""
    return any(text[k : k + BLANK_BLOCK].isspace() for k in range(0, len(text) - BLANK_BLOCK + 1, BLANK_BLOCK))


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    def __init__(self, path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path or default_path())
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path or default_path(RANKS), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._ranked = tiktoken.Encoding(
            "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._other = re.compile("|".join(["[^\\x00-ɏ]", *map(re.escape, added)])).search

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self._other(text) or _has_blank_block(text):
            return self._tokenizer.encode(text, add_special_tokens=False).ids
        return self._ranked(text)

    def pack(self, text: str | None) -> bytes:
        ids = array("I", self.ids(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


_cached: dict[tuple, Bpe] = {}


def worker_bpe(path: str | None = None, ranks_path: str | None = None) -> Bpe:
    """This Python worker's tokenizer for these two forms of one vocabulary."""
    key = (path, ranks_path)
    if key not in _cached:
        _cached[key] = Bpe(path, ranks_path)
    return _cached[key]
