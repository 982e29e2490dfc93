"""Byte-level BPE ids of whole texts, from a public vocabulary, with a cache of what stands between spaces.

The ids are those of the `tokenizers` file. A text is cut before each single space and each stretch is looked up;
only unknown stretches are encoded. The cut changes no id: no pre-token goes on across a space that stands alone,
for the pattern takes a space only at the start of a pre-token or within white space. Texts with two spaces in a row
are encoded whole, texts with a special token's string by the `tokenizers` file itself.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np

#: Stretches that one worker keeps; then it starts anew.
CACHE = 300_000


@dataclass(frozen=True)
class Vocabulary:
    """Where the two files of one vocabulary are, the pattern of its pre-tokens and its special tokens."""

    json_path: str
    ranks_path: str
    pattern: str
    special: tuple[str, ...]


def default_vocabulary() -> Vocabulary:
    import public_tokenizers as P

    return Vocabulary(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ("<|endoftext|>",))


def ranks_encoding(path: str, pattern: str):
    """A tiktoken encoding of a file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class ByteBpe:
    """encode_bytes: ids as little-endian unsigned 32 bits. count: how many."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.encoding = ranks_encoding(vocabulary.ranks_path, vocabulary.pattern)
        self.cache: dict[str, bytes] = {}
        self.whole = None

    def _encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def _special(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary.json_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        if any(s in text for s in self.vocabulary.special):
            return self._special(text)
        if "  " in text:
            return self._encode(text)
        first, *rest = text.split(" ")
        cache = self.cache
        found = list(map(cache.get, rest))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None and (ids := cache.get(rest[i])) is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    ids = cache[rest[i]] = self._encode(" " + rest[i])
                found[i] = ids
        return self._encode(first) + b"".join(found)

    def count(self, text: str) -> int:
        return len(self.encode_bytes(text)) // 4
