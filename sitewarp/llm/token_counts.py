"""Token counts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import tiktoken

#: Where the public vocabulary lies; a parameter of every operator that counts tokens.
VOCABULARY = os.environ.get("SITEWARP_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the vocabulary splits text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """One encoder per Python worker and vocabulary."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    return len(encoding(vocabulary).encode_ordinary(text))
