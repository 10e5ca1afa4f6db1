"""The public byte-level BPE vocabulary, loaded once in each worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Name of the rank file, and of the file that defines the tokenizer (same vocabulary).
RANKS, DEFINITION = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def default_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str | None = None):
    """tiktoken's encoder over the vocabulary. Its ids equal the tokenizers library's (tested), special token included."""
    import public_tokenizers
    import tiktoken

    with open(path or default_path(), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def encode(text: str, path: str | None = None) -> np.ndarray:
    """Ids as uint32."""
    if not text:
        return np.zeros(0, np.uint32)
    return np.asarray(encoding(path).encode_to_numpy(text, allowed_special="all"), np.uint32)
