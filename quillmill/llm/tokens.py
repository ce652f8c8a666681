"""Byte-level BPE by a public vocabulary, whose path is a parameter."""

from __future__ import annotations

import numpy as np

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str = TOKENIZER):
    """path: ranks as lines of base64 token and number."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(enc, text: str | None) -> np.ndarray:
    """Ids of the whole text, none for null."""
    return np.asarray(enc.encode_ordinary(text), np.int32) if text else np.zeros(0, np.int32)
