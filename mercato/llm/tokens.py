"""Token ids of a public byte-level BPE vocabulary.

Texts are encoded whole. The ids are those of ``tokenizers`` for the vocabulary; tests hold
them against it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import numpy as np

VOCABULARY = "byte_bpe_50k"
_SPECIAL = "<|endoftext|>"
_made: dict[str, Callable[[str], np.ndarray]] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The vocabulary's path without its suffix (.json for tokenizers, .tiktoken for its ranks)."""
    import public_tokenizers
    return os.path.splitext(public_tokenizers.path(name + ".json"))[0]


def encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """text -> ids. Kept for a worker's life."""
    if vocabulary in _made:
        return _made[vocabulary]
    import public_tokenizers
    import tiktoken
    with open(vocabulary + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens={_SPECIAL: len(ranks)})

    def encode(text: str) -> np.ndarray:
        return bpe.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    _made[vocabulary] = encode
    return encode
