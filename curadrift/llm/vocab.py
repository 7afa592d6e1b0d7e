"""Public vocabularies as Spark tasks read them: the file's place is a parameter, each Python worker loads it once."""

from __future__ import annotations

import base64
import functools

import numpy as np

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file with a line for each token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}


@functools.lru_cache(maxsize=4)
def byte_pair(path: str):
    """The byte-level BPE of a rank file as a tiktoken encoding without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def token_ids(text: str, encoding) -> np.ndarray:
    """Ids as the tokenizers library gives them for the same vocabulary: its special string inside a text is one id."""
    parts = text.split(SPECIAL)
    found = [np.asarray(encoding.encode_ordinary(parts[0]), dtype=np.uint32)]
    for part in parts[1:]:
        found += [np.array([SPECIAL_ID], dtype=np.uint32), np.asarray(encoding.encode_ordinary(part), dtype=np.uint32)]
    return np.concatenate(found) if len(found) > 1 else found[0]
