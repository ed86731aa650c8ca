"""Public byte-level BPE vocabularies, loaded from a path on whichever machine uses them."""

from __future__ import annotations

import base64

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of the vocabulary: how texts are cut before merging, and the id that ends a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256

_loaded: dict = {}


def encoding(path: str = VOCABULARY):
    """This process's encoder: workers keep it from task to task."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def packed(text: str, path: str = VOCABULARY) -> bytes:
    """The ids of a text as little-endian uint16."""
    return encoding(path).encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()


def count(text: str, path: str = VOCABULARY) -> int:
    return len(encoding(path).encode_to_numpy(text, disallowed_special=()))
