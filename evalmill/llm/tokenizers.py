"""Public tokenizers, read from the vocabulary files of the machine."""

from __future__ import annotations

import base64
import functools
import os

#: Folder of the vocabulary files; a parameter of every operator that tokenises.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed: the pattern that the byte-level vocabularies were built with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def ranked(name: str, folder: str = FOLDER):
    """A byte-level encoding from a file of ranks; once for each worker process."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
