"""Byte-level BPE encoders from rank files; one per worker and file."""

import base64
import json
import os
from functools import lru_cache

import public_tokenizers
import tiktoken

PATTERN = public_tokenizers.PATTERN


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the tokenizer file beside a rank file (same name, .json), if there is one.
    They are cut out of a text as they stand, before anything else."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens") or []
    for token in tokens:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"{beside}: {token['content']} isn't cut out as it stands")
    return {token["content"]: token["id"] for token in tokens}


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """The encoder of a rank file. For its `encode_ordinary`, added tokens are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


def ids_of(path: str):
    """A function from a text to its ids, added tokens included."""
    one = encoder(path)
    return lambda text: one.encode(text, allowed_special="all", disallowed_special=())
