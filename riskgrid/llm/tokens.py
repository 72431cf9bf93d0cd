"""Byte-level BPE from a tokenizers .json file, quick on whole texts."""

from __future__ import annotations

import functools
import json

import public_tokenizers

DEFAULT = "byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level BPE files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def special_tokens(name: str) -> dict[str, int]:
    """Added tokens of the file, which the library matches inside texts by default."""
    with open(public_tokenizers.path(name)) as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


@functools.lru_cache(4)
def library(name: str):
    """The tokenizers object for a .json file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.lru_cache(4)
def quick(name: str):
    """An encoder with the vocabulary of the .json file and the library's ids, several times as fast.

    Ranks are the file's own ids, whose order is the order of its merges; the
    file's special strings in a text become their ids, as the library does by
    default. Tests hold it against the library on every code point.
    """
    import tiktoken

    letters = _byte_letters()
    with open(public_tokenizers.path(name)) as file:
        spec = json.load(file)
    special = special_tokens(name)
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
