"""Byte-level BPE vocabularies, loaded once in each Python worker."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import tiktoken

GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def byte_level_encoding(json_path: str) -> tiktoken.Encoding:
    """A byte-level tokenizer file as an Encoding that gives the same ids.

    Holds where the ids of merged tokens grow in the order of the merges, which is checked here: the lowest id
    is then always the earliest merge.
    """
    with open(json_path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    merged = [vocab[a + b] for a, b in pairs]
    if merged != sorted(set(merged)) or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{json_path} is not a byte-level vocabulary in merge order")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=GPT_PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=4)
def rank_encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    """A rank file as an Encoding without special tokens."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(rank_path), special_tokens={})


def read_ranks(rank_path: str) -> dict[bytes, int]:
    with open(rank_path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}


def encode_ids(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers; special strings become their special ids."""
    return encoding.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)
