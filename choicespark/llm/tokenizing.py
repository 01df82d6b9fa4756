"""Token ids of whole texts from a tokenizer file.

Byte-level BPE files whose ids follow their merges are read as ranks for the faster of the two
installed libraries; both give the same ids (a test compares them).  Any other file, and any text
that holds one of the file's added tokens, goes to the library that the file was written for.  So does a
text with a very long run of white space, which the faster library's pattern matching cannot take.
"""

from __future__ import annotations

import json
import re
import sys
from types import ModuleType

import numpy as np

#: FIXED VALUE: the pattern that cuts text into units in byte-level tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Characters of white space in a row that the faster library gets at most.
SPACES = 100_000
_LONG_SPACE = re.compile(r"\s{%d}" % SPACES)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def merge_ranks(file: dict) -> dict[bytes, int] | None:
    """Token bytes and their ranks, or None where ids are not the order of the merges."""
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    plain = (model["type"] == "BPE" and file.get("normalizer") is None and pre.get("type") == "ByteLevel"
             and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                "fuse_unk", "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    letters, added = byte_letters(), {t["content"] for t in file.get("added_tokens", [])}
    vocab = {token: i for token, i in model["vocab"].items() if token not in added}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items()}


def encoder(path: str):
    """A function from a text to its ids as little-endian unsigned 32-bit bytes; one for each worker process."""
    kept = sys.modules.setdefault("_corpus_encoders", ModuleType("_corpus_encoders")).__dict__
    if path not in kept:
        kept[path] = _encoder(path)
    return kept[path]


def _encoder(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    ranks = merge_ranks(file)
    slow: list[Tokenizer] = []  # built for the first text that needs it, as workers keep it

    def by_file(text: str) -> bytes:
        if not slow:
            slow.append(Tokenizer.from_file(path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    if ranks is None:
        return by_file
    import tiktoken

    fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = [t["content"] for t in file.get("added_tokens", [])]

    def encode(text: str) -> bytes:
        if any(t in text for t in added) or (len(text) >= SPACES and _LONG_SPACE.search(text)):
            return by_file(text)
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    return encode
