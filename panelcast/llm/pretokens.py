"""Byte-level BPE by cached pre-tokens.

A byte-level tokenizer splits a text by a pattern and encodes each match on its own, so a text's ids are the joined ids of
its pre-tokens. A worker keeps a bounded cache of pre-token to ids; most matches cost one dictionary look-up.

The pattern is matched by Python's regular expressions where they and the libraries agree on every character's class; texts
with other characters (recently assigned or unassigned code points) go to the library itself, whole.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: Entries of a worker's pre-token cache before it starts anew.
CACHE = 200_000
#: Code points whose classes (letter, number, space, other) the installed libraries agree on.
_AGREED = regex.compile("[\\x00-\\u052f\\u0900-\\u0bff\\u0e00-\\u0e7f\\u1e00-\\u206f\\u20a0-\\u2bff\\u3000-\\u9fff\\uac00-\\ud7a3\\uff00-\\uffef\\U0001f300-\\U0001f64f]*")


def _members(kinds: str, upto: int = 256) -> str:
    return "".join(re.escape(chr(c)) for c in range(upto) if unicodedata.category(chr(c))[0] in kinds)


@lru_cache
def _latin1_pattern() -> re.Pattern:
    """The split pattern for texts of Latin-1 characters, its classes spelled out."""
    letters, numbers, spaces = _members("L"), _members("N"), "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


@lru_cache
def _any_pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def splitter(text: str):
    """The compiled pattern that splits ``text`` as the libraries do, or None where only they can."""
    try:
        text.encode("latin-1")
        return _latin1_pattern()
    except UnicodeEncodeError:
        return _any_pattern() if _AGREED.fullmatch(text) else None


def unbyte() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, as character to byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a ``.tiktoken`` file or a byte-level ``.json`` file without its special tokens."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    back = unbyte()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model["added_tokens"]}
    return {bytes(back[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}


def is_byte_level(path: str) -> bool:
    """Whether the ``.json`` tokenizer is a plain byte-level BPE whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre, model = j.get("pre_tokenizer") or {}, j.get("model") or {}
    if j.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE":
        return False
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return ids == sorted(ids)


class Coder:
    """Encodes and decodes texts by one vocabulary file; one per worker and path.

    ``ids(text)`` returns little-endian unsigned 32-bit ids as bytes. Special strings: a ``.tiktoken`` file has none; for a
    ``.json`` file they are single tokens, as the tokenizers library has it by default."""

    def __init__(self, path: str, cache: int = CACHE):
        import public_tokenizers
        import tiktoken

        ranks = ranks_of(path)
        self.library = tiktoken.Encoding("panelcast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.special: dict[str, bytes] = {}
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                added = json.load(f)["added_tokens"]
            self.special = {x["content"]: np.uint32(x["id"]).tobytes() for x in added}
            self.bytes_of |= {x["id"]: x["content"].encode() for x in added}
        self._parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        one = self.library._core_bpe.encode_single_piece
        uint32 = np.uint32

        class Ids(dict):
            def __missing__(self, piece):
                if len(self) >= cache:
                    self.clear()
                self[piece] = out = np.array(one(piece.encode()), uint32).tobytes()
                return out

        self.cached = Ids()

    def _plain(self, text: str) -> bytes:
        pattern = splitter(text)
        if pattern is None:
            return np.array(self.library.encode_ordinary(text), np.uint32).tobytes()
        return b"".join(map(self.cached.__getitem__, pattern.findall(text)))

    def ids(self, text: str) -> bytes:
        if self._parts is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special.get(x) or self._plain(x) for x in self._parts.split(text) if x)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, np.uint32).tolist()))


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    """The worker's coder for a file."""
    return Coder(path)
