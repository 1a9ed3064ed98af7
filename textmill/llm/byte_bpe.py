"""Byte-level BPE ids of whole texts, at the speed of a cache of words.

The pattern of this vocabulary family never matches from a non-space character across a following space.  So the ids
of a text are those of its chunks, cut before every single space or line break that stands between non-space
characters.  Chunks repeat, and a bounded cache holds the ids of those seen first.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np

CACHE_CHUNKS = 400_000
CACHED_CHARS = 48


class _Unsafe(Exception):
    pass


class _Chunks(dict):
    """Chunk -> ids as little-endian unsigned 32-bit."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Unsafe
        ids = self.encode(chunk if chunk[0] == "\n" else " " + chunk)
        if len(self) < CACHE_CHUNKS and len(chunk) <= CACHED_CHARS:
            self[chunk] = ids
        return ids


class ByteBpe:
    """Ids of the tokenizer file at path (the JSON of the tokenizers library), as bytes.

    The merges run in tiktoken over the ranks that the same file implies.  Texts that hold a special token's string,
    and those on which that library's pattern overflows (very long runs of spaces), go to the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self._fast = tiktoken.Encoding("textmill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._chunks = _Chunks(self._plain)

    def _plain(self, text: str) -> bytes:
        try:
            return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except (ValueError, RuntimeError):
            return self._exact(text)

    def _exact(self, text: str) -> bytes:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self._exact(text)
        core = text.rstrip()
        tail = text[len(core) :]
        head, _, rest = core.replace("\n", " \n").partition(" ")
        if not core or core[0].isspace() or head[-1].isspace():
            return self._plain(text)
        try:
            out = self._plain(head) + (b"".join(map(self._chunks.__getitem__, rest.split(" "))) if rest else b"")
        except _Unsafe:
            return self._plain(text)
        return out + self._plain(tail) if tail else out


#: Fixed value: the pattern that parts texts before the merges of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_made: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder a worker process and file."""
    if path not in _made:
        _made[path] = ByteBpe(path)
    return _made[path]
