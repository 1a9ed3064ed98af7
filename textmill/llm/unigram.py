"""Unigram tokenization with the pieces and scores of a SentencePiece model file.

Shared by the count-only Viterbi (token counts) and the codec (encoding and decoding).  The rules are those of
SentencePiece's unigram model with byte fallback:

* a text gets a space in front and its spaces become U+2581 (the vocabulary's normaliser is the identity)
* a path is scored by the sum of its pieces' scores; a character without a piece of its own may be an unknown piece,
  scored ten below the least score, and comes out as one byte piece per byte of its UTF-8
* at equal scores the path whose last piece starts first (the longest last piece) wins at every place

Scores are summed in double precision; the library sums in single precision, which is the same while sums are small.

Pieces hold U+2581 only at their start and never a line break (both checked when a vocabulary is loaded), so the best
path of a text is that of its chunks, each a run of spaces with the word behind it or a line break with the word
behind it.  Chunks repeat; a bounded cache holds what the first ones came to.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Scores from here down stand for "none given"; such pieces get one less than the least score given.
NO_SCORE = -1e8
CACHE_CHUNKS, CACHED_CHARS = 400_000, 48
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+")


@dataclass
class Pieces:
    """The normal pieces (text -> id, score), the 256 byte pieces and the scores of unknown characters."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    texts: list[str] = field(default_factory=list)  # by id; "" for control pieces
    unknown: float = 0.0
    chunked: bool = True

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(i) for i in range(model.vocab_size())]
        normal = [i for i in range(len(texts)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        bytes_at = {texts[i]: i for i in range(len(texts)) if model.is_byte(i)}
        scores = {texts[i]: model.get_score(i) for i in normal}
        floor = min((x for x in scores.values() if x > NO_SCORE), default=0.0) - 1
        scores = {t: max(x, floor) for t, x in scores.items()}
        shown = ["" if model.is_control(i) or model.is_unknown(i) else t for i, t in enumerate(texts)]
        chunked = not any("\n" in t or SPACE in t.lstrip(SPACE) for t in scores)
        return cls({texts[i]: i for i in normal}, scores, [bytes_at[f"<0x{b:02X}>"] for b in range(256)], shown, min(scores.values()) - UNKNOWN_PENALTY, chunked)


def normal_form(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Chunks(dict):
    """chunk -> what solve says of it, kept for the first short ones."""

    def __init__(self, solve: Callable[[str], object]):
        super().__init__()
        self.solve = solve

    def __missing__(self, chunk: str):
        value = self.solve(chunk)
        if len(self) < CACHE_CHUNKS and len(chunk) <= CACHED_CHARS:
            self[chunk] = value
        return value


def chunks_of(text: str, chunked: bool = True) -> list[str]:
    """The chunks of a text's normal form; joined they are the normal form."""
    whole = normal_form(text)
    if not chunked:
        return [whole] if whole else []
    if SPACE + SPACE in whole or "\0" in whole:
        return _CHUNK.findall(whole)
    return whole.replace(SPACE, f"\0{SPACE}").replace("\n", "\0\n").split("\0")[1:]
