"""A piece vocabulary read from a SentencePiece model file, and the words its pieces never cross.

The file's bytes (under 1 MB) are read on the driver and travel with the tasks, so executors need no copy.
"""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

#: SentencePiece's stand-in for a space.
SPACE = "▁"

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_bytes(path: str | None = None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> list[tuple[str, int]]:
    """(piece, kind) by id."""
    sp = processor(model)

    def kind(i: int) -> int:
        return BYTE if sp.is_byte(i) else CONTROL if sp.is_control(i) else UNKNOWN if sp.is_unknown(i) else UNUSED if sp.is_unused(i) else NORMAL

    return [(sp.id_to_piece(i), kind(i)) for i in range(sp.get_piece_size())]


@lru_cache(maxsize=2)
def word_pattern(model: bytes) -> re.Pattern[str]:
    """Splits a text (spaces as spaces) into words such that no piece, and so no merge, spans two of them.

    Proved from the vocabulary: no piece has a space after another character, so a word starts at each run of
    spaces; and characters that occur in no longer piece stand alone. Raises if the vocabulary is otherwise.
    """
    alone: set[str] = set("\n\t\r")
    for piece, kind in vocabulary(model):
        if kind == NORMAL and len(piece) > 1:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} spans words")
            alone -= set(piece)
    if not alone:
        return re.compile(" *[^ ]+| +")
    one = "".join(map(re.escape, sorted(alone)))
    return re.compile(f"[{one}]| *[^ {one}]+| +")
