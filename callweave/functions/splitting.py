"""Chunks that end at paragraph, line or word boundaries where the text has them.

The cut depends on how the pieces before it were packed, which no built-in expression can follow; hence a pandas UDF.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.constants import CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_SEPARATORS


def boundary_chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """``array<string>``: trimmed chunks of at most ``size`` characters sharing up to ``overlap`` with the one before."""

    @F.pandas_udf("array<string>")
    def split_batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(split_text(t, size, overlap)))

    return split_batch.asNondeterministic()(text)  # so that it is not evaluated once per use


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = CHUNK_SEPARATORS) -> Iterator[str]:
    """Cut at the coarsest separator the text holds and pack the pieces; a piece too long is cut at the next finer one."""
    at = next((i for i, separator in enumerate(separators) if separator in text), len(separators) - 1)
    finer = separators[at + 1 :]
    fitting: list[str] = []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        yield from _pack(fitting, size, overlap)
        fitting = []
        yield from split_text(piece, size, overlap, finer) if finer else (piece,)
    yield from _pack(fitting, size, overlap)


def _cut(text: str, separator: str) -> Iterable[str]:
    """Pieces of a text, a separator staying at the head of the piece it opens."""
    if not separator:
        return text
    first, *others = text.split(separator)
    return ([first] if first else []) + [separator + other for other in others]


def _pack(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    held: deque[str] = deque()
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            yield from _trimmed(held)
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    yield from _trimmed(held)


def _trimmed(held: Iterable[str]) -> Iterator[str]:
    chunk = "".join(held).strip()
    if chunk:
        yield chunk
