"""What a model must offer.

A scorer travels to the executors pickled, so it should be light: names, paths, settings. ``load`` runs on the executor
and returns the loaded model as a plain function over a batch. A scorer that compares by value, such as a frozen
dataclass, is loaded once per Python worker; any other once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd


class TextModel(Protocol):
    """Prompt in, text out."""

    def load(self) -> Callable[[Sequence[str]], Sequence[str]]: ...


class Encoder(Protocol):
    """Text in, vector of constant width out."""

    def load(self) -> Callable[[Sequence[str]], np.ndarray]: ...


class ZeroShotClassifier(Protocol):
    """Text and candidates (``topic``, ``description`` pairs) in, ``(topic, score)`` pairs out, best first."""

    def load(self) -> Callable[[str, Sequence[tuple[str, str]]], Sequence[tuple[str, float]]]: ...


class PairClassifier(Protocol):
    """Triples of text, topic and description, of many texts at once, in; one score of at least 0 for each out."""

    def load_pairs(self) -> Callable[[Sequence[tuple[str, str, str]]], Sequence[float]]: ...


class FrameModel(Protocol):
    """A frame with the columns ``inputs`` in, a frame with as many rows and the columns of ``outputs``, a schema such as
    ``"score double, reason string"``, out."""

    inputs: Sequence[str]
    outputs: str

    def load(self) -> Callable[[pd.DataFrame], pd.DataFrame]: ...
