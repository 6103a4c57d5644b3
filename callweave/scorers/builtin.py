"""Deterministic stand-ins, so that every job runs and can be checked without a model.

They pick or compare words that are there; they show the data flow, not language quality.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

from callweave.constants import (
    ACTIONS_PROMPT_HEAD,
    BLANK,
    EDGE_BLANK_PATTERN,
    PROMPT_TAIL,
    SUMMARY_PROMPT_HEAD,
    SUMMARY_WORD_LIMIT,
    TERM_PATTERN,
    WORD_PATTERN,
)



def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"\x{85}", r"\x85"))


_TERM, _WORD, _EDGE = _compiled(TERM_PATTERN), _compiled(WORD_PATTERN), _compiled(EDGE_BLANK_PATTERN)


def prompt_body(prompt: str) -> str:
    """The call text inside one of our prompts; any other text is returned as it is."""
    for head in (SUMMARY_PROMPT_HEAD, ACTIONS_PROMPT_HEAD):
        if prompt.startswith(head):
            return prompt.removeprefix(head).removesuffix(PROMPT_TAIL)
    return prompt


@lru_cache(maxsize=8)
def _run_of(word_limit: int) -> regex.Pattern:
    return _compiled(rf"[{BLANK}]*+(?:[^{BLANK}]++[{BLANK}]*+){{1,{word_limit - 1}}}")


def extract_text(text: str, word_limit: int = SUMMARY_WORD_LIMIT) -> str:
    """Python twin of ``functions.text.extract``."""
    run = _run_of(word_limit)
    short = 2 * word_limit - 1  # so many words take at least as many blanks between them
    runs = []
    for piece in text.split("."):
        if len(piece) >= short:
            runs += run.findall(piece)
        elif _WORD.search(piece):
            runs.append(piece)
    best_first = sorted(range(len(runs)), key=lambda k: (-len(set(_TERM.findall(runs[k].lower()))), k))
    kept, total = [], 0
    for k in best_first:
        total += len(_WORD.findall(runs[k]))
        if total >= word_limit:
            break
        kept.append(k)
    return _EDGE.sub("", "".join(runs[k] + "." for k in sorted(kept)))


@dataclass(frozen=True)
class ExtractiveModel:
    """Answers a prompt with the sentences of the text in it that have most terms."""

    word_limit: int = SUMMARY_WORD_LIMIT

    def load(self) -> Callable[[Sequence[str]], Sequence[str]]:
        return lambda prompts: [extract_text(prompt_body(p), self.word_limit) for p in prompts]


@dataclass(frozen=True)
class RefusingModel:
    """Wraps a model and fails on prompts that match ``pattern``; shows that one bad call leaves the others alone."""

    inner: ExtractiveModel
    pattern: str

    def load(self) -> Callable[[Sequence[str]], Sequence[str]]:
        answer, refused = self.inner.load(), re.compile(self.pattern)

        def run(prompts: Sequence[str]) -> Sequence[str]:
            if any(refused.search(p) for p in prompts):
                raise ValueError("prompt refused")
            return answer(prompts)

        return run


@dataclass(frozen=True)
class TermModel:
    """Two columns in and two out: the number of a text's terms, and its language with the first of them."""

    inputs: tuple[str, ...] = ("text", "lang")
    outputs: str = "terms bigint, opening string"

    def load(self) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            found = [_TERM.findall(text.lower()) for text in frame["text"]]
            opening = [f"{lang}:{terms[0] if terms else ''}" for lang, terms in zip(frame["lang"], found)]
            return pd.DataFrame({"terms": [len(terms) for terms in found], "opening": opening})

        return run


@dataclass(frozen=True)
class HashingEncoder:
    """Term counts folded into ``width`` dimensions by a rolling hash of the term's characters."""

    width: int = 256

    def load(self) -> Callable[[Sequence[str]], np.ndarray]:
        @lru_cache(maxsize=100_000)
        def slot(term: str) -> int:
            place = 0
            for char in term:
                place = (place * 31 + ord(char)) % self.width
            return place

        def run(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.width), dtype=np.float32)
            for row, text in enumerate(texts):
                slots = [slot(term) for term in _TERM.findall(text.lower())]
                out[row] = np.bincount(slots, minlength=self.width) if slots else 0
            return out

        return run


@dataclass(frozen=True)
class LexicalClassifier:
    """Scores candidates by the term-count cosine of the whole text and the topic description. Each text of a call is counted once, and
    each description once for as long as it is kept."""

    def load_pairs(self) -> Callable[[Sequence[tuple[str, str, str]]], Sequence[float]]:
        @lru_cache(maxsize=10_000)
        def described(description: str) -> tuple[Counter, int]:
            return _counted(description)

        def run(pairs: Sequence[tuple[str, str, str]]) -> Sequence[float]:
            texts = {text: _counted(text) for text in {text for text, _, _ in pairs}}
            scores = []
            for text, _, description in pairs:
                (counts, own), (other, square) = texts[text], described(description)
                scale = math.sqrt(own * square)
                dot = sum(n * counts[term] for term, n in other.items())
                scores.append(dot / scale if scale else 0.0)
            return scores

        return run


def _counted(text: str) -> tuple[Counter, int]:
    counts = Counter(_TERM.findall(text.lower()))
    return counts, sum(n * n for n in counts.values())
