"""Scoring of (query, text) pairs by a model: its contract, and batches of a bounded number of tokens.

A scorer is an object with ``encode(query, text)``, a pair's token ids, and ``score(batch)``, a number for each of a list of token id
lists; its factory is called once a worker, so a model is loaded once. Pairs of an Arrow batch are taken in order of length and cut
where the longest times their number would exceed the budget, so that a padded batch has a bounded size and little padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The instruction and the prompt of causal rerankers.
INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"
PROMPT = "<Instruct>: {instruction}\n<Query>: {query}\n<Document>: {document}"


class PairScorer(Protocol):
    def encode(self, query: str, text: str) -> list[int]: ...

    def score(self, batch: list[list[int]]) -> list[float]: ...


@dataclass
class CausalScorer:
    """Yes or no of a causal model: ``tokenize`` makes ids of a prompt, ``logits`` gives (no, yes) after each prompt of a batch. The score is
    their difference, whose sigmoid is the softmax probability of yes."""

    tokenize: Callable[[str], list[int]]
    logits: Callable[[list[list[int]]], list[tuple[float, float]]]
    instruction: str = INSTRUCTION

    def encode(self, query: str, text: str) -> list[int]:
        return self.tokenize(PROMPT.format(instruction=self.instruction, query=query, document=text))

    def score(self, batch: list[list[int]]) -> list[float]:
        return [float(yes - no) for no, yes in self.logits(batch)]


def batches(lengths: list[int], budget: int) -> Iterator[list[int]]:
    """Places in order of length, in lists whose longest times their number is at most ``budget``; a longer one stands alone."""
    held: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if held and lengths[i] * (len(held) + 1) > budget:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def scored(scorer: PairScorer, pairs: list[tuple[str | None, str | None]], budget: int, most: int) -> list[float]:
    """Scores in the order of the pairs. Ids beyond ``most`` are cut; nulls are empty."""
    ids = [scorer.encode(q or "", t or "")[:most] for q, t in pairs]
    out = [0.0] * len(ids)
    for at in batches([len(x) for x in ids], budget):
        got = scorer.score([ids[i] for i in at])
        if len(got) != len(at):
            raise ValueError(f"{len(got)} scores for {len(at)} pairs")
        for i, s in zip(at, got, strict=True):
            out[i] = float(s)
    return out


def pair_scores(factory: Callable[[], PairScorer], budget: int = 16_384, most: int = 512) -> Callable[[Column, Column], Column]:
    """A Column function of (query, text), for ``search``'s ``reranker``. ``budget``: tokens of a padded batch; ``most``: of a pair."""

    @F.pandas_udf("double")
    def run(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = factory()
        for q, t in rows:
            yield pd.Series(scored(scorer, [(None if pd.isna(a) else a, None if pd.isna(b) else b) for a, b in zip(q, t, strict=True)], budget, most), dtype="float64")

    return lambda query, text: run(query, text)
