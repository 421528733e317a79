"""A caller's embedding model inside Spark tasks: loaded once a worker, fed with batches of like length.

The model itself is the caller's (``TextModel``). Here are text preparation, batching, padding and
pooling around it, as one vectorised column function that serves tables and streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilar.functions.pooling import DOC_MAX_TOKENS, MAX_TOKENS, PREFIX, SUFFIX


class TextModel(Protocol):
    """What a caller supplies. Ids and masks are matrices [text, place]; a mask is 1 on tokens, 0 on padding."""

    def tokens(self, text: str) -> Sequence[int]:
        """Ids of a text, whole."""

    def states(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Last hidden states [text, place, width]; what stands on padding does not matter."""

    def vectors(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sentence vectors [text, width], for the entries that take the model's own."""


@dataclass(frozen=True)
class ModelHook:
    """How tasks get the model. ``load`` is called once in every Python worker and name; it and all it
    refers to must be picklable (load weights inside it, from storage that all executors reach)."""

    name: str
    load: Callable[[], TextModel]
    batch_size: int = 32
    max_tokens: int = MAX_TOKENS


_LOADED: dict[str, TextModel] = {}


def _model(hook: ModelHook) -> TextModel:
    if hook.name not in _LOADED:
        _LOADED[hook.name] = hook.load()
    return _LOADED[hook.name]


def drop_words(text: str, model: TextModel, budget: int = DOC_MAX_TOKENS, cap: int = MAX_TOKENS) -> str:
    """Drop trailing words until the text fits the budget.

    Each round keeps the share ``budget / tokens`` of the words, the count of tokens being capped.
    """
    count = min(cap, len(model.tokens(text)))
    while count > budget:
        words = text.split()
        text = " ".join(words[: int(len(words) * (budget / count))])
        count = min(cap, len(model.tokens(text)))
    return text


def _padded(rows: list[Sequence[int]], left: bool) -> tuple[np.ndarray, np.ndarray]:
    width = max(1, max(map(len, rows)))
    ids, mask = np.zeros((len(rows), width), dtype=np.int64), np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        at = slice(width - len(row), width) if left else slice(0, len(row))
        ids[i, at], mask[i, at] = row, 1
    return ids, mask


def _pooled(model: TextModel, pool: str, rows: list[Sequence[int]], suffix: list[int]) -> np.ndarray:
    ids, mask = _padded(rows, pool == "suffix")
    if pool in ("none", "l2"):
        out = np.asarray(model.vectors(ids, mask), dtype=np.float64)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out if pool == "none" else out / np.where(norm > 0, norm, 1.0)
    states = np.asarray(model.states(ids, mask), dtype=np.float64)
    if pool == "first":
        return states[:, 0] * mask[:, :1]
    if pool == "suffix":
        tail = np.arange(ids.shape[1])[None, :] >= ids.shape[1] - np.asarray(suffix)[:, None]
        mask = mask * tail
    return (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]


def embed(hook: ModelHook, pool: str, text: str | Column) -> Column:
    """Vectors (``ARRAY<DOUBLE>``) of a text column by a caller's model.

    ``pool``: ``none`` (the model's sentence vector), ``l2`` (that, at unit length), ``first`` (state of the
    first token), ``mean`` (of all tokens) or ``suffix`` (the text is cut by words and put into the template;
    the mean covers text and closing mark). Other texts are cut to ``max_tokens`` tokens. Inside an
    Arrow batch, texts go to the model in falling order of length, so that batches carry little padding;
    rows keep their places. A null text is an empty one; a text without tokens has a zero vector under
    the token pools. Batching does not change results beyond the model's own rounding.
    """
    def prepare(model: TextModel, value: str) -> tuple[Sequence[int], int]:
        if pool != "suffix":
            return model.tokens(value)[: hook.max_tokens], 0
        body = drop_words(value, model).rstrip() + SUFFIX
        return model.tokens(PREFIX + body)[: hook.max_tokens], min(hook.max_tokens, len(model.tokens(body)))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from vigilar.functions import models  # the worker's own module, which outlives the task

        model = models._model(hook)
        for texts in batches:
            ready = [prepare(model, "" if t is None else str(t)) for t in texts]
            order = sorted(range(len(ready)), key=lambda i: -len(ready[i][0]))
            out: list[np.ndarray | None] = [None] * len(ready)
            for at in range(0, len(order), hook.batch_size):
                own = order[at : at + hook.batch_size]
                for i, vector in zip(own, _pooled(model, pool, [ready[i][0] for i in own], [ready[i][1] for i in own]), strict=True):
                    out[i] = vector
            yield pd.Series(out, index=texts.index, dtype=object)

    return run(F.col(text) if isinstance(text, str) else text)
