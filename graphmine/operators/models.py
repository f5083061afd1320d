"""Frozen query encoders scored against candidates in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Contexts that are scored in one pass over the candidates.
CONTEXTS = 1000


#: By name; gelu in its tanh form.
ACTIVATIONS = {
    "relu": lambda x: np.maximum(x, 0),
    "silu": lambda x: x / (1 + np.exp(-x)),
    "gelu": lambda x: 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3))),
}


@dataclass
class Encoder:
    """Layer norm, then three linear layers with an activation between them."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    activation: str = "relu"

    @classmethod
    def of_size(cls, dim: int, seed: int, activation: str = "relu") -> Encoder:
        rng = np.random.default_rng(seed)
        sizes = [dim, 4 * dim, 2 * dim, dim]
        return cls([rng.normal(0, a**-0.5, (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)], [np.zeros(b) for b in sizes[1:]], activation)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            x = x @ w + b
            if i < len(self.weights) - 1:
                x = ACTIVATIONS[self.activation](x)
        return x


def score_candidates(contexts: DataFrame, candidates: DataFrame, models: dict[str, Encoder], dim: int) -> DataFrame:
    """(model_id, context, id, score): dot product of each candidate with each encoded context.

    contexts (context, vector), one for each hub, are encoded once a model, CONTEXTS at a time; the
    candidates (id, vector) stream through in batches for each. A model that fails gives no row, nor does a
    context or candidate whose vector is null or hasn't dim numbers.
    """
    rows = contexts.where(F.size("vector") == dim).toLocalIterator()
    parts = [_scores(few, contexts, candidates, models, dim) for few in _chunks(rows, CONTEXTS)]
    return reduce(DataFrame.union, parts) if parts else _scores([], contexts, candidates, models, dim)


def _chunks(rows: Iterator, size: int) -> Iterator[list]:
    while few := list(islice(rows, size)):
        yield few


def _scores(few: list, contexts: DataFrame, candidates: DataFrame, models: dict[str, Encoder], dim: int) -> DataFrame:
    names, matrix = [], []
    for model, encoder in models.items():
        x = np.array([r["vector"] for r in few], float).reshape(-1, dim)
        try:
            matrix.append(encoder(x))
            names += [(model, r["context"]) for r in few]
        except ValueError:
            continue
    queries = np.concatenate(matrix) if matrix else np.zeros((0, dim))

    def run(batches):
        for pdf in batches:
            v = np.array(pdf["vector"].tolist(), float).reshape(len(pdf), dim)
            score = v @ queries.T
            for j, (model, context) in enumerate(names):
                yield pd.DataFrame({"model_id": model, "context": context, "id": pdf["id"], "score": score[:, j]})

    kind = contexts.schema["context"].dataType.simpleString()
    return candidates.select("id", "vector").where(F.col("vector").isNotNull() & (F.size("vector") == dim)).mapInPandas(run, f"model_id string, context {kind}, id {candidates.schema['id'].dataType.simpleString()}, score double")
