"""Text quality by a support vector machine on n-grams scaled by their class log-count ratios.

A text's features are indicators of n-grams: one word and two in a row as they stand, and one to
three in a row by their shape. A word's shape is its characters by class (small letter, capital,
digit, each other one as itself, letters and digits collapsed to one of a run) and whether it repeats the word
before it. The indicators are hashed to a table of fixed size, scaled by naive Bayes log-count
ratios, and the row by the root of its number of n-grams, so that long texts and short ones
have margins of one size. A linear machine with hinge loss is then fitted by dual coordinate descent, and a logistic curve, set on
labelled texts that the fit didn't see, turns the margin into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .shared import release, tidy

#: Hashed n-grams are dealt to so many places.
BUCKETS = 1 << 20
#: Labelled texts of each class that the training takes at most.
TRAIN_TEXTS = 2000
#: Score from which a text is predicted to be good.
GOOD = 0.7

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = ord("0")
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_COLLAPSED = np.zeros(256, bool)
_COLLAPSED[[ord("0"), ord("A"), ord("a")]] = True


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_COLLAPSED[kind[1:]]
    keep[start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return tb.span_hashes(kind[keep], at[start], at[end])


def _runs(hashes: np.ndarray, text: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all runs of n words within a text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(hashes) - n + 1
    out = np.full(last, salt, np.uint64)
    for j in range(n):
        out = tb.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + last])
    inside = text[:last] == text[n - 1 :]
    return out[inside], text[:last][inside]


def ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text's n-grams in ascending order, and n + 1 offsets of the texts."""
    start, end, of = tb.words(data, offs)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(of))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word, shape = tb.span_hashes(data, start, end), _shapes(data, start, end)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    shape = np.where(again, ~shape, shape)
    parts = [_runs(word, text, n, n) for n in (1, 2)] + [_runs(shape, text, n, 10 + n) for n in (1, 2, 3)]
    bucket = np.concatenate([h for h, _ in parts]) % np.uint64(BUCKETS)
    owner = np.concatenate([t for _, t in parts])
    # one sort by text and bucket
    key = np.unique(owner.astype(np.int64) * BUCKETS + bucket.astype(np.int64))
    return key % BUCKETS, np.searchsorted(key, np.arange(len(offs), dtype=np.int64) * BUCKETS)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """ln of (an n-gram's share of class 1 over its share of class 0), each n-gram counted once a text, `smooth` added to each count."""
    count = [np.full(BUCKETS, smooth) for _ in (0, 1)]
    for row, c in zip(rows, y, strict=True):
        count[int(c)][row] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def hinge_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = 60, gap: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y f(x)), by dual coordinate descent.

    The bias is the weight of a constant feature. y is -1 or 1. A dual variable lies between 0 and
    its cost; rows are visited in a drawn order until no projected gradient exceeds the gap.
    """
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    square = np.array([(v**2).sum() + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            projected = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= cost[i] else slope
            if projected:
                worst = max(worst, abs(projected))
                new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
        if worst < gap:
            break
    return w, bias


@dataclass
class Model:
    """weights: one for each bucket, log-count ratio included; a margin's probability is 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, buckets: np.ndarray, offs: np.ndarray) -> np.ndarray:
        size = np.diff(offs)
        total = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
        return (total[offs[1:]] - total[offs[:-1]]) / np.sqrt(np.maximum(size, 1)) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def _constant(p: float) -> Model:
    return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))


def _curve(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with targets drawn in a little as Platt does and the classes weighed alike."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    x, w = np.stack([f, np.ones(len(f))], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        h = np.maximum(p * (1 - p), 1e-6) * weight
        step = np.linalg.solve((x * h[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (p - target)) + 1e-3 * w)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def train(rows: list[np.ndarray], labels: list[int], cost: float = 10.0, seed: int = 5) -> Model:
    """Fit on the distinct buckets of labelled texts. With one class only, or none, all texts get one score: 0.95, 0.05 or 0.5."""
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return _constant(0.5 if not len(y) else 0.95 if y.max() else 0.05)
    rng = np.random.default_rng(seed)
    fit = np.zeros(len(y), bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        fit[own[: max(1, len(own) * 7 // 10)]] = True
    mine = np.flatnonzero(fit)
    rows = [np.asarray(r, np.int64) for r in rows]
    ratio = log_count_ratios([rows[i] for i in mine], y[mine])
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    # the smaller class weighs as much as the larger
    share = np.bincount(y[mine], minlength=2)
    each = cost * share.max() / share[y[mine]]
    w, bias = hinge_descent([rows[i] for i in mine], [values[i] for i in mine], np.where(y[mine] == 1, 1, -1), each)
    model = Model((w * ratio).astype(np.float32), bias, 1.0, 0.0)
    rest = np.flatnonzero(~fit) if len(np.unique(y[~fit])) == 2 else np.arange(len(y))
    offs = np.concatenate([[0], np.cumsum([len(rows[i]) for i in rest])])
    model.slope, model.shift = _curve(model.margins(np.concatenate([rows[i] for i in rest]), offs), y[rest])
    return model


def fold_of(id_col: str = "doc_id"):
    """The fold of a document: crc32 of its id as text, mod 4; fold 2 is held out from training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_texts: int = TRAIN_TEXTS) -> Model:
    """Train on at most max_texts labelled texts of each class, drawn by a hash of the id, never on held-out ones.

    The texts' distinct buckets are made where the texts lie; the one task that trains reads at most
    2 * max_texts rows of at most BUCKETS numbers each, whatever the texts' lengths.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of() != 2)).distinct()
    order = F.xxhash64(F.lit(12), "doc_id")
    drawn = [known.where(F.col("y") == c).orderBy(order, "doc_id").limit(max_texts) for c in (0, 1)]
    # at most 2 * max_texts ids: a proven bound for the broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").select("doc_id", "y", "text")

    def read(batches):
        for batch in batches:
            for lo, hi, data, offs in tb.chunks(batch.column(2)):
                bucket, of = ngrams(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), tb.binaries(bucket.astype("<i4"), of)], ["doc_id", "y", "buckets"])

    def learn(table: pa.Table) -> pa.Table:
        got = sorted(zip(table.column("doc_id").to_pylist(), table.column("y").to_pylist(), table.column("buckets").to_pylist(), strict=True))
        model = train([np.frombuffer(b, "<i4") for _, _, b in got], [c for _, c, _ in got])
        used = np.flatnonzero(model.weights).astype("<i4")
        release()
        return pa.table({"at": pa.array([used.tobytes()], pa.binary()), "weights": pa.array([model.weights[used].astype("<f4").tobytes()], pa.binary()), "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    found = rows.mapInArrow(tidy(read), "doc_id long, y int, buckets binary").groupBy(F.lit("all")).applyInArrow(learn, "at binary, weights binary, bias double, slope double, shift double").collect()
    model = _constant(0.5)
    for r in found:
        model.weights[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["weights"], "<f4")
        model.bias, model.slope, model.shift = r["bias"], r["slope"], r["shift"]
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add a score (0 to 1) to a table as a column of another name than its own, from the whole text; a null text is scored like an empty one."""
    if out_col in docs.columns:
        raise ValueError(f"the table has a column {out_col}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    cols = docs.columns

    def scan(batches):
        m, at = shared.value, cols.index(text_col)
        for batch in batches:
            got = np.zeros(batch.num_rows)
            for lo, hi, data, offs in tb.chunks(batch.column(at)):
                got[lo:hi] = m.probability(m.margins(*ngrams(data, offs)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*cols, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out_col}` double"
    return docs.mapInArrow(tidy(scan), schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted from a score of GOOD on.

    A null or empty text is scored, by the bias alone; a null id is not held out; rows with equal ids
    are scored each by its text; further columns are ignored. Without labels of both classes every text gets the same
    score; an id that is labelled both ways counts in both classes.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(slim, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold_of() == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).cast("int").alias("predicted"))
