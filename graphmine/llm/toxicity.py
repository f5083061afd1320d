"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel.

The strings are the words of a text and its runs of single characters, folded to
letters, with a mark at both ends. A string's features are its subsequences of
ORDER characters, each weighted by DECAY to the power of the span it takes up, so that
an insult with gaps or inserted characters keeps most of its features. The kernel
is projected on landmark strings (Nyström), a linear support vector machine is
trained there, and as that is linear in the features, one weight for each
subsequence remains for scoring.

Labels hold for texts. Pieces of strings that mark toxic texts tell which strings of a
toxic text are taken as toxic; the training alternates between
fitting and taking in the clean strings that score highest. Texts that the fit
did not see then set the logistic curve that turns a text's highest sentence score
into a probability.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .shared import release, tidy
from .wordcode import WordTable

ORDER, DECAY, ALPHABET = 4, 0.55, 32
#: Longer strings are scored by windows of so many characters.
WINDOW, STEP = 10, 1
#: Labelled texts of each class that the training takes at most.
TRAIN_TEXTS = 1000
LANDMARKS = 160

_FOLD = np.zeros(0x10000, np.uint8)
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _fill_fold() -> None:
    for c in range(0x10000):
        base = _LEET.get(chr(c)) or unicodedata.normalize("NFKD", chr(c).lower())[:1] if not 0xD800 <= c < 0xE000 else ""
        if "a" <= base <= "z":
            _FOLD[c] = ord(base) - 96
        elif base and unicodedata.category(base)[0] in "LN":
            _FOLD[c] = 27 + c % 3


_fill_fold()
EDGE_LEFT, EDGE_RIGHT = 30, 31


def _folded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words in a row, with edges, and their offsets."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    code = np.where(points < 0x10000, _FOLD[np.minimum(points, 0xFFFF)], 27 + points % 3).astype(np.uint8)
    word = np.repeat(np.arange(len(words)), size)[code > 0]
    code = code[code > 0]
    n = np.bincount(word, minlength=len(words)) + 2
    offs = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(offs[-1], np.uint8)
    out[np.arange(len(code)) + 2 * word + 1] = code
    out[offs[:-1]], out[offs[1:] - 1] = EDGE_LEFT, EDGE_RIGHT
    return out, offs


def _shape(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of a string of that length, and their weights, scaled to norm 1."""
    at = np.array(list(combinations(range(length), min(ORDER, length))), np.int64)
    w = DECAY ** (at[:, -1] - at[:, 0] + 1.0)
    return at, (w / np.sqrt((w**2).sum())).astype(np.float32)


_shapes = {n: _shape(n) for n in range(2, WINDOW + 1)}


def features(words: list[str]):
    """(word, subsequence codes, weights) of windows of equal length: word[i] has the features codes[i] with the given weights."""
    code, offs = _folded(words)
    size = np.diff(offs)
    # windows of long words
    n_win = np.where(size > WINDOW, -(-(size - WINDOW) // STEP) + 1, 1)
    word = np.repeat(np.arange(len(words)), n_win)
    k = np.arange(len(word)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    length = np.minimum(size, WINDOW)[word]
    start = offs[:-1][word] + np.minimum(k * STEP, size[word] - length)
    for n in np.unique(length):
        at, weight = _shapes[int(n)]
        mine = np.flatnonzero(length == n)
        for lo in range(0, len(mine), 4096):
            own = mine[lo : lo + 4096]
            letters = code[start[own][:, None] + np.arange(n)].astype(np.int32)
            codes = np.zeros((len(own), len(at)), np.int32)
            for j in range(at.shape[1]):
                codes = codes * ALPHABET + letters[:, at[:, j]]
            yield word[own], codes, weight


#: String scores below this count as this.
FLOOR = -2.0
N_FEATURES = 5


def text_features(f: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """What a text's string scores say: the highest, the means of the two and four highest, and how many are positive, as a number and a share."""
    out = np.zeros((n_texts, N_FEATURES))
    n = np.bincount(text, minlength=n_texts)
    some = np.flatnonzero(f > FLOOR)
    some = some[np.lexsort((-f[some], text[some]))]
    t, v = text[some], f[some]
    rank = np.arange(len(t)) - np.searchsorted(t, t)
    top = np.full((n_texts, 4), FLOOR)
    top[t[rank < 4], rank[rank < 4]] = np.minimum(v[rank < 4], 3.0)
    above = np.bincount(text[f > 0], minlength=n_texts)
    out[:, 0], out[:, 1], out[:, 2] = top[:, 0], top[:, :2].mean(axis=1), top.mean(axis=1)
    out[:, 3], out[:, 4] = np.log1p(above), 10 * above / (n + 10)
    return out


@dataclass
class Model:
    """weights: one for each subsequence code; curve: the logistic weights of the text features, and the shift."""

    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def score_words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -np.inf, np.float32)
        for word, codes, weight in features(words):
            np.maximum.at(out, word, self.weights[codes] @ weight)
        return out + np.float32(self.bias)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -60, 60)))


def strings(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of the words of all texts and of runs of at least three words of one character within one."""
    s, e, of = tb.words(data, offs)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(of))
    char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    one = char[e] - char[s] == 1
    if one.any():
        grown = np.flatnonzero(one & np.concatenate([[True], ~one[:-1] | (text[1:] != text[:-1])]))
        last = np.flatnonzero(one & np.concatenate([~one[1:] | (text[1:] != text[:-1]), [True]]))
        run = last - grown >= 2
        s, e, text = np.concatenate([s, s[grown[run]]]), np.concatenate([e, e[last[run]]]), np.concatenate([text, text[grown[run]]])
    return s, e, text


def _texts_to_strings(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct strings; and for each string met its number there and its text."""
    number: dict[int, int] = {}
    words: list[str] = []
    back, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, _, data, offs in tb.chunks(pa.array([t or "" for t in texts], pa.string())):
        s, e, text = strings(data, offs)
        keys, first, at = np.unique(tb.span_hashes(data, s, e), return_index=True, return_inverse=True)
        place = np.zeros(len(keys), np.int64)
        for i, (key, a, b) in enumerate(zip(keys.tolist(), s[first].tolist(), e[first].tolist(), strict=True)):
            if key not in number:
                number[key] = len(words)
                words.append(data[a:b].tobytes().decode())
            place[i] = number[key]
        back.append(place[at])
        owner.append(lo + text)
    return words, np.concatenate(back), np.concatenate(owner)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    q = (x**2).sum(axis=1) + 0.5 / cost
    rng = np.random.default_rng(seed)
    active = np.arange(len(x))
    for _ in range(rounds):
        moved = 0.0
        keep = []
        for i in rng.permutation(active):
            g = y[i] * (x[i] @ w) - 1 + 0.5 / cost[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new or alpha[i] or g < 0.5:
                keep.append(i)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(g))
                alpha[i] = new
        if moved < 0.02 or not keep:
            break
        active = np.array(keep)
    return w


def _stems(words: list[str], pair_text: np.ndarray, pair_word: np.ndarray, fit: np.ndarray, y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Pieces of strings that tell which strings of toxic texts are toxic, and the strings that hold one.

    Chosen one by one, each the piece of 4 to 6 letters (edges count) that marks the most toxic
    texts, marked ones counting less, while it is many times rarer in clean ones. Copies of a text
    share all its strings, but few texts beside them do.
    """
    def grams(own: np.ndarray):
        """(gram, word) of the strings with these numbers, some at a time."""
        for lo in range(0, len(own), 10_000):
            part = own[lo : lo + 10_000]
            code, offs = _folded([words[i] for i in part])
            word = np.repeat(np.arange(len(part)), np.diff(offs))
            left = offs[word + 1] - np.arange(len(code))
            for n in (4, 5, 6):
                ok = np.flatnonzero(left >= n)
                g = np.zeros(len(ok), np.int64)
                for j in range(n):
                    g = g * ALPHABET + code[ok + j]
                yield g * 8 + n, part[word[ok]]

    bad = np.unique(pair_word[fit[pair_text] & (y[pair_text] == 1)])
    here = np.unique(np.concatenate([np.unique(g) for g, _ in grams(bad)]))
    links = []
    for g, word in grams(np.arange(len(words))):
        at = np.minimum(np.searchsorted(here, g), len(here) - 1)
        known = here[at] == g
        links.append(np.unique(word[known] * np.int64(len(here)) + at[known]))
    link = np.concatenate(links)
    del links
    link.sort()
    l_word, l_gram = (link // len(here)).astype(np.int32), (link % len(here)).astype(np.int32)
    del link
    w_at = np.searchsorted(l_word, np.arange(len(words) + 1))
    seen = np.zeros((2, len(here)))
    kept = {}
    texts = np.flatnonzero(fit & (y == 1))
    row = np.full(len(y), -1, np.int64)
    row[texts] = np.arange(len(texts))
    for c in (0, 1):
        mine = fit[pair_text] & (y[pair_text] == c)
        t, w = pair_text[mine], pair_word[mine]
        for lo in range(0, len(t), 100_000):
            hi = min(len(t), lo + 100_000)
            # whole texts at a time
            while hi < len(t) and t[hi] == t[hi - 1]:
                hi += 1
            if lo and t[lo] == t[lo - 1]:
                lo += int(np.searchsorted(t[lo:hi], t[lo - 1], "right"))
            n = w_at[w[lo:hi] + 1] - w_at[w[lo:hi]]
            g = l_gram[np.repeat(w_at[w[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            both = np.unique(np.repeat(t[lo:hi], n) * np.int64(len(here)) + g)
            seen[c] += np.bincount(both % len(here), minlength=len(here))
            if c:
                kept[lo] = (row[both // len(here)].astype(np.int32), (both % len(here)).astype(np.int32))
    n0, n1 = (max(1, int((fit & (y == c)).sum())) for c in (0, 1))
    ratio = (seen[1] + 0.05) / n1 / ((seen[0] + 0.5) / n0)
    some = np.flatnonzero((seen[1] >= 2) & (ratio >= 4))
    some = some[np.argsort(-seen[1][some] * np.log(ratio[some]), kind="stable")][:6000]
    chosen, holds = [], np.zeros(len(words), bool)
    if not len(some):
        return [], holds
    number = np.full(len(here), -1, np.int64)
    number[some] = np.arange(len(some))
    marked = np.zeros((len(texts), len(some)), bool)
    for t, own in kept.values():
        g = number[own]
        marked[t[g >= 0], g[g >= 0]] = True
    kept.clear()
    worth = np.ones(len(texts), np.float32)
    least = max(1.5, 0.006 * len(texts))
    marked = marked.astype(np.float32)
    while len(chosen) < 80:
        reach = worth @ marked
        k = int(np.argmax(reach * np.log(ratio[some])))
        if reach[k] < least:
            break
        chosen.append(int(some[k]))
        worth[marked[:, k] > 0] *= 0.4
    holds[l_word[np.isin(l_gram, np.array(chosen, np.int64))]] = True
    letters = "?abcdefghijklmnopqrstuvwxyz"
    out = []
    for k in chosen:
        n, g, text = int(here[k] % 8), int(here[k] // 8), ""
        for j in range(n):
            c = g // ALPHABET ** (n - 1 - j) % ALPHABET
            text += letters[c] if c < 27 else ""
        out.append(text)
    return [x for x in out if x], holds


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Fit on labelled texts; with one class only, every text gets that class's side of 0.5."""
    y = np.asarray(toxic, np.int64)
    none = Model(np.zeros(ALPHABET**ORDER, np.float32), 0.0, np.zeros(N_FEATURES + 1))
    if not len(y) or y.min() == y.max():
        none.curve[-1] = -3.0 if not len(y) or not y.max() else 3.0
        return none
    words, back, text = _texts_to_strings(texts)
    if not words:
        none.curve[-1] = -3.0
        return none
    rng = np.random.default_rng(seed)
    fit = np.zeros(len(y), bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        fit[own[: max(1, len(own) * 7 // 10)]] = True
    pair = np.unique(text * np.int64(len(words)) + back)
    pair_text, pair_word = pair // len(words), pair % len(words)
    clean = np.unique(pair_word[fit[pair_text] & (y[pair_text] == 0)])
    in_clean = np.zeros(len(words), bool)
    in_clean[clean] = True
    stems, holds = _stems(words, pair_text, pair_word, fit, y)
    in_toxic = np.zeros(len(words), bool)
    in_toxic[pair_word[fit[pair_text] & (y[pair_text] == 1)]] = True
    rate = [np.bincount(pair_word[fit[pair_text] & (y[pair_text] == c)], minlength=len(words)) / max(1, int((fit & (y == c)).sum())) for c in (0, 1)]
    pos = np.flatnonzero(holds & in_toxic & (rate[1] > 4 * rate[0]))
    clean = clean[~np.isin(clean, pos)]
    if not len(pos):
        none.curve[-1] = -3.0
        return none
    often = np.bincount(pair_word[y[pair_text] == 1], minlength=len(words))
    pos = pos[np.argsort(-often[pos], kind="stable")][:6000]
    negative = set(rng.permutation(clean)[:4000].tolist())
    model = none
    for _ in range(4):
        neg = np.array(sorted(negative))
        # landmarks: the toxic stems and the commonest strings with them, and clean strings
        marks = (stems + [words[i] for i in pos])[: LANDMARKS * 3 // 4] + [words[i] for i in rng.permutation(neg)[: LANDMARKS // 4]]
        weights, bias = _fit_strings(marks, [words[i] for i in pos], [words[i] for i in neg])
        model = Model(weights, bias, np.zeros(N_FEATURES + 1))
        f = model.score_words(words)
        hard = clean[np.argsort(-f[clean])][:1500]
        if f[hard].max() < -0.9:
            break
        negative |= set(hard.tolist())
    x = text_features(model.score_words(words)[back], text, len(y))
    rest = ~fit if len(np.unique(y[~fit])) == 2 else np.ones(len(y), bool)
    model.curve = _logistic(x[rest], y[rest])
    return model


def _fit_strings(marks: list[str], pos: list[str], neg: list[str]) -> tuple[np.ndarray, float]:
    n_codes = ALPHABET**ORDER
    lookup = np.full(n_codes, -1, np.int32)
    own = []
    for word, codes, weight in features(marks):
        own.append((word, codes, weight))
    used = np.unique(np.concatenate([c.ravel() for _, c, _ in own]))
    lookup[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, len(marks)), np.float32)
    for word, codes, weight in own:
        np.add.at(table, (lookup[codes].ravel(), np.repeat(word, codes.shape[1])), np.tile(weight, len(word)))
    norm = np.sqrt((table**2).sum(axis=0))
    table /= np.maximum(norm, 1e-9)
    gram = table.T @ table
    val, vec = np.linalg.eigh(gram.astype(np.float64) + 1e-4 * np.eye(len(marks)))
    root = vec / np.sqrt(np.maximum(val, 1e-6)) @ vec.T

    def mapped(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(marks)), np.float32)
        for word, codes, weight in features(words):
            for lo in range(0, len(word), 256):
                got = np.einsum("ncm,c->nm", table[lookup[codes[lo : lo + 256]]], weight)
                np.maximum.at(out, word[lo : lo + 256], got)
        return out @ root

    x = np.vstack([mapped(pos), mapped(neg)])
    y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
    cost = np.where(y > 0, 10.0 * max(1.0, len(neg) / (4 * len(pos))), 10.0)
    w = _svm(x, y, cost)
    weights = np.zeros(n_codes, np.float32)
    weights[used] = table[:-1] @ (root @ w[:-1])
    return weights, float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the shift) of a logistic curve with a small penalty; targets are drawn in a little, as Platt does."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, 0.05), 1e-3]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        h = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(ridge), x.T @ (p - target) + ridge * w)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold_of(id_col: str = "doc_id"):
    """The fold of a document: crc32 of its id as text, mod 5; fold 0 is held out from training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_texts: int = TRAIN_TEXTS) -> Model:
    """Train on at most max_texts labelled texts of each class, drawn by a hash of the id, never on held-out ones."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of() != 0)).distinct()
    order = F.xxhash64(F.lit(11), "doc_id")
    some = None
    for c in (0, 1):
        part = known.where(F.col("y") == c).orderBy(order, "doc_id").limit(max_texts)
        some = part if some is None else some.union(part)
    # at most 2 * max_texts ids: a proven bound for the broadcast, and for the one task that trains
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "y")

    def learn(table: pa.Table) -> pa.Table:
        got = sorted(zip(table.column(0).to_pylist(), (t or "" for t in table.column(1).to_pylist()), table.column(2).to_pylist(), strict=True))
        model = train([t for _, t, _ in got], [c for _, _, c in got])
        used = np.flatnonzero(model.weights)
        release()
        return pa.table({"codes": pa.array([used.astype("<i4").tobytes()], pa.binary()), "weights": pa.array([model.weights[used].astype("<f4").tobytes()], pa.binary()), "bias": [float(model.bias)], "curve": pa.array([model.curve.astype("<f8").tobytes()], pa.binary())})

    found = rows.groupBy(F.lit("all")).applyInArrow(learn, "codes binary, weights binary, bias double, curve binary").collect()
    model = Model(np.zeros(ALPHABET**ORDER, np.float32), 0.0, np.r_[np.zeros(N_FEATURES), -3.0])
    for r in found:
        model.weights[np.frombuffer(r["codes"], "<i4")] = np.frombuffer(r["weights"], "<f4")
        model.bias, model.curve = r["bias"], np.frombuffer(r["curve"], "<f8").copy()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add a score (0 to 1) to a table as a column of another name than its own; a null or empty text is scored like one without any string."""
    if out_col in docs.columns:
        raise ValueError(f"the table has a column {out_col}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    cols = docs.columns

    def scan(batches):
        m = shared.value

        def code(data, starts, ends):
            got = m.score_words([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            return got, np.ones(len(got), np.int64)

        table = WordTable(code, np.float32)
        at = cols.index(text_col)
        for batch in batches:
            got = np.zeros(batch.num_rows)
            for lo, hi, data, offs in tb.chunks(batch.column(at)):
                s, e, text = strings(data, offs)
                f, _ = table(data, s, e)
                got[lo:hi] = m.probability(text_features(f, text, hi - lo))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*cols, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out_col}` double"
    return docs.mapInArrow(tidy(scan), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    A null or empty text is scored; a null id is not held out; rows with equal ids
    are scored each by its text; further columns are ignored. Without labels of both
    classes every text gets the same score.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(slim, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
