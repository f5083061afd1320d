"""Secret scan: three fixed patterns, and a character convolutional network over every candidate.

A candidate is a maximal run of 12 or more characters of A-Z, a-z, 0-9 and +/_.=-, wherever
it stands, also where a pattern matches in it. The network sees it (a long one through
windows that overlap, of which the likeliest counts) with the text on both sides: one-hot characters, a convolution, maxima and means over the
left context, the candidate and the right context, a hidden layer. It is trained on
labelled findings that `labelled_findings` makes from a seed: published formats of
keys and tokens among words, against addresses, numbers, versions, paths, identifiers
and long words. The threshold is the highest that keeps the asked recall on findings
that the training did not see, on calibrated probabilities.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .shared import tidy

KINDS = ("assign", "access", "hex", "model")
# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

CANDIDATE_LEAST = 12
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True

LEFT, BODY, RIGHT = 16, 48, 6
STRIDE = 16
#: Windows that are scored at once.
BLOCK = 8192
WIDTH, FILTERS, HIDDEN, CODES = 5, 24, 24, 99
_CODE = np.full(256, 97, np.int64)  # other bytes
_CODE[32:127] = np.arange(1, 96)
_CODE[[9, 10, 13]] = 96
PAD = 0


def windows(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the windows of each run s:e: itself up to BODY characters, else pieces of BODY, STRIDE apart, the last at its end."""
    more = np.maximum(0, -(-(e - s - BODY) // STRIDE))
    run = np.repeat(np.arange(len(s)), more + 1)
    k = np.arange(len(run)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    start = np.minimum(s[run] + k * STRIDE, np.maximum(s, e - BODY)[run])
    return run, start, np.minimum(start + BODY, e[run])


def codes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of the windows data[start:end] of the texts data[lo:hi], and of their surroundings."""
    at = np.concatenate([start[:, None] + np.arange(-LEFT, BODY), end[:, None] + np.arange(RIGHT)], axis=1)
    least = np.concatenate([np.repeat(lo[:, None], LEFT, 1), np.repeat(start[:, None], BODY, 1), np.repeat(end[:, None], RIGHT, 1)], axis=1)
    most = np.concatenate([np.repeat(start[:, None], LEFT, 1), np.repeat(end[:, None], BODY, 1), np.repeat(hi[:, None], RIGHT, 1)], axis=1)
    inside = (at >= least) & (at < most)
    return np.where(inside, _CODE[data[np.where(inside, at, 0)]], PAD)


_AREAS = ((0, LEFT), (LEFT, LEFT + BODY), (LEFT + BODY, LEFT + BODY + RIGHT))


@dataclass
class Network:
    table: np.ndarray  # WIDTH x CODES x FILTERS
    shift: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    bias: float = 0.0
    threshold: float = 0.5

    def _forward(self, x: np.ndarray):
        half = WIDTH // 2
        padded = np.pad(x, ((0, 0), (half, half)), constant_values=PAD)
        conv = self.shift + sum(self.table[j][padded[:, j : j + x.shape[1]]] for j in range(WIDTH))
        act = np.maximum(conv, 0)
        pools, arg = [], []
        for a, b in _AREAS:
            part = act[:, a:b]
            arg.append(part.argmax(axis=1) + a)
            pools += [part.max(axis=1), part.mean(axis=1)]
        pooled = np.concatenate(pools, axis=1)
        hid = np.maximum(pooled @ self.w1 + self.b1, 0)
        return padded, conv, arg, pooled, hid, hid @ self.w2 + self.b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.float32)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.bias, -60, 60)))


def labelled_findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """n labelled findings (text before, value, text after, 1 if it is a secret), half of each label; a value may stand within a longer run."""
    rng = np.random.default_rng(seed)
    syllables = ["an", "the", "re", "on", "ti", "en", "er", "st", "ou", "cion", "mente", "que", "ung", "lich", "keit", "ment", "eau", "os", "ver", "ing", "ly", "la", "do", "ar"]
    syllables = [*syllables, "ble", "wh", "nd", "ed", "her", "zu", "ich", "aux"] * 20
    syllables += [c + v + z for c in ("b", "ch", "d", "f", "g", "gr", "h", "k", "l", "m", "n", "pf", "qu", "r", "sch", "st", "t", "th", "tr", "v", "w", "z") for v in ("a", "e", "i", "o", "u", "ie", "eau") for z in ("", "n", "r", "s", "ch", "ft", "ld", "nd", "ng", "ns", "pf", "sch", "th", "tz", "ux", "x")]
    syllables += ["sch", "tz", "pf", "th", "ch", "ndr", "bl"] * 6
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexa, alnum = digits + "abcdef", lower + lower.upper() + digits

    def draw(chars: str, k: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), k))

    def pick(*options: str) -> str:
        return options[int(rng.integers(0, len(options)))]

    def word(least: int = 1, most: int = 4) -> str:
        return "".join(pick(*syllables) for _ in range(rng.integers(least, most + 1)))

    def words(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def secret() -> tuple[str, str]:
        k = int(rng.integers(0, 16))
        value = [
            lambda: draw(hexa, pick_n(32, 40, 64)), lambda: draw(alnum, int(rng.integers(20, 49))), lambda: draw(alnum + "+/", int(rng.integers(24, 60))) + pick("", "=", "=="),
            lambda: "ghp_" + draw(alnum, 36), lambda: pick("xoxb-", "xoxp-") + draw(digits, 11) + "-" + draw(alnum, 24), lambda: "AIza" + draw(alnum + "_-", 35),
            lambda: "sk_live_" + draw(alnum, 24), lambda: "eyJ" + draw(alnum, 30) + "." + draw(alnum + "_-", 40) + "." + draw(alnum + "_-", 30), lambda: "AKIA" + draw(lower.upper() + digits, 16),
            lambda: "glpat-" + draw(alnum + "_-", 20), lambda: draw(hexa.upper(), 32), lambda: "SG." + draw(alnum + "_-", 22) + "." + draw(alnum + "_-", 43),
            lambda: draw(alnum[:52], int(rng.integers(20, 49))), lambda: draw(hexa, 32) + "-" + draw(hexa, 8) + "-" + draw(hexa, 8), lambda: pick("key-", "sk-", "pk_") + draw(hexa, pick_n(16, 24, 32)), lambda: draw(alnum, int(rng.integers(12, 20))),
        ][k]()
        name = pick("token", "secret", "api key", "Authorization", "auth", "key", "password", "credential", "client_secret", "access", "")
        lead = pick(f"{name} = ", f"{name}: ", f'"{name}": "', f"{name} ", f"--{name} ", "") if name else ""
        return lead, value

    def pick_n(*options: int) -> int:
        return options[int(rng.integers(0, len(options)))]

    def cased(text: str) -> str:
        return pick(text, text, text.capitalize(), text.upper())

    def around(value: str) -> tuple[str, str]:
        """What may stand before and after a value in the same run."""
        way = "/".join(word() for _ in range(rng.integers(1, 12)))
        return [lambda: (f"{word()}=", f".{word()}={word()}"), lambda: (way + "/", f"/{word()}.html"), lambda: (f"/{way}/{word()}=", ""), lambda: (f"{word()}={word()}.token=", f".{way}")][int(rng.integers(0, 4))]()

    def benign() -> tuple[str, str]:
        k = int(rng.integers(0, 20))
        value = [
            lambda: ".".join(str(x) for x in rng.integers(10, 256, 4)) + pick("", "/24", ".in-addr.arpa"), lambda: draw(digits, int(rng.integers(14, 20))), lambda: "-".join(draw(digits, 4) for _ in range(4)),
            lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}", lambda: "/".join(word() for _ in range(4)) + f"/{rng.integers(1, 999)}.html", lambda: word(2, 4) + "." + word(2, 3) + f"{rng.integers(1, 999)}.example.com",
            lambda: "_".join(word() for _ in range(3)) + f"_{rng.integers(1, 99)}", lambda: word(3, 6) + str(rng.integers(1, 9999)), lambda: "v" + ".".join(str(x) for x in rng.integers(0, 30, 3)) + "-" + word(2, 3) + "." + str(rng.integers(1, 9)),
            lambda: "-" * int(rng.integers(8, 20)) + str(rng.integers(1, 999)) + "-" * 8, lambda: "+" + draw(digits, 2) + "-" + draw(digits, 3) + "-" + draw(digits, 4) + "-" + draw(digits, 4), lambda: "".join(word(1, 2).capitalize() for _ in range(4)) + str(rng.integers(1, 99)),
            lambda: "-".join(word(1, 2) for _ in range(4)) + "-" + str(rng.integers(1, 9999)),
            lambda: cased(word(4, 8)), lambda: cased(word(4, 7)) + pick(".", "-", "="), lambda: cased(word(2, 5)) + pick("-", ".", "...", "--") + cased(word(2, 5)), lambda: pick("-", "=", "_", ".") * int(rng.integers(12, 60)),
            lambda: "/".join(cased(word()) for _ in range(rng.integers(4, 20))), lambda: pick("&", ".", "/").replace("&", ".").join(f"{word()}={word()}" for _ in range(rng.integers(2, 9))), lambda: cased(word(4, 8)),
        ][k]()
        if len(value) < CANDIDATE_LEAST:
            value += "." + word(4, 5) + word(4, 5)
        return pick("", "", "at ", "no. ", "see ", "from ", "is "), value

    out = []
    for i in range(n):
        lead, value = secret() if i % 2 else benign()
        mark = pick("", "", "### ", "$$$ ", "%%% ", "(")
        ahead, behind = around(value) if rng.integers(0, 5) == 0 else ("", "")
        out.append((words(int(rng.integers(0, 6))) + pick(" ", "\n", ". ") + mark + lead + ahead, value, behind + pick("", " ", ".", '"', "\n", "###", ")") + words(int(rng.integers(0, 3))), i % 2))
    return out


def _windows_of(findings: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, label, finding) of each window of the findings' runs; one that holds part of a secret, but less than 16 characters of it, is left out."""
    rows, label, owner = [], [], []
    for n, (before, value, after, secret) in enumerate(findings):
        a, b, c = before.encode(), value.encode(), after.encode()
        data = np.frombuffer(a + b + c, np.uint8)
        s, e = _runs(_TOKEN[data], np.array([0, len(data)]), 1)
        own = np.flatnonzero((s < len(a) + len(b)) & (e > len(a)))
        _, start, end = windows(s[own], e[own])
        shared = np.minimum(end, len(a) + len(b)) - np.maximum(start, len(a))
        keep = (shared >= min(16, len(b))) | (shared <= 0) if secret else np.ones(len(start), bool)
        rows.append(codes(data, np.zeros(len(start), np.int64), np.full(len(start), len(data)), start, end)[keep])
        label.append(((shared > 0) & bool(secret)).astype(np.int64)[keep])
        owner.append(np.full(int(keep.sum()), n))
    return np.concatenate(rows), np.concatenate(label), np.concatenate(owner)


def _examples(findings: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    return _windows_of(findings)[:2]


def train(n: int = 3000, epochs: int = 4, recall: float = 0.99, seed: int = 17) -> Network:
    """Fit on n findings; calibrate, and set the threshold that keeps `recall`, on a third as many others."""
    rng = np.random.default_rng(seed)
    x, y = _examples(labelled_findings(n, seed))
    f32 = np.float32
    areas = 2 * len(_AREAS) * FILTERS
    net = Network(rng.normal(0, 0.2, (WIDTH, CODES, FILTERS)).astype(f32), np.zeros(FILTERS, f32), rng.normal(0, areas**-0.5, (areas, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32), rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(f32), 0.0)
    params = ["table", "shift", "w1", "b1", "w2", "b2"]
    m = {p: np.zeros_like(np.asarray(getattr(net, p), np.float64)) for p in params}
    v = {p: np.zeros_like(m[p]) for p in params}
    step = 0
    eye = np.eye(CODES, dtype=f32)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            xb, yb = x[order[at : at + 64]], y[order[at : at + 64]]
            padded, conv, arg, pooled, hid, z = net._forward(xb)
            dz = ((1 / (1 + np.exp(-z)) - yb) / len(yb)).astype(f32)
            g = {"w2": hid.T @ dz, "b2": dz.sum()}
            dh = np.outer(dz, net.w2) * (hid > 0)
            g["w1"], g["b1"] = pooled.T @ dh, dh.sum(axis=0)
            dp = dh @ net.w1.T
            da = np.zeros_like(conv)
            row, col = np.arange(len(xb))[:, None], np.arange(FILTERS)[None]
            for i, (a, b) in enumerate(_AREAS):
                da[:, a:b] += (dp[:, (2 * i + 1) * FILTERS : (2 * i + 2) * FILTERS] / (b - a))[:, None]
                np.add.at(da, (row, arg[i], col), dp[:, 2 * i * FILTERS : (2 * i + 1) * FILTERS])
            da *= conv > 0
            g["shift"] = da.sum(axis=(0, 1))
            flat = da.reshape(-1, FILTERS)
            g["table"] = np.stack([eye[padded[:, j : j + x.shape[1]].ravel()].T @ flat for j in range(WIDTH)])
            step += 1
            for p in params:
                m[p] = 0.9 * m[p] + 0.1 * g[p]
                v[p] = 0.999 * v[p] + 0.001 * np.square(g[p])
                change = 0.004 * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8)
                setattr(net, p, getattr(net, p) - (float(change) if p == "b2" else change.astype(f32)))
    held = labelled_findings(n // 3, seed + 1)
    xv, _, owner = _windows_of(held)
    yv = np.array([f[3] for f in held])
    z = np.full(len(held), -np.inf)
    np.maximum.at(z, owner, net.logits(xv).astype(np.float64))
    for _ in range(50):  # Platt's curve by Newton steps
        p = 1 / (1 + np.exp(-np.clip(net.slope * z + net.bias, -60, 60)))
        t = np.where(yv == 1, (yv.sum() + 1) / (yv.sum() + 2), 1 / (len(yv) - yv.sum() + 2))
        h = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - t) * z).sum() + 1e-3 * net.slope, (p - t).sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum()]])
        move = np.linalg.solve(hess, grad)
        net.slope, net.bias = net.slope - np.clip(move[0], -1, 1), net.bias - np.clip(move[1], -1, 1)
    found = np.zeros(len(held))
    np.maximum.at(found, owner, net.probability(xv))
    own = np.sort(found[yv == 1])
    net.threshold = float(own[int((1 - recall) * len(own))])
    return net


def _runs(mask: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least `least` true bytes within a text."""
    if not len(mask):
        none = np.zeros(0, np.int64)
        return none, none
    edge = np.zeros(len(mask) + 1, bool)
    edge[offs] = True
    before, after = np.append(False, mask[:-1]) & ~edge[:-1], np.append(mask[1:], False) & ~edge[1:]
    s, e = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    long = e - s >= least
    return s[long], e[long]


def find(data: np.ndarray, offs: np.ndarray, net: Network) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind, end) in code points, sorted; kind is a place in KINDS."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
    begun = (data & 0xC0) != 0x80
    point = np.concatenate([[0], np.cumsum(begun)])
    base = point[offs]
    text_of = lambda at: np.searchsorted(offs, at, "right") - 1

    def add(kind: int, s: np.ndarray, e: np.ndarray) -> None:
        t = text_of(s)
        for i, a, b in zip(t.tolist(), (point[s] - base[t]).tolist(), (point[e] - base[t]).tolist(), strict=True):
            out[i].append((a, kind, b))

    s, e = _runs(_HEX[data], offs, HEX_LEAST)
    add(2, s, e)
    raw = data.tobytes()
    low = tb.LOWER[data].tobytes()
    for kind, hints, where in ((0, [k.encode() for k in KEYWORDS], low), (1, [b"AKIA"], raw)):
        texts = set()
        for hint in hints:
            at = where.find(hint)
            while at >= 0:
                i = int(text_of(at))
                texts.add(i)
                # the next text: one hit tells that this one must be read
                at = where.find(hint, int(offs[i + 1]))
        for i in sorted(texts):
            text = raw[offs[i] : offs[i + 1]].decode()
            for match in (ASSIGN if kind == 0 else ACCESS).finditer(text):
                a, b = match.span()
                if (len(match[2]) if kind == 0 else b - a) >= (ASSIGN_LEAST if kind == 0 else ACCESS_LEAST):
                    out[i].append((a, kind, b))
    s, e = _runs(_TOKEN[data], offs, CANDIDATE_LEAST)
    t = text_of(s)
    run, start, end = windows(s, e)
    best = np.zeros(len(s))
    for lo in range(0, len(run), BLOCK):
        r, a, b = run[lo : lo + BLOCK], start[lo : lo + BLOCK], end[lo : lo + BLOCK]
        np.maximum.at(best, r, net.probability(codes(data, offs[t[r]], offs[t[r] + 1], a, b)))
    hit = best >= net.threshold
    add(3, s[hit], e[hit])
    for spans in out:
        spans.sort()
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets_report(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row doc_id, n_assign, n_access, n_hex, n_model, base_sha256 and spans (kind:start:end, code points).

    A null or empty text has none; rows with equal or null ids stay separate;
    further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or train())  # weights of a fixed size

    def scan(batches):
        for batch in batches:
            for lo, hi, data, offs in tb.chunks(batch.column(1)):
                found = find(data, offs, shared.value)
                counts = np.array([[sum(k == kind for _, k, _ in spans) for kind in range(4)] for spans in found], np.int64).reshape(-1, 4)
                digest = [hashlib.sha256(_joined([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(counts[:, i]) for i in range(4)), pa.array(digest), pa.array([_joined(x) for x in found])], ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")


def redact(docs: DataFrame, net: Network | None = None, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The same table with each secret, or group of overlapping ones, replaced by a mark; texts without one, and nulls, stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net or train())
    cols = docs.columns
    at = cols.index(text_col)

    def scan(batches):
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            texts = None
            for lo, _, data, offs in tb.chunks(batch.column(at)):
                for i, spans in enumerate(find(data, offs, shared.value)):
                    if spans:
                        texts = texts or batch.column(at).to_pylist()
                        text, out, done = texts[lo + i], [], 0
                        for a, _, b in spans:
                            if a >= done:
                                out += [text[done:a], mark]
                            done = max(done, b)
                        texts[lo + i] = "".join([*out, text[done:]])
            columns = list(batch.columns)
            if texts is not None:
                columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, cols)

    return docs.mapInArrow(tidy(scan), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
