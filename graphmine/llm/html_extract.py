"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks in page order; a block ends where a block element begins or
ends. A logistic classifier of structure and text gives each block the cost of calling it
content and of calling it boilerplate: the capacities of its edges to the two terminals.
Blocks next to each other, and each block with the one before it below the same
parent, are tied by edges whose capacity falls with their distance in the tree. The minimum
cut, found by augmenting paths, labels the blocks; those on the content side, joined by
line feeds, are the text.

The classifier is trained on labelled pages that html_pages makes from a seed (TRAINING of them,
of all families but the held-out ones). Telling words in class and id names are among its
features; none decides alone.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import FAMILIES, HELD_OUT, labelled_pages

#: Labelled pages that the classifier is trained on, and the seed of their making.
TRAINING, SEED = 700, 17

# fixed values: element kinds of HTML, and words of class and id names that tell a region
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
SKIPPED = frozenset("head title script style noscript template textarea iframe object svg math canvas audio video select button".split())
#: What may stand in a head; the start of any other element ends it. What may stand in a drawing, formula or list of options, whose start of a block else ends it.
IN_HEAD = frozenset("html head title base link meta style script noscript template".split())
OPEN_TO_BLOCKS = {"svg": frozenset(), "math": frozenset(), "select": frozenset(["option", "optgroup", "hr"])}
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
TAG_KINDS = {"nav": 0, "menu": 0, "footer": 1, "aside": 2, "header": 3, "form": 4, "fieldset": 4, "search": 4, "dialog": 4}
HEADER_OF_ARTICLE = 1 << 7
BAD_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs captcha colophon comment comments commentlist consent cookie cookies copyright disclaimer disqus feedback foot footer form gdpr header headerbar legal links login masthead menu menubar meta modal nav navbar navigation newsletter notice pager pagination paywall popup privacy promo promoted promotion rail recommend recommended related reply replies respond search share sharing sidebar sidenav signin signup social sponsor sponsored subscribe tabs tags teaser toolbar topbar widget widgets alert complementary contentinfo discussion".split())
GOOD_WORDS = frozenset("article articlebody blog body content entry hentry main maincontent page post postbody posttext prose story text".split())
WHOLE = frozenset("html body article main".split())

_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WHITE = re.compile(r"\s+")


@dataclass
class Node:
    """An open element, with what it and its ancestors tell: kinds of elements (bits), named regions, whether inside article or main."""

    tag: str
    parent: int
    depth: int
    kinds: int = 0
    bad: int = 0
    faint: int = 0
    good: int = 0
    article: bool = False
    hidden: bool = False
    skip: bool = False
    link: bool = False


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text, characters within links) of each block
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _tag_end(text: str, pos: int, last: dict[str, int]) -> int:
    """The place of the > that ends a tag, -1 without one. A quote behind = holds a value up to the next such quote, if there is one; last: where each quote stands last."""
    while (m := _STOP.search(text, pos)) is not None:
        at = m.start()
        if m[0] == ">":
            return at
        before = at - 1
        while text[before].isspace():
            before -= 1
        pos = text.find(m[0], at + 1) + 1 if text[before] == "=" and at < last[m[0]] else at + 1
    return -1


def tokens(text: str):
    """Yield (text, None, None, end) for text and (None, tag, attributes, position) for tags, in linear time; an end tag has its name after a slash."""
    pos, end = 0, len(text)
    last = {q: text.rfind(q) for q in "\"'"}
    while pos < end:
        at = text.find("<", pos)
        if at < 0:
            yield text[pos:], None, None, end
            return
        if at > pos:
            yield text[pos:at], None, None, at
        nxt = text[at + 1 : at + 2]
        if text.startswith("<!--", at):
            stop = text.find("-->", at + 4)
            pos = stop + 3 if stop >= 0 else end
            continue
        if nxt in ("!", "?"):
            stop = text.find(">", at)
            pos = stop + 1 if stop >= 0 else end
            continue
        m = _NAME.match(text, at)
        if m is None:
            yield "<", None, None, at + 1
            pos = at + 1
            continue
        stop = _tag_end(text, m.end(), last)
        if stop < 0:
            yield text[at:], None, None, end
            return
        pos, name, attrs = stop + 1, m[0][1:].lower(), text[m.end() : stop]
        yield None, name, attrs, pos
        if name in RAW and not attrs.rstrip().endswith("/"):
            closed = _raw_end(name).search(text, pos)
            pos = closed.end() if closed else end
            yield None, "/" + name, "", pos


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![^\s/>])", re.I)


def _names(attrs: str) -> tuple[bool, bool, bool]:
    """Whether class, id or role name a bad region (a whole name, or its last part), hold a bad word elsewhere, or name a good one."""
    bad = faint = good = False
    for a in _ATTR.findall(attrs):
        for name in (a[0] or a[1] or a[2]).split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if not parts:
                continue
            told = parts[-1] in BAD_WORDS or "".join(parts) in BAD_WORDS
            bad |= told
            faint |= not told and any(p in BAD_WORDS for p in parts)
            good |= not told and any(p in GOOD_WORDS for p in parts)
    return bad, faint, good


def read(text: str) -> Page:
    """The elements and non-empty text blocks of a page; unclosed, misnested and stray tags are tolerated."""
    page = Page([Node("", -1, 0)])
    nodes, at = page.nodes, 0
    parts: list[str] = []
    linked = 0
    owner = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if joined:
                page.blocks.append((owner, joined, min(linked, len(joined))))
            parts.clear()
            linked = 0

    opened: dict[str, int] = {}
    ends: dict[str, int] = {}

    def shut(to: int) -> None:
        """Close all elements below the parent of one, and that."""
        nonlocal at
        while at != nodes[to].parent:
            opened[nodes[at].tag] -= 1
            at = nodes[at].parent

    def up_to(tag: str) -> int:
        to = at
        while nodes[to].tag != tag:
            to = nodes[to].parent
        return to

    def has_end(tag: str, place: int) -> bool:
        """Whether an end tag of that name comes later in the page."""
        if tag not in ends:
            ends[tag] = max((m.start() for m in _end_of(tag).finditer(text)), default=-1)
        return ends[tag] >= place

    for piece, tag, attrs, place in tokens(text):
        if tag is None:
            # text can't stand in a head itself
            if nodes[at].tag == "head" and piece.strip():
                shut(at)
            if not nodes[at].skip:
                if not parts:
                    owner = at
                    while nodes[owner].tag not in BLOCK and nodes[owner].parent >= 0:
                        owner = nodes[owner].parent
                parts.append(piece)
                if nodes[at].link:
                    linked += len(piece.strip())
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag in BLOCK:
                flush()
            if not opened.get(tag):
                continue
            to, crossed = at, False
            while nodes[to].tag != tag:
                crossed |= nodes[to].tag in BLOCK
                to = nodes[to].parent
            # an inline end tag doesn't close blocks
            if tag in BLOCK or not crossed or nodes[to].skip:
                shut(to)
            continue
        if opened.get("head") and tag not in IN_HEAD:
            shut(up_to("head"))
        if tag in BLOCK and nodes[at].skip:
            for name, inner in OPEN_TO_BLOCKS.items():
                if opened.get(name) and tag not in inner and not opened.get("foreignobject"):
                    shut(up_to(name))
        if tag in SKIPPED and tag != "head" and (attrs.rstrip().endswith("/") or not has_end(tag, place)) and tag not in RAW:
            continue  # closed at once, or never: it holds nothing
        if tag in BLOCK:
            flush()
            if tag in CLOSES:
                up = at
                while up > 0 and nodes[up].tag not in BLOCK:
                    up = nodes[up].parent
                if nodes[up].tag in CLOSES[tag] and up > 0:
                    shut(up)
        if tag == "br" and not nodes[at].skip and parts:
            parts.append(" ")
        if tag in VOID:
            continue
        up = nodes[at]
        node = Node(tag, at, up.depth + 1, up.kinds, up.bad, up.faint, up.good, up.article or tag in ("article", "main"), up.hidden, up.skip or tag in SKIPPED, up.link or tag == "a")
        kind = TAG_KINDS.get(tag)
        if kind is not None:
            # a header or footer of an article isn't the page's
            node.kinds |= 1 << (kind + 4 if up.article and kind in (1, 3) else kind)
        if attrs and "=" in attrs:
            bad, faint, good = _names(attrs)
            if tag in WHOLE:
                bad, faint = False, faint or bad
            node.bad, node.faint, node.good = up.bad + bad, up.faint + faint, up.good + good
        if attrs and not up.hidden and tag not in ("html", "body"):
            node.hidden = bool(_HIDDEN.search(attrs))
        nodes.append(node)
        at = len(nodes) - 1
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return page


_INNER = frozenset("p li ul ol h1 h2 h3 h4 h5 h6 blockquote figure figcaption pre dd dt".split())


def features(page: Page) -> np.ndarray:
    """A row for each block: its place in the page, names on the way to it, its text, and how its region stands to the richest one.

    A block's region is the nearest element around it that isn't part of running text. The richest region holds most text outside links, less so where
    names or element kinds speak against it.
    """
    nodes = page.nodes
    any_article = any(nodes[b[0]].article for b in page.blocks)
    inside: dict[int, list[int]] = {}
    titles: dict[int, int] = {}
    homes = []
    # an element comes after its parent
    region = list(range(len(nodes)))
    for i, n in enumerate(nodes):
        if n.tag in _INNER and n.parent > 0:
            region[i] = region[n.parent]
    for i, (node, text, linked) in enumerate(page.blocks):
        home = region[node]
        homes.append(home)
        got = inside.setdefault(home, [0, 0, 0])
        got[0] += len(text)
        got[1] += linked
        got[2] += 1
        if nodes[node].tag == "h1":
            titles.setdefault(home, i)
    total = sum(g[0] for g in inside.values()) or 1
    worth = {k: (g[0] - g[1]) * 0.3 ** (min(nodes[k].bad, 2) + 2 * nodes[k].hidden + (nodes[k].kinds & ~HEADER_OF_ARTICLE != 0)) for k, g in inside.items()}
    best = max(worth, key=lambda k: (worth[k], -k)) if worth else 0
    above, at = set(), best
    while at >= 0:
        above.add(at)
        at = nodes[at].parent
    within = [False] * len(nodes)
    for i in range(best, len(nodes)):
        within[i] = i == best or within[nodes[i].parent]
    first, last = (homes.index(best), len(homes) - 1 - homes[::-1].index(best)) if homes else (0, 0)
    title = min(titles.values()) if titles else -1
    rows = []
    for i, ((node, text, linked), home) in enumerate(zip(page.blocks, homes, strict=True)):
        n, (size, links, count) = nodes[node], inside[home]
        words = text.count(" ") + 1
        share = linked / len(text)
        bad, richest = min(n.bad, 2), home == best
        row = [1.0, n.article, any_article and not n.article, n.article and not n.bad and not n.hidden and not n.kinds & ~HEADER_OF_ARTICLE, *((n.kinds >> i & 1) for i in range(8)), bad, min(n.faint, 2), min(n.good, 2), n.hidden]
        row += [min(math.log1p(len(text)), 7) / 5, words < 4, len(text) > 150, text[-1] in ".!?:;\"'»…", share, share > 0.6, text[0] in "©|", min(text.count(","), 4) / 4, n.tag in ("h1", "h2"), n.tag in ("h3", "h4", "h5", "h6"), n.tag == "li"]
        row += [min(math.log1p(size), 9) / 5, links / size, size / total, min(count, 8) / 8, (size - links) / count / 200 if size - links < 200 * count else 1.0]
        row += [richest, within[home] and not richest, home in above and not richest, worth[home] / worth[best] if worth[best] else 0, i < first, i > last]
        row += [home in titles, i < title, bool(titles) and home not in titles, n.tag == "h1" and not n.bad, home in titles and not n.bad]
        row += [richest and not n.bad and not n.hidden, bad * n.article, bad * richest, nodes[home].link or (linked == len(text) and len(text) < 40)]
        rows.append([float(v) for v in row])
    return np.array(rows)


#: How much more a lost block of content weighs in the training than a kept one of boilerplate.
CONTENT = 2.0


def fit_weights(pages: list, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; a labelled block that the reader doesn't find, or finds twice, is left out."""
    xs, ys = [], []
    for text, labels in pages:
        page = read(text)
        known: dict[str, bool | None] = {}
        for block, label in labels:
            known[block] = label if block not in known or known[block] == label else None
        rows = features(page)
        for row, block in zip(rows, page.blocks, strict=True):
            if known.get(block[1]) is not None:
                xs.append(row)
                ys.append(known[block[1]])
    x, y = np.array(xs), np.array(ys, float)
    w, k = np.zeros(x.shape[1]), np.where(y > 0, CONTENT, 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (k * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (k * (y - p)) - ridge * w)
    return w


@functools.cache
def weights() -> np.ndarray:
    """The trained weights; the same in every process."""
    return fit_weights(labelled_pages(TRAINING, SEED, tuple(f for f in FAMILIES if f not in HELD_OUT)))


def _tie(nodes: list[Node], a: int, b: int) -> float:
    """Capacity between two blocks: falls by half with every step in the tree beyond siblings."""
    steps = 0
    while a != b and steps < 12:
        if nodes[a].depth >= nodes[b].depth:
            a = nodes[a].parent
        else:
            b = nodes[b].parent
        steps += 1
    return 1.2 * 0.5 ** max(0, steps - 2)


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut.

    source and sink are the terminal capacities, edges are undirected. Flow through one node is pushed
    first. Then each node with flow left sends it along shortest augmenting paths; what it
    reaches when no sink is left for it can never reach one later, and isn't visited again.
    """
    n = len(source)
    rest = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    eps = 1e-9
    cut_off = [False] * n
    for start in range(n):
        while rest[start] > eps and not cut_off[start]:
            before = {start: -1}
            queue, goal = deque([start]), -1
            while queue and goal < 0:
                i = queue.popleft()
                for j, c in near[i].items():
                    if c > eps and j not in before and not cut_off[j]:
                        before[j] = i
                        if rest[j] < -eps:
                            goal = j
                            break
                        queue.append(j)
            if goal < 0:
                for i in before:
                    cut_off[i] = True
                break
            flow, j = min(rest[start], -rest[goal]), goal
            while before[j] >= 0:
                flow = min(flow, near[before[j]][j])
                j = before[j]
            rest[start] -= flow
            rest[goal] += flow
            j = goal
            while before[j] >= 0:
                i = before[j]
                near[i][j] -= flow
                near[j][i] = near[j].get(i, 0.0) + flow
                j = i
    return cut_off


def extract(text: str | None, trained: np.ndarray | None = None) -> str:
    """The main text of a page; empty if there is none. trained: the weights, if they are at hand."""
    page = read(text or "")
    if not page.blocks:
        return ""
    trained = weights() if trained is None else trained
    source, sink, edges = [], [], []
    last: dict[int, int] = {}
    for i, (block, z) in enumerate(zip(page.blocks, (features(page) @ trained).tolist(), strict=True)):
        # -log of the probability of the other label
        source.append(math.log1p(math.exp(min(z, 30.0))))
        sink.append(math.log1p(math.exp(min(-z, 30.0))))
        if i:
            edges.append((i - 1, i, _tie(page.nodes, page.blocks[i - 1][0], block[0])))
        parent = page.nodes[block[0]].parent
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, 0.6))
        last[parent] = i
    keep = minimum_cut(source, sink, edges)
    return "\n".join(b[1] for b, k in zip(page.blocks, keep, strict=True) if k)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page gives an empty text; null or equal ids stay separate rows; a
    missing url column gives null; further columns are ignored.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    trained = weights()
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"))

    def scan(batches):
        for batch in batches:
            texts = [extract(h, trained) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
