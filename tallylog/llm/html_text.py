"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier gives each block a log-odds of being content, from its text, its place in the page and what the elements
around it say of themselves (names, roles, class words): all of these are features, none of them decides alone. The log-odds are the capacities to the two
terminals; neighbours in the page and in the element tree are joined by edges, the stronger the nearer their common ancestor. The minimum cut, found by max-flow,
labels all blocks of the page at once. A block whose own capacity exceeds all its edges is settled before; its edges then act as its neighbours' capacities,
which leaves the cut the same and most pages without a flow to push.

The classifier is trained here, on a bounded sample of pages: blocks in elements of plain meaning are its labelled rows. Each is learnt twice, once as it is and once
with all names and class words taken away, so that text and place must do where a page says nothing of itself. Only what is never part of an article stays out for good:
scripts, styles, forms and what is hidden.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, positional

#: Most pages to train the classifier on, chosen by a hash, and the most characters that such a page has.
SAMPLE_PAGES, SAMPLE_CHARS = 400, 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html head legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these ends an open one of those, unless a container lies between.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_HOLD = {"ul", "ol", "dl", "table", "select", "menu"}
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "html", "head", "body"}
_DEAD = {"head", "svg", "math", "object", "canvas", "audio", "video", "map", "form", "button", "select", "fieldset", "label", "dialog", "search"}
_ROLES_AGAINST = {"navigation", "banner", "contentinfo", "complementary", "menu", "menubar", "alert", "toolbar"}
_ROLES_DEAD = {"search", "form", "dialog", "alertdialog"}
_WORDS_AGAINST = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted nav navbar navigation menu menubar topbar breadcrumb breadcrumbs footer "
    "sidebar aside widget widgets related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices "
    "banner alert popup modal overlay newsletter subscribe subscription signup login toolbar pagination pager copyright disclaimer masthead skip outbrain taboola teaser teasers paywall announcement".split()
)
_WORDS_FOR = {"article", "content", "post", "entry", "story", "main", "body", "text", "articlebody", "maincontent"}
#: Class names that tell of the layout, not of the text in the element: has-sidebar, no-comments, comments-open.
_LAYOUT = re.compile(r"(?:has|no|with|without|hide|show)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_SENTENCE = re.compile(r"[.!?…][\"'”’)]*(?:\s|$)")
#: What a block's elements say of themselves, as features.
_SAYS = ("article", "nav", "footer", "aside", "header", "role", "against", "partly", "for")
_SAYS_AT = {k: i for i, k in enumerate(_SAYS)}
_TAGS = ("p", "li", "h", "div", "td")
#: Features: the text's and the place's, then the names'; the last says that the page has an article, and this block is outside it.
NAMES = ["bias", "length", "links", "sentences", "ends", "sign", "inside", "share", "late", "last", "siblings", *_TAGS, *_SAYS, "elsewhere"]
_PLAIN = 11
#: How strongly the classifier is held to its prior weights.
PULL = 0.02
#: Weights for a page set from which nothing can be learnt.
PRIOR = np.array([-2.2, 0.35, -3.5, 0.5, 0.3, -2.0, 1.6, 0.8, 0.0, -0.5, 0.3, 0.8, -0.2, 0.3, 0.0, 0.0, 3.0, -6.0, -6.0, -6.0, -5.0, -7.0, -8.0, -2.5, 1.2, -2.5])


class Block:
    __slots__ = ("text", "links", "tag", "says", "parent")

    def __init__(self, text, links, tag, says, parent):
        self.text, self.links, self.tag, self.says, self.parent = text, links, tag, says, parent


class _Element:
    __slots__ = ("tag", "up", "says", "link", "depth", "chars", "leaf")

    def __init__(self, tag, up, says, link):
        self.tag, self.up, self.says, self.link = tag, up, says, link
        self.depth = up.depth + 1 if up else 0
        self.chars, self.leaf = 0, False


def _class_words(value: str) -> tuple[float, bool]:
    """The greatest share of words against content in one class name or id, and whether some word speaks for it."""
    most, good = 0.0, False
    for name in value.split():
        if _LAYOUT.fullmatch(name):
            continue
        words = [w.lower() for w in _CAMEL.split(name) if w]
        if words:
            whole = name.lower() in _WORDS_AGAINST
            most = max(most, 1.0 if whole else sum(w in _WORDS_AGAINST for w in words) / len(words))
            good = good or any(w in _WORDS_FOR for w in words)
    return most, good


def _says(tag: str, attrs: str, up: _Element) -> list[float] | None:
    """What the elements down to this one say of the text in it: None for no text at all, else a value for each of ``_SAYS``."""
    if up.says is None or tag in _DEAD:
        return None
    own = tag in ("article", "main") and not up.says[0]
    if not attrs and not own and tag not in ("article", "main", "nav", "menu", "dir", "footer", "aside", "header"):
        return up.says
    says = list(up.says)

    def put(kind: str, value: float = 1.0) -> None:
        says[_SAYS_AT[kind]] = max(says[_SAYS_AT[kind]], value)

    if own:  # its wrappers' class words are of the layout
        says = [0.0 if k in ("against", "partly") else x for k, x in zip(_SAYS, says, strict=True)]
        put("article")
    elif tag in ("nav", "menu", "dir"):
        put("nav")
    elif tag in ("footer", "aside"):
        put(tag)
    elif tag == "header" and not up.says[0]:
        put("header")
    if attrs and tag not in ("html", "body"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                most, good = _class_words(value)
                if most and not own:
                    put("against" if most == 1 else "partly")
                if value.strip().lower() == "header" and not says[0] and tag[0] != "h":
                    put("header")
                if good:
                    put("for")
            elif name == "role":
                role = value.strip().lower()
                if role in _ROLES_DEAD:
                    return None
                if role in _ROLES_AGAINST:
                    put("role")
                if role in ("main", "article"):
                    put("article")
            elif name == "itemprop" and value.lower() == "articlebody":
                put("article")
            elif (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (name == "aria-hidden" and value.lower() == "true"):
                return None
        if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs):
            return None
    return says


def blocks_of(page: str) -> list[Block]:
    """All blocks of text of a page, in order; scripts, styles, comments and the head have none."""
    top = _Element("", None, [0.0] * len(_SAYS), False)
    at, out, parts, linked, pos, raw = top, [], [], 0, 0, None

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                box = at
                while box.tag not in _BLOCK and box.up:
                    box = box.up
                out.append(Block(text, min(1.0, linked / max(1, len(text))), box.tag, at.says, box))
                box.leaf, up = True, box
                while up:
                    up.chars, up = up.chars + len(text) - min(linked, len(text)), up.up
        parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if at.says is None or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if at.link:
            linked += len(text.strip())

    while pos < len(page):
        m = _TOKEN.search(page, pos)
        if not m:
            say(page[pos:])
            break
        say(page[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        block = tag in _BLOCK
        if closing:
            box = at
            while box.up and box.tag != tag and (block or box.tag not in _BLOCK):
                box = box.up
            if box.up and box.tag == tag:
                if block:
                    flush()
                at = box.up
            elif block:
                flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if tag == "br":
            say(" ")
            continue
        if block:
            flush()
            ends = _ENDS.get(tag)
            box = at
            while box.up:
                if (ends and box.tag in ends) or (box.tag == "p" and tag in _ENDS_P):
                    at = box.up
                elif box.tag in _HOLD or (box.tag in _BLOCK and box.tag != "p" and not ends):
                    break
                box = box.up
        if tag in _VOID:
            continue
        at = _Element(tag, at, _says(tag, attrs, at), at.link or tag == "a")
    flush()
    return out


def _main_box(blocks: list[Block]) -> _Element:
    """The deepest element with two thirds of the page's text outside links, of those that hold more than a block."""
    path: dict[int, _Element] = {}
    for b in blocks:
        box = b.parent
        while box and id(box) not in path:
            path[id(box)] = box
            box = box.up
    whole = max(x.chars for x in path.values())
    inner = [x for x in path.values() if 3 * x.chars >= 2 * whole and not (x.leaf and x.up)]
    return max(inner, key=lambda x: x.depth) if inner else max(path.values(), key=lambda x: -x.depth)


def features(blocks: list[Block]) -> np.ndarray:
    """A row of ``NAMES`` for each block."""
    rows, n = np.zeros((len(blocks), len(NAMES))), len(blocks)
    if not n:
        return rows
    box, total = _main_box(blocks), sum(len(b.text) for b in blocks)
    has_article = any(b.says[0] for b in blocks)
    inside = []
    for b in blocks:
        up = b.parent
        while up and up.depth > box.depth:
            up = up.up
        inside.append(up is box)
    around = max(1, sum(len(b.text) for b, x in zip(blocks, inside, strict=True) if x))
    last = max((i for i in range(n) if inside[i] and len(blocks[i].text) * 20 > around), default=n - 1)
    for i, b in enumerate(blocks):
        tag, text = "h" if re.fullmatch("h[1-6]", b.tag) else b.tag, b.text
        up = b.parent.up or b.parent
        rows[i, :_PLAIN] = (
            1, np.log1p(len(text)), b.links, min(4, len(_SENTENCE.findall(text))), text[-1] in ".!?…:\"'”’)", bool(re.match(r"[©®™]|\(c\)", text, re.I)),
            inside[i], len(text) / total, i > last, i == n - 1 and n > 1, up is box)
        if tag in _TAGS:
            rows[i, _PLAIN + _TAGS.index(tag)] = 1
        rows[i, -len(_SAYS) - 1 : -1] = b.says
        rows[i, -1] = has_article and not b.says[0]
    return rows


def _plain_meaning(b: Block) -> bool | None:
    """Whether a block's elements alone make it content (or not) beyond doubt."""
    says = dict(zip(_SAYS, b.says, strict=True))
    if any(says[k] for k in ("nav", "footer", "aside", "header", "role", "against")):
        return False
    return True if says["article"] and not says["partly"] else None


def train(pages: list[str]) -> np.ndarray:
    """Logistic weights, learnt from blocks whose elements are of plain meaning; the prior ones where one of the classes is missing."""
    x, y = [], []
    for page in pages:
        blocks = blocks_of(page)
        known = [_plain_meaning(b) for b in blocks]
        at = [i for i, k in enumerate(known) if k is not None]
        if at:
            x.append(features(blocks)[at])
            y.extend(known[i] for i in at)
    y = np.array(y, dtype=float)
    if not len(y) or y.min() == y.max():
        return PRIOR
    x = np.concatenate(x)
    bare = x.copy()
    bare[:, _PLAIN:] = 0
    bare[:, _PLAIN + _TAGS.index("div")] = 1
    x, y, w = np.concatenate([x, bare]), np.concatenate([y, y]), PRIOR.copy()
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(v: np.ndarray) -> float:
        z = np.where(y > 0, x @ v, -(x @ v))
        return float((weight * np.logaddexp(0, -z)).mean() + PULL / 2 * ((v - PRIOR) ** 2).sum())

    for _ in range(25):  # Newton steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) / len(y) + PULL * (w - PRIOR)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + PULL * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w


def _proximity(a: Block, b: Block) -> float:
    """Weight of the edge between two blocks: by the steps to their common ancestor. A heading goes with what follows it in its element."""
    x, y, steps = a.parent, b.parent, 0
    if x.up is y.up and re.fullmatch("h[1-6]", a.tag):
        return 1.6
    while x is not y and steps < 6:
        if x.depth >= y.depth:
            x = x.up
        else:
            y = y.up
        steps += 1
    return 1.6 / (1 + steps) if x is y else 0.15


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of |odds| of blocks labelled against their sign, plus the weights of edges between unlike labels. Zero odds without edges: not content."""
    n = len(odds)
    odds, label = list(odds), [None] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    free = [sum(w for _, w in near[i]) for i in range(n)]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) >= free[i]:
            label[i] = odds[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    odds[j] += w if label[i] else -w
                    free[j] -= w
                    todo.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if not open_:
        return label
    # Max-flow by shortest augmenting paths among the open blocks; s and t are -1 and -2.
    cap: dict[int, dict[int, float]] = {i: {} for i in [*open_, -1, -2]}
    for i in open_:
        cap[-1][i], cap[i][-1] = max(odds[i], 0.0), 0.0
        cap[i][-2], cap[-2][i] = max(-odds[i], 0.0), 0.0
        for j, w in near[i]:
            if label[j] is None:
                cap[i][j] = cap[i].get(j, 0.0) + w
    while True:
        came, queue = {-1: None}, deque([-1])
        while queue and -2 not in came:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if -2 not in came:
            break
        path, j = [], -2
        while came[j] is not None:
            path.append((came[j], j))
            j = came[j]
        flow = min(cap[i][j] for i, j in path)
        for i, j in path:
            cap[i][j] -= flow
            cap[j][i] += flow
    for i in open_:
        label[i] = i in came
    return label


def page_graph(blocks: list[Block], weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds of the blocks, and the edges between them."""
    odds = (features(blocks) @ weights).tolist()
    edges = [(i, i + 1, _proximity(blocks[i], blocks[i + 1])) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}  # blocks of the same element that aren't next to each other
    for i, b in enumerate(blocks):
        box = id(b.parent.up)
        if box in last and last[box] < i - 1:
            edges.append((last[box], i, 0.4))
        last[box] = i
    return odds, edges


def label_blocks(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    return min_cut(*page_graph(blocks, weights)) if blocks else []


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """Content blocks joined by line feeds. Empty for null, for an empty page, and for one that has no content."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, weights), strict=True) if keep)


def sample_pages(df: DataFrame, html_col: str, most: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """At most ``most`` whole pages of at most ``chars`` characters, by a hash of the page: a count, then a threshold, so that no task sends more than its share."""
    pages = df.where(F.length(html_col).between(1, chars)).select(F.col(html_col).alias("h"))
    n = pages.count()
    if not n:
        return []
    luck = F.abs(F.xxhash64("h", F.lit("html"))) / F.lit(float(1 << 63))
    return [r["h"] for r in pages.where(luck < min(1.0, most / n)).distinct().limit(most).collect()]


def extract(df: DataFrame, html_col: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``df`` without its HTML, with the main text and its length in code points.

    One row out per row in, repeated ones as well. A null or empty page has an empty text. ``df``'s other columns stay as they are; where one has the name of a
    new column, the new one gets leading underscores. An empty input gives no rows.
    """
    own = df.columns
    kept = df.drop(html_col)
    text_out, n_out = fresh(kept, text, n_chars)
    df, html_col = positional(df, html_col)
    weights = train(sorted(sample_pages(df, html_col)))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda p: main_text(p, weights), na_action=None)

    done = df.withColumn("_main", run(F.col(html_col)))
    names = {f"c{i}": c for i, c in enumerate(own) if f"c{i}" != html_col}
    return done.select(*[F.col(k).alias(c) for k, c in names.items()], F.col("_main").alias(text_out), F.length("_main").cast("long").alias(n_out))


def op7_min_cut(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
