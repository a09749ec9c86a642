"""Main text of web pages by minimum-cut labelling of text blocks.

A classifier gives every block its odds of being content, from what its elements and its
text look like; their logarithm is the block's capacity to one of the two terminals. Blocks
that follow each other, and blocks of one container, are joined by edges whose capacity
grows with their proximity in the document tree. The minimum cut, found by blocking flows
along shortest paths, separates content from boilerplate at the least total cost.

The classifier is a logistic one, fitted to a bounded sample of the pages at hand: blocks
inside an article or main element are taken for content, blocks inside elements or names of
boilerplate are not, and others teach nothing. Half of the rows hide what their label came
from, so that text and tags are weighed too. Weights are drawn to ``PRIOR``, which is what
stays where the sample has nothing to say.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, with_computed
from .html_blocks import Block, Element, read

#: Pages of the sample, and the most characters of one of them.
SAMPLE_PAGES, SAMPLE_CHARS = 400, 200_000
#: Prior log-odds of being content that each property of a block adds.
PRIOR = {
    "any": 0.0, "article": 2.6, "main": 2.0, "boiler element": -9.0, "boiler name": -2.8, "content name": 0.8,
    "p": 0.6, "h1": 0.7, "h2": 0.4, "h3": 0.3, "blockquote": 0.4, "pre": 0.4, "td": 0.05, "li": -0.1, "figcaption": 0.2,
    "length": 1.0, "marks": 0.6, "linked": -2.2, "short": -0.2, "outside": -2.6,
}
_AT = {name: k for k, name in enumerate(PRIOR)}
#: What labels of the sample come from.
_TOLD = [_AT[x] for x in ("article", "main", "boiler element", "boiler name")]
#: Characters of an article, or of the main element, from which on what is outside of them counts as that; never learnt.
ARTICLE = 200
#: How strongly weights are drawn to the prior, beside the mean loss of a block.
PULL, STEPS = 0.02, 300
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
#: Whole class names, ids and roles that name boilerplate: its words, alone or with words of place and shape.
_WORD = r"(?:nav(?:bar|igation)?|menu|breadcrumbs?|footer|header|masthead|sidebar|side|aside|ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|replies|reply|disqus|respond|widget|toolbar|copyright|legal|skip|pagination|pager|search|contentinfo|complementary)\d*"
_PLACE = r"(?:site|global|top|bottom|left|right|main|primary|secondary|box|bar|list|links?|container|wrap|wrapper|section|area|block|inner|outer|\d+)"
BOILER_NAMES = re.compile(rf"(?<!\S)(?:{_PLACE}[_-]+)*{_WORD}(?:[_-]+(?:{_WORD}|{_PLACE}))*(?!\S)", re.I)
#: Parts of them that name content.
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|main|story|post|entry|body|text)(?=$|[\s_-]|\d)", re.I)
#: Capacities are whole numbers, so cuts are exact: ``UNIT`` for one of log-odds, up to ``MOST``.
UNIT, MOST = 100, 2000
#: Capacity between neighbours that share a container's block, and between the blocks of a container.
NEXT, NEAR = 24, 40


def _names(e: Element) -> str:
    a = e.attributes
    return " ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""))).strip() if a else ""


_KINDS = Memory(lambda names: (bool(BOILER_NAMES.search(names)), bool(CONTENT_NAMES.search(names))), 20_000)


def wrappers(blocks: list[Block]) -> set[int]:
    """Numbers of the elements that hold an article or the main element."""
    out: set[int] = set()
    for b in blocks:
        inner = max((k for k, e in enumerate(b.path) if e.tag in ("article", "main")), default=0)
        out.update(e.number for e in b.path[:inner])
    return out


def _inside(block: Block) -> bool:
    return any(e.tag in ("article", "main") for e in block.path)


def properties(block: Block, wrapping: Collection[int] = (), apart: bool = False) -> list[float]:
    """How much the block has of each property of ``PRIOR``; ``apart``: its page has an article that it is not in.

    An element of boilerplate's kind counts unless it is among the ``wrapping`` ones. A name
    of boilerplate, or such an element around an article, counts for what is inside it and
    makes what is around it count no more; an article inside halves that and the main
    element ends it, as the name is then of the layout around them.
    """
    has = [0.0] * len(PRIOR)
    named = boiler = 0.0
    inside = False
    for e in block.path:
        names = _names(e)
        if e.tag in ("article", "main"):
            inside = True
            named = named / 2 if e.tag == "article" else 0.0
        if e.tag in BOILER_TAGS or e.tag == "header" and not inside:
            if e.number not in wrapping:
                boiler = 1.0
            elif e.tag in ("nav", "footer", "aside", "menu"):
                has, named = [0.0] * len(PRIOR), named + 1
        elif names:
            bad, good = _KINDS[names]
            if bad and e.tag not in ("html", "body", "article", "main"):
                has, named = [0.0] * len(PRIOR), named + 1
            elif good:
                has[_AT["content name"]] += 1
        at = _AT.get(e.tag)
        if at is not None:
            has[at] += 1
    text = block.text
    n = len(text)
    has[_AT["any"]], has[_AT["boiler element"]], has[_AT["boiler name"]] = 1.0, boiler, named
    has[_AT["length"]] = min(n, 300) / 300
    has[_AT["marks"]] = min(10, sum(map(text.count, ".,;:!?"))) / 10
    has[_AT["linked"]] = 0.0 if inside and not boiler else block.linked / max(1, n)  # an article's links are its own
    has[_AT["outside"]] = float(apart and not inside and not has[_AT["h1"]])  # titles may stand before their article
    has[_AT["short"]] = float(n < 25)
    return has


def page_blocks(page: str) -> tuple[list[Block], np.ndarray]:
    """A page's blocks and their properties."""
    blocks = [b for b in read(page) if isinstance(b, Block)]
    wrapping = wrappers(blocks)
    apart = sum(len(b.text) for b in blocks if _inside(b)) >= ARTICLE
    return blocks, np.array([properties(b, wrapping, apart) for b in blocks], np.float64).reshape(-1, len(PRIOR))


def fit(pages: Iterable[str]) -> np.ndarray:
    """Weights of the properties, from the sample's own structure."""
    prior = np.array(list(PRIOR.values()))
    x = np.concatenate([np.zeros((0, len(PRIOR))), *[page_blocks(p)[1] for p in pages]])
    article, main, element, name = x[:, _TOLD].T
    out = (element > 0) | (name >= 1)
    inside = (article + main > 0) & (element == 0) & (name < 1)
    x, y = x[out | inside], inside[out | inside].astype(float)
    if not len(y) or y.min() == y.max():
        return prior
    hidden = x.copy()
    hidden[:, _TOLD] = 0
    x, y = np.concatenate([x, hidden]), np.concatenate([y, y])
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, rate = prior.copy(), 4 / (float((share @ x**2).sum()) + 4 * PULL)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (share * (p - y)) + PULL * (w - prior))
        w[_AT["outside"]] = prior[_AT["outside"]]
    return w


def capacities(has: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
    """Capacities of blocks from the content terminal and to the boilerplate terminal."""
    odds = np.clip(np.rint(UNIT * (has @ weights)), -MOST, MOST).astype(int).tolist()
    return [(max(0, z), max(0, -z)) for z in odds]


def edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """``(i, j, capacity)`` of smoothness edges: neighbours, and the next block of a container."""
    out = []
    latest: dict[int, int] = {}
    for j, b in enumerate(blocks):
        if j:
            a = blocks[j - 1].path
            common = 0
            for x, y in zip(a, b.path):
                if x.number != y.number:
                    break
                common += 1
            apart = len(a) + len(b.path) - 2 * common
            out.append((j - 1, j, max(1, NEXT // (1 + apart))))
        holder = b.path[-2].number if len(b.path) > 1 else 0
        if holder in latest:
            out.append((latest[holder], j, NEAR))
        latest[holder] = j
    return out


def minimum_cut(terminal: list[tuple[int, int]], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes fall on the source's side of a minimum cut.

    ``terminal`` has each node's capacities from the source and to the sink, ``links``
    two-way capacities between nodes. Ties fall to the sink's side. Each round pushes a
    blocking flow along paths of the least length.
    """
    n = len(terminal)
    supply = [max(0, s - t) for s, t in terminal]  # what passes straight through changes nothing
    demand = [max(0, t - s) for s, t in terminal]
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for i, j, c in links:
        out[i].append(len(to))
        to.append(j)
        room.append(c)
        out[j].append(len(to))
        to.append(i)
        room.append(c)
    while True:
        queue = [i for i in range(n) if supply[i]]
        level = [-1] * n
        for i in queue:
            level[i] = 0
        sources, least = len(queue), -1
        for i in queue:
            if least >= 0 and level[i] >= least:
                break
            for e in out[i]:
                j = to[e]
                if level[j] < 0 and room[e]:
                    level[j] = level[i] + 1
                    queue.append(j)
                    if least < 0 and demand[j]:
                        least = level[j]
        if least < 0:
            return [x >= 0 for x in level]
        left = [iter(x) for x in out]
        for s in queue[:sources]:
            path: list[int] = []
            i = s
            while supply[s]:
                if demand[i]:
                    push = min(supply[s], demand[i], *[room[e] for e in path])
                    supply[s] -= push
                    demand[i] -= push
                    full = len(path)
                    for k in range(len(path) - 1, -1, -1):
                        e = path[k]
                        room[e] -= push
                        room[e ^ 1] += push
                        if not room[e]:
                            full = k
                    if full < len(path):  # go on from where the first full edge begins
                        i = to[path[full] ^ 1]
                        del path[full:]
                    continue
                for e in left[i]:
                    if room[e] and level[to[e]] == level[i] + 1 <= least:
                        path.append(e)
                        i = to[e]
                        break
                else:
                    if not path:
                        break
                    i = to[path.pop() ^ 1]


def main_text(page: str, weights: np.ndarray | None = None) -> str:
    """The page's content blocks in page order, joined by two newlines."""
    blocks, has = page_blocks(page)
    if not blocks:
        return ""
    keep = minimum_cut(capacities(has, np.array(list(PRIOR.values())) if weights is None else weights), edges(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def sample(pages: DataFrame, html_col: str = "html") -> list[str]:
    """At most ``SAMPLE_PAGES`` pages of up to ``SAMPLE_CHARS`` characters, in the order of a hash of the page."""
    html = F.col(html_col).cast("string")
    some = pages.select(html.alias("html")).where((F.char_length("html") > 0) & (F.char_length("html") <= SAMPLE_CHARS))
    return [r["html"] for r in some.orderBy(F.xxhash64("html"), "html").limit(SAMPLE_PAGES).collect()]


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of every page.

    Null and empty pages have an empty text. Rows repeat as they occur, whatever their ids,
    other columns are ignored, an empty table gives an empty one. Pages are read whole, of
    any length, each by itself.
    """
    weights = fit(sample(pages, html_col))

    def compute(html: list[bytes]) -> dict:
        texts = [main_text(h.decode("utf-8", "replace"), weights) if h else "" for h in html]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    # the page stands last, under a name that none of the kept columns has
    own = "_" * max(map(len, keep)) + "_html"
    rows = pages.select(*keep, F.col(html_col).cast("string").cast("binary").alias(own))
    return with_computed(rows, compute, "text string, n_chars long", own)
