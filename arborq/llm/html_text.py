"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A classifier gives each block log odds of being content, from its looks (words,
links, end of sentence, heading, what its container holds and where it stands) and its markup (tags, words in class and id,
roles). What looks weigh is fitted, in one pass, to the blocks that markup marks clearly; these log odds become the
capacities to two terminals, all of them finite. Neighbours in the page and blocks near in the DOM (through nodes for
their containers) are tied by smoothness edges. The minimum cut, found by maximum flow, parts content from
boilerplate: clear markup outweighs what a block looks like, and where markup says nothing, the company that a block
keeps settles what its looks leave open.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import table

# HTML elements by their part in a page.
DROPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video head title select button textarea".split())
RAW = frozenset("script style textarea title".split())
HEAD_PARTS = frozenset("base basefont bgsound html link meta".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_TAGS = frozenset(["article", "main"])
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
}
# Words in class and id that mark boilerplate or content.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar sidebars rail widget "
    "widgets menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus reply replies respond "
    "responses discussion popup modal overlay login search pagination pager toc legal copyright toolbar alert topbar skip teaser outbrain taboola".split()
)
# Of these words a compound such as notice-board says less, unless it ends in another such word or a frame's.
AMBIGUOUS_WORDS = frozenset("notice notices header alert legal rail social search discussion response responses copyright".split())
FRAME_WORDS = frozenset("area bar block box col column container group holder inner item items left link links list outer panel right row section slot strip unit wrap wrapper zone".split())
CONTENT_WORDS = frozenset("article content main post entry story text body prose".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)[^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
# Log odds of the classifier: bounds of what looks and markup can say, and what each sign adds.
LOOKS, BOILER, HALF, CONTENT, WORD, MIXED, HIDDEN = 2.0, -8.0, -3.0, 3.0, 1.0, -1.5, -10.0
# What looks weigh where nothing is fitted: constant, log words, share in links, end of sentence, heading, list item without links,
# then of its container log words, share in links, words against the largest container; before or after the largest container.
PLAIN = (-1.2, 0.7, -5.0, 0.6, 0.5, 1.5, 0.0, 0.0, 0.0, 0.0)
FITTED = (1, 2, 3, 6, 7, 8, 9)  # tags are left as they are: in marked pages they repeat the marks
SHRINK = 0.5  # how much of each variance is added, so that no look is trusted without bound where classes part fully
NEXT, DOM = 1.6, 0.9  # smoothness between neighbours in the page and between a block and its container


class _Box:
    """An open or closed block element: its parent and what its markup, with all around it, says in log odds."""

    __slots__ = ("content", "depth", "index", "markup", "parent", "tag")

    def __init__(self, tag: str, parent: _Box | None, content: bool, markup: float, index: int):
        self.tag, self.parent, self.content, self.markup, self.index = tag, parent, content, markup, index
        self.depth = parent.depth + 1 if parent else 0


def _ambiguous(names: str) -> bool:
    """Whether all that speaks of boilerplate in a class or id are compounds of an ambiguous word with one that is no frame's."""
    for name in names.lower().split():
        parts = _PARTS.findall(name)
        bad = BOILER_WORDS.intersection(parts)
        if bad and (not bad <= AMBIGUOUS_WORDS or parts[-1] in BOILER_WORDS or parts[-1] in FRAME_WORDS or not parts[-1].isalpha()):
            return False
    return True


def _judged(tag: str, attributes: str, parent: _Box) -> tuple[bool, float]:
    """(inside content markup, log odds of the markup) of a new element. Boilerplate within content is boilerplate, not the reverse."""
    marked = tag in CONTENT_TAGS
    against = BOILER if tag in BOILER_TAGS or (tag == "header" and not parent.content) else 0.0
    words_for = 0.0
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                words = {w.lower() for w in _PARTS.findall(value)}
                if words & BOILER_WORDS and tag not in CONTENT_TAGS and tag not in ("body", "html") and _ambiguous(value):
                    against = min(against, HALF)
                elif words & BOILER_WORDS and tag not in CONTENT_TAGS and tag not in ("body", "html"):
                    if words & CONTENT_WORDS:
                        words_for += MIXED
                    else:
                        against = min(against, BOILER)
                elif words & CONTENT_WORDS:
                    words_for += WORD
            elif name == "role":
                against = min(against, BOILER) if value.lower() in BOILER_ROLES else against
                marked = marked or value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                against = HIDDEN
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                against = HIDDEN
    markup = parent.markup + (CONTENT if marked and not parent.content else 0.0) + words_for
    return parent.content or marked, max(HIDDEN, min(CONTENT, markup) + against)


def blocks_of(html: str) -> tuple[list[tuple[str, _Box, float]], list[_Box]]:
    """(text, box, share of its characters in links) of each block with text, in page order; and all boxes."""
    root = _Box("", None, False, 0.0, 0)
    boxes, stack = [root], [root]
    found: list[tuple[str, _Box, float]] = []
    parts: list[str] = []
    linked = links = dropped = 0
    skip: list[str] = []
    inside: list[str] = []  # blocks open within the dropped elements

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append((text, stack[-1], min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else n]
        if skip == ["head"] and text and not text.isspace():
            skip.clear()
            dropped = 0
        if text and not dropped:
            parts.append(text)
            if links:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if skip and tag not in DROPPED:
            # end tags of head may be left out; other unclosed dropped elements end with the block around them
            if skip[-1] == "head" and not closing and tag not in HEAD_PARTS:
                skip.pop()
            elif closing and (tag in ("body", "html") or (tag in BLOCKS and tag not in inside and any(box.tag == tag for box in stack))):
                skip.clear()
            elif tag in BLOCKS and closing and tag in inside:
                del inside[len(inside) - 1 - inside[::-1].index(tag) :]
            elif tag in BLOCKS and not closing and tag != "hr":
                inside.append(tag)
            dropped = len(skip)
        if tag in DROPPED:
            if not closing and tag in RAW:
                end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            elif closing:
                if tag in skip:
                    while skip.pop() != tag:
                        pass
                    dropped = len(skip)
                    if not skip:
                        inside.clear()
            elif tag not in VOID and not (m[3] or "").endswith("/"):
                skip.append(tag)
                dropped = len(skip)
        elif dropped:
            pass
        elif tag == "a":
            links = 0 if closing else int(any(x[1].lower() == "href" for x in _ATTRIBUTE.finditer(m[3] or "")))
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            inside.clear()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            elif tag != "hr":
                while len(stack) > 1 and stack[-1].tag in CLOSES.get(tag, ("p",)):
                    stack.pop()
                box = _Box(tag, stack[-1], *_judged(tag, m[3] or "", stack[-1]), len(boxes))
                boxes.append(box)
                stack.append(box)
    flush()
    return found, boxes


def _home(box: _Box) -> _Box:
    """The container of a block; that of a list is what the list stands in."""
    return box.parent if box.parent is not None and (box.tag in ("p", "li", "td", "ul", "ol") or box.tag in HEADINGS) else box


def _looks(text: str, box: _Box, share: float) -> list[float]:
    """What a block is like, by itself: the first six of PLAIN."""
    item = box.tag == "li" and share == 0
    return [1.0, math.log1p(text.count(" ") + 1), share, float(text[-1] in ".!?…。\"'”"), float(box.tag in HEADINGS), float(item)]


def looks_of(blocks: list[tuple[str, _Box, float]]) -> list[list[float]]:
    """What each block is like, by itself and by its container, in the order of PLAIN; no part of it comes from classes, ids, roles or meaningful tags."""
    words: dict[int, float] = {}
    linked: dict[int, float] = {}
    homes = [_home(_home(box) if box.tag == "li" and share == 0 else box).index for _, box, share in blocks]
    for home, (text, _, share) in zip(homes, blocks, strict=True):
        n = text.count(" ") + 1
        words[home] = words.get(home, 0.0) + n
        linked[home] = linked.get(home, 0.0) + n * share
    largest = max(words, key=words.__getitem__, default=0)
    inside = [i for i, home in enumerate(homes) if home == largest]
    found = []
    for i, (home, block) in enumerate(zip(homes, blocks, strict=True)):
        outside = float(i < inside[0] or i > inside[-1])
        found.append([*_looks(*block), math.log1p(words[home]), linked[home] / words[home], words[home] / words[largest], outside])
    return found


def leaning(text: str, box: _Box, link_share: float, looks: list[float] | None = None, weights: Sequence[float] = PLAIN) -> float:
    """Log odds that a block is content, by its looks (bounded) and its markup."""
    says = sum(a * b for a, b in zip(looks or _looks(text, box, link_share), weights, strict=False))
    return max(-LOOKS, min(LOOKS, says)) + box.markup


def weights_of(n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> tuple[float, ...]:
    """Weights of looks by the shrunk linear discriminant of two classes, from their counts, sums and sums of products.

    PLAIN if either class has fewer than 20 blocks. What is not in FITTED, or doesn't vary in the blocks, keeps its weight of PLAIN.
    """
    if n.min() < 20:
        return PLAIN
    means, mean = sums / n[:, None], sums.sum(0) / n.sum()
    within = (squares - n[:, None, None] * means[:, :, None] * means[:, None, :]).sum(0) / n.sum()
    overall = np.diag(squares.sum(0)) / n.sum() - mean**2
    use = [i for i in FITTED if overall[i] > 1e-9]
    out = np.array(PLAIN)
    out[use] = np.linalg.solve(within[np.ix_(use, use)] + SHRINK * np.diag(overall[use]), (means[1] - means[0])[use])
    out[0] = math.log(n[1] / n[0]) - means.mean(0)[use] @ out[use]
    return tuple(out.tolist())


def fit(pages: DataFrame, html: str = "html") -> tuple[float, ...]:
    """Weights of looks, from all blocks of all pages that markup marks clearly as content or boilerplate.

    One pass; two classes' sums and sums of products (2 x 11 x 10 numbers) reach the driver, however many pages there are. No page, or none with
    marks of either kind, gives PLAIN. Sums are rounded to nine places, so that the order in which tasks end changes nothing.
    """
    m = len(PLAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, m + 1, m))
        for batch in batches:
            for page in batch.column(0).to_pylist():
                blocks = blocks_of(page)[0] if page else []
                for (_, box, _), looks in zip(blocks, looks_of(blocks), strict=True):
                    if box.markup >= CONTENT or box.markup <= CONTENT + BOILER:
                        x, k = np.array(looks), int(box.markup > 0)
                        total[k, 0] += x
                        total[k, 1:] += np.outer(x, x)
        yield pa.RecordBatch.from_pydict({"at": np.arange(total.size), "x": np.round(total.ravel(), 9)})

    sums = pages.select(html).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,9)")).cast("double").alias("x")).collect()
    total = np.zeros(2 * (m + 1) * m)
    for r in sums:
        total[r["at"]] = r["x"]
    total = total.reshape(2, m + 1, m)
    return weights_of(total[:, 0, 0], total[:, 0], total[:, 1:])


def _nearness(a: _Box, b: _Box) -> float:
    """Weight of the edge between neighbouring blocks, less the further apart they are in the DOM."""
    steps = 0
    while a is not b and steps < 6:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return NEXT / (1.0 + steps)


def minimum_cut(pull: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes end on the source's side. pull > 0 is capacity from the source, pull < 0 capacity to the sink.

    A node whose pull outweighs all its edges keeps its side in some minimum cut and is merged with that
    terminal first; Dinic's algorithm settles the rest. Of several minimum cuts, nodes without a path
    from the source fall to the sink.
    """
    n = len(pull)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    pull = list(pull)
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(pull[i]) >= sum(near[i].values()) and (pull[i] or not near[i]):
            side[i] = pull[i] > 0
            for j, w in near[i].items():
                pull[j] += w if side[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    free = [i for i in range(n) if side[i] is None]
    if not free:
        return [bool(s) for s in side]
    number = {v: k for k, v in enumerate(free)}
    source, sink = len(free), len(free) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(free) + 2)]

    def tie(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for v in free:
        if pull[v] > 0:
            tie(source, number[v], pull[v], 0.0)
        elif pull[v] < 0:
            tie(number[v], sink, -pull[v], 0.0)
        for u, w in near[v].items():
            if v < u:
                tie(number[v], number[u], w, w)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        turn = [0] * len(out)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                keep = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                v = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while turn[v] < len(out[v]):
                e = out[v][turn[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(out[v]):
                path.append(out[v][turn[v]])
                v = to[path[-1]]
            elif v == source:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]
    for v in free:
        side[v] = level[number[v]] >= 0
    return [bool(s) for s in side]


def graph_of(blocks: list[tuple[str, _Box, float]], weights: Sequence[float] = PLAIN) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Log odds of the blocks, then 0 for each container's node; and the smoothness edges among them."""
    pull = [leaning(*block, looks, weights) for block, looks in zip(blocks, looks_of(blocks), strict=True)]
    edges: dict[tuple[int, int], float] = {}
    for i in range(len(blocks) - 1):
        edges[i, i + 1] = _nearness(blocks[i][1], blocks[i + 1][1])
    node: dict[int, int] = {}
    for i, (_, box, _) in enumerate(blocks):  # DOM proximity: a block hangs on its container, this on the next one
        below, weight, up = i, DOM, _home(box)
        while up is not None and weight > 0.1:
            fresh = up.index not in node
            if fresh:
                node[up.index] = len(pull)
                pull.append(0.0)
            edges[below, node[up.index]] = weight
            if not fresh:
                break
            below, weight, up = node[up.index], weight / 2, up.parent
    return pull, edges


def labels_of(html: str | None, weights: Sequence[float] = PLAIN) -> list[tuple[str, bool]]:
    """Each block's text and whether it is content."""
    blocks = blocks_of(html)[0] if html else []
    sides = minimum_cut(*graph_of(blocks, weights)) if blocks else []
    return [(text, keep) for (text, _, _), keep in zip(blocks, sides, strict=False)]


def main_text(html: str | None, weights: Sequence[float] = PLAIN) -> str:
    """Content blocks of a page, joined by line ends; empty for a null, empty or all-boilerplate page. Time and memory grow with the page."""
    return "\n".join(text for text, keep in labels_of(html, weights) if keep)


def extract(pages: DataFrame, html: str = "html", out: str = "text", weights: Sequence[float] = PLAIN) -> DataFrame:
    """Replace the column of whole HTML texts by the main text of each; null and empty pages give an empty text.

    A column named as the result is replaced. Rows are worked on one by one, so repeated rows stay, and an empty table gives an empty result.
    """
    pages = pages if out == html else pages.drop(out)
    columns, at = pages.columns, pages.columns.index(html)
    names = [out if c == html else c for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h, weights) for h in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names)

    schema = ", ".join(f"`{n}` {'string' if i == at else f.dataType.simpleString()}" for i, (n, f) in enumerate(zip(names, pages.schema.fields, strict=True)))
    return pages.mapInArrow(run, schema)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, weights=fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
