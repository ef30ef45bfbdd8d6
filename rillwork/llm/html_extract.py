"""Main text of web pages by a minimum cut.

A page is cut into text blocks at block-level elements.  A linear classifier turns each block's place, names and text (``WEIGHTS``) into log-odds of
being content, and these into two terminal capacities: the cost of calling it boilerplate and the cost of calling it content.  Adjacent blocks,
and blocks under the same parent, are joined by smoothness edges that are the heavier the more ancestors they share, and light between different
zones (an article, a menu, a comment list).  An edge is worth about as much as a middling classifier result, so the cut decides where a block
by itself says little: a short or linked line goes with what stands around it.  The blocks on the source's side of the minimum cut (Dinic's
max-flow) are the main text.

White space inside a block becomes one space; blocks are joined in page order by two newlines; nothing else is dropped or capped.  Scripts, styles,
templates, frames, fields of forms, and what media elements and noscript hold as a substitute are markup and not text; text in math, svg and object
elements is text.

Defined results.  Null html and pages without main text give the empty text.  Unclosed and stray tags are repaired as browsers do in the plain cases: a
block-level start ends an open paragraph, an end tag without a start is ignored, an unclosed script, style or comment runs to the end.
Where both labels cost the same a block is boilerplate.  Repeated rows each give a row; extra columns are ignored.  An empty table gives no rows.

One narrow pass; memory is bounded by the largest page; work is near linear in a page's length and blocks.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.common import bounded_batches, sliced

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template title textarea iframe audio video canvas select".split())
_ENDS_P = _BLOCK - {"body", "html", "option", "optgroup", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
#: An open element of the key is closed by a start tag of the values.
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NAME = re.compile(r"[a-z]+|[0-9]+")
#: Names that say what a page has beside an element ("has-sidebar") say nothing of the element.
_BESIDE = re.compile(r"(?i)(?<![a-z])(?:has|with|without|no|hide|is)[-_][\w-]+")

_NEVER = frozenset("nav aside menu dialog search footer".split())
#: Words in a class, id or role that mark what stands around an article.
_AROUND = frozenset("ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs cookie cookies consent copyright disclaimer footer gdpr header masthead menu menus modal nav navbar navigation navigational newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related rail share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar trending widget widgets complementary contentinfo search".split())
#: Words that mark what may belong to an article or not.
_MAYBE = frozenset("print tags teaser toc".split())
_REMARKS = frozenset("comment comments commentlist commentary disqus discussion replies reply respond reviews".split())
_INSIDE = frozenset("article articlebody body content entry main maincontent post story text".split())


#: Log-odds of content: of the zone that a block stands in, and of its own form and text.
WEIGHTS = {
    "article": 2.5, "inside": 1.2, "around": -5.0, "maybe": -3.2,
    "links": -2.8, "links in an article": -1.8, "words": 1 / 15, "most of words": 2.0, "few words": -0.6, "sentence": 0.5, "heading": 0.5, "paragraph": 0.3, "hidden": -0.7, "rights": -4.0,
}
#: Smoothness of neighbours in one zone and in two, and of blocks under one parent.
SAME_ZONE, OTHER_ZONE, SAME_PARENT = 1.2, 0.2, 0.5


class _Element:
    __slots__ = ("depth", "name", "parent", "prior", "zone", "firm", "link", "hidden")

    def __init__(self, name: str, attrs: dict[str, str], parent: "_Element | None"):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        prior, zone, firm = (parent.prior, parent.zone, parent.firm) if parent else (0.0, None, False)
        own = None
        # Each hyphen or underscore part of each name; a letter run after a lower-case one (camelCase) is a part too.
        label = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
        words = set(_NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", _BESIDE.sub(" ", label)).lower())) if label.strip() else set()
        if prior > 0:
            words.discard("header")  # an article's own head holds its title
        main = name in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
        if name in ("body", "html"):
            pass
        elif words & _REMARKS or name in _NEVER:
            own, firm = WEIGHTS["around"], True
        elif name == "form" or (name == "header" and not prior > 0) or (words & _AROUND and not (words & _INSIDE and name in ("main", "article"))):
            own = WEIGHTS["around"]
        elif main and not firm:
            own = WEIGHTS["article"]
        elif words & _MAYBE:
            own = prior + WEIGHTS["maybe"]
        elif words & _INSIDE and prior == 0:
            own = WEIGHTS["inside"]
        self.prior, self.zone, self.firm = (prior, zone, firm) if own is None else (own, self, firm)
        self.link = name == "a" or bool(parent and parent.link)
        style = attrs.get("style", "").replace(" ", "").lower()
        self.hidden = bool(parent and parent.hidden) or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style


class Block:
    """A run of text under one block-level element."""

    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: _Element):
        self.text, self.linked, self.element = text, linked, element


def blocks(page: str) -> list[Block]:
    """The visible text blocks of a page in order."""
    root = _Element("#root", {}, None)
    stack = [root]
    out: list[Block] = []
    run: list[str] = []
    linked = 0
    endless: set[str] = set()

    def holder() -> _Element:
        return next(e for e in reversed(stack) if e.name in _BLOCK or e is root)

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(Block(text, linked, holder()))
            run.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if stack[-1].link:
                linked += len(" ".join(text.split()))

    def close(at: int) -> None:
        if any(e.name in _BLOCK for e in stack[at:]):
            flush()
        del stack[at:]

    def find(names, stop) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in stop:
                break
        return 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name == "br":
                run.append(" ")
            elif name == "p" and not find({"p"}, ()):
                flush()
            elif i := find({name}, {"article", "td", "table"} - {name} if name not in _BLOCK else ()):
                close(i)
            continue
        if name in ("br", "wbr"):
            run.append(" " if name == "br" else "")
            continue
        if name in ("html", "body", "head"):
            flush()
            if name == "body":
                close(i) if (i := find({"head"}, ())) else None
        if name in _ENDS_P and (i := find({"p"}, {"td", "th", "div", "li", "article", "section", "table", "button"})):
            close(i)
        for open_name, enders in _ENDED_BY.items():
            if name in enders and (i := find({open_name}, _SCOPE[open_name])):
                close(i)
        if name in _BLOCK:
            flush()
        if name in _VOID:
            continue
        if name in _RAW:
            # Once no end follows, none does later: an unclosed tag is searched for once.
            end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            nested = name in ("audio", "video", "canvas", "select", "noscript", "template", "iframe")
            if end is None:
                endless.add(name)
            if end or not nested:
                at = end.end() if end else len(page)
                run.append(" ") if nested else None
            continue
        raw = m["attrs"] if m["attrs"] is not None else m["attrs2"]
        attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(raw)} if raw and raw.strip(" /") else {}
        if raw.endswith("/") and name not in _BLOCK and name not in ("a", "b", "i", "em", "span", "strong"):
            continue
        stack.append(_Element(name, attrs, stack[-1]))
    flush()
    return out


def odds(block: Block) -> float:
    """The classifier: log-odds that a block by itself is content."""
    e, text, w = block.element, block.text, WEIGHTS
    words, links = text.count(" ") + 1, block.linked / len(text)
    article = e.prior >= w["article"]
    z = e.prior + w["links in an article" if article else "links"] * links
    z += min(w["most of words"], w["words"] * words) * (1 - links) if words >= 5 else w["few words"]
    if text[-1] in ".!?\"'”»…" and words >= 4:
        z += w["sentence"] * (1 - links)
    if e.name in ("h1", "h2", "h3"):
        z += w["heading"]
    elif e.name in ("p", "blockquote", "pre"):
        z += w["paragraph"]
    if e.hidden:
        z += w["hidden"]
    if not article and (text[0] in "©®" or words < 30 and "all rights reserved" in text.lower()):
        z += w["rights"]
    return z


def costs(block: Block) -> tuple[float, float]:
    """(cost of boilerplate, cost of content) of one block."""
    z = odds(block)
    return max(z, 0.0), max(-z, 0.0)


def _near(a: _Element, b: _Element) -> float:
    """Share of common ancestors, from 0 to 1."""
    deep, x, y = max(a.depth, b.depth), a, b
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
    return (x.depth + 1) / (deep + 1)


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stand on the source's side of a minimum cut: Dinic's algorithm on an undirected neighbour graph."""
    n = len(source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for i in range(n):  # what runs from the source through one node to the sink needs no search
        d = source[i] - sink[i]
        if d > 0:
            link(s, i, d, 0.0)
        elif d < 0:
            link(i, t, -d, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for k in graph[x]:
                if cap[k] > eps and level[to[k]] < 0:
                    level[to[k]] = level[x] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[k] for k in path)
                for k in path:
                    cap[k] -= flow
                    cap[k ^ 1] += flow
                cut = next(i for i, k in enumerate(path) if cap[k] <= eps)
                x = to[path[cut] ^ 1]
                del path[cut:]
            own = graph[x]
            while nxt[x] < len(own) and not (cap[own[nxt[x]]] > eps and level[to[own[nxt[x]]]] == level[x] + 1):
                nxt[x] += 1
            if nxt[x] < len(own):
                path.append(own[nxt[x]])
                x = to[path[-1]]
            elif path:
                k = path.pop()
                x = to[k ^ 1]
                nxt[x] += 1
            else:
                break


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (block, block, weight) of adjacent blocks and of neighbours under one parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            near = _near(found[i - 1].element, b.element)
            edges.append((i - 1, i, (SAME_ZONE if found[i - 1].element.zone is b.element.zone else OTHER_ZONE) * near))
        parent = id(b.element.parent)
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SAME_PARENT if found[last[parent]].element.zone is b.element.zone else OTHER_ZONE))
        last[parent] = i
    return edges


def labels(found: list[Block]) -> list[bool]:
    """Which blocks are content."""
    terminal = [costs(b) for b in found]
    return min_cut([c for c, _ in terminal], [x for _, x in terminal], smoothness(found))


def extract(page: str | None) -> str:
    """The main text of a page."""
    found = blocks(page) if page else []
    return "\n\n".join(b.text for b, k in zip(found, labels(found)) if k) if found else ""


def transform(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches):
        for b in sliced(batches, 2):
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return bounded_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
