"""Main text of web pages by a minimum cut.

A page is cut into blocks of text. A linear classifier gives each block a cost; its positive part is
the capacity from the source (content), its negative part the capacity to the sink (boilerplate).
Edges between blocks that follow one another, and between blocks and the containers of the DOM that
hold them, are smoothness capacities. Maximum flow separates the two sides. Nodes whose terminal
capacity is at least that of all their edges are settled first, which is exact and leaves small graphs.

Null and empty pages have no text. Pages are independent of each other; repeated rows stay.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import text_slices
from .workspace import small_batches

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # a comment
    r"|<(script|style|title|textarea|noscript|iframe|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"  # a doctype or instruction
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[^\W\d_]+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr".split()) | frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd maction semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that closes an open element of the same kind.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOT_IN_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SECTIONS = frozenset("article aside body footer form header main nav section".split())
#: Elements whose text is left out, and the start tags that end each of them if it was not closed.
DROPPED = {
    "svg": NOT_IN_P | SECTIONS | frozenset("b big br center code dd dt em embed head i img li menu meta nobr ruby s small span strike strong sub sup tt u var".split()),
    "button": SECTIONS | {"button"},
    "select": NOT_IN_P - {"hr"} | SECTIONS | frozenset("button input select textarea".split()),
    "template": frozenset(),
}

OUTER = frozenset("nav footer aside form menu dialog fieldset".split())
INNER = frozenset("article main".split())
BAD_NAME = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner sidebar widget menu nav navbar navigation footer breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "comment comments commentlist reply replies respond disqus discussion login search form copyright toolbar pagination pager skip masthead topbar alert notification paywall".split()
)
#: Of these, the names of what readers write: however much of it there is, it is not the page's own text.
READERS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: A class such as with-sidebar or share-enabled says what is there or set, not what the element is.
_STATE = re.compile(r"(?:^|\s)(?:with|without|has|have|no|not|is|hide|show)[-_]\S+|\S+[-_](?:enabled|disabled|on|off|open|opened|closed|visible|hidden|active|inactive|collapsed|expanded|left|right)(?=\s|$)")
#: Headings that readers' comments begin with, in pages that do not name their container.
_READERS_HEAD = re.compile(r"(?:\d+\s+)?(?:(?:reader|user|visitor)s?\s+)?(?:comments?|responses?|replies|reactions?)(?:\s*[:(]?\s*\d*\s*\)?)?|(?:leave|post|add|write)\s+(?:a|your)\s+(?:comment|reply|response)", re.I)
GOOD_NAME = frozenset("article content post entry story main body articlebody text".split())


#: A container is taken for the page itself if it holds more than so many times the words that nothing speaks against.
FEW = 20


@dataclass(frozen=True)
class Weights:
    """The classifier's weights and the capacities of the smoothness edges."""

    bias: float = -0.6
    outer: float = -8.0
    header: float = -5.0
    bad_name: float = -8.0
    inner: float = 3.0
    good_name: float = 1.5
    hidden: float = -8.0
    paragraph: float = 1.0
    heading: float = 0.6
    sentence: float = 0.8
    words: float = 0.05
    words_most: float = 2.0
    links: float = -4.0
    adjacent: float = 0.6
    container: float = 0.4


@dataclass
class Node:
    """An open or closed element that holds blocks. `score` is what it adds to its blocks, `doubt` what it adds unless it holds most of the page."""

    tag: str
    up: int
    score: float
    inner: bool
    doubt: float = 0.0
    blocks: list[int] = field(default_factory=list)


def _names(attrs: str) -> tuple[frozenset[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words, hidden = set(), False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role", "itemprop", "aria-label"):
            words.update(_WORDS.findall(_STATE.sub(" ", value) if key in ("class", "id") else value))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return frozenset(words), hidden


def blocks_of(page: str, w: Weights) -> tuple[list[str], list[float], list[int], list[Node]]:
    """Texts of blocks in page order, the classifier's score and the container of each, and the containers."""
    nodes, stack = [Node("", -1, 0.0, False)], [0]
    texts: list[str] = []
    scores: list[float] = []
    owner: list[int] = []
    prose: list[int] = []
    parts: list[str] = []
    linked, in_link = 0, 0
    out = 0  # where the outermost dropped element is on the stack

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not out:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if parts:
            body = " ".join("".join(parts).split())
            if body:
                node = nodes[stack[-1]]
                n = body.count(" ") + 1
                score = w.bias + min(w.words_most, w.words * n) + w.links * min(1.0, linked / len(body))
                score += w.paragraph if node.tag == "p" else w.heading if re.fullmatch("h[1-6]", node.tag) else 0.0
                score += w.sentence if body[-1] in ".!?…。”\"" else 0.0
                node.blocks.append(len(texts))
                texts.append(body)
                scores.append(score)
                owner.append(stack[-1])
                prose.append(n if 2 * linked < len(body) else 0)
            parts.clear()
            linked = 0

    def close(tags: tuple[str, ...], until: frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                del stack[k:]
                return
            if tag in until:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            parts.append(" ")
            continue
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if out:
            root = nodes[stack[out]].tag
            if m[2]:
                k = next((k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag), 0)
                if not k:
                    continue
                del stack[max(k, out) :]
                if k > out:
                    continue
                out = 0
                if tag == root:
                    continue
            elif tag in DROPPED[root] and not (root == "svg" and any(nodes[k].tag == "foreignobject" for k in stack[out:])):
                del stack[out:]
                out = 0
            else:
                if tag not in VOID and tag not in INLINE and not m[4].endswith("/"):
                    nodes.append(Node(tag, stack[-1], 0.0, False))
                    stack.append(len(nodes) - 1)
                continue
        if tag in DROPPED:
            parts.append(" ")
            if not m[2] and not (tag == "svg" and m[4].endswith("/")):
                nodes.append(Node(tag, stack[-1], 0.0, False))
                stack.append(len(nodes) - 1)
                out = len(stack) - 1
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[2] else 1
            elif not m[2] and m[4].strip() and _names(m[4])[1]:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        in_link = 0
        if m[2]:
            close((tag,), frozenset() if tag in OUTER | INNER | {"body", "html"} else OUTER | INNER if tag in ("p", "li") else frozenset())
            continue
        if tag in VOID or tag in ("html", "body", "head"):
            continue
        if tag in NOT_IN_P and nodes[stack[-1]].tag == "p":
            stack.pop()
        if tag in CLOSES:
            close(CLOSES[tag], frozenset(("ul", "ol", "table", "dl", "div", "section", "article")))
        up = nodes[stack[-1]]
        score, doubt, inner = 0.0, 0.0, up.inner or tag in INNER
        if tag == "form":
            doubt += w.outer
        elif tag in OUTER:
            score += w.outer
        elif tag == "header" and not up.inner:
            score += w.header
        elif tag in INNER:
            score += w.inner
        if m[4].strip():
            names, hidden = _names(m[4])
            if names & BAD_NAME and tag not in INNER:
                if names & READERS:
                    score += w.bad_name
                else:
                    doubt += w.bad_name
            elif names & GOOD_NAME and not up.inner:
                score += w.good_name
            if "main" in names and "role" in m[4]:
                inner = True
            if hidden:
                score += w.hidden
        nodes.append(Node(tag, stack[-1], score, inner, doubt))
        stack.append(len(nodes) - 1)
    text(page[at:])
    if out:
        del stack[out:]
    flush()
    _inherit(texts, scores, owner, prose, nodes, w)
    return texts, scores, owner, nodes


def _inherit(texts: list[str], scores: list[float], owner: list[int], prose: list[int], nodes: list[Node], w: Weights) -> None:
    """Adds to each block what its containers say of it.

    A name or a form speaks against what it holds, unless it holds most of the page's unlinked words and next to none
    are left that nothing speaks against: then it wraps the page, and would leave none of it. Blocks from a
    heading of readers' comments on, up to the end of its container, are theirs.
    """
    sure, plain = [0.0] * len(nodes), [True] * len(nodes)
    for k in range(1, len(nodes)):
        sure[k] = sure[nodes[k].up] + nodes[k].score
        plain[k] = plain[nodes[k].up] and not nodes[k].doubt
    held, clean = [0] * len(nodes), 0
    for k, n in zip(owner, prose):
        if sure[k] > min(w.outer, w.bad_name) / 2:
            held[k] += n
            clean += n * plain[k]
    for k in range(len(nodes) - 1, 0, -1):
        held[nodes[k].up] += held[k]
    total = [0.0] * len(nodes)
    for k in range(1, len(nodes)):
        wraps = 2 * held[k] > held[0] and FEW * clean < held[k]
        total[k] = total[nodes[k].up] + nodes[k].score + (0.0 if wraps else nodes[k].doubt)
    ends: list[int] = []
    for i, k in enumerate(owner):
        scores[i] += total[k]
        if ends:
            above = k
            while above not in ends and above > 0:
                above = nodes[above].up
            if above in ends:
                scores[i] += w.bad_name
                continue
        if re.fullmatch("h[1-6]", nodes[k].tag) and _READERS_HEAD.fullmatch(texts[i]):
            scores[i] += w.bad_name
            ends.append(nodes[k].up)


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut; a tie goes to the source's side."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    net, side = list(scores), [None] * n
    todo = deque(range(n))
    while todo:  # settles what its own capacity decides; a settled neighbour becomes a terminal
        i = todo.popleft()
        if side[i] is None and abs(net[i]) >= sum(near[i].values()):
            side[i] = net[i] >= 0
            for j, c in near[i].items():
                net[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    if None not in side:
        return side
    left = [i for i in range(n) if side[i] is None]
    name = {i: k for k, i in enumerate(left)}
    source, sink = len(left), len(left) + 1
    graph: list[list[int]] = [[] for _ in range(len(left) + 2)]
    to: list[int] = []
    cap: list[float] = []

    def link(a: int, b: int, c: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, back))

    for i in left:
        if net[i] > 0:
            link(source, name[i], net[i], 0.0)
        elif net[i] < 0:
            link(name[i], sink, -net[i], 0.0)
        for j, c in near[i].items():
            if i < j:
                link(name[i], name[j], c, c)
    while True:  # Dinic's algorithm: blocking flows in level graphs
        level = [-1] * len(graph)
        level[sink] = 0
        queue = deque([sink])
        while queue:
            v = queue.popleft()
            for e in graph[v]:
                if cap[e ^ 1] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[source] < 0:
            break
        nxt = [0] * len(graph)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[v] < len(graph[v]):
                e = graph[v][nxt[v]]
                if cap[e] > 1e-9 and level[to[e]] == level[v] - 1:
                    break
                nxt[v] += 1
            else:
                if v == source:
                    break
                nxt[to[path[-1] ^ 1]] += 1
                v = to[path.pop() ^ 1]
                continue
            path.append(e)
            v = to[e]
    for i in left:  # what can't reach the sink any more is content
        side[i] = level[name[i]] < 0
    return side


def main_text(page: str, w: Weights = Weights()) -> str:  # noqa: B008
    """The blocks on the content side, joined by one space."""
    texts, scores, owner, nodes = blocks_of(page, w)
    n = len(texts)
    if not n:
        return ""
    edges = [(i, i + 1, w.adjacent * (1.0 if owner[i] == owner[i + 1] or nodes[owner[i]].up == nodes[owner[i + 1]].up else 0.3)) for i in range(n - 1)]
    used: dict[int, int] = {}
    for i, k in enumerate(owner):  # a node of the graph for each container, linked with what it holds
        k = nodes[k].up if len(nodes[k].blocks) < 2 else k
        below = i
        while k > 0:
            seen = k in used
            edges.append((below, n + used.setdefault(k, len(used)), w.container))
            if seen:
                break
            below, k = n + used[k], nodes[k].up
    side = min_cut(scores + [0.0] * len(used), edges)
    return " ".join(t for t, s in zip(texts, side) if s)


def extract(pages: DataFrame, key: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",), weights: Weights = Weights()) -> DataFrame:  # noqa: B008
    """The key, `keep` columns and text (empty if none) of every page; other columns are dropped."""
    small_batches(pages.sparkSession)
    own = pages.select(key, *keep, F.coalesce(F.col(html_column), F.lit("")).alias("text"))
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = [main_text(p, weights) for p in part.column(len(names) - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=names)

    return own.mapInArrow(run, own.schema)
