"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is cut into text blocks. A linear classifier gives each block a cost of being called content and a cost of being
called boilerplate: these are the capacities of its edges to the two terminals. Blocks that follow each other or that are
near in the document tree are joined by smoothness edges. The minimum cut, found by maximum flow, is the labelling that costs
least; blocks on the content side make up the text.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements without an end tag, with raw text, and those that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg annotation annotation-xml select option".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table "
                  "tbody tfoot thead tr ul button".split())
CELLS = frozenset(("td", "th", "caption", "br"))  # parts of a block that white space divides
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that never hold main text, wherever they stand, and those that hold it unless something inside speaks against it.
NEVER = frozenset("nav footer aside head menu button dialog search".split())
FORMS = frozenset(("form", "fieldset"))
CONTROLS = frozenset("input select textarea button".split())
# An end or a new start of these closes none that is open beyond the nearest of the others.
SCOPED = frozenset("p li tr dt dd".split())
WALLS = frozenset("article main div section ul ol dl table blockquote td th form".split())
MAIN = frozenset(("article", "main"))

# Words in class, id and role that tell what an element holds.
BAD_NAMES = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
                      "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination "
                      "popup promo related reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget "
                      "complementary contentinfo alert recommended".split())
# Of these, names of tools: within an article they are judged by what the element holds, as forms are.
TOOL_NAMES = frozenset("breadcrumb breadcrumbs login menu modal nav navbar navigation pager pagination popup share sharing signup social "
                       "subscribe toolbar widget".split())
GOOD_NAMES = frozenset("article articlebody body content entry main maintext post postbody story text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
                   r"|<([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)", re.S)
UNENDED = re.compile(r"<[/a-zA-Z!?][^>]*$")
NAMING = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
UNSEEN = re.compile(r"""(?:^|\s)type\s*=\s*["']?hidden\b""", re.I)
PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@dataclass(frozen=True)
class Weights:
    """Log odds of the classifier and of the smoothness edges."""

    bias: float = -0.4
    inside_main: float = 5.0
    never: float = -60.0
    form: float = -14.0  # of a form or tool that is there for its controls, see Form.odds
    control_words: float = 8.0  # words of prose that speak against a control
    bad_name: float = -14.0
    good_name: float = 2.0
    page_header: float = -8.0
    per_log_word: float = 0.55
    punctuation: float = 0.8
    links: float = -5.0
    heading: float = 0.6
    links_in_flow: float = -2.5  # in a list that prose leads to and goes on after
    flow: float = 8.0  # between such a list, its items and the prose around it
    neighbour: float = 0.8  # blocks that follow each other
    sibling: float = 0.8  # and are children of one element; halved for each step apart in the tree


@dataclass(slots=True, eq=False)
class Form:
    """What a form, a group of fields or a tool of an article holds, those inside it included."""

    outer: Form | None
    controls: int = 0
    labels: int = 0  # words
    prose: float = 0.0  # words outside labels, links and what is never main text

    def odds(self, w: Weights) -> float:
        """A form counts in full if half or more of what it holds is controls and labels, not at all up to a quarter."""
        fields = w.control_words * (1 + self.controls) + self.labels
        return w.form * min(1.0, max(0.0, 4 * fields / (fields + self.prose) - 1))


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    bad: int = 0  # names of the element and all around it
    good: int = 0
    never: bool = False
    form: Form | None = None  # the innermost, unless an article stands between
    main: bool = False
    header: bool = False
    within: Form | None = None  # the innermost
    label: bool = False  # of a form's control

    @property
    def apart(self) -> bool:
        """Something about this element itself speaks against it, so its text is no part of a block around it."""
        up = self.parent
        return up is not None and (self.bad, self.never, self.form is not None and self.form is not up.form) > (up.bad, up.never, False)


@dataclass(slots=True)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _opened(tag: str, attributes: str, parent: Element) -> Element:
    """A new element, with what it and those around it tell. Main text may stand in a form, or in an element of any name.

    Labels of a form's controls are never main text; the form itself is judged by what it holds.
    """
    main = tag in MAIN
    within = Form(parent.within) if tag in FORMS else parent.within
    label = parent.label or within is not None and tag in ("label", "legend")
    form = None if main else within if tag in FORMS else parent.form
    e = Element(tag, parent, parent.depth + 1, 0 if main else parent.bad, parent.good, parent.never or label or tag in NEVER,
                form, parent.main or main, parent.header or tag == "header", within, label)
    if attributes and not attributes.isspace():
        for name, *values in NAMING.findall(attributes):
            value, name = "".join(values), name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                e.never = True
            elif name != "aria-hidden" and tag not in ("html", "body") and not main:
                words = {w.lower() for w in PART.findall(value)} | set(value.lower().split())
                good, bad = not words.isdisjoint(GOOD_NAMES), not words.isdisjoint(BAD_NAMES)
                if parent.main and bad and not good and words & BAD_NAMES <= TOOL_NAMES:
                    if e.form is parent.form:
                        e.form = e.within = Form(parent.within)
                    bad = False
                e.bad += bad and not good
                e.good += good and not bad
                e.header |= "header" in words and not good
    return e


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in its order. Character references are decoded after the markup has been taken away."""
    root = Element("", None, 0)
    here, found, current, linked, at = root, [], None, 0, 0
    forms: list[Form] = []
    depths: dict[str, list[int]] = {}  # of the open elements of a name
    walls: list[int] = []

    def close(tag: str) -> bool:
        """Leave the innermost open ``tag``; nothing happens if there is none within its scope. Looks only at what it closes."""
        nonlocal here
        opened = depths.get(tag)
        if not opened or tag in SCOPED and walls and walls[-1] > opened[-1]:
            return False
        least = opened[-1]
        while here.depth >= least:
            depths[here.tag].pop()
            if here.tag in WALLS:
                walls.pop()
            here = here.parent
        return True

    def add(raw: str) -> None:
        nonlocal current
        if raw and (current is not None or not raw.isspace()):
            if current is None:
                current = Block(here)
                found.append(current)
            text = html.unescape(raw) if "&" in raw else raw
            current.parts.append(text)
            if linked:
                current.linked += len(text)

    while (token := TOKEN.search(page, at)) is not None:
        add(page[at:token.start()])
        at = token.end()
        closing, opening = token[1], token[2]
        if opening:
            tag = opening.lower()
            if here.within is not None and tag in CONTROLS and not (tag == "input" and UNSEEN.search(token[3])):
                here.within.controls += 1
            if tag in BLOCK:
                current = None
                close(tag if tag in SCOPED else "p")
            elif tag in CELLS and current is not None:
                current.parts.append(" ")
            if tag in RAW and not token[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = end.start() if end else len(page)
            elif tag == "a":
                linked = 1
            elif tag not in VOID and (tag in BLOCK or tag in CELLS or tag in ("label", "legend") or token[3].strip()):
                around, here = here, _opened(tag, token[3], here)
                depths.setdefault(tag, []).append(here.depth)
                if tag in WALLS:
                    walls.append(here.depth)
                if here.within is not around.within:
                    forms.append(here.within)
                if here.apart:
                    current = None
        elif closing:
            tag = closing.lower()
            if tag in BLOCK:
                current = None
            if tag == "a":
                linked = 0
            elif tag in CELLS and current is not None:
                current.parts.append(" ")
            before = here
            if close(tag) and before.apart:
                current = None
    add(UNENDED.sub("", page[at:]))
    kept = []
    for block in found:
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            kept.append(block)
            e = block.element
            if e.within is not None:
                words = block.text.count(" ") + 1
                if e.label:
                    e.within.labels += words
                elif not e.never and not e.bad:
                    e.within.prose += words * max(0.0, 1 - block.linked / len(block.text))
    for form in reversed(forms):  # those inside come after those around them
        if form.outer is not None:
            form.outer.controls += form.controls
            form.outer.labels += form.labels
            form.outer.prose += form.prose
    return kept


def flowing_lists(found: Sequence[Block]) -> dict[int, Element]:
    """Blocks of the lists that stand in a flow of prose, with their list: it follows prose and prose follows it, all children of one element."""
    lists: list[tuple[Element, int, int]] = []
    for i, block in enumerate(found):
        e = block.element
        while e is not None and e.tag not in ("ul", "ol", "dl"):
            e = e.parent if e.tag in ("li", "dt", "dd", "p") else None
        if e is None:
            continue
        if lists and lists[-1][0] is e and lists[-1][2] == i - 1:
            lists[-1] = (e, lists[-1][1], i)
        else:
            lists.append((e, i, i))
    out: dict[int, Element] = {}
    for e, first, last in lists:
        if first and last + 1 < len(found) and _prose(found[first - 1], e) and _prose(found[last + 1], e):
            out |= dict.fromkeys(range(first, last + 1), e)
    return out


def _prose(block: Block, beside: Element) -> bool:
    """A paragraph beside an element, of eight words or more, most of them not linked, that ends as a sentence does."""
    e = block.element
    return (e.tag == "p" and e.parent is beside.parent and block.text.count(" ") >= 7 and 2 * block.linked < len(block.text)
            and block.text[-1] in ".!?…:;,\"»”")


def log_odds(block: Block, w: Weights, in_flow: bool = False) -> float:
    """What the classifier says for content, in log odds."""
    e, words = block.element, block.text.count(" ") + 1
    inner = e.tag in HEADINGS
    score = w.bias + w.per_log_word * min(6.0, words.bit_length())
    score += (w.links_in_flow if in_flow else w.links) * block.linked / len(block.text)
    score += w.punctuation * (block.text[-1] in ".!?…\"»”:;") + w.heading * inner + w.inside_main * e.main
    score += w.good_name * min(2, e.good) + w.bad_name * min(2, e.bad) + w.never * e.never
    if e.form is not None:
        score += e.form.odds(w)
    if e.header and not (e.main and inner):
        score += w.page_header
    return score


def smoothness(found: Sequence[Block], w: Weights, flowing: dict[int, Element] | None = None) -> dict[tuple[int, int], float]:
    """Edges between blocks: each and the next, and each and the next child of the same element; strong ones along a flow of prose."""
    flowing = flowing or {}
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for j, block in enumerate(found):
        if j:
            a, b, steps = found[j - 1].element, block.element, 0
            while a is not b:
                a, b, steps = (a.parent, b, steps + 1) if a.depth >= b.depth else (a, b.parent, steps + 1)
            edges[j - 1, j] = w.neighbour * 0.5 ** max(0, steps - 2) + w.flow * (j in flowing or j - 1 in flowing)
        around = id(block.element.parent or block.element)
        if (i := last.get(around)) is not None:
            edges[i, j] = edges.get((i, j), 0.0) + w.sibling
        last[around] = j
    return edges


def minimum_cut(odds: Sequence[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut, the smallest such side.

    Positive odds are the capacity from the source, negative ones that to the sink. A node whose terminal edge outweighs all its
    other edges together has its label for certain; it is taken out and its edges become terminal capacity of its neighbours.
    Augmenting paths by breadth-first search (Dinic's levels) settle what is left.
    """
    n, supply = len(odds), list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(supply[i]) > sum(near[i].values()):
            label[i] = supply[i] > 0
            for j, c in near[i].items():
                supply[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        reached = _max_flow(rest, supply, near)
        for i in rest:
            label[i] = i in reached
    return [bool(x) for x in label]


def _max_flow(nodes: Sequence[int], supply: Sequence[float], near: Sequence[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches once the flow is greatest."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        left[i] = dict(near[i])
    for i in nodes:
        if supply[i] > 0:
            left[source][i] = supply[i]
            left[i][source] = 0.0
        elif supply[i] < 0:
            left[i][sink] = -supply[i]
            left[sink][i] = 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in left[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level) - {source}
        turn = {u: iter(list(left[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(left[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    left[a][b] -= flow
                    left[b][a] += flow
                cut = next(k for k in range(len(path) - 1) if left[path[k]][path[k + 1]] <= 1e-12)
                del path[cut + 1:]
                continue
            for v in turn[u]:
                if left[u][v] > 1e-12 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                level[u] = -1


def labelled(page: str | None, weights: Weights = Weights()) -> list[tuple[Block, bool]]:
    """The blocks of a page and whether they lie on the content side of the cut."""
    found = blocks(page or "")
    flowing = flowing_lists(found)
    odds = [log_odds(b, weights, i in flowing) for i, b in enumerate(found)]
    return list(zip(found, minimum_cut(odds, smoothness(found, weights, flowing)), strict=True))


def main_blocks(page: str | None, weights: Weights = Weights()) -> list[Block]:
    return [b for b, kept in labelled(page, weights) if kept]


def main_text(page: str | None, weights: Weights = Weights()) -> str:
    """The content blocks, each with single spaces, joined by newlines; empty for null, empty or textless pages."""
    return "\n".join(b.text for b in main_blocks(page, weights))


def extract(column: str = "html", weights: Weights = Weights()) -> Column:
    """A struct of the main ``text`` of whole pages, its length in code points, and the numbers of blocks and of kept ones."""

    @F.pandas_udf("text string, n_chars long, n_blocks long, n_kept long")
    def extracted(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in pages:
            rows = []
            for page in series:
                found = labelled(page, weights)
                text = "\n".join(b.text for b, kept in found if kept)
                rows.append((text, len(text), len(found), sum(kept for _, kept in found)))
            yield pd.DataFrame(rows, columns=["text", "n_chars", "n_blocks", "n_kept"])

    return extracted(F.col(column))
