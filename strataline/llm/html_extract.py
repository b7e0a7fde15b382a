"""Main-text extraction from HTML by minimum-cut labelling of text blocks.

A page becomes its text blocks in page order.  A logistic classifier over each block's evidence (names, class and id words
of the elements it stands in, link density, length, sentence marks) gives the cost of calling it content and of calling
it boilerplate; these are the capacities to the two terminals.  Neighbouring blocks are joined by smoothness edges whose
capacity falls with every step of the DOM path between them, and a block is also joined to the last one before it under
the same parent.  The minimum cut labels the blocks; what remains on the content side is the text.

The classifier is fitted here, on labelled pages drawn by a seeded generator of page layouts (a part of them with class
names that say nothing, so that text and neighbours must decide); the strength of the smoothness edges is the one with the
fewest wrong blocks on a second part.  Words of elements that wrap the page's main part (`<body class="has-sidebar">`, a
container around the article with most of the text) are no evidence.

Blocks that no cut would move (own cost difference above the sum of their edges) are settled first; maximum flow by
blocking flows runs on each connected rest.  Scripts, styles, forms and the like are dropped while parsing, in time linear
in the page whatever its nesting.  Each page is handled alone in an Arrow batch: no shuffle, memory bounded by a page.

Defined results: null or empty html gives the empty text; markup cut off at the end of the page is dropped with the
unfinished tag; a tag with an unclosed quote ends at its first ">"; a head without end tag ends where body content
starts; pages without elements are one block; control characters decode as in a browser; repeated rows give repeated
results; input columns named like an output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_append
from .quality import fit_logistic

#: Elements whose text never shows, or belongs to a form or an embedded object.
DROPPED = frozenset("script style noscript template head title iframe object svg form select textarea button canvas audio video map datalist".split())
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that can stand in a head; any other one, or text, ends it.
HEAD = frozenset("head title meta link base script style noscript template".split())
#: Elements that flow within a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas are text of the paragraph they stand in; only their source annotations, which are not shown, are dropped.
INLINE |= frozenset("math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded menclose maction msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd annotation annotation-xml".split())
ANNOTATIONS = frozenset(("annotation", "annotation-xml"))
DROPPED |= ANNOTATIONS
#: An open <p> ends where one of these starts.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Open items that a start tag ends, and the elements beyond which it ends none.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
BORDERS = ("ul", "ol", "dl", "table", "select", "tbody", "div")

# Names that are evidence of what an element holds.
ELEMENTS = frozenset("article main nav footer aside header menu dialog address section figure figcaption blockquote pre li dt dd td th p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role attributes by the parts of a page that they name.
WORDS = {
    "main text": "article body content entry main post story text".split(),
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pagination skip tags toolbar".split(),
    "header": "banner header masthead".split(),
    "footer": "contentinfo copyright footer".split(),
    "sidebar": "recommended related sidebar widget".split(),
    "notice": "alert consent cookie cookies gdpr modal notice popup".split(),
    "advert": "ad ads adv advert advertisement promo sponsor sponsored".split(),
    "form": "login newsletter share sharing signup social subscribe".split(),
    "comments": "comment comments disqus replies reply respond".split(),
}
KNOWN = frozenset(w for words in WORDS.values() for w in words)
#: Class names that start so tell about the page, not about what the element holds.
MODIFIERS = frozenset("has have with without no is hide show".split())

_QUOTED = r""""[^"]*"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:(?:[^>"']|{_QUOTED})*+(?=>|\Z))|[^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    __slots__ = ("depth", "element", "linked", "parent", "shared", "text")

    def __init__(self, text: str, linked: int, element: int, parent: int, depth: int, shared: int):
        self.text, self.linked, self.element, self.parent, self.depth, self.shared = text, linked, element, parent, depth, shared


def _tokens(name: str, attrs: str, inside: bool) -> tuple[set[str], set[str], bool]:
    """Evidence of an element's start tag: of its name, of its attributes' words; and whether it is hidden."""
    own, words, hidden = set(), set(), False
    if name in HEADINGS:
        own.add("<heading>")
    elif name in ELEMENTS:
        own.add(f"<inner {name}>" if inside and name in ("header", "footer") else f"<{name}>")
    if attrs and "=" in attrs or "hidden" in attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
                hidden = True
            elif key in ("class", "id", "role") and name not in ("html", "body"):
                for part in value.split():
                    split = _SPLIT.split(part)
                    if split[0] not in MODIFIERS:
                        words.update(w for w in split if w in KNOWN)
    return own, words, hidden


def parse(page: str) -> tuple[list[Block], list[frozenset[str]]]:
    """The text blocks of a page in page order, without dropped elements, and the evidence of every element by number."""
    out: list[Block] = []
    names: list[str] = []  # the stack: names, numbers (of the block element around, for inline ones), dropped or not
    numbers: list[int] = [0]
    dropped: list[bool] = [False]
    where: dict[str, list[int]] = {}  # places of each name on the stack
    parents, own, words, mass, leads = [0], [set()], [set()], [0], [False]
    parts: list[str] = []
    linked, links, depth, low = 0, 0, 0, 0

    def top(name: str) -> int:
        found = where.get(name)
        return found[-1] if found else -1

    def flush() -> None:
        nonlocal linked, low
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, numbers[-1], parents[numbers[-1]], depth, min(low, depth)))
                mass[numbers[-1]] += len(text)
                low = depth
            parts.clear()
        linked = 0

    def close(place: int) -> None:
        nonlocal links, depth, low
        if any(n not in INLINE for n in names[place:]):
            flush()
        for n in names[place:]:
            where[n].pop()
            links -= n == "a"
            depth -= n not in INLINE
        low = min(low, depth)
        del names[place:], numbers[place + 1:], dropped[place + 1:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at: m.start() if m else end]
        if text and names and names[-1] == "head" and not text.isspace():
            close(len(names) - 1)
        if text and not dropped[-1]:
            parts.append(text)
            if links > 0:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[1] is not None and not dropped[-1]:
            parts.append(m[1])
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            if name == "br" or name == "p" and top("p") < 0:
                parts.append(" ")
            elif top(name) >= 0:
                close(top(name))
            continue
        if names and names[-1] in ANNOTATIONS:
            continue
        if names and names[-1] == "head" and name not in HEAD:
            close(len(names) - 1)
        if name in RAW:
            stop = re.compile(rf"</{name}\b", re.I).search(page, at)
            if name in DROPPED or stop is None:
                at = stop.start() if stop else end
                if stop:
                    at = page.find(">", at) + 1 or end
                if name not in INLINE and name not in ("script", "style", "noscript"):
                    flush()
                continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name not in INLINE and name == "hr":
                flush()
            continue
        if name in CLOSES_P and top("p") >= 0:
            close(top("p"))
        elif name in ENDS:
            place = max(map(top, ENDS[name]))
            if place > max(map(top, BORDERS)):
                close(place)
        if name not in INLINE:
            flush()
        tokens, more, hidden = _tokens(name, m[4], top("article") >= 0 or top("main") >= 0)
        if name in INLINE:
            number = numbers[-1]
        else:
            number = len(parents)
            parents.append(numbers[-1]), own.append(tokens), words.append(more), mass.append(0), leads.append(name in ("article", "main", "h1"))
            depth += 1
        where.setdefault(name, []).append(len(names))
        names.append(name), numbers.append(number), dropped.append(dropped[-1] or hidden or name in DROPPED)
        links += name == "a"
        if m[4].endswith("/") and name in ("svg", "iframe", "object"):
            close(len(names) - 1)
    flush()
    # text and main parts below each element; elements are numbered from the root, so one pass back and one forth do
    for e in range(len(parents) - 1, 0, -1):
        mass[parents[e]] += mass[e]
        leads[parents[e]] = leads[parents[e]] or leads[e]
    evidence, total = [frozenset()], mass[0]
    for e in range(1, len(parents)):
        wraps = leads[e] and 2 * mass[e] >= total and "<article>" not in own[e] and "<main>" not in own[e]
        mine = own[e] | {w for w in words[e] if not (wraps and w not in WORDS["main text"])}
        evidence.append(evidence[parents[e]] | mine if mine else evidence[parents[e]])
    return out, evidence


# --- the classifier --------------------------------------------------------------------------------------------------

TOKENS = sorted(KNOWN | {f"<{n}>" for n in ELEMENTS} | {"<heading>", "<inner header>", "<inner footer>"})
STATS = ["link share", "log of length", "sentence marks", "short", "copyright sign", "ends a sentence"]
#: Evidence that names a part of the page; what a block's text looks like counts apart with and without such.
NAMING = KNOWN | frozenset(f"<{n}>" for n in "article main nav footer aside header menu".split())
#: Log-odds are held within this, so that enough neighbours can outweigh any block's own evidence.
MOST = 8.0


def statistics(block: Block, named: bool) -> list[float]:
    text, n = block.text, len(block.text)
    found = [min(1.0, block.linked / n), math.log(n), float(min(3, text.count(".") + text.count("!") + text.count("?"))), float(n < 25), float("©" in text[:12]), float(text[-1] in ".!?:…\"")]
    none = [0.0] * len(found)
    return [*found, *none, 1.0] if named else [*none, *found, 0.0]


class Model:
    """Log-odds weights by token, of the statistics and the intercept; strength of the edges and its decay by DOM step."""

    def __init__(self, tokens: dict[str, float], stats: list[float], bias: float, near: float, decay: float, sibling: float):
        self.tokens, self.stats, self.bias, self.near, self.decay, self.sibling = tokens, stats, bias, near, decay, sibling

    def costs(self, blocks: list[Block], evidence: list[frozenset[str]]) -> list[float]:
        """Log-odds that each block is content: what labelling it boilerplate costs more than labelling it content."""
        known: dict[frozenset[str], tuple[float, bool]] = {}
        out = []
        for b in blocks:
            found = evidence[b.element]
            if found not in known:
                known[found] = self.bias + sum(self.tokens[t] for t in sorted(found)), not NAMING.isdisjoint(found)
            own, named = known[found]
            out.append(max(-MOST, min(MOST, own + sum(w * x for w, x in zip(self.stats, statistics(b, named))))))
        return out

    def edges(self, blocks: list[Block]) -> list[tuple[int, int, float]]:
        """Neighbours, by the steps of the DOM path between them (two for siblings), and the last block under the same parent."""
        edges, last = [], {}
        for i, b in enumerate(blocks):
            if i and self.near:
                edges.append((i - 1, i, self.near * self.decay ** min(60, max(0, b.depth + blocks[i - 1].depth - 2 * b.shared - 2))))
            if self.sibling and last.get(b.parent, i - 1) != i - 1:
                edges.append((last[b.parent], i, self.sibling))
            last[b.parent] = i
        return edges


def labelled_pages(n: int, seed: int) -> list[tuple[str, frozenset[str]]]:
    """n pages with the texts of their main blocks, from a seeded generator of layouts."""
    r = random.Random(seed)
    syllables = "an er th in on re ti es or te en at ed nd to it is ou ea hi ng st le che ra mo la ver sch tion que ment".split()
    serial = [0]

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def phrase(lo: int, hi: int) -> str:
        serial[0] += 1  # every text is told from the others by its last word
        return " ".join([*(word() for _ in range(r.randint(lo, hi))), f"{word()}{serial[0]}"]).capitalize()

    def prose(sentences: int) -> str:
        return " ".join(phrase(3, 16) + r.choice("....!?") for _ in range(sentences))

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def page() -> tuple[str, frozenset[str]]:
        main: list[str] = []
        mute = r.random() < 0.25  # class names that say nothing

        def tag(name: str, part: str, inside: str) -> str:
            if mute:
                return f'<div class="c{r.randint(1, 99)}">{inside}</div>'
            own = r.choice(WORDS[part])
            if r.random() < 0.25:  # a part's name beside that of the whole
                own = f"{r.choice(WORDS['main text'])}-{own}"
            attr = r.choice([f'class="{own}"', f'id="{own}"', f'class="x-{own} {word()}"', f'class="{own}-{r.choice(["box", "wrap", "area", word()])}"'])
            name = r.choice([name, name, "div"])
            return f"<{name} {attr}>{inside}</{name}>" if name in ("div", "section") or r.random() < 0.4 else f"<{name}>{inside}</{name}>"

        def said(text: str) -> str:
            main.append(text)
            return text

        def links(k: int) -> str:
            items = [link(phrase(0, 2)) for _ in range(k)]
            shape = r.random()
            if shape < 0.25:  # a box of links under a heading, with a line of plain text now and then
                return f"<h3>{phrase(0, 2)}</h3>" + "".join(f"<p>{i}</p>" if r.random() < 0.8 else f"<p>{phrase(1, 5)}</p>" for i in items)
            if shape < 0.4:
                return f"<h4>{phrase(0, 1)}</h4><ul><li>" + "</li><li>".join(items) + "</li></ul>"
            return "<ul><li>" + "</li><li>".join(items) + "</li></ul>" if r.random() < 0.7 else " | ".join(items)

        def paragraph() -> str:
            kind = r.random()
            if kind < 0.62:
                text = said(prose(r.randint(1, 6)))
                if r.random() < 0.06:  # linked as a whole
                    return f"<p>{link(said(phrase(2, 8)))}</p><p>{text}</p>"
                if r.random() < 0.15:
                    head, tail = text.split(" ", 1)
                    return f"<p>{link(head)} {tail}</p>"
                return f"<{wrap}>{text}</{wrap}>"
            if kind < 0.74:
                return f"<p>{said(r.choice([phrase(0, 4), word().capitalize(), word().capitalize() + ' ' + word()]) + r.choice(['', '.', '.', '!']))}</p>"
            if kind < 0.82:
                return f"<h{k}>{said(phrase(1, 5))}</h{k}>" if (k := r.randint(2, 4)) else ""
            if kind < 0.9:
                return "<ul>" + "".join(f"<li>{said(phrase(1, 9))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            if kind < 0.94:
                return f"<blockquote>{said(prose(1))}</blockquote>"
            if kind < 0.97:
                return "<table><tr>" + "".join(f"<td>{said(phrase(0, 2))}</td>" for _ in range(4)) + "</tr></table>"
            return f"<figure><img src=x><figcaption>{said(phrase(2, 8))}</figcaption></figure>"

        def comment() -> str:
            return f"<p>{prose(r.randint(1, 3))}</p>" if mute else tag("div", "comments", f"<p>{prose(r.randint(1, 3))}</p>")

        wrap = r.choice(["p", "p", "p", "p", "p", "div"])  # some pages write paragraphs so
        title = f"<h1>{said(phrase(2, 7))}</h1>"
        if r.random() < 0.15:
            title = f"<header>{title}</header>" if not mute else title
        inner = [title] + [paragraph() for _ in range(r.randint(2, 12))]
        if r.random() < 0.25:
            inner.insert(r.randint(1, len(inner)), tag("aside", r.choice(["advert", "sidebar"]), r.choice([f"<p>{prose(1)}</p>", links(3)]) if not mute else links(2)))
        if r.random() < 0.25:
            inner.append(tag("footer", r.choice(["form", "menu", "footer"]), r.choice([links(3), f"<p>{phrase(1, 5)}</p>"])))
        if r.random() < 0.2 and not mute:
            inner.append(tag("section", "comments", "".join(comment() for _ in range(r.randint(1, 4)))))
        if r.random() < 0.3:
            inner = [f"<section>{x}</section>" if r.random() < 0.5 else x for x in inner]
        body = "".join(inner)
        shape = r.random()
        if not mute and shape < 0.45:
            body = f"<article>{body}</article>" if r.random() < 0.6 else f'<article class="{r.choice(WORDS["main text"])}">{body}</article>'
        elif not mute and shape < 0.6:
            body = f"<main>{body}</main>"
        elif not mute and shape < 0.85:
            body = f'<div {r.choice(["class", "id"])}="{r.choice(WORDS["main text"])}">{body}</div>'
        else:
            body = f'<div class="c{r.randint(1, 99)}">{body}</div>'
        def filled(*usual: str) -> str:
            """What a part of the page holds: as usual, or any prose where its name tells."""
            return r.choice(usual) if mute or r.random() < 0.6 else r.choice([f"<p>{prose(r.randint(1, 4))}</p>", prose(1), f"<p>{phrase(1, 6)}</p>"])

        for _ in range(r.choice([0, 0, 1, 2]) if not mute else 0):  # wrappers that name the main text again
            body = f'<div class="{r.choice(WORDS["main text"])}">{body}</div>'
        before = [tag("header", "header", filled(f"<h2>{phrase(0, 2)}</h2>", f"<p>{phrase(0, 3)}</p>", link(phrase(0, 1)))) for _ in range(r.random() < 0.6)]
        before += [tag("nav", "menu", filled(links(r.randint(3, 8)))) for _ in range(r.random() < 0.8)]
        before += [tag("div", "notice", filled(f"<p>{prose(r.randint(1, 2))}</p>")) for _ in range(not mute and r.random() < 0.4)]
        before += [tag("div", "advert", filled(phrase(1, 4), prose(1))) for _ in range(not mute and r.random() < 0.5)]
        after = [tag("aside", "sidebar", filled(links(r.randint(2, 6)))) for _ in range(r.random() < 0.6)]
        after += [tag("div", "comments", "".join(comment() for _ in range(r.randint(1, 4)))) for _ in range(not mute and r.random() < 0.4)]
        after += [tag("div", "form", filled(links(3), f"<p>{phrase(2, 6)}</p>")) for _ in range(not mute and r.random() < 0.3)]
        after += [tag("footer", "footer", r.choice(["&copy; ", "© ", ""]) + filled(phrase(1, 5), links(4))) for _ in range(r.random() < 0.8)]
        if r.random() < 0.3:
            r.shuffle(after)
        whole = "".join(before) + body + "".join(after)
        for _ in range(r.randint(0, 3)):
            whole = f"<div>{whole}</div>"
        return f"<html><head><title>{word()}</title></head><body>{whole}</body></html>", frozenset(main)

    return [page() for _ in range(n)]


@lru_cache(maxsize=1)
def trained(seed: int = 4711, n_fit: int = 500, n_choose: int = 300) -> Model:
    """The classifier and the strengths of the smoothness edges; the same on every run."""
    place, n = {t: i for i, t in enumerate(TOKENS)}, len(TOKENS)
    rows, good = [], []
    for page, main in labelled_pages(n_fit, seed):
        found, evidence = parse(page)
        for b in found:
            row = np.zeros(n + 2 * len(STATS) + 1)
            row[[place[t] for t in evidence[b.element]]] = 1
            row[n:] = statistics(b, not NAMING.isdisjoint(evidence[b.element]))
            rows.append(row), good.append(b.text.removeprefix("© ") in main)
    weights = fit_logistic(np.array(rows), np.array(good, float), ridge=2.0)
    tokens, stats = dict(zip(TOKENS, weights.tolist())), weights[n:-1].tolist()
    held = [(parse(page), main) for page, main in labelled_pages(n_choose, seed + 1)]
    best = None
    for near in (0.0, 0.5, 1.0, 2.0, 4.0):
        for decay in (0.2, 0.4):
            for sibling in (0.0, 0.5, 1.0):
                model = Model(tokens, stats, float(weights[-1]), near, decay, sibling * near)
                wrong = sum(c != (b.text.removeprefix("© ") in main) for (found, evidence), main in held for b, c in zip(found, label(model, found, evidence)))
                if best is None or wrong < best[0]:
                    best = (wrong, model)
    return best[1]


# --- the cut ---------------------------------------------------------------------------------------------------------


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut.

    A node i is joined to the source with capacity max(0, unary[i]), to the sink with max(0, -unary[i]); edges are
    symmetric.  Nodes whose terminal capacity exceeds all their edges are on its side in every minimum cut; they are
    settled first, their edges turning into terminal capacities of the neighbours.  What stays open falls into
    connected parts, each with a maximum flow of its own.
    """
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0.0) + c
            near[j][i] = near[j].get(i, 0.0) + c
    left, label, rest = list(unary), [None] * n, [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(left[i]) > rest[i]:
            label[i] = left[i] > 0
            for j, c in near[i].items():
                if label[j] is None:
                    left[j] += c if label[i] else -c
                    rest[j] -= c
                    queue.append(j)
    for start in range(n):
        if label[start] is None:
            part, todo = {start}, [start]
            while todo:
                for j in near[todo.pop()]:
                    if label[j] is None and j not in part:
                        part.add(j)
                        todo.append(j)
            side = _source_side(sorted(part), left, near, n)
            for i in part:
                label[i] = i in side
    return label


def _source_side(nodes: list[int], left: list[float], near: list[dict[int, float]], n: int) -> dict[int, int]:
    """The nodes that a maximum flow leaves reachable from the source (Dinic's blocking flows)."""
    source, sink, inside = n, n + 1, set(nodes)
    graph: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        graph[i] = {j: c for j, c in near[i].items() if j in inside}
    for i in nodes:
        graph[source][i], graph[i][source] = max(0.0, left[i]), 0.0
        graph[i][sink], graph[sink][i] = max(0.0, -left[i]), 0.0
    while True:
        level, todo = {source: 0}, deque([source])
        while todo:
            i = todo.popleft()
            for j, c in graph[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    todo.append(j)
        if sink not in level:
            return level
        ahead = {i: iter(list(graph[i])) for i in level}
        path = [source]
        while path:  # a blocking flow within the levels, one path after the other
            i = path[-1]
            if i == sink:
                flow = min(graph[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    graph[a][b] -= flow
                    graph[b][a] += flow
                path = [source]
                ahead[source] = iter(list(graph[source]))
                continue
            step = next((j for j in ahead[i] if graph[i][j] > 1e-9 and level.get(j) == level[i] + 1), None)
            if step is None:
                level.pop(i)
                path.pop()
            else:
                path.append(step)
                if step != sink:
                    ahead[step] = iter(list(graph[step]))


def label(model: Model, found: list[Block], evidence: list[frozenset[str]]) -> list[bool]:
    """Whether each block is content; all are where there is no element at all."""
    if len(evidence) == 1:
        return [True] * len(found)
    return minimum_cut(model.costs(found, evidence), model.edges(found))


def main_text(page: str | None, model: Model | None = None) -> str:
    """The main text of a page, one line per block."""
    found, evidence = parse(page or "")
    return "\n".join(b.text for b, content in zip(found, label(model or trained(), found, evidence)) if content)


def extract(pages: DataFrame, html_col: str = "html", model: Model | None = None) -> DataFrame:
    """pages with `text`, the main text of each."""
    model = model or trained()

    def fn(batch):
        return [pa.array([main_text(p, model) for p in batch.column(html_col).to_pylist()], pa.string())]

    return arrow_append(pages, [T.StructField("text", T.StringType())], html_col, fn)
