"""HTML extraction with wrappers: union-free regular expressions inferred for each host.

A page is a stream of container and block tags and of texts. Adjacent equal groups fold into repeated groups (a menu's items,
paragraphs), which gives its folded stream. Folded streams of one host are aligned one after another: where a stream and the
wrapper so far disagree, a group that only one of them has becomes optional, a group that one has once and the other several
times becomes repeated (its texts compare as one sequence), and texts that differ become slots; a text that is equal on all pages stays template text if at
least ``SUPPORT`` different pages have it (pages with the same headings and the same longest text are near copies and count once). The result is one expression without unions.

Tags whose class or id differ only in digits count as equal. No part of a page is left out: streams too long for one table are
aligned in pieces, cut at nodes that occur once in both. A wrapper grows with a host's different structure.

Inference is spread, and its result does not depend on how: pages of one host and one folded stream (a shape) merge text by
text, in any order; then a host's shapes align in the order of their hashes, ``MERGED`` a task at most, the results likewise,
until each host has one wrapper. No task holds a host's pages or all its shapes, and a hot host is no larger than others.

Extraction aligns a page's shape with its host's wrapper, which tells the page's slots from its template. The main container
is read from the wrapper, by the slots' text: from the page's root down, as long as one container holds ``MOST`` of it.
On this way the innermost ``article``, else the innermost ``main``, settles a tie between nested containers, as does a heading
that would be left outside. Text under an element that is a menu, header, footer, sidebar, notice, advert, form or comment list by tag,
role, class or id counts little (under ``article`` or ``main`` double), and is left out inside the main container; elements around the main container are never
judged by this. A bare ``header`` element is the page's, and left out, only where the main container is the body; inside an article
it holds the article's title. The page's text is the blocks of the main container that are slots, and template blocks that belong to
such: a heading with a slot under it (up to the next heading of its rank), the cells of a table or list of terms that has a slot. If all
blocks are template, they are the text. A page without text in that container (another kind of page) is read by its own wrapper.

Character references are decoded before texts are compared; white space inside a block becomes one space; blocks are joined by
an empty line. Defined results: null html counts as empty and gives the empty text; a page without markup is one block;
unclosed tags (``head`` and raw elements, too), cut pages and malformed markup never fail; a url without a host has the host "";
repeated rows get a row each, and add nothing to a wrapper; other columns are not read.
"""

from __future__ import annotations

import html as _html
import json
import operator
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeforge.llm.runtime import lean_batches, staged

_token = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z)|<[!?][^>]*+>)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|(?P<text>[^<]++|<)",
    re.S,
)
#: Elements whose content is no text of the page; one that is not closed is only a tag, but for scripts and styles, which go to the end.
RAW = frozenset("script style noscript template svg iframe textarea select title".split())
_raw_end = {t: re.compile(rf"</{t}\s*>" + (r"|(?=</head\b|<body\b|<meta\b|<link\b|<style\b|<script\b)" if t == "title" else ""), re.I) for t in RAW}
_named = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_unit = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_digits = re.compile(r"[0-9]+")
CONTAINERS = frozenset("div section article main nav header footer aside form ul ol dl table tbody thead tr figure blockquote dialog menu fieldset details center td th".split())
BLOCKS = CONTAINERS | frozenset("html body p li h1 h2 h3 h4 h5 h6 pre dt dd figcaption summary address caption hr legend".split())
DROPPED_TAGS = frozenset("nav header footer aside form dialog menu button fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead toolbar "
    "comment comments disqus reply replies discussion respond skip login".split()
)
#: Words that may stand beside a dropped word in one class without changing what it says (site-header, but not content-with-sidebar).
NEUTRAL_WORDS = frozenset("site page global main top bottom left right inner outer primary secondary box block bar list item items link links area section wrap wrapper container user reader module slot the".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose template blocks stay if another block of theirs is a slot.
WHOLE = frozenset("table dl".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOLD = 12
#: Cells of an alignment's table; longer streams are aligned in pieces.
MAX_CELLS = 160_000
#: Containers nested deeper than this are not told apart from the one they are in.
MAX_DEPTH = 100
#: Different pages that must agree on a text before it is template.
SUPPORT = 3
#: Share of the slots' text that a container must hold to be the main one, and what text counts under a dropped element, or under ``article`` or ``main``.
MOST, DROPPED_WEIGHT, NAMED_WEIGHT = 0.5, 0.1, 2.0
#: Shapes or wrappers that one task aligns.
MERGED = 64
#: Shapes a task holds before it hands them on.
HELD_SHAPES = 4_000
#: Bytes of wrappers up to which those of all hosts are broadcast; beyond, pages join them by host.
BROADCAST_BYTES = 48 << 20


def boilerplate(value: str) -> bool:
    """Whether one of the names in a class or id says so: all its words are neutral or dropped, one is dropped."""
    for name in value.split():
        words = {w.lower() for w in _unit.findall(name)}
        if not DROPPED_WORDS.isdisjoint(words) and words <= DROPPED_WORDS | NEUTRAL_WORDS:
            return True
    return False


def dropped(tag: str, attrs: str) -> bool:
    """Whether an element is boilerplate by its tag, role, class, id or by being hidden."""
    if tag in DROPPED_TAGS:
        return True
    for name, value in _named.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if boilerplate(value):
                return True
            continue
        value = value.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display" in value and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in DROPPED_ROLES:
            return True
    return False


def bare_header(tag: str, attrs: str) -> bool:
    """Whether an element is boilerplate only for being a ``header``."""
    return tag == "header" and not dropped("div", attrs)


def signature(tag: str, attrs: str) -> str:
    """A tag with its class or id, less digits, which tells containers of a template apart."""
    for name, value in _named.findall(attrs) if attrs else ():
        if name.lower() in ("class", "id") and value:
            return f"{tag}.{_digits.sub('0', value.strip('\"').strip(chr(39))).replace('>', '')}"
    return tag


def stream(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, attributes); kind: open, close or text."""
    at, match, unclosed, last = 0, _token.match, set(), page.rfind(">")
    while at < len(page):
        if at > last:  # no tag ends any more
            if not page.startswith("<!--", at):
                yield "text", page[at:], ""
            return
        m = match(page, at)
        at = m.end()
        if m["text"] is not None:
            yield "text", m["text"], ""
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag in RAW and not m["close"] and tag not in unclosed:
                end = _raw_end[tag].search(page, at)
                if end:
                    at = end.end()
                    continue
                unclosed.add(tag)  # nor is any later one closed
                if tag in ("script", "style"):
                    return
            yield ("close" if m["close"] else "open"), tag, m["attrs"]


# Nodes: ["t", tag's signature], ["x", text's digest or None for a slot, path, size, digests of pages that agree], ["?", nodes], ["+", nodes].
# A path is the signatures of the containers around a text, "-" before dropped ones ("~" before bare headers), and "|" and the block's tag.


def _key(node: list) -> str:
    return node[1] if node[0] == "t" else "#" if node[0] == "x" else node[0] + "(" + " ".join(map(_key, node[1])) + ")"


def _digest(text: str) -> str:
    return blake2b(text.encode(errors="surrogatepass"), digest_size=16).hexdigest()


class Page:
    """A page's unfolded nodes and its blocks of text, in order; text nodes end with the numbers of their blocks."""

    def __init__(self, page: str):
        self.nodes: list[list] = []
        self.blocks: list[str] = []
        self.paths: list[str] = []
        self.kinds: list[str] = []  # the tags of the blocks
        support = [""]
        text: list[str] = []
        open_: list[tuple[str, str]] = [("", "")]  # (tag, path) of containers and dropped blocks
        block, counts = "", Counter()
        for kind, tag, attrs in stream(page):
            if kind == "text":
                text.append(tag)
                continue
            if tag not in BLOCKS:
                if tag in VOID or kind == "open" and tag in ("button", "label"):
                    text.append(" ")
                continue
            if text:
                self._flush(text, open_[-1][1], block, support)
                text = []
            if open_[-1][0] not in CONTAINERS and (kind == "open" or tag == open_[-1][0]):
                if len(open_) > 1:  # a dropped block ends with its end tag or the next block
                    counts[open_.pop()[0]] -= 1
            if kind == "open":
                block = tag
                sign = signature(tag, attrs)
                self.nodes.append(["t", sign])
                gone = tag not in ("html", "body") and dropped(tag, attrs)
                if tag in CONTAINERS or gone and tag != "hr":
                    path = open_[-1][1]
                    if len(open_) <= MAX_DEPTH or gone and ">-" not in path:
                        path = f"{path}>{'~' if gone and bare_header(tag, attrs) else '-' if gone else ''}{sign}"
                    open_.append((tag, path))
                    counts[tag] += 1
            else:
                block = ""
                self.nodes.append(["t", "/" + tag])
                if tag in CONTAINERS and counts[tag]:
                    inner = None
                    while inner != tag:
                        inner = open_.pop()[0]
                        counts[inner] -= 1
        if text:
            self._flush(text, open_[-1][1], block, support)
        # near copies agree on their headings and their longest text: together they are one page that agrees
        heads = [b for b, k in zip(self.blocks, self.kinds) if k in HEADINGS]
        support[0] = _digest("\n".join([*heads, max(self.blocks, key=lambda b: (len(b), b), default="")]))[:16]

    def _flush(self, text: list[str], path: str, block: str, support: list[str]) -> None:
        whole = "".join(text)
        whole = " ".join((_html.unescape(whole) if "&" in whole else whole).split())
        if whole:
            self.nodes.append(["x", _digest(whole), f"{path}|{block}", len(whole), support, [len(self.blocks)]])
            self.blocks.append(whole)
            self.paths.append(path)
            self.kinds.append(block)


def fold(nodes: list[list]) -> list[list]:
    """Adjacent equal groups of up to FOLD nodes become one repeated group, short groups first."""
    keys = list(map(_key, nodes))
    for size in range(1, FOLD + 1):
        if not any(map(operator.eq, keys, keys[size:])):
            continue
        out: list[list] = []
        i, n = 0, len(nodes)
        while i < n:
            times = 1
            if i + size < n and keys[i] == keys[i + size] and keys[i] != "#":
                group = keys[i : i + size]
                while keys[i + times * size : i + (times + 1) * size] == group and not (size == 1 and group[0][0] not in "?+"):
                    times += 1
            if times > 1:
                body = nodes[i : i + size]
                for t in range(1, times):
                    body = _chained(body, nodes[i + t * size : i + (t + 1) * size])
                out.append(["+", body] if not (size == 1 and body[0][0] == "+") else body[0])
                i += times * size
            else:
                out.append(nodes[i])
                i += 1
        if len(out) < len(nodes):
            nodes = out
            keys = list(map(_key, nodes))
    return nodes


def _shared(a: str, b: str) -> str:
    """The path of the containers that two paths share."""
    if a == b:
        return a
    (x, p), (y, q) = a.rsplit("|", 1), b.rsplit("|", 1)
    same = []
    for u, v in zip(x.split(">"), y.split(">")):
        if u != v:
            break
        same.append(u)
    return ">".join(same) + "|" + (p if p == q else "")


def _same(a: list[list], b: list[list]) -> list[list]:
    """Two node lists of equal keys, of different pages, as one: texts that differ become slots, sizes add up. The same in any order."""
    out = []
    for x, y in zip(a, b):
        if x[0] == "x":
            equal = x[1] is not None and x[1] == y[1]
            pages = (x[4] if x[4] == y[4] else sorted({*x[4], *y[4]})[:SUPPORT]) if equal else []
            out.append(["x", x[1] if equal else None, _shared(x[2], y[2]), x[3] + y[3], pages])
        elif x[0] == "t":
            out.append(x)
        else:
            out.append([x[0], _same(x[1], y[1])])
    return out


def _chained(a: list[list], b: list[list]) -> list[list]:
    """Two occurrences of a group on one page as one; a text stands for all its occurrences, in their order."""
    out = []
    for x, y in zip(a, b):
        if x[0] == "x":
            out.append(["x", _digest(x[1] + y[1]), _shared(x[2], y[2]), x[3] + y[3], x[4], x[5] + y[5]])
        else:
            out.append(x if x[0] == "t" else [x[0], _chained(x[1], y[1])])
    return out


def _cores(a: list[list], b: list[list]) -> tuple:
    """Both streams with their repeated groups brought in line, the groups inside their nodes, and pairs of places that match."""
    a, b = _repeat_like(a, b), _repeat_like(b, a)
    core = [x[1] if x[0] == "?" else [x] for x in a], [x[1] if x[0] == "?" else [x] for x in b]
    ka, kb = ([" ".join(map(_key, g)) for g in side] for side in core)
    return a, b, core, _matches(ka, kb)


def align(a: list[list], b: list[list]) -> list[list]:
    """The least union-free expression found that covers both: equal nodes merge, a repeated group takes single occurrences, the rest is optional."""
    a, b, core, pairs = _cores(a, b)
    out, i, j = [], 0, 0
    for u, v in [*pairs, (len(a), len(b))]:
        out += [["?", g] for g in core[0][i:u]] + [["?", g] for g in core[1][j:v]]
        if u < len(a):
            body = _same(core[0][u], core[1][v])
            out += [["?", body]] if "?" in (a[u][0], b[v][0]) else body
        i, j = u + 1, v + 1
    return out


def leaves(nodes: list[list]) -> Iterator[list]:
    """The text nodes."""
    for x in nodes:
        if x[0] == "x":
            yield x
        elif x[0] != "t":
            yield from leaves(x[1])


def template_of(wrapper: list[list], shape: list[list]) -> list[str | None]:
    """For each text node of a folded page the template text that the wrapper has at its place, or None."""
    a, b, core, pairs = _cores(wrapper, shape)
    found: dict[int, str | None] = {}
    for u, v in pairs:
        for x, y in zip(leaves(core[0][u]), leaves(core[1][v])):
            found[id(y)] = x[1] if x[1] is not None and len(x[4]) >= SUPPORT else None
    return [found.get(id(y)) for y in leaves(b)]


def _matches(ka: list[str], kb: list[str]) -> list[tuple[int, int]]:
    """Increasing pairs of places with equal keys: the most there are, but for streams that are cut in pieces."""
    done: list[tuple[int, int]] = []
    todo = [(0, len(ka), 0, len(kb))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and ka[i] == kb[j]:
            done.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and ka[n - 1] == kb[m - 1]:
            n, m = n - 1, m - 1
            done.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= MAX_CELLS:
            done += _table(ka, kb, i, n, j, m)
            continue
        once = [{k: at for at, k in enumerate(side) if count[k] == 1} for side in (ka[i:n], kb[j:m]) for count in [Counter(side)]]
        both = [(i + at, j + once[1][k]) for k, at in once[0].items() if k in once[1]]
        u, v = min(both, key=lambda x: abs(2 * x[0] - i - n) + abs(2 * x[1] - j - m), default=((i + n) // 2, (j + m) // 2))
        if not both and min(n - i, m - j) == 1:  # one node against very many
            side = (ka.index(kb[j], i, n), j) if m - j == 1 and kb[j] in ka[i:n] else (i, kb.index(ka[i], j, m)) if n - i == 1 and ka[i] in kb[j:m] else None
            done += [side] if side else []
            continue
        todo += [(i, u, j, v), (u, n, v, m)]
    return sorted(done)


def _table(ka: list[str], kb: list[str], i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two slices, as pairs of places."""
    a, b = ka[i:n], kb[j:m]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a) - 1, -1, -1):
        row, below = best[x], best[x + 1]
        for y in range(len(b) - 1, -1, -1):
            row[y] = below[y + 1] + 1 if a[x] == b[y] else max(below[y], row[y + 1])
    out, x, y = [], 0, 0
    while x < len(a) and y < len(b):
        if a[x] == b[y]:
            out.append((i + x, j + y))
            x, y = x + 1, y + 1
        elif best[x + 1][y] >= best[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def _repeat_like(nodes: list[list], other: list[list]) -> list[list]:
    """Single occurrences of groups that ``other`` repeats become repeated."""
    for body in (x[1] for x in other if x[0] == "+"):
        group = list(map(_key, body))
        k, i, out = len(group), 0, []
        while i < len(nodes):
            if len(nodes) - i >= k and list(map(_key, nodes[i : i + k])) == group:
                out.append(["+", nodes[i : i + k]])
                i += k
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def main_container(wrapper: list[list]) -> str:
    """The path of the container that holds most of the slots' text; see the module's docstring."""
    below: dict[str, float] = {}
    heads: set[str] = set()
    for x in leaves(wrapper):
        if x[1] is not None and len(x[4]) >= SUPPORT:
            continue
        path, block = x[2].rsplit("|", 1)
        parts = path.split(">")
        gone = any(p.startswith(("-", "~")) for p in parts)
        weight = x[3] * (DROPPED_WEIGHT if gone else NAMED_WEIGHT if any(p.split(".")[0] in ("article", "main") for p in parts) else 1.0)
        if block in ("h1", "h2") and not gone:
            heads.add(path)
        for k in range(1, len(parts) + 1):
            at = ">".join(parts[:k])
            below[at] = below.get(at, 0.0) + weight
    total, at, way = below.get("", 0.0), "", [""]
    children: dict[str, list[str]] = {}
    for p in below:
        if p:
            children.setdefault(p.rsplit(">", 1)[0], []).append(p)
    while True:
        nxt = max(children.get(at, ()), key=lambda p: (below[p], p), default=None)
        if nxt is None or below[nxt] < MOST * total:
            break
        at = nxt
        way.append(at)
    tags = [p.rsplit(">", 1)[-1].lstrip("-~").split(".")[0] for p in way]
    for tag in ("article", "main"):
        if tag in tags:
            return way[len(tags) - 1 - tags[::-1].index(tag)]
    inside = lambda h, p: h == p or h.startswith(p + ">")
    while len(way) > 1 and any(inside(h, way[-2]) and not inside(h, way[-1]) for h in heads):
        way.pop()
    return way[-1]


def _whole(path: str) -> str | None:
    """The innermost table or list of terms that a block is in."""
    parts = path.split(">")
    for k in range(len(parts), 0, -1):
        if parts[k - 1].split(".")[0] in WHOLE:
            return ">".join(parts[:k])
    return None


def _kept(page: Page, main: str, template: set[int]) -> tuple[list[str], bool]:
    """The blocks of a container that are slots or belong to one (if there are none, all), and whether there were any."""
    body = main.rsplit(">", 1)[-1].split(".")[0] in ("", "html", "body")
    inside = []
    for i, path in enumerate(page.paths):
        if path == main or path.startswith(main + ">"):
            rest = path[len(main) :]
            if ">-" not in rest and not (body and ">~" in rest):
                inside.append(i)
    if not any(i not in template for i in inside):
        return [page.blocks[i] for i in inside], bool(inside)
    whole = {_whole(page.paths[i]) for i in inside if i not in template} - {None}
    out, live = [], [False] * 7  # live[k]: a block stays before the next heading of rank k or higher
    for i in reversed(inside):
        kind = page.kinds[i]
        rank = int(kind[1]) if kind in HEADINGS else 0
        stays = i not in template or rank and live[rank] or _whole(page.paths[i]) in whole
        if rank:
            live[rank:] = [False] * (7 - rank)
        if stays:
            out.append(page.blocks[i])
            live[: rank or 7] = [True] * (rank or 7)
    return out[::-1], True


class Extractor:
    """A host's wrapper as extraction uses it; the templates of shapes are kept."""

    def __init__(self, wrapper: list[list]):
        self.wrapper, self.main = wrapper, main_container(wrapper)
        self.templates: dict[str, list[str | None]] = {}

    def __call__(self, html: str) -> str:
        page = Page(html)
        if not page.blocks:
            return ""
        shape = fold(page.nodes)
        key = " ".join(map(_key, shape))
        of = self.templates.get(key)
        if of is None:
            of = template_of(self.wrapper, shape) if self.wrapper else [None] * sum(1 for _ in leaves(shape))
            if len(self.templates) < HELD_SHAPES:
                self.templates[key] = of
        template = {i for y, text in zip(leaves(shape), of) if text == y[1] for i in y[5]}
        kept, any_ = _kept(page, self.main, template)
        if not any_:
            kept, any_ = _kept(page, main_container(shape), set())
        return "\n\n".join(kept)


def infer(pages: list[str]) -> list[list]:
    """The wrapper of a few pages, as infer_wrappers makes it of many."""
    shapes: dict[str, list[list]] = {}
    for page in pages:
        key, nodes = _shape(page)
        shapes[key] = _same(shapes[key], nodes) if key in shapes else nodes
    out: list[list] = []
    for _, nodes in sorted(shapes.items(), key=lambda x: _digest(x[0])):
        out = align(out, nodes) if out else nodes
    return out


def extract(page: str, wrapper: list[list] | None = None) -> str:
    """The main text of a page by its host's wrapper (without one: by the page's own)."""
    return Extractor(infer([page]) if wrapper is None else wrapper)(page) if page else ""


def _bare(nodes: list[list]) -> list[list]:
    """Without the numbers of blocks."""
    return [x[:5] if x[0] == "x" else x if x[0] == "t" else [x[0], _bare(x[1])] for x in nodes]


def _shape(page: str) -> tuple[str, list[list]]:
    nodes = _bare(fold(Page(page).nodes))
    return " ".join(map(_key, nodes)), nodes


_host = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_kind = "host string, shape string, wrapper string"


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, shape, wrapper) from (host, html): each host's wrapper as JSON; shape is of no further use."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[tuple[str, str], list[list]] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                if page.as_py():
                    key, nodes = _shape(page.as_py())
                    at = host, _digest(key)
                    shapes[at] = _same(shapes[at], nodes) if at in shapes else nodes
            if len(shapes) > HELD_SHAPES:
                yield rows(shapes)
                shapes = {}
        yield rows(shapes)

    def rows(shapes: dict[tuple[str, str], list[list]]) -> pa.RecordBatch:
        columns = list(zip(*((h, s, json.dumps(w)) for (h, s), w in shapes.items()))) if shapes else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "shape", "wrapper"])

    def same(of: pa.Table) -> pa.Table:
        out: list[list] = []
        for w in of["wrapper"].to_pylist():
            out = _same(out, json.loads(w)) if out else json.loads(w)
        return pa.table({"host": of["host"][:1], "shape": of["shape"][:1], "wrapper": [json.dumps(out)]})

    def aligned(of: pa.Table) -> pa.Table:
        rows = sorted(zip(of["shape"].to_pylist(), of["wrapper"].to_pylist()))
        out: list[list] = []
        for _, w in rows:
            out = align(out, json.loads(w)) if out else json.loads(w)
        return pa.table({"host": of["host"][:1], "shape": [rows[0][0]], "wrapper": [json.dumps(out)]})

    found = staged(pages.select("host", "html").mapInArrow(partial, _kind).groupBy("host", "shape").applyInArrow(same, _kind), "page-shapes")
    while True:
        counts = staged(found.groupBy("host").agg(F.count("*").alias("n")), "shape-counts")  # a row a host
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found
        salted = found.join(counts, "host").withColumn("salt", F.pmod(F.xxhash64("shape", "n"), F.ceil(F.col("n") / MERGED)))
        found = staged(salted.groupBy("host", "salt").applyInArrow(lambda of: aligned(of), _kind), "wrappers")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    spark = pages.sparkSession
    lean_batches(spark)
    id_, url, html = (F.col(f"`{c}`") for c in (id_col, url_col, html_col))
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _host, 1))
    plain = pages.select(id_.cast("long").alias("page_id"), url.cast("string").alias("url"), F.coalesce(html.cast("string"), F.lit("")).alias("html"), host.alias("host"))
    found = infer_wrappers(plain).select("host", "wrapper")
    size = found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    kind = "page_id bigint, url string, text string, n_chars bigint"

    def texts(batches: Iterator[pa.RecordBatch], wrappers) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, Extractor] = {}
        for batch in batches:
            out = []
            for i, (host, page) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2))):
                if host not in hosts:
                    if len(hosts) > HELD_SHAPES:
                        hosts.clear()
                    found = wrappers(batch, i, host)
                    hosts[host] = Extractor(json.loads(found) if found else [])
                out.append(hosts[host](page.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.collect()})
        return plain.mapInArrow(lambda batches: texts(batches, lambda batch, i, host: shared.value.get(host)), kind)
    joined = plain.join(found, "host", "left").select("page_id", "url", "html", "host", "wrapper")
    return joined.mapInArrow(lambda batches: texts(batches, lambda batch, i, host: batch.column(4)[i].as_py()), kind)
