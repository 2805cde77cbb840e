"""Main text of web pages by wrapper induction.

For each host, up to SAMPLES pages (chosen by a digest, so bounded whatever the host's size) are parsed into DOM trees and
aligned pairwise by simple tree matching. Text nodes that are aligned and equal are constant. Besides, the (path, text)
digests of all pages of a host are counted, once a page, whatever elements they stand in: those on COMMON_SHARE of the pages are
constant as well, unless the pages that hold one agree in most of their content, as copies do. Inside articles only what
INSIDE_SHARE of the host's pages have in common is constant, so copies of an article, and what articles quote, stay.

The alignment also tells which containers are part of the template: those that stand once on each sampled page, in one place. Over
all pages of the host the varying text below each of them, links apart, is summed up; from the root, the wrapper enters a
container as long as it holds REGION_SHARE of that text (where no container does, text under elements that mark page
furniture is left out of account). The container where that ends is the host's region, whatever its tag and its names: its
varying slots, and the headings right before it, are content; all else is template.

Marks of furniture (elements, roles, whole class names) decide alone only for what no wrapper can tell: hosts with a single page,
pages without the region, hosts without one; there a page with an article (or main) element has its content in it, unless the
wrapper leaves more text outside. Within the content they tell what was added to it: menus, forms, adverts, reader comments; of
an article's own header headings and sentences stay.

A text's blocks are the runs of text between block elements; white space in a block becomes one blank, a line break element
counts as white space, and blocks are joined by line feeds. Defined cases: null or empty html gives an empty text; a null
or unreadable url is a host of its own kind; unclosed and stray tags are repaired as browsers do for paragraphs, list items
and table cells; a tag with a quote that never closes ends at its next ">"; pages may be of any depth; repeated rows are handled one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, read, small_join, tidy

SAMPLES = 4
#: Pages that agree in more than this share of their content (the article's, if there is one) are copies and teach nothing.
COPY_SHARE = 0.8
#: Digests on fewer of a host's pages aren't counted as constant, which bounds a wrapper whatever the host's size.
COMMON_SHARE = 0.05
#: Inside articles, where authors repeat themselves: at least this share, and INSIDE_PAGES.
INSIDE_SHARE, INSIDE_PAGES = 0.3, 3
#: On half of a host's pages, if it has WIDE or more, a text is no article's copy: WIDE_COPY_SHARE holds (short texts in long templates).
WIDE, WIDE_COPY_SHARE = 8, 0.95
#: What paths inside an article start with.
ARTICLE = "@"
#: A container is entered while it holds this share of the varying text around it.
REGION_SHARE = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul video audio".split())
CODE = frozenset("script style noscript template head title iframe svg object embed canvas".split())
FURNITURE = CODE | frozenset("nav header footer aside form button select input textarea menu dialog label".split())
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
#: Names of furniture, as the last part of a class name or id: what sites, advertisers and readers add to any page, ...
ADDED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments respond replies disqus share sharing newsletter nav navigation menu sidebar breadcrumb breadcrumbs pagination pager related recommended toolbar".split())
#: ... what is theirs unless it stands inside an article, where the name may be the author's, ...
NAMED = ADDED | frozenset("banner cookie cookies consent notice notices alert popup modal overlay subscribe signup login masthead header footer widget widgets social recommendations skiplink copyright legal".split())
#: ... and inside articles only if it is the whole name.
WHOLE = frozenset("notice alert popup modal banner subscribe signup login cookie-banner cookie-notice cookie-bar cookie-consent".split())
#: Parts of names that say where or in what form a thing stands, after its name, and whose it is, before it.
FORMS = frozenset("left right top bottom bar box list area section block wrapper wrap container inner outer item items link links button buttons posts articles stories news".split())
OWNERS = frozenset("site page main post article entry blog wp social global top bottom side user reader google cookie big".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: A comment, a declaration, a tag, or (a quote that never closes) a tag that ends at the next ">".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "mark", "kids", "shape")

    def __init__(self, tag: str, mark: str):
        self.tag, self.mark, self.kids, self.shape = tag, mark, [], 0


class _Open:
    """The open elements of a parse, with their number by tag, so that looking for one that isn't open costs nothing."""

    def __init__(self, root: Node):
        self.stack, self.count = [root], Counter()

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.tag] += 1

    def close(self, tags: set[str], stops: set[str] | frozenset[str] = frozenset()) -> None:
        """Close the innermost element of these tags and all inside it, unless one of ``stops`` is open inside it."""
        for t in tags:
            if self.count.get(t):
                break
        else:
            return
        stack = self.stack
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for node in stack[i:]:
                    self.count[node.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in stops:
                return


def parse(page: str) -> Node:
    """A repaired DOM tree of any depth; children are nodes and strings (character references decoded)."""
    root = Node("", "")
    held = _Open(root)
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            held.stack[-1].kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] if m[3] is not None else m[4]
        if m[1]:
            held.close({tag})
            continue
        if tag in BLOCK and held.count.get("p"):
            held.close({"p"}, BLOCK)  # a block ends an open paragraph
        if tag in CLOSES:
            held.close(CLOSES[tag], STOPS[tag])
        mark = ""
        if attributes:
            mark = " ".join(f"{a[0].lower()}={a[1] or a[2] or a[3]}" for a in _ATTR.findall(attributes)).lower()
        node = Node(tag, mark)
        held.stack[-1].kids.append(node)
        if tag in VOID:  # no other element closes itself, whatever its tag ends in
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.kids.append(page[at : close.start()] if close else page[at:])
            at = close.end() if close else end
            continue
        held.push(node)
    return root


@lru_cache(1 << 14)
def _marked(mark: str, inside: bool) -> bool:
    if "hidden=" in mark and ("aria-hidden=true" in mark or re.search(r"(^| )hidden=", mark)):
        return True
    for part in mark.split(" "):
        if part.startswith("role="):
            if part[5:] in ROLES:
                return True
            continue
        name = part.removeprefix("class=").removeprefix("id=")
        if inside and name in WHOLE:
            return True
        parts = [x for x in re.split(r"[-_\d]+", name) if x]
        while len(parts) > 1 and parts[-1] in FORMS:
            parts.pop()
        if parts and parts[-1] in (ADDED if inside else NAMED) and all(x in OWNERS for x in parts[:-1]):
            return True
    return False


def furniture(node: Node, inside: bool) -> bool:
    """Whether an element marks menus, headers, footers, sidebars, notices, adverts, forms, scripts or comments.

    Inside articles only elements, roles and the names of what readers and advertisers add count; there, other names are the author's.
    """
    if node.tag in FURNITURE:
        return True
    return bool(node.mark) and node.tag not in ("html", "body", "article", "main") and _marked(node.mark, inside)


def _sentence(node: Node) -> bool:
    """Whether the text of a paragraph ends as sentences do: a lead, not a byline or a date."""
    words, stack = [], [node]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            words.append(k)
        elif not furniture(k, True):
            stack += reversed(k.kids)
    return "".join(words).rstrip().endswith((".", "!", "?", "…", "。", '."', ".”", "?”", "!”"))


def headings(node: Node) -> list[Node]:
    """The outermost headings and sentences below a node, outside furniture: what an article's own header adds to its text."""
    out, stack = [], list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, Node) and (k.tag in HEADINGS or k.tag == "p" and not furniture(k, True) and _sentence(k)):
            out.append(k)
        elif isinstance(k, Node) and not furniture(k, True):
            stack += reversed(k.kids)
    return out


def _squeeze(text: str) -> str:
    return " ".join(text.split())


class Matcher:
    """Simple tree matching of the pages of a host: the largest order-keeping matching of equal tags, level by level.

    Subtrees that are equal but for their texts have one shape; the matching of two shapes is weighed once, from the leaves
    up and without recursion, so deep pages and long lists of like items cost no more than their distinct shapes.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.kids: list[tuple[int, ...]] = []
        self.tags: list[str] = []
        self.marks: list[str] = []
        self.weights: dict[tuple[int, int], int] = {}

    def shape(self, root: Node) -> None:
        """Number the shapes of a tree; 0 is a text."""
        if not self.kids:
            self._number("#text", "", ())
        stack: list[tuple[Node, bool]] = [(root, False)]
        while stack:
            node, ready = stack.pop()
            if not ready:
                stack.append((node, True))
                stack += [(k, False) for k in node.kids if isinstance(k, Node)]
                continue
            node.shape = self._number(node.tag, node.mark, tuple(k.shape if isinstance(k, Node) else 0 for k in _solid(node)))

    def _number(self, tag: str, mark: str, kids: tuple[int, ...]) -> int:
        key = (tag, mark, kids)
        if key not in self.known:
            self.known[key] = len(self.kids)
            self.kids.append(kids)
            self.tags.append(tag)
            self.marks.append(mark)
        return self.known[key]

    def _missing(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        ys = set(y)
        return [(p, q) for p in set(x) for q in ys if p and q and p != q and self.tags[p] == self.tags[q] and (p, q) not in self.weights]

    def weight(self, a: int, b: int) -> int:
        """Size of the matching of two shapes, a match of equal attributes counting more (0: their roots differ)."""
        if a == b or not a or not b or self.tags[a] != self.tags[b]:
            return self._same(a) if a == b else 0
        stack = [(a, b)]
        while stack:
            pair = stack[-1]
            if pair in self.weights:
                stack.pop()
                continue
            x, y, first = self._middle(self.kids[pair[0]], self.kids[pair[1]])
            if todo := self._missing(x, y):
                stack += todo
                continue
            stack.pop()
            kids = self.kids[pair[0]]
            ends = [*kids[:first], *kids[first + len(x) :]]
            self.weights[pair] = 1 + (self.marks[pair[0]] == self.marks[pair[1]]) + sum(map(self._same, ends)) + (int(self._table(x, y)[-1][-1]) if x and y else 0)
        return self.weights[a, b]

    def _same(self, a: int) -> int:
        """Weight of a shape against itself."""
        stack = [a]
        while stack:
            p = stack[-1]
            if (p, p) in self.weights:
                stack.pop()
            elif todo := [k for k in set(self.kids[p]) if (k, k) not in self.weights]:
                stack += todo
            else:
                self.weights[p, p] = 1 if not p else 2 + sum(self.weights[k, k] for k in self.kids[p])
        return self.weights[a, a]

    @staticmethod
    def _middle(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], int]:
        """Both lists without their equal ends, and the length of the equal beginning."""
        i, n = 0, min(len(x), len(y))
        while i < n and x[i] == y[i]:
            i += 1
        j = 0
        while j < n - i and x[-1 - j] == y[-1 - j]:
            j += 1
        return x[i : len(x) - j], y[i : len(y) - j], i

    def _scores(self, x: tuple[int, ...], y: tuple[int, ...]) -> np.ndarray:
        """Weights of all pairs of distinct shapes; rows and columns as in sorted(set(x)) and sorted(set(y))."""
        return np.array([[self.weight(p, q) if p == q or p and q and self.tags[p] == self.tags[q] else 0 for q in sorted(set(y))] for p in sorted(set(x))], np.int64)

    def _table(self, x: tuple[int, ...], y: tuple[int, ...], last_only: bool = True) -> list[np.ndarray]:
        """Rows of the dynamic programme over two lists; only the last one unless all are asked for."""
        score = self._scores(x, y)
        at, to = {p: i for i, p in enumerate(sorted(set(x)))}, np.searchsorted(sorted(set(y)), y)
        row = np.zeros(len(y) + 1, np.int64)
        rows = [row]
        for p in x:
            best = row.copy()
            best[1:] = np.maximum(row[1:], row[:-1] + score[at[p]][to])
            row = np.maximum.accumulate(best)
            if last_only:
                rows[0] = row
            else:
                rows.append(row)
        return rows

    def pairs(self, x: tuple[int, ...], y: tuple[int, ...], cells: int = 1 << 22) -> list[tuple[int, int]]:
        """Places of the matched pairs of the best order-keeping matching; long lists are halved, so space stays linear."""
        out: list[tuple[int, int]] = []
        work = [(0, len(x), 0, len(y))]
        while work:
            a, b, c, d = work.pop()
            if a == b or c == d:
                continue
            if (b - a) * (d - c) > cells and b - a > 1:
                mid = (a + b) // 2
                left = self._table(x[a:mid], y[c:d])[-1]
                right = self._table(x[mid:b][::-1], y[c:d][::-1])[-1][::-1]
                cut = c + int(np.argmax(left + right))
                work += [(a, mid, c, cut), (mid, b, cut, d)]
                continue
            rows = self._table(x[a:b], y[c:d], last_only=False)
            p, q = b - a, d - c
            while p and q:
                if rows[p][q] == rows[p - 1][q]:
                    p -= 1
                elif rows[p][q] == rows[p][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    out.append((a + p, c + q))
        return out

    def align(self, a: Node, b: Node) -> list[tuple[object, object]]:
        """Matched children of two matched nodes."""
        u, v = _solid(a), _solid(b)
        x, y, i = self._middle(self.kids[a.shape], self.kids[b.shape])
        after = len(u) - i - len(x)
        out = list(zip(u[:i], v[:i], strict=True)) + (list(zip(u[-after:], v[-after:], strict=True)) if after else [])
        return out + [(u[i + p], v[i + q]) for p, q in self.pairs(x, y)]


def _solid(node: Node) -> list[object]:
    """Children but for blank texts."""
    return [k for k in node.kids if isinstance(k, Node) or k.strip()]


#: Where a text stands: whether inside an article, and a digest of the elements around it.
Path = tuple[bool, bytes]
TOP: Path = (False, b"")


def _digest(path: Path, text: str) -> str:
    """Starts with ARTICLE for a text inside an article."""
    return (ARTICLE if path[0] else "") + hashlib.blake2b(path[1] + text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def _enter(path: Path, node: Node) -> Path:
    """The path inside a node."""
    opens = not path[0] and node.tag in ("article", "main")
    return path[0] or opens, _inner(path[1], node.tag, node.mark)


@lru_cache(1 << 16)
def _inner(path: bytes, tag: str, mark: str) -> bytes:
    return hashlib.blake2b(path + f"/{tag} {_stable(mark)}".encode("utf-8", "replace"), digest_size=8).digest()


@lru_cache(1 << 14)
def _stable(mark: str) -> str:
    """The names of a mark without those that hold digits, as names of single pages do."""
    return " ".join(x for x in mark.split(" ") if not re.search(r"\d", x))


def flow(root: Node, every: bool = False) -> Iterator[tuple[Path, str] | None]:
    """(path, text) of a page's texts outside furniture, or of ``every`` text but code, in their order; None ends a block."""
    # (node, path) to enter, or None to end a block; an explicit stack bears any depth
    return _flow([(root, TOP)], root, every)


def _flow(stack: list[tuple[object, Path]], root: Node | None, every: bool = False, within: bool = False) -> Iterator[tuple[Path, str] | None]:
    while stack:
        k, path = stack.pop()
        if k is None:
            yield None
        elif isinstance(k, str):
            yield path, k
        elif k.tag == "br":
            yield path, " "
        elif not every and (path[0] or within) and k.tag == "header":
            stack += [(x, _enter(path, k)) for x in reversed(headings(k))]
        elif k.tag not in CODE if every else not furniture(k, path[0] or within):
            here = path if k is root else _enter(path, k)
            if k.tag in BLOCK:
                yield None
                stack.append((None, TOP))
            stack += [(x, here) for x in reversed(k.kids)]


def nodes(root: Node) -> Iterator[tuple[Node, Path, list[object]]]:
    """(element, path, its siblings) of all elements but code, in their order."""
    stack: list[tuple[Node, Path, list[object]]] = [(root, TOP, [])]
    while stack:
        node, path, beside = stack.pop()
        yield node, path, beside
        stack += [(k, _enter(path, k), node.kids) for k in reversed(node.kids) if isinstance(k, Node) and k.tag not in CODE]


def region_flow(root: Node, region: str) -> Iterator[tuple[Path, str] | None]:
    """flow() of a page's region and the headings right before it in the same container."""
    for node, path, beside in nodes(root):
        if node.tag in CONTAINERS and path[1].hex() == region:
            before: list[Node] = []
            for k in beside:
                if k is node:
                    break
                before = [*before, k] if isinstance(k, Node) and k.tag in HEADINGS else before if isinstance(k, str) and not k.strip() else []
            for k in [*before, node]:
                yield from _flow([(x, path) for x in reversed(k.kids)], None, within=True)
                yield None


def constants(matcher: Matcher, a: Node, b: Node) -> tuple[set[str], int, int]:
    """Digests of the texts outside articles that two aligned pages share in place, and the characters of content shared and in all of a."""
    found: set[str] = set()
    shared = {False: 0, True: 0}
    stack = [(a, b, TOP)]
    while stack:
        x, y, path = stack.pop()
        for p, q in matcher.align(x, y):
            if isinstance(p, str) and isinstance(q, str):
                if _squeeze(p) == _squeeze(q):
                    if not path[0]:  # two pages are too few to judge those
                        found.add(_digest(path, _squeeze(p)))
                    shared[path[0]] += len(_squeeze(p))
            elif isinstance(p, Node) and isinstance(q, Node) and p.tag not in CODE:
                stack.append((p, q, _enter(path, p)))
    total = {False: 0, True: 0}
    for path, text in filter(None, flow(a, True)):
        total[path[0]] += len(_squeeze(text))
    inside = total[True] > 0
    return found, shared[inside], total[inside]


def induce(pages: list[str]) -> list[str]:
    """The constant texts of a host from sampled pages: what any two of them, unless copies, have in common in place."""
    return learn_template(pages)[0]


def learn_template(pages: list[str]) -> tuple[list[str], list[str]]:
    """(constant texts, containers of the template) of a host from sampled pages; containers by their paths, none from a single page."""
    matcher, trees = Matcher(), [parse(p) for p in pages]
    for t in trees:
        matcher.shape(t)
    out: set[str] = set()
    places: set[str] = set()
    for i, a in enumerate(trees):
        for b in trees[:i]:
            found, shared, total = constants(matcher, a, b)
            if total and shared <= COPY_SHARE * total:
                out |= found
            places |= aligned_containers(matcher, a, b)
    for t in trees:
        times = Counter(path[1].hex() for node, path, _ in nodes(t) if node.tag in CONTAINERS)
        places -= {p for p, n in times.items() if n > 1}
    return sorted(out), sorted(places)


def aligned_containers(matcher: Matcher, a: Node, b: Node) -> set[str]:
    """Paths of the containers of two pages that are aligned and stand at one path on both."""
    out: set[str] = set()
    stack = [(a, b, TOP, TOP)]
    while stack:
        x, y, p, q = stack.pop()
        for u, v in matcher.align(x, y):
            if isinstance(u, Node) and isinstance(v, Node) and u.tag in CONTAINERS:
                here, there = _enter(p, u), _enter(q, v)
                if here == there:
                    out.add(here[1].hex())
                    stack.append((u, v, here, there))
    return out


def masses(page: str, wrapper: set[str] | frozenset[str], places: set[str] | frozenset[str]) -> dict[str, list]:
    """By container of the template: [container around it, tag, characters of varying text below it but in links, the same outside marked furniture]."""
    out: dict[str, list] = {"": [None, "", 0, 0]}
    stack: list[tuple[object, Path, tuple[str, ...], bool]] = [(parse(page), TOP, ("",), False)]
    while stack:
        k, path, around, marked = stack.pop()
        if isinstance(k, str):
            text = _squeeze(k)
            if text and _digest(path, text) not in wrapper:
                for p in around:
                    out[p][2] += len(text)
                    out[p][3] += 0 if marked else len(text)
        elif k.tag not in CODE and k.tag != "a":
            here = path if not k.tag else _enter(path, k)
            if k.tag in CONTAINERS and (name := here[1].hex()) in places and name not in out:
                out[name] = [around[-1], k.tag, 0, 0]
                around = (*around, name)
            marked = marked or bool(k.tag) and furniture(k, here[0])
            stack += [(x, here, around, marked) for x in k.kids]
    return out


def choose_region(rows: list[tuple[str, str | None, str, int, int]]) -> str | None:
    """The region of a host from the sums of (container, container around it, tag, varying text, the same outside furniture); null for none."""
    about = {r[0]: r for r in rows}
    now, inner = "", True
    while inner and about[now][2] not in ("article", "main"):
        inner = False
        kids = sorted(r for r in rows if r[1] == now)
        for column in (3, 4):
            best = max(kids, key=lambda r: r[column], default=None)
            if best and best[column] > 0 and best[column] >= REGION_SHARE * about[now][column]:
                now, inner = best[0], True
                break
    return None if about[now][2] in ("", "html", "body") else now


def main_text(page: str, wrapper: frozenset[str] | set[str], region: str | None = None) -> str:
    """The content blocks of a page, given its host's constant texts and region."""
    root = parse(page)
    kept = lambda found: [x if x is None or not wrapper or not x[1].strip() or _digest(x[0], _squeeze(x[1])) not in wrapper else (x[0], "") for x in found]
    parts = kept(region_flow(root, region)) if region else []
    if any(x and x[1].strip() for x in parts):
        return _joined(parts)
    parts = kept(flow(root))
    size = {True: 0, False: 0}
    for path, text in filter(None, parts):
        size[path[0]] += len(_squeeze(text))
    inside = any(x and x[0][0] for x in parts) and not (wrapper and size[False] > size[True])
    return _joined([x for x in parts if x is None or not inside or x[0][0]])


def _joined(parts: list[tuple[Path, str] | None]) -> str:
    """Blocks of the texts between the Nones, one a line."""
    blocks: list[str] = []
    run: list[str] = []
    for x in [*parts, None]:
        if x is None:
            if run and (text := _squeeze("".join(run))):
                blocks.append(text)
            run.clear()
        else:
            run.append(x[1])
    return "\n".join(blocks)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def page_texts(page: str) -> dict[str, tuple[int, bool]]:
    """Length by digest of a page's texts but code, and whether they are inside an article."""
    return {_digest(path, text): (len(text), path[0]) for path, raw in filter(None, flow(parse(page), True)) if (text := _squeeze(raw))}


def common(pages: DataFrame) -> DataFrame:
    """(host, digest) of texts that are constant over a host's pages, all of them read. pages(host, html).

    A text is judged by the pages that hold it: what else they hold and is found on at most half as many pages must make up
    more than 1 - COPY_SHARE of their content, less what half of a wide host's pages have. So the texts of an article that is there several times, edited or not, stay.
    """
    spark = pages.sparkSession
    kind, weighed = "host string, digest string", "host string, digest string, rest long, total long"
    one, two = arrow_schema(kind, spark), arrow_schema(weighed, spark)
    pages = pages.where("html is not null").select("host", "html")

    def digests(batches):
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = ["", *page_texts(page)]  # the empty one counts pages
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(held), pa.string()), pa.array(held, pa.string())], schema=one)

    counted = materialize(pages.mapInArrow(tidy(digests), kind).groupBy("host", "digest").agg(F.count("*").alias("n")).where("n > 1"), "counted-texts")
    size = counted.where("digest = ''").select("host", F.col("n").alias("pages"))
    counted = materialize(counted.where("digest <> ''").join(size, "host").where((F.col("n") >= F.col("pages") * COMMON_SHARE) & (~F.col("digest").startswith(ARTICLE) | (F.col("n") >= F.greatest(F.lit(INSIDE_PAGES), F.col("pages") * INSIDE_SHARE)))), "common-texts")
    known = materialize(counted.groupBy("host").agg(F.collect_list("digest").alias("held"), F.collect_list("n").alias("n"), F.first("pages").alias("pages")), "common-by-host")
    stats = known.agg(F.count("*"), F.sum(F.size("held") * 32 + 72)).first()

    def weigh(batches):
        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for host, page, held, n, pages in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                texts, often = page_texts(page), dict(zip(held, n, strict=True))
                inside = any(i for _, i in texts.values())
                content = [(often.get(d, 1), size) for d, (size, i) in texts.items() if i or not inside]
                wide = pages / 2 if pages >= WIDE else pages + 1
                counts = {often[d] for d in texts if d in often}
                rest = {k: sum(size for m, size in content if 2 * m <= k) for k in counts}
                total = {k: sum(size for m, size in content if m < wide or k >= wide) for k in counts}
                for d in texts:
                    if d in often:
                        at = sums.setdefault((host, d), [0, 0])
                        at[0] += rest[often[d]]
                        at[1] += total[often[d]]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], schema=two)

    joined = small_join(pages, known, ["host"], "inner", max(1, (stats[1] or 0) // max(1, stats[0])), stats[0])
    sums = joined.select("host", "html", "held", "n", "pages").mapInArrow(tidy(weigh), weighed).groupBy("host", "digest").agg(F.sum("rest").alias("rest"), F.sum("total").alias("total"))
    copies = F.when((F.col("pages") >= WIDE) & (2 * F.col("n") >= F.col("pages")), F.lit(WIDE_COPY_SHARE)).otherwise(F.lit(COPY_SHARE))
    return sums.join(counted, ["host", "digest"]).where(F.col("rest") > (1 - copies) * F.col("total")).select("host", "digest")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, places): constant texts and containers of the template, from tree matching of sampled pages and counts over all. pages(page_id, host, html)."""
    # by the pages' own digests, so that repeated ids and copies count once
    held = pages.where("html is not null").select("host", "html", F.md5("html").alias("digest"))
    chosen = held.groupBy("host", F.pmod(F.xxhash64("digest"), F.lit(SAMPLES)).alias("k")).agg(F.min("digest").alias("digest")).select("host", "digest")
    chosen = materialize(chosen, "sampled-pages")
    sampled = small_join(held, chosen, ["host", "digest"], "left_semi", 96).groupBy("host", "digest").agg(F.first("html").alias("html"))

    def learn(key, pdf):
        import pandas as pd

        texts, places = learn_template(sorted(set(pdf["html"])))
        return pd.DataFrame({"host": [key[0]], "wrapper": [texts], "places": [places]})

    matched = materialize(sampled.groupBy("host").applyInPandas(learn, "host string, wrapper array<string>, places array<string>"), "templates")
    texts = matched.select("host", F.explode("wrapper").alias("digest")).unionByName(common(pages)).groupBy("host").agg(F.collect_set("digest").alias("wrapper"))
    return texts.join(matched.select("host", "places"), "host", "full")


def regions(pages: DataFrame, learned: DataFrame, row_bytes: int, rows: int) -> DataFrame:
    """(host, region): the container that holds the varying text of a host, all of its pages summed up."""
    schema = "host string, place string, around string, tag string, varying long, unmarked long"
    kind = arrow_schema(schema, pages.sparkSession)

    def weigh(batches):
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for host, page, wrapper, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for place, (around, tag, varying, unmarked) in masses(page, frozenset(wrapper or ()), frozenset(places)).items():
                    at = sums.setdefault((host, place, around, tag), [0, 0])
                    at[0] += varying
                    at[1] += unmarked
            columns = [*zip(*sums), *zip(*sums.values())] if sums else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    known = small_join(pages.where("html is not null").select("host", "html"), learned.where(F.size("places") > 0), ["host"], "inner", row_bytes, rows)
    sums = known.select("host", "html", "wrapper", "places").mapInArrow(tidy(weigh), schema).groupBy("host", "place", "around", "tag").agg(F.sum("varying").alias("varying"), F.sum("unmarked").alias("unmarked"))

    def choose(key, pdf):
        import pandas as pd

        rows: dict[str, list] = {}
        for place, around, tag, varying, unmarked in sorted(zip(pdf["place"], pdf["around"], pdf["tag"], pdf["varying"], pdf["unmarked"], strict=True), key=lambda r: (r[0], r[1] or "")):
            at = rows.setdefault(place, [place, around, tag, 0, 0])  # one path has one way down to it
            at[3] += int(varying)
            at[4] += int(unmarked)
        return pd.DataFrame({"host": [key[0]], "region": [choose_region([tuple(r) for r in rows.values()])]})

    return sums.groupBy("host").applyInPandas(choose, "host string, region string").where("region is not null")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    schema = arrow_schema(EXTRACTED, pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    learned = materialize(wrappers(pages), "wrappers")
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)) * 24
    n, total = learned.agg(F.count("*"), F.sum(size("wrapper") + size("places") + 96)).first()
    row_bytes = max(1, (total or 0) // max(1, n))
    found = learned.join(regions(pages, learned, row_bytes, n), "host", "left").select("host", "wrapper", "region")
    joined = small_join(pages, materialize(found, "regions"), ["host"], "left", row_bytes, n)

    def run(batches):
        for batch in batches:
            text = [main_text(h, frozenset(w or ()), r) if h else "" for h, w, r in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], schema=schema)

    return joined.select("page_id", "url", "html", "wrapper", "region").mapInArrow(tidy(run), EXTRACTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
