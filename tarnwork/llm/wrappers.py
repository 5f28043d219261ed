"""Main text of web pages by wrappers: union-free regular expressions that are inferred for each host.

A page is a stream of tags and text slots, read as nested groups. A container without a class is told apart by its kind: links,
bare text, or blocks. Inside a page, neighbouring groups of one name and shape become one repeated group. Streams of one host are
aligned one after the other (longest common subsequence of the groups at each level): what only one side has becomes optional,
text that differs becomes a free slot, text that all pages share stays a constant of the template. Partial wrappers are made
where pages are read, equal ones are merged, and they meet in rounds of bounded groups, so that no task holds a host's pages; a
wrapper grows with the template and not with the number of pages.

The wrapper decides what is main text (decide):
- Text counts as free where it differs between pages and stands in no link. A constant of two pages or more is the template's,
  if free text times the other pages weighs as much as all constants; else the pages are copies of each other and say nothing.
- The main group is an article, a main element, or one named as content that holds a fifth of the free text; without such
  names, the innermost group that holds all free text.
- Around it everything goes. In a group that carries no name, containers of constants and containers of links go too, and, if that is
  the whole body, constants before the first and after the last free text. Inside an article, constants are its own text and stay.
- Menus, footers, sidebars, notices, adverts, forms and comments that tags or classes name go everywhere, inline ones too. Blocks
  named related, share and the like go only if they are the template's constants or lists of links.
This becomes a small tree of verdicts for each host, and each page is aligned with it, group by group. A page without a host, or
in which the host's main group has no text, is decided by its own wrapper. Character references are decoded, white space in a
block becomes one space, blocks are joined by a line feed.

Null or empty html gives empty text. A null or unreadable url has no host. Repeated rows give repeated results, rows without an
id are read like others, an empty table gives an empty one, and other columns (whatever their names) are not read. Pages are
read whole and groups nest as deep as they like (no step uses Python's own stack); time is linear in unclosed or broken markup,
which is read as far as it goes. Which partial wrappers meet first depends on how the table is split into tasks.
"""

from __future__ import annotations

import functools
import html
import json
import math
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import discard, pieces, written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]]|[^\s,\[\]"]+')
#: Fixed lists: elements whose content is no markup or no text (those of RAW end with the page if nothing closes them), that have
#: no end, that stand inside a line of text, and that end an open one of their kind.
RAW = frozenset("script style".split())
HIDDEN = frozenset("head title noscript template svg iframe textarea select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("article main section div body ul ol dl table tr td th nav aside footer header form blockquote".split())
#: Fixed lists: elements and words of class, id and role that mark what is not main text, those that do so only for lists of links
#: and constants, those that do so inside a line, and those of heads, which count outside the article.
ZONE_TAGS = frozenset("nav footer aside form button menu dialog".split())
ZONE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup footer contentinfo comment comments reply replies respond discussion disqus "
    "pagination pager toolbar search login complementary".split()
)
DOUBTFUL_WORDS = frozenset("share sharing social related recommended widget banner".split())
INLINE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo share sharing".split())
HEAD_WORDS = frozenset("header masthead".split())
MAIN_WORDS = frozenset("article content post entry story main body text".split())
NEVER_ZONES = ("article", "main", "body", "html", "")
#: What a group is: main text as far as it can be told, a zone if links or constants make it up, a zone.
PLAIN, DOUBTFUL, ZONE = 0, 1, 2
#: Partial wrappers that meet in one task.
FAN = 64
#: Hosts whose partial wrappers a reading task holds at a time; bytes of all rules up to which they are broadcast.
HELD, BROADCAST_BYTES = 2000, 8_000_000


def words_of(attrs: str) -> list[str]:
    """The words of class, id and role."""
    found = " ".join(v.strip("\"'") for _, v in ATTR.findall(attrs)) if attrs and "=" in attrs else ""
    found = " ".join(x for x in found.split() if not re.match(r"(?i)(?:no|has|with|without)[-_]", x))
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", found).lower())


@functools.lru_cache(maxsize=20_000)
def parts_of(name: str) -> tuple[str, frozenset[str]]:
    """(tag, words) of a group's name."""
    tag, *own = name.split("~")[0].split(".")
    return tag, frozenset(own)


@functools.lru_cache(maxsize=20_000)
def sort_of(name: str) -> tuple[int, bool]:
    """(PLAIN, DOUBTFUL or ZONE; whether it is a head)."""
    tag, own = parts_of(name)
    if tag in NEVER_ZONES:
        return PLAIN, False
    if tag in INLINE:
        return ZONE if own & INLINE_WORDS else PLAIN, False
    zone = ZONE if tag in ZONE_TAGS or own & ZONE_WORDS else DOUBTFUL if own & DOUBTFUL_WORDS else PLAIN
    return zone, tag == "header" or bool(own & HEAD_WORDS)


@functools.lru_cache(maxsize=20_000)
def _name(tag: str, attrs: str) -> str:
    return ".".join([tag, *words_of(attrs)])


def name_of(tag: str, attrs: str) -> str:
    return _name(tag, attrs) if len(attrs) < 500 else _name.__wrapped__(tag, attrs)


class Link(str):
    """Text inside a link."""

    __slots__ = ()


@functools.cache
def end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.IGNORECASE)


def groups(page: str) -> list:
    """The page as nested groups [name, children, words, words in links] (words are counted by stream()); a child that is a string is text, a br is white space."""
    root: list = ["", [], 0, 0]
    stack, tags = [root], [""]
    places: dict[str, list[int]] = {}  # of the open groups of each tag
    holds: list[int] = []  # places of the open containers
    link = at = 0  # how many groups were open where the open link began
    unclosed: set[str] = set()

    def close(to: int) -> None:
        nonlocal link
        for tag in tags[to:]:
            places[tag].pop()
            if tag in CONTAINERS:
                holds.pop()
        del stack[to:], tags[to:]
        if to < link:
            link = 0

    def open_(tag: str, name: str) -> None:
        new = [name, [], 0, 0]
        stack[-1][1].append(new)
        if tag not in VOID:
            places.setdefault(tag, []).append(len(tags))
            if tag in CONTAINERS:
                holds.append(len(tags))
            stack.append(new)
            tags.append(tag)

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            stack[-1][1].append(Link(text) if link else text)
            continue
        if not (tag := m["tag"]):
            continue
        tag, end = tag.lower(), m["end"]
        if tag in INLINE:
            if tag == "br":
                stack[-1][1].append(" ")
            elif end:
                if tag == "a":
                    link = 0
                if own := places.get(tag):  # an inline zone, or what stands in one
                    close(own[-1])
            elif tag not in VOID:
                name = name_of(tag, m["attrs"].strip())
                if places.get(tag) or sort_of(name)[0] == ZONE:
                    open_(tag, name)
                elif tag == "a":
                    link = len(tags)
        elif end:
            if own := places.get(tag):
                close(own[-1])
        elif tag in VOID and tag != "hr":
            continue
        else:
            if tag in RAW or tag in HIDDEN:
                if tag in unclosed or m["attrs"].endswith("/"):
                    continue
                if found := end_of(tag).search(page, at):
                    at = found.end()
                elif tag in RAW:
                    break
                else:  # without an end its start is passed over, and no later one has an end either
                    unclosed.add(tag)
                continue
            if ends := CLOSES.get(tag):
                to = max(holds[-1] if holds else 0, *(places[x][-1] for x in ends if places.get(x)), 0)
                if tags[to] in ends:
                    close(to)
            open_(tag, name_of(tag, m["attrs"].strip()))
    return root


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


# A wrapper: [name, optional, repeated, children, pages] and, for a page's own, the groups of the page; a text slot:
# ["#", optional, repeated, hash of the text or None where it is free, words, words in links, pages].


def settled(steps: Generator) -> list:
    """The value of a recursion written as generators that yield their calls, on a stack of its own."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def _text(parts: list[str]) -> tuple[str, int, int]:
    """(text, words, words in links) of a block."""
    text = clean("".join(parts))
    n = text.count(" ") + 1 if text else 0
    linked = [x for x in parts if type(x) is Link]
    return text, n, n if len(linked) == len(parts) else min(n, len(html.unescape(" ".join(linked)).split())) if linked else 0


def is_inline(group: list) -> bool:
    return parts_of(group[0])[0] in INLINE


def stream(root: list, own: bool = False) -> list:
    """A wrapper of one page's groups, and the words of each group; own: nodes know their groups."""
    todo: list[list] = [[root, 0, []]]  # group, next child, wrappers of the children so far
    while True:
        group, at, kids = frame = todo[-1]
        children, parts = group[1], []
        while at < len(children):
            child = children[at]
            if isinstance(child, str):
                parts.append(child)
            elif not is_inline(child):
                break
            at += 1
        if parts:
            text, n, linked = _text(parts)
            if text:
                _fold(kids, ["#", False, False, xxhash.xxh64_hexdigest(text), n, linked, 1])
                group[2] += n
                group[3] += linked
        if at < len(children):
            frame[1] = at + 1
            todo.append([children[at], 0, []])
            continue
        name = group[0]
        if name in CONTAINERS and name not in NEVER_ZONES:
            kind = "links" if group[2] and 2 * group[3] >= group[2] else "blocks" if any(k[0] != "#" for k in kids) else "text"
            name = f"{name}~{kind}"
        node = [name, False, False, kids, 1] + ([[group]] if own else [])
        todo.pop()
        if not todo:
            return node
        above = todo[-1][0]
        above[2] += group[2]
        above[3] += group[3]
        _fold(todo[-1][2], node)


def alike(a: list, b: list) -> bool:
    """Whether neighbours of one name are one repeated group: containers need the same names inside."""
    return a[0] == b[0] and (a[0] == "#" or parts_of(a[0])[0] not in CONTAINERS or {k[0] for k in a[3]} == {k[0] for k in b[3]})


def _fold(kids: list, node: list) -> None:
    if kids and alike(kids[-1], node):
        kids[-1] = aligned(kids[-1], node, True)
        kids[-1][2] = True
    else:
        kids.append(node)


def _folded(kids: list) -> Generator:
    """Neighbours that are alike become one repeated group."""
    out: list = []
    for k in kids:
        if out and alike(out[-1], k):
            out[-1] = yield _aligned(out[-1], k, True)
            out[-1][2] = True
        else:
            out.append(k)
    return out


def aligned(a: list, b: list, together: bool = False) -> list:
    """One wrapper for both; together: they stand in the same page."""
    return settled(_aligned(a, b, together))


def _aligned(a: list, b: list, together: bool) -> Generator:
    optional, repeated = a[1] or b[1], a[2] or b[2]
    if a[0] == "#":
        return ["#", optional, repeated, a[3] if a[3] == b[3] else None, max(a[4], b[4]), max(a[5], b[5]), max(a[6], b[6]) if together else a[6] + b[6]]
    pages = max(a[4], b[4]) if together else a[4] + b[4]
    x, y, kids, i, j = a[3], b[3], [], 0, 0
    for p, q in [*matches([k[0] for k in x], [k[0] for k in y]), (len(x), len(y))]:
        for k in [*x[i:p], *y[j:q]]:
            kids.append([k[0], True, *k[2:]])
        if p < len(x):
            kids.append((yield _aligned(x[p], y[q], together)))
        i, j = p + 1, q + 1
    if len(a) > 5:
        a[5].extend(b[5])  # a is used up
    return [a[0], optional, repeated, (yield _folded(kids)), pages, *a[5:6]]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence: of all such, the one that matches as early as it can and else leaves out names of a first.

    Row i has a bit for each place of b, the last place lowest: 0 where the longest of a[i:] and b[j:] is one longer than that of
    a[i:] and b[j + 1:]. A few rows are kept; those between are made again when the walk gets there.
    """
    if a == b:
        return [(i, i) for i in range(len(a))]
    n, m = len(a), len(b)
    full, where, step, block = (1 << m) - 1, {}, math.isqrt(n) + 1, {}
    for j, name in enumerate(b):
        where.setdefault(name, bytearray(m // 8 + 1))[(m - 1 - j) >> 3] |= 1 << ((m - 1 - j) & 7)
    where = {name: int.from_bytes(x, "little") for name, x in where.items()}

    def above(i: int, row: int) -> int:
        hit = row & where.get(a[i], 0)
        return (row + hit | row - hit) & full

    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            kept[i] = row

    def longest(i: int, j: int) -> int:
        """Of a[i:] and b[j:]."""
        row = kept.get(i)
        if row is None:
            row = block.get(i)
        if row is None:
            start = i - i % step
            end = min(n, start + step)
            row = kept[end]
            block.clear()
            for k in range(end - 1, start, -1):
                row = block[k] = above(k, row)
            row = block[i]
        return m - j - (row & full >> j).bit_count()

    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif longest(i + 1, j) >= longest(i, j + 1):
            i += 1
        else:
            j += 1
    return out


def dumped(made: list) -> str:
    """Nested lists as JSON, of any depth."""
    try:
        return json.dumps(made)
    except RecursionError:
        parts, todo = [], [(made, "")]
        while todo:
            x, after = todo.pop()
            if isinstance(x, list) and any(isinstance(k, list) for k in x):
                parts.append("[")
                todo.append((None, "]" + after))
                todo += [(k, ", " if i else "") for i, k in enumerate(reversed(x))]
            else:
                parts += [after] if x is None and after.startswith("]") else [json.dumps(x), after]
        return "".join(parts)


def loaded(text: str) -> list:
    try:
        return json.loads(text)
    except RecursionError:
        stack: list[list] = [[]]
        for m in JSON_TOKEN.finditer(text):
            if m[0] == "[":
                stack[-1].append([])
                stack.append(stack[-1][-1])
            elif m[0] == "]":
                stack.pop()
            else:
                stack[-1].append(json.loads(m[0]))
        return stack[0][0]


def expression(wrapper: list) -> str:
    """The wrapper as a union-free regular expression, for people."""
    return settled(_expression(wrapper))


def _expression(w: list) -> Generator:
    if w[0] == "#":
        inner = "#PCDATA" if w[3] is None else "'...'"
        return f"({inner}){'+' if w[2] else ''}{'?' if w[1] else ''}" if w[1] or w[2] else inner
    name = w[0].split("~")[0]
    parts = [f"<{name}>"]
    for k in w[3]:
        parts.append((yield _expression(k)))
    inner = "".join(parts) + f"</{name.split('.')[0]}>"
    return f"({inner}){'+' if w[2] else ''}{'?' if w[1] else ''}" if w[1] or w[2] else inner


class Node:
    """A group of a wrapper with what decide() has to know of it."""

    def __init__(self, w: list, up: int, depth: int):
        self.w, self.up, self.depth, self.kids = w, up, depth, []
        self.tag, self.own = parts_of(w[0])
        self.sort, self.head = sort_of(w[0])
        self.free = self.fixed = self.links = self.words = 0  # words of all that is below
        self.free_below = 0  # the same as free, but zones and lists of links do not count

    @property
    def listing(self) -> bool:
        return self.words > 0 and 2 * self.links >= self.words

    @property
    def constant(self) -> bool:
        """Nothing but constants of the template."""
        return self.fixed > 0 and not self.free


def _weigh(nodes: list[Node], links_count: bool, fixed_count: bool) -> None:
    for n in reversed(nodes):
        n.free = n.fixed = n.links = n.words = n.free_below = 0
        for k in n.w[3]:
            if k[0] == "#":
                fixed = fixed_count and k[3] is not None and k[6] >= 2
                n.words += k[4]
                n.links += k[5]
                if fixed:
                    n.fixed += k[4]
                else:
                    n.free += (k[4] - k[5] if links_count else k[4]) * (3 if k[2] else 1)
        n.free_below = n.free
        for i in n.kids:
            k = nodes[i]
            n.words, n.links, n.fixed, n.free = n.words + k.words, n.links + k.links, n.fixed + k.fixed, n.free + k.free
            out = k.sort == ZONE or k.head and k.tag not in NEVER_ZONES or k.sort == DOUBTFUL and (k.listing or k.constant) or links_count and k.listing and k.tag in CONTAINERS
            n.free_below += 0 if out else k.free_below


def weighed(wrapper: list) -> tuple[list[Node], bool]:
    """(groups from the top down, whether links and constants tell anything)."""
    nodes = [Node(wrapper, -1, 0)]
    for at, n in enumerate(nodes):  # grows
        for k in n.w[3]:
            if k[0] != "#":
                n.kids.append(len(nodes))
                nodes.append(Node(k, at, n.depth + 1))
    _weigh(nodes, True, True)
    telling = nodes[0].free_below > 0 and nodes[0].free_below * (wrapper[4] - 1) >= nodes[0].fixed
    if not telling:  # copies of one page, or a single one
        _weigh(nodes, True, False)
        if not nodes[0].free_below:
            _weigh(nodes, False, False)
    return nodes, nodes[0].free_below > 0


def main_group(nodes: list[Node]) -> tuple[int, bool]:
    """(place of the group with the main text, whether its name tells so)."""
    whole, best = nodes[0].free_below, (0, 0, 0, 0)
    for at, n in enumerate(nodes):
        words = n.free_below
        if not at or not words:
            continue
        rank = 3 if n.tag == "article" or "articlebody" in n.own else 2 if n.tag == "main" else 1 if n.tag in ("div", "section", "td") and n.own & MAIN_WORDS else 0
        if rank and words * 5 >= whole:
            best = max(best, (rank, words, -n.depth, -at))
    if best[0]:
        return -best[3], True
    at = 0
    while inner := next((i for i in nodes[at].kids if nodes[i].tag in CONTAINERS | {"html", "main"} and nodes[i].sort == PLAIN and not nodes[i].w[2] and nodes[i].free_below == whole and whole), 0):
        at = inner
    return at, False


def decide(wrapper: list) -> list:
    """The verdicts: a tree of [name, whether its text stays, the groups inside where some differ from that, hashes of its texts that go]."""
    nodes, _ = weighed(wrapper)
    main, named = main_group(nodes)
    keep, fixed = [False] * len(nodes), [[] for _ in nodes]
    mains = {main}
    if named:  # its equals beside it are main text too
        mains |= {i for i in nodes[nodes[main].up].kids if nodes[i].w[0] == nodes[main].w[0]}
    for at, n in enumerate(nodes):  # from the top down
        keep[at] = at in mains or n.up >= 0 and keep[n.up] and not (
            n.sort == ZONE
            or n.sort == DOUBTFUL and (n.listing or n.constant)
            or not named and n.tag in CONTAINERS and (n.constant or n.listing and nodes[main].free_below > 0 and not n.free_below)
        )
    if not named and nodes[main].tag in ("", "html", "body") and nodes[main].free_below:
        kids, group = iter(nodes[main].kids), []
        for k in nodes[main].w[3]:
            at = next(kids) if k[0] != "#" else -1
            free = nodes[at].free if at >= 0 else 0 if k[3] is not None and k[6] >= 2 else k[4]
            group.append((k, at, bool(free)))
        free = [i for i, g in enumerate(group) if g[2]]
        if nodes[0].fixed and free:
            for k, at, _ in [*group[: free[0]], *group[free[-1] + 1 :]]:
                if at >= 0:
                    keep[at] = False
                else:
                    fixed[main].append(k[3])
    rules: list = [None] * len(nodes)
    for at in range(len(nodes) - 1, -1, -1):
        n = nodes[at]
        own = [rules[i] for i in n.kids]
        rules[at] = [n.w[0], int(keep[at]), own if any(r[1] != keep[at] or r[2] or r[3] for r in own) else [], fixed[at]]
        for i in n.kids:
            rules[i] = None
    return rules[0]


@functools.lru_cache(maxsize=4096)
def rule_of(text: str) -> list:
    return loaded(text)


def _kept(root: list, own: list, rule: list) -> str:
    """The text of a page that the verdicts leave."""
    verdict: dict[int, tuple[int, list]] = {}
    todo: list = [(own, rule)]
    while todo:  # the page is aligned with the rule
        node, r = todo.pop()
        for g in node[5]:
            verdict[id(g)] = (r[1], r[3])
        if r[2]:
            inside = [k for k in node[3] if k[0] != "#"]
            todo += [(inside[i], r[2][j]) for i, j in matches([k[0] for k in inside], [k[0] for k in r[2]])]
    blocks: list[str] = []
    todo = [[root, 0, 0, False]]  # group, next child, whether it stays, whether it lies in an article
    while todo:
        group, at, stays, article = frame = todo[-1]
        if not at:
            stays, gone = verdict.get(id(group), (stays, []))
            tag, words = parts_of(group[0])
            frame[2], frame[3] = stays, article or bool(stays and (tag in ("article", "main") or words & MAIN_WORDS))
            article = frame[3]
        else:
            gone = verdict.get(id(group), (0, []))[1]
        children, parts = group[1], []
        while at < len(children):
            child = children[at]
            if isinstance(child, str):
                parts.append(child)
            elif not is_inline(child):
                break
            at += 1
        if stays and parts and (text := clean("".join(parts))) and not (gone and xxhash.xxh64_hexdigest(text) in gone):
            blocks.append(text)
        if at == len(children):
            todo.pop()
            continue
        frame[1] = at + 1
        child = children[at]
        sort, head = sort_of(child[0])
        if sort != ZONE and (article or not head) and not (sort == DOUBTFUL and 2 * child[3] >= child[2] > 0):
            todo.append([child, 0, stays, article])
    return "\n".join(blocks)


def extract(page: str, rule: str | None) -> str:
    """The main text of a page by its host's verdicts (as JSON), or by its own where it has none or they leave nothing."""
    if not page:
        return ""
    root = groups(page)
    own = stream(root, True)
    return rule and _kept(root, own, rule_of(rule)) or _kept(root, own, decide(own))


def host(url: Column) -> Column:
    """The host of a url; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _meet(wrappers: list[str]) -> str:
    made = None
    for w in sorted(wrappers):
        made = loaded(w) if made is None else aligned(made, loaded(w))
    return dumped(made)


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): a wrapper for each host of all pages, as JSON. Wrappers meet FAN at a time, round by round."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"host": pa.array(list(held), pa.string()), "wrapper": pa.array([dumped(w) for w in held.values()], pa.string())})
            held.clear()
            return made

        for batch in batches:
            for at, n in pieces(batch.column(1)):
                for h, page in zip(batch.column(0).slice(at, n).to_pylist(), batch.column(1).slice(at, n).to_pylist(), strict=True):
                    if page:
                        w = stream(groups(page))
                        held[h] = aligned(held[h], w) if h in held else w
                        if len(held) >= HELD:
                            yield out()
        if held:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        return pa.table({"host": [table.column("host")[0].as_py()], "wrapper": [_meet(table.column("wrapper").to_pylist())]})

    named = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host is not null")
    made = written(named.mapInArrow(read, "host string, wrapper string"), "partial-wrappers")
    while True:
        many = made.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if many <= 1:
            return made
        part = F.pmod(F.xxhash64("wrapper"), F.lit(-(-many // FAN)))
        met = written(made.groupBy("host", part.alias("part")).applyInArrow(lambda t: meet(t), "host string, wrapper string"), "wrappers")
        discard(made)
        made = met


def rules(wrappers: DataFrame) -> DataFrame:
    """(host, rule): the verdicts of each host's wrapper, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in pieces(batch.column(1)):
                made = [dumped(decide(loaded(w))) for w in batch.column(1).slice(at, n).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(made, pa.string())], ["host", "rule"])

    return wrappers.select("host", "wrapper").mapInArrow(run, "host string, rule string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text string, n_chars long) for each page."""
    wrappers = infer(pages, url_col, html_col)
    own = written(rules(wrappers), "rules")
    discard(wrappers)
    weight = own.agg(F.sum(F.octet_length("rule") + F.octet_length("host"))).first()[0] or 0
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    joined = rows.join(F.broadcast(own) if weight <= BROADCAST_BYTES else own, "host", "left").select("id", "url", "html", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in pieces(batch.column(2)):
                part = batch.slice(at, n)
                texts = [extract(p, w) for p, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
