"""HTML extraction by wrappers inferred for each host.

A page becomes a tree of block elements whose leaves are text slots. Repeated
siblings fold into repeated groups, and the trees of a host are aligned one
after the other: what only some have becomes optional, texts become slots. The
result is a union-free regular expression over tags, the host's wrapper, with
what was seen in each slot. Its slots are labelled once: main text or not. A
page is then aligned with its host's wrapper, and the blocks in slots of main
text are its text.

Pages are folded where they lie; a task hands on one wrapper for each host it
has seen, and those are aligned in a salted tree, so a hot host meets in no task.

What a slot may be is read from its own path: a menu, advert or the like, or an
article, main or named content region, or neither. Which of a page's slots are
its text follows from the regions that this page has and from what the host's
wrapper saw: text that no page varies is the template's.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

SALTS = 32
#: Wrappers of all hosts up to so many characters are sent to every task; more are joined by host and salt.
SENT_CHARS = 64_000_000
#: Elements nested deeper lie in the tree beside the one at this depth; their slots keep what their own path says.
DEPTH = 64
#: Two sequences of children of more pairs than this are aligned from their unique common elements.
PAIRS = 250_000
#: What a tag is, by the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math object canvas textarea select".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements and roles that hold no main text, wherever they are.
ASIDE_TAGS = frozenset("head title nav aside footer button menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: Words by which classes and ids name what holds no main text, or what does. A
#: name counts if all its words are of the list or of the layout: ``comment-list``
#: and ``siteFooter`` do, ``no-sidebar`` and ``social-science`` don't.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert newsletter subscribe signup share sharing "
    "social related recommended popup modal overlay widget login search toolbar pagination pager copyright masthead topbar".split()
)
MAIN_WORDS = frozenset("article content main post entry story maincontent articlebody postcontent".split())
LAYOUT_WORDS = frozenset(
    "site page main left right top bottom primary secondary global box block area section wrap wrapper container content inner outer bar list lists link links "
    "item items unit slot text row col column panel group holder fixed sticky inline post posts article articles entry form buttons icons body single".split()
)
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td th dt dd".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|([^<]+|<)", re.S,
)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Whether a slot is no main text: no, by a word of a class or a form around it, by a tag.
NOT, SOFT, HARD = "", "s", "x"


class Node:
    """An element, a repeated group (sig ``*``) or a text slot (sig ``#`` and what its path says)."""

    __slots__ = ("sig", "kids", "rep", "opt", "blocks", "n", "low", "high", "chars", "links")

    def __init__(self, sig, kids=None, rep=False, opt=False):
        self.sig, self.kids, self.rep, self.opt = sig, kids if kids is not None else [], rep, opt
        self.blocks, self.n, self.low, self.high, self.chars, self.links = [], 0, 0, 0, 0, 0

    @property
    def is_slot(self) -> bool:
        return self.sig[:1] == "#"

    def dump(self):
        if self.is_slot:
            return [self.sig, int(self.opt), self.n, self.low, self.high, self.chars, self.links]
        return [self.sig, int(self.opt), int(self.rep), [k.dump() for k in self.kids]]

    @classmethod
    def load(cls, d):
        if d[0][:1] == "#":
            node = cls(d[0], opt=bool(d[1]))
            node.n, node.low, node.high, node.chars, node.links = d[2:7]
            return node
        return cls(d[0], [cls.load(k) for k in d[3]], bool(d[2]), bool(d[1]))

    def shape(self) -> str:
        mark = "+" * self.rep + "?" * self.opt
        return f"{self.sig}{mark}" if self.is_slot else f"{self.sig}{mark}({','.join(k.shape() for k in self.kids)})"


def _named(names: tuple[str, ...], words: frozenset) -> bool:
    """Is one of the names made of ``words`` and layout words, with one of ``words`` at least?"""
    for name in names:
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and words.intersection(parts) and all(p in words or p in LAYOUT_WORDS for p in parts):
            return True
    return False


class Place:
    """What the path to a point of the page says: (aside, region, within a text tag).
    Region 3 is within an article, 2 within main, 1 within something named as content."""

    def __init__(self):
        self.known: dict = {}

    def below(self, above: tuple[str, int, bool], tag: str, attrs: str) -> tuple[str, tuple[str, int, bool]]:
        """Signature of an element, and what holds within it."""
        key = (above, tag, attrs)
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = self._below(*key)
        return self.known[key]

    def _below(self, above, tag, attrs):
        aside, region, _ = above
        names, roles = [], []
        for kind, *values in _NAMES.findall(attrs):
            (roles if kind.lower() == "role" else names).extend("".join(values).split())
        names = tuple(sorted(set(names)))
        roles = {r.lower() for r in roles}
        page = tag in ("html", "body")
        if tag == "main" or "main" in roles:
            region, aside = max(region, 2), NOT if aside == SOFT else aside
        elif tag == "article" or "article" in roles:
            region = 3
        elif not page and ASIDE_ROLES & roles or tag in ASIDE_TAGS or tag == "header" and region < 2:
            aside = HARD
        elif not page:
            if tag in ("form", "fieldset") or _named(names, ASIDE_WORDS) or region < 2 and _named(names, frozenset(("header",))):
                aside = aside or SOFT
            if "main" in names:
                region = max(region, 2)
            elif _named(names, MAIN_WORDS):
                region = max(region, 1)
        return ".".join([tag, *names]), (aside, region, tag in TEXT_TAGS)


def parse(page: str | None) -> tuple[Node, list[tuple[str, int]]]:
    """The page's tree and its blocks (text, characters in links) in page order."""
    page, place = page or "", Place()
    root = Node("")
    # open elements: tag, node, what holds within
    stack: list[tuple[str, Node, tuple]] = [("", root, (NOT, 0, False))]
    open_: Counter = Counter()
    blocks: list[tuple[str, int]] = []
    pieces: list[str] = []
    link_chars, in_link, at = 0, 0, 0

    def flush():
        nonlocal pieces, link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                aside, region, own = stack[-1][2]
                slot = Node(f"#{aside}{region}{'t' * own}")
                slot.blocks, slot.n, slot.chars, slot.links = [len(blocks)], 1, len(text), min(link_chars, len(text))
                slot.low = slot.high = zlib.crc32(text.encode("utf-8", "replace"))
                stack[-1][1].kids.append(slot)
                blocks.append((text, slot.links))
        pieces, link_chars = [], 0

    def close_to(depth: int):
        for tag, _, _ in stack[depth:]:
            open_[tag] -= 1
        del stack[depth:]

    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        close, name, attrs, text = m.groups()
        if text:
            text = html.unescape(text)
            pieces.append(text)
            if in_link:
                link_chars += len(text)
            continue
        if not name:
            continue
        tag = name.lower()
        if tag in RAW:
            if not close and not attrs.endswith("/"):
                flush()
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            in_link = 0 if close else 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        if close:
            if open_[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close_to(depth)
            continue
        if stack[-1][0] == "p":
            close_to(len(stack) - 1)
        if tag in CLOSED_BY_SAME:
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if any(open_[t] for t in same):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in same:
                        close_to(depth)
                        break
                    if stack[depth][0] in CLOSED_BY_SAME[tag]:
                        break
        sig, within = place.below(stack[-1][2], tag, attrs)
        if len(stack) < DEPTH:
            node = Node(sig)
            stack[-1][1].kids.append(node)
        else:
            node = stack[-1][1]
        if attrs.endswith("/") and tag not in ("p", "div"):
            continue
        stack.append((tag, node, within))
        open_[tag] += 1
    flush()
    return root, blocks


def _absorb(a: Node, b: Node) -> None:
    """What was seen in b's place is seen in a's."""
    a.opt |= b.opt
    a.rep |= b.rep
    if a.is_slot:
        a.low, a.high = (min(a.low, b.low), max(a.high, b.high)) if a.n and b.n else (a.low, a.high) if a.n else (b.low, b.high)
        a.n, a.chars, a.links = a.n + b.n, a.chars + b.chars, a.links + b.links
        a.blocks += b.blocks
    else:
        a.kids = align(a.kids, b.kids)


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Increasing pairs of equal signatures: a longest common subsequence, a
    before b on a tie. Sequences of more than ``PAIRS`` pairs are first cut at
    signatures that each has once, and what is still too long for a table is
    matched to the next of its signature; so memory is bounded, and time nearly linear."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= PAIRS:
            found += [(i + x, j + y) for x, y in _longest(a[i:n], b[j:m])]
            continue
        once_a, once_b = Counter(a[i:n]), Counter(b[j:m])
        at_b = {x: k for k, x in enumerate(b[j:m], j) if once_b[x] == 1}
        anchors = _increasing([(k, at_b[x]) for k, x in enumerate(a[i:n], i) if once_a[x] == 1 and x in at_b])
        if anchors:
            for x, y in [*anchors, (n, m)]:
                todo.append((i, x, j, y))
                i, j = x + 1, y + 1
            found += anchors
            continue
        places: dict[str, list[int]] = {}
        for k in range(j, m):
            places.setdefault(b[k], []).append(k)
        for k in range(i, n):
            own = places.get(a[k], [])
            at = bisect_left(own, j)
            # a step ahead of more than what is left of a would cost it its own partners
            if at < len(own) and own[at] - j <= max(64, m - j - (n - k)):
                found.append((k, own[at]))
                j = own[at] + 1
    return sorted(found)


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs whose second numbers increase too."""
    tails, ends, before = [], [], []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [y], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One sequence for both: matched pairs merged, everything else optional; a
    before b where neither matches."""
    if len(a) == len(b) and all(x.sig == y.sig for x, y in zip(a, b, strict=True)):
        for x, y in zip(a, b, strict=True):
            _absorb(x, y)
        return a
    out, i, j = [], 0, 0
    for x, y in [*matches([k.sig for k in a], [k.sig for k in b]), (len(a), len(b))]:
        for k in (*a[i:x], *b[j:y]):
            k.opt = True
            out.append(k)
        if x < len(a):
            _absorb(a[x], b[y])
            out.append(a[x])
        i, j = x + 1, y + 1
    return refold(out)


def refold(kids: list[Node], widest: int = 3) -> list[Node]:
    """Tandem repeats become repeated groups: of one element, then of up to ``widest``."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].sig == k.sig:
            opt = out[-1].opt and k.opt
            _absorb(out[-1], k)
            out[-1].rep, out[-1].opt = True, opt
        else:
            out.append(k)
    for w in range(2, widest + 1):
        sigs, made, i = [x.sig for x in out], [], 0
        while i < len(out):
            if sigs[i : i + w] != sigs[i + w : i + 2 * w] or i + 2 * w > len(out) or "*" in sigs[i : i + w]:
                made.append(out[i])
                i += 1
                continue
            group, at = Node("*", out[i : i + w], rep=True), i + w
            while sigs[at : at + w] == sigs[i : i + w]:
                for x, y in zip(group.kids, out[at : at + w], strict=True):
                    _absorb(x, y)
                at += w
            made.append(group)
            i = at
        out = made
    return out


def fold(node: Node) -> Node:
    for k in node.kids:
        if not k.is_slot:
            fold(k)
    # an element without text in or below it says nothing
    node.kids = refold([k for k in node.kids if k.is_slot or k.kids])
    return node


def slots(node: Node) -> list[Node]:
    return [node] if node.is_slot else [s for k in node.kids for s in slots(k)]


def said(slot: Node) -> tuple[str, int, bool]:
    """What a slot's path says, from its signature."""
    mark = slot.sig[1:]
    aside = mark[0] if mark[0] in (SOFT, HARD) else NOT
    return aside, int(mark[len(aside)]), mark.endswith("t")


def main_slots(page: list[Node], models: list[Node | None]) -> list[bool]:
    """For each slot of a page, with its slot of the host's wrapper: does it hold main text?

    Slots in menus, forms and the like don't. Of the others those in the
    narrowest kind of region that this page has do (article, main, named
    content, any). Where neither article nor main is marked, slots that are
    mostly links don't. A slot whose text no page of the host varies is the
    template's own, unless only one text was seen in it, or it is a heading,
    paragraph or the like of a marked region, or less than half of the text
    varies: pages of one title, or copies of a page, keep their text. A page all of whose regions are named as
    something else by a class has no better text than these: it keeps them.
    """
    paths = [said(s) for s in page]
    keep = [p[0] == NOT for p in paths]
    if not any(keep):
        keep = [p[0] == SOFT and p[1] > 0 for p in paths]
    top = max((p[1] for p, k in zip(paths, keep, strict=True) if k), default=0)
    keep = [k and p[1] == top for p, k in zip(paths, keep, strict=True)]
    stats = [m if m is not None else s for s, m in zip(page, models, strict=True)]
    if top < 2:
        keep = [k and 2 * s.links <= s.chars for s, k in zip(stats, keep, strict=True)]
    varied = sum(s.chars for s, k in zip(stats, keep, strict=True) if k and s.low != s.high)
    if varied and varied >= sum(s.chars for s, k in zip(stats, keep, strict=True) if k and s.low == s.high):
        keep = [k and (s.low != s.high or s.n < 2 or top > 0 and p[2]) for s, k, p in zip(stats, keep, paths, strict=True)]
    return keep


def aligned(page: Node, wrapper: Node) -> list[Node | None]:
    """The wrapper's slot for each of the page's slots, from aligning the two
    trees; none where the wrapper has no place, as only a page has that wasn't aligned."""
    out: dict[int, Node | None] = {}

    def place(node: Node, model: Node | None):
        if node.is_slot:
            out[id(node)] = model
            return
        for k, m in _partners(node.kids, model.kids if model is not None else []):
            place(k, m)

    place(page, wrapper)
    return [out[id(s)] for s in slots(page)]


def _partners(a: list[Node], b: list[Node]) -> list[tuple[Node, Node | None]]:
    """Each of a with its partner in b, groups standing for their elements;
    leftovers, which another page's group has folded, go to the first of their signature."""
    flat_a, flat_b = ([k for x in side for k in (x.kids if x.sig == "*" else [x])] for side in (a, b))
    first = {x.sig: x for x in reversed(flat_b)}
    own = dict(matches([x.sig for x in flat_a], [x.sig for x in flat_b]))
    return [(x, flat_b[own[i]] if i in own else first.get(x.sig)) for i, x in enumerate(flat_a)]


def merged(wrappers: list[Node]) -> Node:
    """All aligned one after the other, in the order of their shapes."""
    wrappers = sorted(wrappers, key=lambda w: w.shape())
    for w in wrappers[1:]:
        _absorb(wrappers[0], w)
    return wrappers[0]


def host_of(url) -> "F.Column":
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of every host of ``pages`` (host, html)."""

    def local(frames):
        for f in frames:
            by_shape: dict[tuple[str, str], Node] = {}
            for host, page in zip(f.host, f.html, strict=True):
                tree = fold(parse(page)[0])
                key = (host, tree.shape())
                if key in by_shape:
                    _absorb(by_shape[key], tree)
                else:
                    by_shape[key] = tree
            hosts: dict[str, list[Node]] = {}
            for (host, _), tree in by_shape.items():
                hosts.setdefault(host, []).append(tree)
            rows = [(h, merged(t)) for h, t in hosts.items()]
            yield pd.DataFrame({
                "host": [h for h, _ in rows], "salt": [zlib.crc32(w.shape().encode() + str(f.html.iloc[0])[:200].encode("utf-8", "replace")) % SALTS for _, w in rows],
                "wrapper": [json.dumps(w.dump()) for _, w in rows],
            })

    def combined(f: pd.DataFrame) -> pd.DataFrame:
        w = merged([Node.load(json.loads(x)) for x in sorted(f.wrapper)])
        return pd.DataFrame({"host": f.host.iloc[:1], "salt": f.salt.iloc[:1], "wrapper": [json.dumps(w.dump())]})

    kind = "host string, salt int, wrapper string"
    partial = pages.select("host", "html").mapInPandas(local, kind)
    salted = partial.groupBy("host", "salt").applyInPandas(combined, kind)
    return salted.groupBy("host").applyInPandas(combined, kind).drop("salt")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty html gives an empty text; a null url belongs to the host ''.
    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by an empty line. Repeated rows get equal texts.
    Pages of any length and depth are read whole. An empty table gives no rows.
    Other columns aren't read.
    """
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = cut(infer_wrappers(hosted), "wrappers")

    @F.pandas_udf("string")
    def main_text(pages: pd.Series, wrappers: pd.Series) -> pd.Series:
        loaded, known, out = {}, {}, []
        for page, raw in zip(pages, wrappers, strict=True):
            tree, blocks = parse(page)
            tree = fold(tree)
            own = slots(tree)
            key = (raw, tree.shape())
            if key not in known:
                if raw not in loaded:
                    loaded[raw] = Node.load(json.loads(raw))
                known[key] = main_slots(own, aligned(tree, loaded[raw]))
            kept = sorted(b for s, k in zip(own, known[key], strict=True) if k for b in s.blocks)
            out.append("\n\n".join(blocks[b][0] for b in kept))
        return pd.Series(out, dtype=object)

    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    if size <= SENT_CHARS:
        joined = hosted.join(F.broadcast(wrappers), "host")
    else:  # pages of one host are dealt to SALTS tasks
        salts = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salts, ["host", "salt"])
    return joined.select("page_id", "url", main_text("html", "wrapper").alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def query(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))
