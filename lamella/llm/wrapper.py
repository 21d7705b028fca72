"""HTML extraction by wrapper induction.

Pages become trees of block-level nodes whose leaves are runs of text. Whole trees are aligned, by simple tree
matching, with the pivot page of their host that is built most like them. Pivots only name the slots; what a slot holds is
counted over all distinct pages of the host: texts that stand again and again in a slot that few texts fill are template,
a slot whose leaves nearly all stand in furniture (menus, forms, adverts, comments ...) is template whatever its
texts, and the slots that vary are content. Where alignment doesn't settle it (no slot, or a host of few pages), a
leaf's own markup does.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.bpe import slices
from lamella.llm.common import py, settle, table

#: Pivot pages of a host, at most: one of each of its so many commonest shapes, and one with each of its so many commonest longest texts.
PIVOTS = 4
#: A text is template if at least so many pages have it in its slot,
AGREE = 2
#: it stands on at least this part of the layout's pages, and such texts together fill the slot on more than half of them.
SHARE = 0.25
#: Spaces in a text that may be template by itself: shorter ones recur in articles too.
SHORT = 2
#: Counts of a slot that aren't those of a text: all its leaves, and those whose own markup is furniture's.
ALL, OUT = -2, -3
#: A slot is furniture if at least so many pages fill it, and at least this part of its leaves is marked as such.
FILLED, MARKED = 3, 0.9
#: Pairs of children up to which plain lists are faster than arrays.
FEW = 400
#: Levels of a tree; what is nested deeper becomes part of the last one, as in browsers, but for furniture, which is left out at any depth.
DEPTH = 160
#: A page is a copy of a pivot, and isn't counted, if they share at least this part of all their words,
COPY = 0.9
#: and at least this part of the words of those leaves that differ.
VARIES = 0.5
#: Bytes of pivot trees up to which they are broadcast; beyond, pages are joined to them by host.
BROADCAST_BYTES = 32 << 20
#: A list or cell whose text stands in links to this part is a menu, if no article or main element marks the content.
LINKED = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr nobr blink".split())
FURNITURE = frozenset("head nav aside footer header form button select dialog menu noscript svg math canvas object audio video applet map datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag closes if it is open, and the elements at which the search for it ends.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table menu select body html article main div section nav".split())
#: What class and id names call furniture, words that may stand beside these in such a name, and roles.
CUES = frozenset(
    "nav navbar navigation topnav subnav menu submenu breadcrumb breadcrumbs crumbs header masthead topbar banner footer foot colophon sidebar aside rail ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promoted cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations trending popular comment comments commentlist disqus reply replies respond discussion pagination pager paging widget widgets toolbar search searchform copyright legal disclaimer skip skiplink hidden form tagcloud paywall survey poll".split()
)
BESIDE = frozenset("js site page main top bottom left right global primary secondary mobile desktop sticky fixed box block bar area section container wrapper wrap inner outer list item items link links button buttons icon icons unit slot zone panel content text body row col column group post article user reader the my new all us up in x xs sm md lg xl a b c d h v w".split())
#: Names that tell furniture only outside of an article: inside, they may name what it is about.
LOOSE = frozenset("legal copyright disclaimer notice notices alert alerts header footer foot banner search popular related recommended trending poll survey register form skip promoted discussion overlay rail".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert status note".split())

_TOKEN = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "text", "children", "cue", "linked")

    def __init__(self, tag: str, text: str = "", cue: frozenset | set = frozenset(), linked: int = 0):
        self.tag, self.text, self.children, self.cue, self.linked = tag, text, [], cue, linked


def named(value: str) -> set[str]:
    """Furniture that a class or id names: a name counts if all its parts are cues, words that stand beside them, or numbers."""
    found = set()
    for name in value.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        own = CUES.intersection(parts)
        if own and all(x in CUES or x in BESIDE for x in parts):
            found |= own
    return found


def cues(attributes: str) -> frozenset:
    return _cues(attributes) if len(attributes) < 500 else _cues.__wrapped__(attributes)


@lru_cache(maxsize=20_000)
def _cues(attributes: str) -> frozenset:
    """What class, id, role and style of an element say about it: names of furniture."""
    found = set()
    if _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        found.add("hidden")
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            found |= ROLES.intersection(value.lower().split()) | ({"main"} if "main" in value.lower().split() else set())
        elif name in ("class", "id"):
            found |= named(value)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value.lower() == "true":
            found.add("hidden")
    return frozenset(found)


def parse(source: str | None) -> Node:
    """The tree of a page: block-level nodes, with runs of decoded text as leaves.

    Inline elements are part of the run they stand in (those with furniture's names are left out), end tags that match
    nothing are ignored, and what is open at the end is closed there. Each byte is looked at a bounded number of times.
    """
    source = source or ""
    root = Node("#root")
    stack, run = [root], []
    link, linked, skip, skipped = 0, 0, "", 0
    deep: Counter = Counter()  # open elements beyond DEPTH, which have no node
    buried, within = "", Counter()  # an element of furniture beyond DEPTH, and what is open in it
    at, last = 0, source.rfind(">")

    def flush():
        nonlocal linked
        if run:
            text = "".join(run)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                stack[-1].children.append(Node("#text", text, linked=min(linked, len(text))))
            run.clear()
        linked = 0

    def close(tags, stop=frozenset()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while at <= last and (m := _TOKEN.search(source, at)):
        if m.start() > at and not skip and not buried:
            run.append(piece := source[at : m.start()])
            if link:
                linked += len(piece)
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if buried and tag not in RAW:
            if not end:
                within[tag] += tag not in VOID
                continue
            if within[tag]:
                within[tag] -= 1
                continue
            if tag == buried:
                buried = ""
                continue
            if not deep[tag] and not any(n.tag == tag for n in stack):
                continue
            buried = ""  # an element around it ends
        if end:
            if skip:
                if tag == skip:
                    skipped -= 1
                    skip = skip if skipped else ""
                elif tag not in INLINE and any(n.tag == tag for n in stack):
                    skip = ""
                else:
                    continue
            if tag == "a":
                link = 0
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                flush()
            elif tag not in INLINE and tag not in VOID:
                if deep[tag]:
                    deep[tag] -= 1
                    flush()
                else:
                    close((tag,))
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = over.end() if over else len(source)
            continue
        if skip:
            if tag == skip:
                skipped += 1
            if tag in INLINE or tag in VOID:
                continue
            skip = ""
        if tag == "br":
            run.append(" ")
        elif tag == "hr":
            close(("p",), SCOPE)
            flush()
        elif tag in VOID:
            continue
        elif tag in INLINE:
            if "=" in attributes or "hidden" in attributes:
                found = cues(attributes)
                if found and not attributes.endswith("/"):
                    skip, skipped = tag, 1
                    continue
            link = int(tag == "a") or link
        else:
            if tag in CLOSES_P:
                close(("p",), SCOPE - CLOSES_P if tag != "p" else SCOPE)
            if tag in SAME:
                close(SAME[tag], SCOPE)
            flush()
            link = 0
            if len(stack) > DEPTH:
                inside = deep["article"] or deep["main"] or any(n.tag in ("article", "main") or "main" in n.cue for n in stack)
                found = cues(attributes) - {"main"} - (LOOSE if inside else frozenset()) if attributes else frozenset()
                if tag not in ("article", "main") and (found or tag in FURNITURE and not (inside and tag == "header")):
                    buried, within = tag, Counter()
                else:
                    deep[tag] += 1
                continue
            node = Node(tag, cue=cues(attributes) if attributes else frozenset())
            stack[-1].children.append(node)
            if not attributes.endswith("/") or tag not in ("svg", "path", "use", "object"):
                stack.append(node)
    if at < len(source) and not skip and not buried:  # a tag that never ends is dropped
        run.append(re.split(r"<[a-zA-Z/!?]", source[at:], maxsplit=1)[0])
    flush()
    return root


def leaves(node: Node):
    if node.tag == "#text":
        yield node
    for x in node.children:
        yield from leaves(x)


def holds(node: Node, tags: tuple[str, ...]) -> bool:
    return any(x.tag in tags or "main" in x.cue or holds(x, tags) for x in node.children)


def content(root: Node) -> Node:
    """A page's tree without furniture, below its main element or its articles if it has such."""

    def walk(node: Node, inside: bool) -> Node | None:
        if node.tag == "#text":
            return node
        inside = inside or node.tag in ("article", "main") or "main" in node.cue
        drop = node.tag in FURNITURE or bool(node.cue - {"main"} - (LOOSE if inside else frozenset()))
        if node.tag in ("html", "body", "#root") or "main" in node.cue or node.tag == "main":
            drop = "hidden" in node.cue and node.tag != "body"
        elif node.tag == "article":
            drop = bool(node.cue & COMMENTS) or "hidden" in node.cue
        elif node.tag in HEADINGS:
            drop = "hidden" in node.cue
        elif drop and node.tag not in ("head", "nav", "aside", "footer") and holds(node, ("article", "main")) and not node.cue & COMMENTS:
            drop = False
        if drop:
            if inside and (node.tag == "header" or node.cue == {"header"}) and node.tag not in ("nav", "aside", "form"):
                out = Node("header")
                out.children = [Node(x.tag) for x in node.children if x.tag in HEADINGS]
                for a, b in zip(out.children, [x for x in node.children if x.tag in HEADINGS]):
                    a.children = b.children
                return out if out.children else None
            return None
        out = Node(node.tag, cue=node.cue)
        out.children = [y for x in node.children if (y := walk(x, inside)) is not None and (y.tag == "#text" or y.children)]
        return out

    def find(node: Node, hit) -> list[Node]:
        return [node] if hit(node) else [y for x in node.children for y in find(x, hit)]

    tree = walk(root, False) or Node("#root")
    found = find(tree, lambda n: n.tag == "main" or "main" in n.cue) or find(tree, lambda n: n.tag == "article")
    out = Node("#root")
    if found and any(True for f in found for _ in leaves(f)):
        out.children = found
        return out

    def unlinked(node: Node) -> Node | None:
        if node.tag == "#text":
            return node
        if node.tag in ("ul", "ol", "dl", "table", "td"):
            own = [(len(x.text), x.linked) for x in leaves(node)]
            if sum(a for a, _ in own) * LINKED <= sum(b for _, b in own):
                return None
        node.children = [y for x in node.children if (y := unlinked(x)) is not None]
        return node

    out.children = [y for x in tree.children if (y := unlinked(x)) is not None]
    return out


def skeleton(root: Node) -> list:
    """A tree as nested lists [tag, hash of text or 0, children, runs of text]."""
    below = [skeleton(x) for x in root.children]
    return [root.tag, _hash(root.text) if root.text else 0, below, int(root.tag == "#text") + sum(x[3] for x in below)]


def match(a: list, b: list, known: dict | None = None) -> float:
    """The greatest matching of two trees: simple tree matching, where equal texts count twice. ``known`` remembers pairs of subtrees."""
    if a[0] != b[0]:
        return 0.0
    left, right = a[2], b[2]
    if not left or not right:
        return 2.0 if a[1] and a[1] == b[1] else 1.0
    known = {} if known is None else known
    if len(left) == 1 and len(right) == 1:
        return 1.0 + match(left[0], right[0], known)
    key = id(a), id(b)
    if key not in known:
        known[key] = 1.0 + float(_table(_weights(left, right, known))[-1][-1])
    return known[key]


def _weights(left: list, right: list, known: dict):
    """Matchings of all pairs of children; of many, those without children are compared all at once."""
    if len(left) * len(right) <= FEW:
        return [[match(x, y, known) if x[0] == y[0] else 0.0 for y in right] for x in left]
    w = np.zeros((len(left), len(right)))
    tag = {t: i for i, t in enumerate({x[0] for x in left} | {x[0] for x in right})}
    ta, tb = (np.array([tag[x[0]] for x in c]) for c in (left, right))
    flat = [np.array([x[1] if not x[2] else x[2][0][1] if len(x[2]) == 1 and x[2][0][0] == "#text" else -1 for x in c], np.int64) for c in (left, right)]
    deep = [np.array([0 if not x[2] else 1 if f >= 0 else 2 for x, f in zip(c, fs)]) for c, fs in zip((left, right), flat)]
    same = ta[:, None] == tb[None, :]
    equal = (flat[0][:, None] == flat[1][None, :]) & (flat[0] > 0)[:, None]
    both = np.minimum(deep[0][:, None], deep[1][None, :])
    w[same] = (1.0 + both + (equal & (deep[0][:, None] == deep[1][None, :])))[same]  # a run alone in its element is one level deeper
    for i, j in zip(*np.nonzero(same & (np.maximum(deep[0][:, None], deep[1][None, :]) == 2))):
        w[i, j] = match(left[i], right[j], known)
    return w


def _table(w) -> list | np.ndarray:
    """Best sums of matchings of the first i and the first j children."""
    if isinstance(w, list):
        out = [[0.0] * (len(w[0]) + 1)]
        for own in w:
            above, row = out[-1], [0.0]
            for j, x in enumerate(own):
                row.append(max(above[j + 1], row[j], above[j] + x))
            out.append(row)
        return out
    out = np.zeros((w.shape[0] + 1, w.shape[1] + 1))
    for i in range(len(w)):
        out[i + 1, 1:] = np.maximum.accumulate(np.maximum(out[i, 1:], out[i, :-1] + w[i]))
    return out


def align(a: list, b: list, at: int, to: int, slots: list[int], known: dict) -> int:
    """Write to ``slots`` which leaf of ``b`` (numbered from ``to``) each leaf of ``a`` (numbered from ``at``, in page order) is aligned with; returns the next number."""
    if not a[2]:
        if a[0] == "#text":
            slots[at] = to if b[0] == "#text" else -1
            return at + 1
        return at
    starts, others = [at], [to]
    for x in a[2]:
        starts.append(starts[-1] + x[3])
    for x in b[2]:
        others.append(others[-1] + x[3])
    if b[2]:
        left, right = a[2], b[2]
        pre = 0
        while pre < min(len(left), len(right)) and left[pre] == right[pre]:
            slots[starts[pre] : starts[pre + 1]] = range(others[pre], others[pre + 1])
            pre += 1
        post = 0
        while post < min(len(left), len(right)) - pre and left[-1 - post] == right[-1 - post]:
            k, m = len(left) - 1 - post, len(right) - 1 - post
            slots[starts[k] : starts[k + 1]] = range(others[m], others[m + 1])
            post += 1
        left, right = left[pre : len(left) - post], right[pre : len(right) - post]
        if left and right:
            w = _weights(left, right, known)
            t = _table(w)
            i, j = len(left), len(right)
            while i and j:
                if w[i - 1][j - 1] > 0 and t[i][j] == t[i - 1][j - 1] + w[i - 1][j - 1]:
                    align(left[i - 1], right[j - 1], starts[pre + i - 1], others[pre + j - 1], slots, known)
                    i, j = i - 1, j - 1
                elif t[i][j] == t[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
    return starts[-1]


class Shape:
    """A page's tree for comparisons: skeleton, texts of its leaves with their hashes, which of them their own markup lets stand, leaves of each path of tags."""

    __slots__ = ("skeleton", "texts", "hashes", "stands", "paths", "_words")

    def __init__(self, tree: Node, stands: list[bool] | None = None):
        self.skeleton, self.texts, self.paths, self._words = skeleton(tree), [], Counter(), None
        todo, own = [(tree, "")], set()
        if stands is None:
            own = {id(x) for x in leaves(content(tree))}
        self.stands = stands if stands is not None else []
        while todo:
            node, path = todo.pop()
            path += "/" + node.tag
            if node.tag == "#text":
                self.texts.append(node.text)
                if stands is None:
                    self.stands.append(id(node) in own)
                self.paths[path] += 1
            todo += [(x, path) for x in reversed(node.children)]
        self.hashes = [_hash(t) for t in self.texts]

    @property
    def words(self) -> tuple[int, set[str]]:
        """(words of the page, distinct ones)."""
        if self._words is None:
            every = " ".join(t for t, stands in zip(self.texts, self.stands) if stands).split()
            self._words = len(every), set(every)
        return self._words

    def near(self, other: Shape) -> float:
        """How alike two pages are built, whatever their texts: common paths of leaves."""
        return 2 * sum(min(n, other.paths[p]) for p, n in self.paths.items() if p in other.paths) / max(1, len(self.texts) + len(other.texts))


#: Stands before the hash of a text that isn't kept.
HASHED = "\0crc:"


def _hash(text: str) -> int:
    return int(text[len(HASHED) : -1]) if text.startswith(HASHED) else zlib.crc32(text.encode("utf-8", "replace"))


def telling(text: str) -> bool:
    """Whether a text may be template by itself."""
    return text[-1] == "+" if text.startswith(HASHED) else text.count(" ") >= SHORT


def packed(tree: Node, stands: list[bool]) -> bytes:
    """A tree as compressed JSON: nested lists [tag, text, children], and which leaves stand. Of leaves that don't, only the hash is kept."""
    left = iter(stands)

    def lists(node: Node) -> list:
        text = node.text
        if node.tag == "#text" and not next(left):
            text = f"{HASHED}{_hash(text)}{'+' if telling(text) else '-'}"
        return [node.tag, text, [lists(x) for x in node.children]]

    raw = json.dumps([lists(tree), [int(x) for x in stands]], ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def unpacked(data: bytes) -> Shape:
    def node(s: list) -> Node:
        out = Node(s[0], s[1])
        out.children = [node(x) for x in s[2]]
        return out

    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    tree, stands = json.loads(raw.decode("utf-8", "surrogatepass"))
    return Shape(node(tree), [bool(x) for x in stands])


def is_copy(own: Shape, other: Shape) -> bool:
    """Whether a page is a copy of another: nearly all words equal, and most of them in the leaves that differ too.

    However long the boilerplate two pages have in common, articles of their own tell them apart.
    """
    (n, mine), (m, theirs) = own.words, other.words
    least = COPY * max(n, m)  # words in common are at most those of the smaller page, less those the other lacks
    if min(n, m) < least or n - len(mine - theirs) < least:
        return False
    mine, theirs = (Counter(h for h, stands in zip(x.hashes, x.stands) if stands) for x in (own, other))
    same = mine & theirs
    if mine == theirs:
        return True

    def rest(shape: Shape) -> tuple[int, Counter]:
        left, shared, words = same.copy(), 0, Counter()
        for t, h, stands in zip(shape.texts, shape.hashes, shape.stands):
            if not stands:
                continue
            if left[h]:
                left[h] -= 1
                shared += len(t.split())
            else:
                words.update(t.split())
        return shared, words

    (shared, a), (_, b) = rest(own), rest(other)
    common, longest = sum((a & b).values()), max(a.total(), b.total())
    return common >= VARIES * longest and shared + common >= COPY * (shared + longest)


def placed(own: Shape, pivots: list[Shape]) -> tuple[int, list[int]]:
    """(number of the pivot that is built most like a page, the pivot's leaf that each leaf of the page is aligned with, or -1)."""
    k = max(range(len(pivots)), key=lambda i: (own.near(pivots[i]), -i))
    slots = [-1] * len(own.texts)
    align(own.skeleton, pivots[k].skeleton, 0, 0, slots, {})
    return k, slots


def extract(page: str | None, pivots: list[Shape], template: frozenset | set = frozenset()) -> tuple[str, int]:
    """(main text, template leaves removed) of a page, given the pivots of its host and its template: "pivot/slot/text hash", or "pivot/slot" for all texts."""
    own = Shape(parse(page))
    gone = [False] * len(own.texts)
    if own.texts and template:
        k, slots = placed(own, pivots)
        gone = [f"{k}/{at}" in template or f"{k}/{at}/{h}" in template for h, at in zip(own.hashes, slots)]
    return "\n".join(t for t, g, s in zip(own.texts, gone, own.stands) if s and not g), sum(gone)


def host_of(url: str = "url"):
    """The host of a URL, lower-cased; empty for a null or odd URL."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


@lru_cache(maxsize=500)
def _pivots(trees: tuple[bytes, ...]) -> list[Shape]:
    return [unpacked(t) for t in trees]


def beside(rows: DataFrame, hosts: DataFrame, columns: tuple[str, ...]):
    """(rows, read): ``read`` gives, in a task, each row's ``columns`` of its host, or None each.

    Up to BROADCAST_BYTES of trees go to each worker once; beyond, rows are joined to them.
    """
    size = F.aggregate("trees", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))
    if hosts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] > BROADCAST_BYTES:
        return rows.join(hosts.select("host", *columns), "host", "left"), lambda part: zip(*(part.column(c).to_pylist() for c in columns))
    held = rows.sparkSession.sparkContext.broadcast({r[0]: tuple(tuple(bytes(x) if isinstance(x, bytearray) else x for x in c) for c in r[1:]) for r in hosts.select("host", *columns).collect()})
    return rows, lambda part: (held.value.get(h) or (None,) * len(columns) for h in part.column("host").to_pylist())


def induce(pages: DataFrame) -> DataFrame:
    """(host, trees, template): a host's packed pivot trees and the "pivot/slot/hash" of its template texts; only hosts that have any.

    Every page with distinct content votes once. Shuffled are trees once (by content), then counts that tasks have
    summed up; never whole hosts.
    """
    spark = pages.sparkSession

    def shapes(batches):
        for part in slices(batches, "html"):
            out = []
            for host, text in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                tree = parse(text)
                own = Shape(tree)
                if own.texts:
                    out.append((host, _hash("\n".join(sorted(own.paths))), _hash(max(own.texts, key=len)), packed(tree, own.stands)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["host", "shape", "longest", "tree"])

    given = pages.where("html is not null").select(host_of().alias("host"), "html")
    trees = py(spark, given, shapes, "host string, shape long, longest long, tree binary").withColumn("h", F.xxhash64("tree"))
    voters = settle(trees.dropDuplicates(["host", "h"]), "voters")

    def commonest(kind: str) -> DataFrame:
        best = voters.groupBy("host", kind).agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h"))
        rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), kind))
        return best.withColumn("k", rank).where(F.col("k") <= PIVOTS).select("host", "h", F.lit(kind).alias("kind"), "k")

    picked = settle(commonest("shape").unionByName(commonest("longest")), "picked").groupBy("host", "h").agg(F.min(F.struct(F.when(F.col("kind") == "shape", 0).otherwise(1).alias("kind"), "k")).alias("at"))
    pivots = voters.select("host", "h", "tree").join(picked, ["host", "h"]).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "h", "tree"))).alias("p"))  # at most 2 * PIVOTS a host
    pivots = settle(pivots.select("host", F.col("p.h").alias("ids"), F.col("p.tree").alias("trees")), "pivots")

    joined, read = beside(voters.select("host", "h", "tree"), pivots, ("ids", "trees"))

    def count(batches):
        for part in slices(batches, "tree"):
            seen = Counter()
            own_columns = (part.column(c).to_pylist() for c in ("host", "h", "tree"))
            for host, h, tree, (ids, trees) in zip(*own_columns, read(part)):
                own, others = unpacked(tree), _pivots(tuple(trees))
                before = others[: ids.index(h)] if h in ids else others  # of pivots that are copies of each other the first votes
                if any(is_copy(own, x) for x in before):
                    continue
                k, slots = placed(own, others)
                seen[host, k, -1, 0] += 1
                at = slots
                seen.update((host, k, i, x) for i, x, t in zip(at, own.hashes, own.texts) if i >= 0 and telling(t))
                seen.update((host, k, i, ALL) for i in at if i >= 0)
                seen.update((host, k, i, OUT) for i, stands in zip(at, own.stands) if i >= 0 and not stands)
            yield pa.RecordBatch.from_arrays([pa.array([key[i] for key in seen], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))] + [pa.array(list(seen.values()), pa.int64())], ["host", "pivot", "slot", "text", "n"])

    counts = settle(py(spark, joined, count, "host string, pivot int, slot int, text long, n long").groupBy("host", "pivot", "slot", "text").agg(F.sum("n").alias("n")).where(F.col("n") >= F.when(F.col("slot") < 0, 1).otherwise(AGREE)), "counts")
    voted = counts.where("slot < 0").select("host", "pivot", F.col("n").alias("voted"))
    often = counts.where("slot >= 0 and text >= 0").join(voted, ["host", "pivot"]).where(F.col("n") >= SHARE * F.col("voted"))
    filled = often.withColumn("mass", F.sum("n").over(Window.partitionBy("host", "pivot", "slot"))).where("2 * mass > voted")  # at most 1 / SHARE texts a slot
    constant = filled.select("host", F.concat_ws("/", "pivot", "slot", "text").alias("t"))
    every = counts.where(F.col("text") == ALL).where(F.col("n") >= FILLED).select("host", "pivot", "slot", F.col("n").alias("every"))
    out = counts.where(F.col("text") == OUT).join(every, ["host", "pivot", "slot"]).where(F.col("n") >= MARKED * F.col("every"))
    template = constant.unionByName(out.select("host", F.concat_ws("/", "pivot", "slot").alias("t"))).groupBy("host").agg(F.collect_list("t").alias("template"))  # bounded by the slots of a host's pivots
    return pivots.select("host", "trees").join(template, "host")


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of pages (page_id, url, html).

    Returns page_id, url, text, n_chars (code points) and n_template (leaves removed as the host's template, whatever their markup).
    Null and empty html give an empty text; a null or odd URL belongs to the host ""; rows that repeat a
    page_id are extracted each; an empty table gives an empty one. Nothing is cut from long pages.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    induced = settle(induce(pages), "wrappers")
    joined, read = beside(pages.withColumn("host", host_of()), induced, ("trees", "template"))

    def run(batches):
        known = {}
        for part in slices(batches, "html"):
            rows = []
            for host, text, (trees, template) in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), read(part)):
                if trees and host not in known:
                    known[host] = frozenset(template)
                rows.append(extract(text, _pivots(tuple(trees)), known[host]) if trees else extract(text, []))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_template"],
            )

    return py(spark, joined, run, "page_id long, url string, text string, n_chars long, n_template long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
