"""Main text of raw pages by scoring the tree.

An element is suspected of being page furniture by its kind, its role and the words of its class and id; the suspicion
falls where it holds most of the page's text, as a layout's wrapper does. Every paragraph passes points, for its length and
its commas, to the elements above it, halved from level to level; an element's points are discounted by the share of its
text that stands in links. The best container and those of its siblings that score well enough are kept; a container within
an article or main element stands for that element. All passes over a page take time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .support import read

# The elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = RAW | frozenset("noscript template head button select option input svg canvas object embed video audio map datalist math".split())
ASIDE = frozenset("nav aside footer menu dialog".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main nav ol p pre section summary table tbody td tfoot th thead tr ul aside footer form".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main figcaption h1 h2 h3 h4 h5 h6".split())
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCKS - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "legend"}
#: An element that ends an open one of its kind, and up to which container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of class and id that name furniture: readers' remarks, parts of a page, and parts that a layout may also wrap the article in.
REMARKS = frozenset("comment comments commentlist discussion discussions disqus feedback remarks replies reply respond responses".split())
#: Elements that may hold remarks; a name on a span, a paragraph or code says something of its text instead.
HOLDERS = frozenset("article aside dd details div dl footer form li ol section table ul".split())
PARTS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot alert alerts breadcrumb breadcrumbs consent cookie cookies footer footers gdpr masthead nav navbar navigation newsletter
    notice notices pagination pager related share sharing signup social sponsor sponsored sponsors subscribe subscription toolbar topbar""".split()
)
WRAPS = frozenset("banner banners header menu menus modal overlay popup promo promos promotion sidebar sidebars widget widgets".split())
FURNITURE = REMARKS | PARTS | WRAPS
#: Words that may stand beside these in a name of furniture; with any other word a name says something else.
NEUTRAL = frozenset(
    """all area article articles bar bars bg blog block blocks body bottom box boxes button buttons cell center col column container containers content count desktop entries entry first fixed float
    global group head heading holder home html icon icons id image images img inner item items js label last latest layout left line link links list lists loop lower main message messages mobile module more my
    name new news outer outside page pages panel panels pane policy popular post posts primary rail recent region right row section sections secondary secondarywrap set single site slot small sticky stories story
    strip sub text thread title tool tools top unit upper user users view wide wrap wrapper wrapping zone""".split()
)
EXCEPT = frozenset("has no not with without".split())
CONTENT = frozenset("article content post entry story main body text page".split())
#: Elements that an end tag of running text does not reach beyond.
BARRIERS = frozenset("td th table article main".split())
HEADINGS = frozenset("h1 h2 h3".split())

# A quoted value begins after an equals sign only, and no part gives back what it has taken, so a match takes linear time.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^\s/>]*+(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+>|</?[a-zA-Z].*+|<!?[^a-zA-Z/<][^<]*+|[^<]++|<", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"\shidden(?=[\s=/>])", re.I)
_NOT_SHOWN = re.compile(r"\saria-hidden\s*=\s*[\"']?true\b|\sstyle\s*=\s*(?:\"[^\"]*?|'[^']*?|)\b(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
GOOD_SIBLING = 0.2
#: Characters outside links from which an article or main element is taken for the page's.
LEAST_ARTICLE = 60


class Node:
    __slots__ = ("children", "inside", "kind", "links", "name", "parent", "passed", "size", "tag", "within")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.children: list[Node | str] = []
        self.kind = ""  # of furniture, if it is suspected: remarks, part or wrap
        self.name = ""  # its class
        self.passed = 0.0  # points of the paragraphs below
        self.size = self.links = self.within = 0  # characters: of all text, in links, in articles


def _hidden(source: str) -> bool:
    """Whether a tag's attributes hide its element from readers."""
    bare = _QUOTED.sub('""', source)
    return bool(_HIDDEN.search(bare) or _NOT_SHOWN.search(source))


def _suspected(tag: str, source: str, parent: Node) -> str:
    """What kind of furniture an element may be, or nothing; a header within an article is the article's own."""
    within = parent.inside
    if tag in ASIDE or ("=" in source or "hidden" in source) and _hidden(source):
        return "part"
    if tag == "form" or (tag == "header" and not within):
        return "wrap"
    if "=" not in source or tag in ("html", "body", "main"):
        return ""
    for m in _ATTRIBUTE.finditer(source):
        value = next(g for g in m.groups()[1:] if g is not None)
        if m[1].lower() == "role":
            if tag != "article" and value.strip().lower() in ROLES:
                return "part"
            continue
        for name in value.split():
            words = {w.lower() for w in _WORDS.findall(name)}
            named = words & FURNITURE
            if not named or words & EXCEPT or not words <= FURNITURE | NEUTRAL or (within and named == {"header"}):
                continue
            if named & REMARKS:
                if tag in HOLDERS:
                    return "remarks"
                continue
            first, last = _WORDS.match(name), _WORDS.findall(name)[-1].lower()
            if tag == "article" or (last in CONTENT and first is not None and first[0].lower() not in FURNITURE):
                continue
            return "part" if named & PARTS else "wrap"
    return ""


class _Open:
    """The open elements, with the places of each kind in the stack, so that no tag makes the whole stack be walked."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}
        self.dropped: list[bool] = [False]

    def last(self, key: str) -> int:
        """The place of the innermost element of a tag, or of a set of tags by its name; 0 is the root."""
        places = self.at.get(key)
        return places[-1] if places else 0

    def _keys(self, tag: str) -> list[str]:
        return [tag, *[k for k, tags in (("#block", BLOCKS), ("#barrier", BARRIERS)) if tag in tags]]

    def push(self, node: Node, dropped: bool) -> None:
        for k in self._keys(node.tag):
            self.at.setdefault(k, []).append(len(self.stack))
        self.stack.append(node)
        self.dropped.append(dropped)

    def close(self, place: int) -> None:
        """Ends the element at a place and all within it."""
        while len(self.stack) > place:
            self.dropped.pop()
            for k in self._keys(self.stack.pop().tag):
                self.at[k].pop()


def parse(source: str) -> Node:
    """A tree of elements and text. Unclosed, stray and cut-off tags are mended as a browser would for text."""
    root = Node("html", None)
    open_ = _Open(root)
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        part, at = m[0], m.end()
        node, dropped = open_.stack[-1], open_.dropped[-1]
        name = _NAME.match(part) if part[0] == "<" else None
        if name is None:
            if not dropped and not part.startswith(("<!", "<?")):
                node.children.append(part)
            continue
        if part[-1] != ">":
            continue  # the page is cut off within a tag
        tag = name[1].lower()
        if part[1] == "/":
            place = open_.last(tag)
            if place and (tag in BLOCKS or place >= open_.last("#barrier")):
                open_.close(place)
            elif tag == "br" and not dropped:
                node.children.append(" ")
            continue
        if tag in VOID:
            if not dropped:
                node.children.append(Node(tag, node) if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P and open_.last("p") and open_.last("p") == open_.last("#block"):
            open_.close(open_.last("p"))
        if tag in SIBLINGS:
            ended, within = SIBLINGS[tag]
            least = max(map(open_.last, within))
            places = [at_[i] for e in ended if (i := bisect_right(at_ := open_.at.get(e, ()), least)) < len(at_)]
            if places:
                open_.close(min(places))
        if open_.stack[-1].tag == "head" and tag not in ("script", "style", "title", "noscript", "template"):
            open_.close(len(open_.stack) - 1)
        node, dropped = open_.stack[-1], open_.dropped[-1] or tag in DROPPED
        child = Node(tag, node)
        if not dropped:
            child.kind = _suspected(tag, part, node)
            child.name = next((next(g for g in a.groups()[1:] if g is not None) for a in _ATTRIBUTE.finditer(part) if a[1].lower() == "class"), "")
            node.children.append(child)
        if tag in RAW:
            end = _END[tag].search(source, at)
            at = end.end() if end else n
        elif not part.endswith("/>") or tag not in ("svg", "path"):
            open_.push(child, dropped)
    return root


def _in_order(root: Node) -> list[Node]:
    """All elements, each before its children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    return out


def _cleared(root: Node) -> None:
    """Takes furniture out of the tree.

    Readers' remarks go unless the page holds nothing else. Other parts stay where an article or main element within them holds over half of the
    page's text; a wrapper or form also where it holds so much itself and no article or main element has text elsewhere.
    """
    nodes = _in_order(root)
    linked: dict[Node, bool] = {}
    for x in nodes:
        linked[x] = x.tag == "a" or (x.parent is not None and linked[x.parent])
        x.size = 0 if linked[x] else sum(len(c.strip()) for c in x.children if isinstance(c, str))
    above: dict[Node, bool] = {}
    for x in nodes:
        above[x] = x.kind == "remarks" or (x.parent is not None and above[x.parent])
    alone = not any(x.size for x in nodes if not above[x])
    for x in reversed(nodes):
        if x.kind == "remarks" and alone:
            x.kind = ""
        if x.kind == "remarks":
            x.size = x.within = 0
        if x.tag in ("article", "main"):
            x.within = x.size
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.within += x.within
    most, articles = root.size / 2, root.within
    for x in nodes:
        stays = x.kind != "remarks" and (x.within > most or (x.kind == "wrap" and x.size > most and x.within == articles))
        if x.kind and not stays:
            x.children = []


def _blocks(root: Node) -> list[tuple[str, Node, int]]:
    """The text of blocks in page order, with the element of each and the characters of it in links."""
    out: list[tuple[str, Node, int]] = []
    held: list[str] = []
    links = 0

    def flush(owner: Node) -> None:
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            out.append((text, owner, min(links, len(text))))
        held.clear()
        links = 0

    stack: list[tuple[Node, int, bool, Node]] = [(root, 0, False, root)]  # element, next child, in a link, the block it stands in
    while stack:
        here, i, linked, owner = stack.pop()
        if i == len(here.children):
            if here.tag in BLOCKS:
                flush(here)
            continue
        stack.append((here, i + 1, linked, owner))
        child = here.children[i]
        if isinstance(child, str):
            held.append(child)
            links += len(child) if linked else 0
        elif child.tag in BLOCKS:
            flush(owner)
            stack.append((child, 0, linked, child))
        else:
            stack.append((child, 0, linked or child.tag == "a", owner))
    flush(root)
    return out


def _keeps(x: Node, best: Node, top: float, score: dict[Node, float], paragraphs: set[Node], running: set[Node]) -> bool:
    """Whether a sibling of the best container is part of the article."""
    density = x.links / x.size
    alike = x.tag == best.tag or x.tag in ("article", "section")
    if x.tag == best.tag and x.name and x.name == best.name and density < 0.25 and x in running:
        return True  # another row of the same kind
    long = x.size > (40 if alike else 80)
    if density < 0.5 and (x.tag in HEADINGS or score.get(x, 0.0) >= (GOOD_SIBLING * top if alike and (long or x in paragraphs) else max(10, GOOD_SIBLING * top))):
        return True
    return density < 0.25 and long and (x.tag == "p" or x in paragraphs)


def extract(source: str | None) -> str:
    """The main text of a page: its blocks, joined by line breaks."""
    root = parse(source or "")
    _cleared(root)
    blocks = _blocks(root)
    if not blocks:
        return ""
    nodes = _in_order(root)
    for x in nodes:
        x.size = x.links = 0
    paragraphs: set[Node] = set()
    for text, owner, links in blocks:
        owner.size += len(text)
        owner.links += links
        if owner.tag == "p" and owner.parent is not None:
            paragraphs.add(owner.parent)
        if owner.tag not in PARAGRAPHS:
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        points *= 1 - links / len(text)
        to = owner.parent if owner.tag not in ("div", "section", "article", "main") else owner
        to.passed += points
    score: dict[Node, float] = {}
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.links += x.links
            x.parent.passed += x.passed / 2
            if x.passed:
                score[x] = x.passed * (1 - x.links / max(1, x.size))
    running: set[Node] = set()  # with a paragraph somewhere below
    for x in reversed(nodes):
        if x.parent is not None and (x in paragraphs or x in running):
            running.update((x, x.parent))
    # the page's one article, or else its one main element, wins over what weighs more outside it
    outer: dict[str, list[Node]] = {"article": [], "main": []}
    where: dict[Node, dict[str, Node]] = {}
    for x in nodes:
        where[x] = dict(where[x.parent]) if x.parent is not None else {}
        if x.tag in outer and x.tag not in where[x]:
            where[x][x.tag] = x
            if x.size - x.links >= LEAST_ARTICLE and x.links < x.size / 3 and x in running:
                outer[x.tag].append(x)
    only = next((x[0] for x in outer.values() if len(x) == 1), None) if len(outer["article"]) < 2 else None
    best = max((x for x in nodes if x in score and (only is None or where[x].get(only.tag) is only)), key=score.__getitem__, default=only or root)
    up, top = best, score.get(best, 0.0)
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = None if up is only else up.parent
    while best.parent is not None and best.parent is not root and best.parent.size == best.size and best.tag not in ("article", "main"):
        best = best.parent  # a wrapper of nothing else: what stands beside it counts
    kept = {best}
    if best is not root and best.tag != "main":
        kept |= {x for x in best.parent.children if isinstance(x, Node) and x is not best and x.size and (x.tag in HEADINGS if best is only else _keeps(x, best, score.get(best, top), score, paragraphs, running))}
    stays: set[Node] = set()
    for x in nodes:
        if x in kept or x.parent in stays:
            stays.add(x)
    return "\n".join(text for text, owner, _ in blocks if owner in stays)


def main_text(pages: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep of every row of pages, with text and n_chars, its code points.

    A null or empty page has an empty text. Pages without any element of text outside furniture have an empty text too.
    Repeated rows stay repeated; an empty table gives an empty result; only the columns named are read.
    """
    wanted = pages.select(*keep, source)

    def kernel(batches):
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return wanted.mapInArrow(kernel, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
