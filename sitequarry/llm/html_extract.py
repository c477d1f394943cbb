"""HTML extraction by tree scoring.

A page becomes a tree of elements. Elements that are never content (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are left out. Every paragraph passes points for its length and its
commas to its ancestors, less with each level; a container's points are discounted by its link density. The best
container is kept, or the article or main element around it, with those siblings that score near it, and its blocks are the page's text.

What an element is called decides less inside an article or main element than outside: there a name counts only if all its words
are of that kind ("ad-banner" goes, "social-science" stays), and headings and paragraphs don't go by their id.

Defined results: null html is an empty page; an empty page, and one without text, gives ''; unclosed tags, stray end tags
and unclosed quotes are tolerated; a page of any length and depth is read whole, in time that grows with its length; rows are kept as they come, repeated or not; other
columns are ignored. <br> counts as white space.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
QUOTED_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
DECLARATION = re.compile(r"<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
VALUE = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg canvas".split())
DROPPED = RAW | frozenset("nav footer aside form button select input dialog menu head fieldset audio video annotation annotation-xml".split())
DROPPED_OUTSIDE = frozenset("noscript object label".split())  # in an article, or in a paragraph, what they hold is text
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("html body caption td th tr tbody thead tfoot legend summary".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr td th", ("table",)), "option": ("option", ("select",)), "body": ("head", ())}
BARRIERS = ("td", "th", "table", "article", "main")
OVER_BARRIERS = frozenset("table tr tbody article main body html section div".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p pre blockquote".split())
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion promoted banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup"
    " login sidebar sidebars aside rail nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot bottombar copyright comment comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations"
    " widget widgets pagination pager toolbar skip hidden search form outbrain taboola tracking".split()
)
CONTENT = frozenset("article content main body post entry story text".split())
ALWAYS = frozenset("comment comments sidebar ad ads advert footer nav menu related".split())
BESIDE = frozenset("area bar block bottom box btn button buttons class col column container content group icon icons inner item items js left line link links list mod module outer panel post posts right row section side slot text title tools top unit wrap wrapper".split())  # words that say nothing of what an element is
NOT_OF_TEXT = frozenset("header masthead search form social menu discussion share reply skip alert notice".split())  # an article's headings and paragraphs may be called so
NOT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WEIGHT = {"article": 25, "main": 15, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "dt": -3, "dd": -3, "address": -3, "th": -5}
SCORED = frozenset("p td pre blockquote li dd div section article main body figcaption h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "points", "length", "linked", "links", "cls", "inside", "in_link", "own", "commas", "beside_text")

    def __init__(self, tag: str, parent: Node | None, cls: str = ""):
        self.tag, self.parent, self.cls = tag, parent, cls
        self.parts: list = []  # texts and nodes in page order
        self.points, self.length, self.linked, self.links = 0.0, 0, 0, 0
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.in_link = tag == "a" or parent is not None and parent.in_link
        self.own, self.commas, self.beside_text = 0, 0, False  # length and commas of the text that stands directly in it; whether it holds headings or paragraphs


def names_noise(names: str, tag: str, inside: bool) -> bool:
    """Whether the class and id of an element say that it is no content."""
    if not inside:
        parts = {p.lower() for p in NAME_PART.findall(names)}
        bad = parts & NOT_CONTENT
        return bool(bad) and (not parts & CONTENT or bool(bad & ALWAYS))
    for name in names.split():
        parts = {p.lower() for p in NAME_PART.findall(name)}
        bad = parts & NOT_CONTENT - ({"header", "masthead"} | (NOT_OF_TEXT if tag in TEXTUAL or tag not in BLOCK else set()))
        if bad and (not parts - bad - BESIDE or bad & ALWAYS and parts & CONTENT and not parts - bad - CONTENT - BESIDE):
            return True
    return False


def unwanted(tag: str, attributes: str, above: Node, in_paragraph: bool) -> tuple[bool, str]:
    """Whether an element is left out, and its class and id."""
    if tag in DROPPED:
        return True, ""
    if tag in DROPPED_OUTSIDE:
        return not (above.inside or in_paragraph), ""
    if tag == "header":
        return not above.inside, ""
    if not attributes or tag in ("html", "body"):
        return False, ""
    found = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if found.get("role", "").lower() in NOT_ROLE or found.get("aria-hidden", "").lower() == "true" or "hidden" in VALUE.sub("", attributes).lower().split() or "hidden" in found or re.search(r"display\s*+:\s*+none", found.get("style", ""), re.I):
        return True, names
    if names != " " and tag not in ("article", "main") and names_noise(found.get("class", "") if above.inside and tag in TEXTUAL else names, tag, above.inside):
        return True, names
    return False, names


class Tokens:
    """The tags of a page, one after the other. A scan that finds no end is not begun again."""

    def __init__(self, page: str):
        self.page, self.failures, self.unended = page, 0, set()
        self.last = page.rfind(">")

    def next(self, at: int):
        """(place, end, closing, tag, attributes) of the next tag from at on; tag is '' for what isn't one. None if there is none."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                return at, COMMENT.match(page, at).end(), "", "", ""
            if at > self.last:
                return None
            match = QUOTED_TAG.match(page, at) if self.failures < 16 else None
            if not match:
                match = PLAIN_TAG.match(page, at)
                self.failures += match is not None
            if match:
                return at, match.end(), match[1], match[2].lower(), match[3]
            if match := DECLARATION.match(page, at):
                return at, match.end(), "", "", ""
            at += 1
        return None

    def after_raw(self, tag: str, at: int) -> int:
        """Where the page goes on after an element whose content isn't markup."""
        if tag not in self.unended:
            if close := re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at):
                return close.end()
            self.unended.add(tag)
        return len(self.page) if tag in ("script", "style") else at


class Tree:
    """The tree of a page, without what is never content. nodes are in page order, so a node comes before what it holds."""

    def __init__(self):
        self.nodes = [Node("html", None)]
        self.open = [self.nodes[0]]
        self.at: dict[str, list[int]] = defaultdict(list)  # the places of open elements, by tag
        self.blocks: list[int] = []  # those of blocks other than p
        self.barriers: list[int] = []

    def text(self, text: str) -> None:
        self.open[-1].parts.append(text)

    def add(self, tag: str, cls: str = "") -> Node:
        node = Node(tag, self.open[-1], cls)
        self.open[-1].parts.append(node)
        self.nodes.append(node)
        return node

    def begin(self, tag: str, cls: str) -> None:
        place = len(self.open)
        self.open.append(self.add(tag, cls))
        self.at[tag].append(place)
        if tag in BLOCK and tag != "p":
            self.blocks.append(place)
        if tag in BARRIERS:
            self.barriers.append(place)

    def end_from(self, place: int) -> None:
        while len(self.open) > place:
            tag = self.open.pop().tag
            self.at[tag].pop()
            for places in (self.blocks, self.barriers):
                if places and places[-1] == len(self.open):
                    places.pop()

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def close(self, tag: str) -> None:
        place = self.last(tag)
        if place and (tag in OVER_BARRIERS or tag in BARRIERS or not self.barriers or self.barriers[-1] <= place):
            self.end_from(place)

    def before(self, tag: str) -> None:
        """Ends what a tag that begins ends: an open paragraph, an item before it."""
        if tag in ENDS_P and self.last("p") > (self.blocks[-1] if self.blocks else 0):
            self.end_from(self.last("p"))
        if tag in CLOSES:
            ends, limits = CLOSES[tag]
            limit = self.last(*limits)
            while (place := self.last(*ends.split())) > limit:
                self.end_from(place)
                if tag != "tr":
                    break


def parse(page: str) -> Tree:
    tree, tokens, at = Tree(), Tokens(page), 0
    skipped: list[str] = []  # open elements inside one that is left out
    depth: Counter = Counter()

    def skip(tag: str) -> int:
        if tag in RAW:
            return tokens.after_raw(tag, at)
        skipped.append(tag)
        depth[tag] += 1
        return at

    while at < len(page):
        token = tokens.next(at)
        if not skipped and (text := page[at : token[0] if token else len(page)]):
            tree.text(text)
        if not token:
            break
        _, at, closing, tag, attributes = token
        if not tag:
            continue
        if skipped:
            if closing:
                if depth[tag]:
                    while (ended := skipped.pop()) != tag:
                        depth[ended] -= 1
                    depth[tag] -= 1
                elif tag in ("body", "html", "article", "main"):  # an element that was left open
                    skipped.clear()
                    depth.clear()
                    tree.close(tag)
            elif tag not in VOID and not attributes.endswith("/"):
                if tag == "body":
                    skipped.clear()
                    depth.clear()
                    tree.begin("body", "")
                elif tag == skipped[-1] or tag in DROPPED or tag in ("div", "ul", "ol", "section", "table"):
                    at = skip(tag)
            continue
        if closing:
            tree.close(tag)
            continue
        tree.before(tag)
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                tree.add(tag)
            continue
        drop, cls = unwanted(tag, attributes, tree.open[-1], tree.last("p") > (tree.blocks[-1] if tree.blocks else 0))
        if drop:
            if tag in BLOCK:
                tree.add("hr")
            if not attributes.endswith("/"):
                at = skip(tag)
            continue
        if not (attributes.endswith("/") and tag not in BLOCK and tag != "a"):
            tree.begin(tag, cls)
    return tree


def score(nodes: list[Node]) -> None:
    """Passes the points of every paragraph to its ancestors."""
    for node in reversed(nodes):
        holds_blocks = False
        for part in node.parts:
            if isinstance(part, str):
                size = len(part.strip())
                node.own, node.commas = node.own + size, node.commas + part.count(",")
                node.length += size
                node.linked += size * node.in_link
                continue
            node.length, node.linked, node.links = node.length + part.length, node.linked + part.linked, node.links + part.links
            node.beside_text |= part.tag in TEXTUAL and part.length > 0
            if part.tag in BLOCK:
                holds_blocks = True
            else:
                node.own, node.commas = node.own + part.own, node.commas + part.commas
        node.links += node.tag == "a"
        if node.tag in SCORED and node.own >= 25:
            points = 1 + node.commas + min(node.own / 100, 3)
            above, level = node if holds_blocks and node.tag not in ("p", "li", "dd") else node.parent or node, 0
            while above is not None and level < 5:
                above.points += points / (1, 2, 6, 9, 12)[level]
                above, level = above.parent, level + 1


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def best_containers(nodes: list[Node]) -> list[Node]:
    """The best container and the siblings that belong with it, in page order."""
    rating = lambda n: (n.points + WEIGHT.get(n.tag, 0)) * (1 - density(n))
    rated = [n for n in nodes if n.points > 0 and n.tag not in ("p", "a", "html")]
    if not rated:
        named = [n for n in nodes if n.tag in ("article", "main") and n.length] or [n for n in nodes if n.tag == "body"]
        return [max(named, key=lambda n: n.length)] if named else nodes[:1]
    best = max(rated, key=rating)
    if best.tag in ("td", "blockquote", "pre", "li") and best.parent:
        best = best.parent
    top = rating(best)
    for tag in ("article", "main"):
        around = best
        while around is not None and around.tag != tag:
            around = around.parent
        if around is not None:
            best = around
            break
    if best.parent is None:
        return [best]
    kept = []
    headed = any(isinstance(p, Node) and p.tag == "h1" for p in best.parts)
    for part in best.parent.parts:
        if isinstance(part, str):
            continue
        alike = part.tag == best.tag or best.tag in ("div", "section") and part.tag in ("div", "section", "article")
        near = alike and part.points > 0 and rating(part) >= max(10, top * 0.2)
        same = part.tag == best.tag and best.tag in ("div", "section") and part.cls == best.cls and part.length > 0 and density(part) < 0.25
        paragraph = part.tag == "p" and best.tag != "article" and part.length > 80 and density(part) < 0.25
        heading = part.tag in ("h1", "h2") and best.tag in ("div", "section") and not headed
        if part is best or near or same or paragraph or heading:
            kept.append(part)
    return kept


def blocks_of(top: Node, out: list[list[str]]) -> None:
    """Adds the texts beneath a node to out, a list for each block."""
    open_ = [(top, iter(top.parts))]
    out.append([])
    while open_:
        node, parts = open_[-1]
        part = next(parts, None)
        if part is None:
            open_.pop()
            if node.tag in BLOCK:
                out.append([])
        elif isinstance(part, str):
            out[-1].append(part)
        elif part.tag == "br":
            out[-1].append(" ")
        elif part.tag in ("ul", "ol", "div", "table", "dl") and not part.inside and not node.beside_text and part.links >= 3 and density(part) > 0.8:
            out.append([])  # a menu: nothing but links, outside any article, and not among paragraphs
        else:
            if part.tag in BLOCK:
                out.append([])
            open_.append((part, iter(part.parts)))


def main_text(page: str | None) -> str:
    """The main text of a page: blocks with single spaces, joined by a blank line."""
    if not page:
        return ""
    nodes = parse(page).nodes
    score(nodes)
    out: list[list[str]] = [[]]
    for node in best_containers(nodes):
        out.append([])
        blocks_of(node, out)
    joined = (" ".join(unescape("".join(x)).split()) for x in out if x)
    return "\n\n".join(x for x in joined if x)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
