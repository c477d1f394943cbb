"""HTML extraction: one pass of the standard parser over each page gives all columns, and the html is dropped.

Pages are read in Arrow batches where they lie; nothing is shuffled. Unclosed tags are tolerated.
"""

from __future__ import annotations

import re
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from ..sources.shared import materialised
from .totals import within

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# What isn't content, which blocks make the text, where an article stands.
REMOVED_TAGS = frozenset("script style noscript iframe svg canvas template nav header footer aside img video audio".split())
REMOVED_ROLES = frozenset("navigation banner contentinfo".split())
REMOVED_CLASSES = frozenset("cookie cookies cookie-banner cookie-consent nav navbar menu sidebar breadcrumb breadcrumbs ads advertisement social-share share-buttons popup".split())
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li td th dt dd".split())
REMOVED_IDS = frozenset("cookie cookie-banner".split())
CONTAINER_TAGS, CONTAINER_NAMES = frozenset("main article section".split()), frozenset("content main-content".split())
UTILITY_TITLES = ("accedi", "login", "log in", "sign in", "signin", "esci", "logout", "log out", "cerca", "search", "ricerca")

PARSED = (
    "title string, description string, lang string, canonical string, modified string, hrefs array<string>, anchors array<struct<text:string,href:string>>,"
    " headings array<string>, block_text string, article_text string, raw_text string, body_text string, aside_text string, visible int"
)


REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*)(;?)")

TREE_TAGS = frozenset("body article main section div td blockquote form ul ol table dl".split())


class TextTree:
    """The blocks of a page with their own text: where most of it stands densely, and little of it in links, is the article (HTM3).

    A block's density is what it says outside links less three times what it says inside, plus as much again for its paragraphs, less a charge for each block; sums over subtrees find where
    to cut: the subtree of the greatest sum is the article, of equal ones the innermost. Lists of teasers and menus have negative densities, so an ancestor that gathers them loses to the block that is text alone."""

    def __init__(self, charge: int = 80, least: int = 140, marked: int = 50):
        self.charge, self.least, self.marked = charge, least, marked
        self.parent: list[int] = []
        self.plain: list[int] = []
        self.linked: list[int] = []
        self.prose: list[int] = []
        self.parts: list[tuple[int, str]] = []
        self.tags: list[str] = []
        self.add(0, "")  # the page

    def add(self, parent: int, tag: str) -> int:
        self.tags.append(tag)
        self.parent.append(parent)
        for column in (self.plain, self.linked, self.prose):
            column.append(0)
        return len(self.parent) - 1

    def text(self, node: int, data: str, in_link: bool, in_paragraph: bool) -> None:
        self.parts.append((node, data))
        size = len(" ".join(data.split()))
        (self.linked if in_link else self.plain)[node] += size
        if in_paragraph and not in_link:
            self.prose[node] += size

    def article(self) -> str | None:
        """The text of the page's only `article`, if that says anything worth the name, else of the densest subtree, in page order; where none says enough outside links, that of
        an only `article` or `main` however short; else null."""
        own = [p - 3 * k + q - self.charge for p, k, q in zip(self.plain, self.linked, self.prose)]
        total, size = own[:], self.plain[:]
        for node in range(len(own) - 1, 0, -1):  # children come after their parent
            total[self.parent[node]] += total[node]
            size[self.parent[node]] += size[node]
        marked = next((x for x in ([n for n, t in enumerate(self.tags) if t == tag] for tag in ("article", "main")) if x), [])
        if len(marked) == 1 and self.tags[marked[0]] == "article" and size[marked[0]] >= self.marked:
            best = marked[0]
        else:
            best = max((n for n in range(len(own)) if size[n] >= self.least and total[n] > 0), key=lambda n: (total[n], n), default=None)
        if best is None:
            if len(marked) != 1:
                return None
            best = marked[0]
        inside = {best}
        for node in range(best + 1, len(own)):
            if self.parent[node] in inside:
                inside.add(node)
        return _flat([text for node, text in self.parts if node in inside]) or None


class Page(HTMLParser):
    """Collects what the columns need while the page streams by. An open element is (tag, whether it is removed, its collectors, its node in the tree)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, list[list[str]], int]] = []
        self.tree = TextTree()
        self.within: Counter = Counter()  # open elements by tag
        self.collecting: list[list[str]] = []  # what text goes to, of all open elements
        self.titles, self.h1s, self.meta = [], [], {}
        self.lang = self.canonical = ""
        self.anchors: list[tuple[list[str], str]] = []
        self.headings, self.blocks, self.containers = [], [], []
        self.body, self.aside, self.shown = [], [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            self.meta.setdefault(a.get("name", a.get("property", "")).lower(), a.get("content", ""))
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonical = self.canonical or a.get("href", "")
        if tag in VOID:
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            self._end_open(tag)
        classes, name = set(a.get("class", "").lower().split()), a.get("id", "").lower()
        removed = self._removed() or tag in REMOVED_TAGS or a.get("role", "").lower() in REMOVED_ROLES or bool(classes & REMOVED_CLASSES) or name in REMOVED_IDS
        into: list[list[str]] = []

        def collect(where: list, holder=None):
            into.append([])
            where.append(holder(into[-1]) if holder else into[-1])

        if tag == "title":
            collect(self.titles)
        if tag == "h1":
            collect(self.h1s)
        if tag == "a" and "href" in a:
            collect(self.anchors, lambda t: (t, a["href"]))
        if not removed:
            if tag in ("h1", "h2", "h3"):
                collect(self.headings)
            if tag in TEXT_BLOCKS:
                collect(self.blocks)
            if tag in CONTAINER_TAGS or (classes | {name}) & CONTAINER_NAMES or a.get("role") == "main":
                collect(self.containers)
        parent = self.open[-1][3] if self.open else 0
        node = self.tree.add(parent, tag) if tag in TREE_TAGS and not removed else parent
        self.open.append((tag, removed, into, node))
        self.within[tag] += 1
        self.collecting += into

    def _removed(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def _end_open(self, tag: str):
        """An unclosed p, li and so on ends where the next begins, unless a container opened in between."""
        for i in range(len(self.open) - 1, -1, -1) if self.within[tag] else ():
            if self.open[i][0] == tag:
                self._close(i)
                return
            if self.open[i][0] in ("ul", "ol", "table", "div", "section", "article", "main", "body", "dl", "nav"):
                return

    def _close(self, i: int):
        """Ends the open elements from the i-th on."""
        while len(self.open) > i:
            tag, _, into, _ = self.open.pop()
            self.within[tag] -= 1
            del self.collecting[len(self.collecting) - len(into) :]

    def handle_endtag(self, tag):
        if self.within[tag]:
            self._close(next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag))

    def handle_data(self, data):
        inside = self.within
        quiet = inside["script"] or inside["style"]
        if not quiet:
            for parts in self.collecting:
                parts.append(data)
        if inside["head"] or quiet:
            return
        if not inside["noscript"]:
            self.shown.append(data)
        if not self._removed():
            self.body.append(data)
            self.tree.text(self.open[-1][3] if self.open else 0, data, bool(inside["a"]), bool(inside["p"]))
        if inside["nav"] or inside["footer"] or inside["header"] or inside["aside"]:
            self.aside.append(data)


def _flat(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def closed_references(html: str) -> str:
    """html in which only character references with their semicolon are any."""
    return REFERENCE.sub(lambda m: m[0] if m[2] and (m[1][0] == "#" or m[1] + ";" in html5) else f"&amp;{m[1]}{m[2]}", html)


def parse_page(html: str | None, open_references: bool = True) -> dict:
    """The raw columns of a page. open_references: character references without their semicolon are read too, as browsers do; else they stay as they are written."""
    page = Page()
    page.feed((html or "") if open_references else closed_references(html or ""))
    page.close()
    first = lambda texts: next((x for x in map(_flat, texts) if x), "")
    meta = lambda *names: next((page.meta[n] for n in names if page.meta.get(n)), "")
    boxes = [x for x in map(_flat, page.containers) if len(x) > 50]
    article = page.tree.article()
    return {
        "title": first(page.titles[:1]) or first(page.h1s[:1]),
        "description": meta("description", "og:description"),
        "lang": page.lang,
        "canonical": page.canonical,
        "modified": meta("article:modified_time", "og:updated_time", "last-modified") or None,
        "hrefs": [h for _, h in page.anchors],
        "anchors": [{"text": "".join(t).strip(), "href": h} for t, h in page.anchors[:61]],
        "headings": [x for x in ("".join(h).strip() for h in page.headings[:31]) if len(x) > 3],
        "block_text": "\n\n".join(x for x in map(_flat, page.blocks) if x),
        "article_text": article or None,
        "raw_text": (" ".join(boxes) if boxes else _flat(page.body))[:8000],
        "body_text": _flat(page.body),
        "aside_text": _flat(page.aside),
        "visible": len(_flat(page.shown)),
    }


def parsed(pages: DataFrame, html_col: str = "html", open_references: bool = True) -> DataFrame:
    """pages without html, with the raw columns of parse_page (HTM1-3, 6-9, 13-16, 23, 26)."""
    kept = [c for c in pages.columns if c != html_col]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept) + ", " + PARSED

    def run(frames):
        for frame in frames:
            columns = pd.DataFrame([parse_page(x, open_references) for x in frame[html_col]], index=frame.index, columns=[c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", PARSED)])
            yield pd.concat([frame[kept], columns], axis=1)

    return pages.select(*kept, html_col).mapInPandas(run, schema)


def page_links(hrefs: Column, url: Column) -> Column:
    """HTM10: canonical links, different ones."""
    return U.let(F.struct(U.parsed(url).alias("p")), lambda page: F.array_distinct(F.array_compact(F.transform(hrefs, lambda h: U.normalize_url(h, url, page["p"])))))


def site_links(hrefs: Column, url: Column) -> Column:
    """HTM11: links of the page's own site, those in menus and footers too, repeats kept."""
    return F.filter(F.transform(hrefs, lambda h: U.clean_href(h, url)), lambda u: U.site_of(u) == U.site_of(url))


def content_links(hrefs: Column, url: Column) -> Column:
    """HTM12."""
    own = F.filter(F.transform(hrefs, lambda h: U.light_normalize(h, url)), lambda u: (U.site_of(u) == U.site_of(url)) & ~U.is_binary(u) & ~U.is_utility(u))
    return F.array_distinct(own)


def named_links(anchors: Column, url: Column) -> Column:
    """HTM13."""
    asset = r"(?i)\.(jpg|jpeg|png|gif|pdf|ico|css|js|woff)"
    resolved = F.transform(anchors, lambda a: F.struct(a["text"].alias("text"), U.clean_href(a["href"], url).alias("url")))
    return F.filter(resolved, lambda a: a["url"].isNotNull() & (F.length(a["text"]) > 3) & ~a["url"].rlike(asset))


def documents(pages: DataFrame, url_col: str = "url", html_col: str = "html", open_references: bool = True) -> DataFrame:
    """The extracted document of each page: url, canonical_url, title, description, lang, text, links, content_hash and
    what ranking needs (headings, raw_text, named_links, phones, emails, addresses, opening_hours)."""
    url = F.col(url_col)
    p = parsed(pages.select(url_col, html_col), html_col, open_references)
    article, blocks = F.nullif(T.normalize_text(F.col("article_text")), F.lit("")), T.normalize_text(F.col("block_text"))
    contacts = F.concat_ws(" ", "raw_text", "body_text", "aside_text")
    p = p.withColumn("text", F.when(article.isNull() | (F.length(blocks) > 1.4 * F.length(article)), blocks).otherwise(article)).withColumn("contacts", contacts)
    return p.select(
        url.alias("url"),
        F.coalesce(U.normalize_url(F.nullif(F.col("canonical"), F.lit("")), url), url).alias("canonical_url"),
        "title", "description", "lang", "text",
        page_links(F.col("hrefs"), url).alias("links"),
        T.content_hash(F.col("text")).alias("content_hash"),
        "headings", "raw_text",
        named_links(F.col("anchors"), url).alias("named_links"),
        T.phones(F.col("contacts")).alias("phones"), T.emails(F.col("contacts")).alias("emails"),
        T.addresses(F.col("contacts")).alias("addresses"), T.opening_hours(F.col("contacts")).alias("opening_hours"),
        T.visible_date(F.col("body_text")).alias("visible_date"), F.col("modified").alias("meta_modified"),
        (F.col("visible") < 200).alias("needs_rendering"),
    )


def is_utility_title(title: Column) -> Column:
    """HTM27: the title up to its first separator."""
    return F.coalesce(F.lower(T.trimmed(F.element_at(F.split(title, r"[|\-–—:•·]"), 1))).isin(*UTILITY_TITLES), F.lit(False))


# The looser patterns of collected data; quantifiers are bounded so that long prose can't make them backtrack.
LOOSE_PHONE = r"(?:\+39|0)?\s*\d{2,4}\s*\d{6,8}|800\s*\d{6}"
LOOSE_ADDRESS = r"(?i)(?:Via|Piazza|Corso|Viale|Strada)\s+[a-zA-Z]+(?:\s[a-zA-Z]+){0,6},\s*\d+\s*-?\s*\d{5}\s+[a-zA-Z]+(?:\s[a-zA-Z()]+){0,4}"


def collected(pages: DataFrame, key: str, order: str, *, most: int = 10, chars: int = 3000) -> DataFrame:
    """HTM21: pages (key, order, content, links of text and url) -> for each key the different phones, emails, addresses and the
    texts of links to forms and to services, `most` of each in page order, and the first `chars` characters of the contents."""
    mentions = lambda a, words: F.greatest(*[F.contains(F.lower(a), F.lit(w)) for w in words]) if len(words) > 1 else F.contains(F.lower(a), F.lit(words[0]))
    texts_of = lambda in_text, in_url: F.transform(F.filter("links", lambda a: mentions(a["text"], in_text) | mentions(a["url"], in_url)), lambda a: a["text"])
    found = {
        "phones": T.found(F.col("content"), LOOSE_PHONE), "emails": T.found(F.col("content"), T.EMAIL), "addresses": T.found(F.col("content"), LOOSE_ADDRESS),
        "forms": texts_of(("modulo", "form"), ("modulo",)), "services": texts_of(("servizio", "servizi"), ("servizio",)),
    }
    none = F.array().cast("array<string>")
    rows = materialised(pages.select(key, order, F.substring("content", 1, chars).alias("content"), *[F.slice(F.array_distinct(F.coalesce(c, none)), 1, most).alias(n) for n, c in found.items()]))
    # Of each kind only the values that can be among the first `most` are gathered: the first place of each value, then the first values; so
    # no row holds what a whole site says, however many pages it has.
    values = rows.select(key, order, F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("list")) for n in found])).alias("k")).select(key, order, "k.kind", F.posexplode("k.list").alias("pos", "value"))
    firsts = values.groupBy(key, "kind", "value").agg(F.min(F.struct(order, "pos")).alias("at"))
    w = Window.partitionBy(key, "kind").orderBy("at")
    few = firsts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    listed = few.groupBy(key).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == n, F.struct("_n", "value")))), lambda x: x["value"]).alias(n) for n in found])
    # texts likewise: each page's length alone says how far the first `chars` characters reach
    texts = within(rows.select(key, order, F.coalesce("content", F.lit("")).alias("content")), key, order, "content", chars - 1, between=1)
    joined = texts.groupBy(key).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_before", "content"))), lambda x: x["content"]), " "), 1, chars).alias("text_content"))
    out = joined.join(listed, key, "left")
    return out.select(key, *[F.coalesce(n, none).alias(n) for n in found], "text_content")
