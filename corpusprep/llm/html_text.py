"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: a node is the path of block elements with their
classes and ids, of at most ``MAX_DEPTH`` steps. Every node gathers, over the host's pages, its presentations (sequences of child
elements) and its contents (hashes of the text blocks below it). Its importance is

    (1 - g**l) * presentation + g**l * content

with l presentations and g = 0.9; ``presentation`` is the entropy of the presentations to the base
of the pages m that hold the node, ``content`` is the mean over its text blocks of 1 - log_m(d), d
being the pages that hold the same block (1 if m = 1). A menu that is alike on all pages comes to
0, an article that differs on every page to 1.

From each page go (a) elements that are no text, and branches whose element, class or id names a
menu, header, footer, sidebar, notice, advert, form or reader comments: their importance is 0 by
presentation; (b) where a page marks its main part (article, main, or a class or id that says so),
what lies outside it; (c) branches of importance below ``MIN_IMPORTANCE`` on hosts with
``MIN_PAGES`` pages that hold them; (d) paragraphs and the like directly in the main part (no headings)
whose own content entropy on the host, 1 - log_m(d), is below ``MAIN_IMPORTANCE``, if more than half of
the page's text stays: a promotion that nearly all articles of a host repeat, not an article copied.

Distribution: pages become narrow (host, node, feature) rows, counted with map-side combine, so a
host with a third of all pages is no hot task; the low branches of a host are joined back by host
(broadcast after a size check, else a shuffle join that Spark can split). A host's pages never
meet in one task.

Edge cases: NULL or empty html has the empty text; a NULL or unreadable url is its own host; pages
are handled row by row, so NULL ids and repeated rows stay; broken markup, unclosed elements and
attributes with > are parsed as far as they go; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache, partial

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import fixed, map_rows, small_side

GAMMA = 0.9
MIN_IMPORTANCE = 0.2
MIN_PAGES = 5
MAIN_IMPORTANCE = 0.05

#: Levels of the tree; what lies deeper belongs to its branch there.
MAX_DEPTH = 64

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"""[>"']""")
#: A name with its value; a name alone is taken whole too, so that a long one is read once.
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++)))?+""")

# Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
NO_TEXT = RAW | {"head", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "datalist", "map"}
NOISE_TAGS = {"nav", "aside", "footer", "form", "dialog", "menu", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tr", "td",
         "th", "figure", "figcaption", "hgroup"}
#: An element that closes open elements of the same kind (up to the listed limits).
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"td", "th", "li", "table"}}
_NOISE_WORD = re.compile(r"ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?\w*|consent|notices?|alerts?|popup|modal|newsletter|subscri\w*"
                         r"|signup|shar(?:e|ing)\w*|social\w*|related\w*|recommend\w*|sidebar\w*|widgets?|menus?|nav|navbar|navigation|breadcrumbs?"
                         r"|pagination|pager|comments?|commentlist|disqus\w*|repl(?:y|ies)|respond|footers?|copyright|legal|disclaimer|login|search\w*|toolbar", re.I)
_HEADER_WORD = re.compile(r"header|masthead|topbar", re.I)
#: Words that may stand beside a noise word in one class token (site-footer, share-buttons); with any other
#: word the token says something else (no-sidebar, has-banner, comments-open, right-sidebar).
_BESIDE = {"site", "page", "main", "primary", "secondary", "global", "top", "bottom", "post", "entry", "article", "content", "user", "reader", "wrap", "wrapper",
           "container", "box", "area", "list", "block", "section", "bar", "links", "buttons", "button", "form", "inner", "items", "item", "posts", "articles",
           "text", "body", "icons", "slot", "unit", "holder", "media", "mobile", "desktop", "header", "this", ""}
_MAIN_NAME = re.compile(r"(?:^|[_-])(?:article|articlebody|main|content|post|entry|story|hentry)(?:$|[_-])", re.I)
#: Elements that are never noise by their name.
_NEVER_NOISE = {"html", "body", "main", "article"}
_P_ENDS = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
           "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul"}


@lru_cache(20_000)
def _kind(name: str) -> str:
    """``noise``, ``header``, ``main`` or nothing, as the tokens of class, id and role say."""
    header = main = False
    for token in name.split():
        parts = re.split("[_-]", token.lower())
        own = [bool(_NOISE_WORD.fullmatch(p)) for p in parts] if token.lower() not in ("sign-up", "sign_up") else [True]
        if any(own):
            if parts[0] != "content" and all(n or p in _BESIDE or p.isdigit() for n, p in zip(own, parts)):
                return "noise"
            continue
        if any(_HEADER_WORD.fullmatch(p) for p in parts):
            header = header or all(p in _BESIDE or _HEADER_WORD.fullmatch(p) for p in parts)
        elif _MAIN_NAME.search(token):
            main = True
    return "header" if header else "main" if main else ""


class Tags:
    """The tags, comments and text of a page in order. Every character is looked at a bounded number
    of times, whatever is left open."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self._first = (0, -1)  # between these places there is none of > " '
        self._dead: set[int] = set()  # quotes from which no tag end can be reached

    def tag_end(self, at: int) -> int:
        """The place after the > that ends the tag whose attributes begin at ``at``; -1 if a quote is
        left open before it."""
        html, passed, first = self.html, [], True
        while at <= self.last:
            if first and self._first[0] <= at <= self._first[1]:
                s = self._first[1]
            else:
                m = _SPECIAL.search(html, at)
                if not m:
                    break
                s = m.start()
                if first:
                    self._first = (at, s)
            first = False
            if s in self._dead:
                break
            if html[s] == ">":
                return s + 1
            passed.append(s)
            close = html.find(html[s], s + 1)
            if close < 0:
                break
            at = close + 1
        self._dead.update(passed)
        return -1

    def __iter__(self):
        """("text", text), ("start", tag, attributes) and ("end", tag)."""
        html, at, pos, size = self.html, 0, 0, len(self.html)
        while pos < size:
            lt = html.find("<", pos)
            if lt < 0:
                break
            if html.startswith("<!--", lt) or html.startswith("<![CDATA[", lt):
                mark = "-->" if html[lt + 2] == "-" else "]]>"
                close = html.find(mark, lt + (4 if mark == "-->" else 9))
                end, token = (size if close < 0 else close + 3), None
            elif lt > self.last:  # no tag ends any more; a comment may still begin
                starts = [x for x in (html.find("<!--", lt), html.find("<![CDATA[", lt)) if x >= 0]
                if not starts:
                    break
                pos = min(starts)
                continue
            elif html[lt + 1:lt + 2] in ("!", "?"):
                end, token = html.index(">", lt) + 1, None
            else:
                m = _TAG.match(html, lt)
                end = self.tag_end(m.end()) if m else -1
                if end < 0:
                    pos = lt + 1
                    continue
                tag = m[2].lower()
                token = ("end", tag) if m[1] else ("start", tag, html[m.end():end - 1])
            if lt > at:
                yield "text", html[at:lt]
            at = pos = end
            if token is None:
                continue
            yield token
            if token[0] == "start" and token[1] in RAW:  # its content is no markup, up to the end tag
                m = re.compile(rf"</{token[1]}\b[^>]*>", re.I).search(html, at) if at <= self.last else None
                at = pos = m.end() if m else size
        # a last unfinished tag is markup
        cut = re.compile(r"<[/!?a-zA-Z]").search(html, at)
        if at < size:
            yield "text", html[at:cut.start()] if cut else html[at:]


class Page:
    """The text blocks of a page, each with its node, and the presentations of the nodes.

    ``nodes``: (parent, step, identity, depth); the identity is a hash of the parent's and the step, so
    it is that of the path. ``blocks``: (node, text, state, weighed) with state ``main``, ``rest`` or
    ``noise``; ``weighed`` is false for prose directly in the main part. What is noise by a name only
    (``named``) is left again where it turns out to hold the page's main part: an article in it
    (``inner``) if the page has no main part elsewhere, or a part that its name calls so (``deep``) if
    it has no other text."""

    def __init__(self, html: str | None):
        self.nodes: list[tuple[int, str, int, int]] = [(-1, "", 0, 0)]
        self.blocks: list[tuple[int, str, str, bool]] = []
        self.children: dict[int, list[str]] = {}
        self._known: dict[tuple[int, str], int] = {}
        self._run: list[str] = []
        #: open elements: tag, node, state, weighed; and where each tag is open
        self._open: list[tuple[str, int, str, bool]] = [("", 0, "rest", True)]
        self._places: dict[str, list[int]] = {}
        if html:
            self._read(html)

    def _node(self, parent: int, step: str) -> int:
        depth = self.nodes[parent][3] + 1
        if depth > MAX_DEPTH:
            return parent
        at = self._known.get((parent, step))
        if at is None:
            at = self._known[parent, step] = len(self.nodes)
            self.nodes.append((parent, step, _hash(f"{self.nodes[parent][2]}>{step}"), depth))
        return at

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.nodes[node][1])
            node = self.nodes[node][0]
        return "".join(f">{x}" for x in reversed(steps))

    def is_heading(self, node: int) -> bool:
        return re.match(r"(?:h[1-6]|th|dt)(?:\.|\Z)", self.nodes[node][1]) is not None

    def _text(self, raw: str):
        if raw:
            self._run.append(entities.unescape(raw) if "&" in raw else raw)

    def _end_block(self):
        if self._run:
            text = " ".join("".join(self._run).split())
            self._run = []
            if text:
                _, node, state, weighed = self._open[-1]
                self.blocks.append((node, text, state, weighed))

    def _push(self, tag: str, node: int, state: str, weighed: bool):
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append((tag, node, state, weighed))

    def _cut(self, k: int):
        """Close the open elements from place ``k`` on."""
        self._end_block()
        for tag, _, _, _ in self._open[k:]:
            self._places[tag].pop()
        del self._open[k:]

    def _innermost(self, tags) -> int:
        """The place of the innermost open element of ``tags``; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self._places.get(t))), default=0)

    def _start(self, tag: str, attrs: str):
        tags = self._open
        if tag == "br":
            self._run.append(" ")
            return
        if tag in INLINE:
            # an inline element stays on the stack only to carry a noise name
            if tag == "span" and attrs and _kind(self._name(attrs)[0]) == "noise":
                self._end_block()
                self._push(tag, tags[-1][1], "noise", True)
            return
        self._end_block()
        if tag in _P_ENDS:
            self._close({"p"}, {"td", "th", "li", "table", "article", "section", "div", "main", "button"})
        if tag in CLOSES and tag != "p":
            self._close(CLOSES[tag], STOPS.get(tag, set()))
        _, node, state, weighed = tags[-1]
        name, label = self._name(attrs) if attrs and "=" in attrs else ("", "")
        step = tag + label
        self.children.setdefault(node, []).append(step)
        if tag in VOID:
            return
        if state != "noise":
            kind = _kind(name) if name and tag not in _NEVER_NOISE else ""
            if tag in NO_TEXT or tag in NOISE_TAGS or "hidden" in attrs and re.search(r"\shidden(?:[\s=/]|\Z)|aria-hidden=.?true|display:\s*none", attrs):
                state = "noise"
            elif kind == "noise" or state == "rest" and kind == "header":
                state = "named" if state in ("rest", "named", "main") else "noise"
            elif state == "rest" and tag == "header":
                state = "noise"
            elif tag in ("article", "main"):
                state, weighed = "main" if tag == "main" or state in ("rest", "main") else "inner", False
            elif state in ("rest", "named") and tag in ("div", "section", "td") and kind == "main":
                state, weighed = "main" if state == "rest" else "deep", False
            elif tag not in PROSE:
                weighed = True
        self._push(tag, self._node(node, step), state, weighed)

    def _close(self, which: set[str], stops: set[str]):
        k = self._innermost(which)
        if k and k > self._innermost(stops - which):
            self._cut(k)

    def _end(self, tag: str):
        if tag in INLINE and tag != "span":
            return
        if tag == "span":
            if self._open[-1][0] == "span":
                self._cut(len(self._open) - 1)
            return
        if tag not in VOID and (k := self._innermost((tag,))):
            self._cut(k)

    @staticmethod
    def _name(attrs: str) -> tuple[str, str]:
        """What class, id and role say, and a label for the node without longer numbers."""
        got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs) if m.end() > m.end(1)}
        name = " ".join(got[k] for k in ("class", "id", "role", "itemprop") if got.get(k))
        return name, "." + re.sub(r"[0-9]{2,}", "", ".".join(sorted(name.split()))) if name else ""

    def _read(self, html: str):
        for token in Tags(html):
            if token[0] == "text":
                self._text(token[1])
            elif token[0] == "end":
                self._end(token[1])
            elif token[1] in RAW:
                self._end_block()
            else:
                self._start(token[1], token[2])
        self._end_block()
        held = {b[2] for b in self.blocks}
        main = next((x for x in ("main", "inner", "rest", "deep") if x in held), "")
        self.blocks = [(n, t, "rest" if x == "rest" else "main" if x == main else "noise", w) for n, t, x, w in self.blocks]

    def candidates(self) -> list[tuple[int, str, bool]]:
        """(node, text, weighed) of the blocks that presentation leaves."""
        main = [(n, t, w) for n, t, s, w in self.blocks if s == "main"]
        return main or [(n, t, True) for n, t, s, _ in self.blocks if s == "rest"]


def main_text(html: str | None, low: set[int] | frozenset = frozenset(), common: set[int] | frozenset = frozenset()) -> str:
    """The page's main text; ``low``: identities of nodes of low importance on its host; ``common``:
    hashes of blocks of main parts that nearly all its pages repeat. These go only if most of the text
    stays, so copied articles are kept."""
    page = Page(html)
    gone = [False] * len(page.nodes)
    if low:
        for k, (parent, _, ident, _) in enumerate(page.nodes):  # parents come before their children
            gone[k] = ident in low or parent >= 0 and gone[parent]
    got = [(n, t, w) for n, t, w in page.candidates() if not (w and gone[n])]
    if common:
        own = [(n, t, w) for n, t, w in got if w or page.is_heading(n) or _hash(t) not in common]
        if 2 * sum(len(t) for _, t, _ in own) > sum(len(t) for _, t, _ in got):
            got = own
    return "\n".join(t for _, t, _ in got)


def host_of(url: str = "url") -> Column:
    """The host in lower case; the whole value where there is none, so that no page is lost."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host).otherwise(F.concat(F.lit("?"), u))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _features(rows, paths: bool = False):
    """(host, node, prior, presentation, feature): the host's tree, one row per page and distinct
    feature; the node by its identity, or its path if ``paths``. The prior of a node by its
    presentation: 0 noise, 1 prose of the main part, else NULL."""
    for host, html in rows:
        page = Page(html)
        seen, prior = set(), {}
        for node, text, state, weighed in page.blocks:
            h = _hash(text)
            prior[node] = 0 if state == "noise" else None if weighed else 1
            while node:  # a branch has the blocks of all that is below it
                seen.add((node, False, h))
                node = page.nodes[node][0]
        for node in {n for n, _, _ in seen}:
            # runs of the same child count as one
            steps = page.children.get(node, [])
            steps = [s for k, s in enumerate(steps) if k == 0 or steps[k - 1] != s]
            seen.add((node, True, _hash(" ".join(steps))))
        for node, shown, h in seen:
            yield host, page.path(node) if paths else page.nodes[node][2], prior.get(node), shown, h


def _tree_rows(pages: DataFrame, url: str, html: str, paths: bool = False) -> DataFrame:
    """``host``, ``node``, ``shown`` (a presentation, else a text block), ``feature``, ``d`` pages that have it, ``prior``."""
    rows = map_rows(pages.select(host_of(url).alias("host"), F.col(html).alias("html")), partial(_features, paths=paths),
                    f"host string, node {'string' if paths else 'long'}, prior int, shown boolean, feature long")
    return rows.groupBy("host", "node", "shown", "feature").agg(F.count(F.lit(1)).alias("d"), F.min("prior").alias("prior"))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host``, ``node`` (its path), ``pages`` that hold it, ``prior``, ``presentation``, ``content`` and
    ``importance``: 0 for nodes that are noise by their presentation, no less than
    ``MIN_IMPORTANCE`` for prose of the main part."""
    return _tree(_tree_rows(pages, url, html, paths=True)).drop("common")


def _tree(each: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The style tree, with the prose blocks of main parts that at least ``min_pages`` pages repeat
    (``common``: hash and pages)."""
    repeated = F.when(~F.col("shown") & (F.col("prior") == 1) & (F.col("d") >= min_pages), F.struct("feature", "d"))
    # a page has one presentation of a node, so their counts add up to its pages
    node = each.groupBy("host", "node").agg(
        F.min("prior").alias("prior"),
        F.sum(F.when(F.col("shown"), F.col("d"))).alias("pages"), F.count(F.when(F.col("shown"), 1)).alias("styles"),
        F.sum(F.when(F.col("shown"), F.col("d") * F.ln("d"))).alias("pd"),
        F.sum(F.when(~F.col("shown"), F.col("d"))).alias("blocks"), F.sum(F.when(~F.col("shown"), F.col("d") * F.ln("d"))).alias("bd"),
        F.collect_list(repeated).alias("common"))
    m = F.col("pages")
    many = m > 1
    presentation = F.when(many, (F.ln(m) - F.col("pd") / m) / F.ln(m)).otherwise(1.0)
    content = F.when(many, 1 - F.col("bd") / F.col("blocks") / F.ln(m)).otherwise(1.0)
    g = F.pow(F.lit(GAMMA), F.col("styles"))
    weight = (1 - g) * presentation + g * content
    importance = F.when(F.col("prior") == 0, 0.0).when(F.col("prior") == 1, F.greatest(weight, F.lit(MIN_IMPORTANCE))).otherwise(weight)
    return node.select("host", "node", "pages", "prior", presentation.alias("presentation"), content.alias("content"), importance.alias("importance"), "common")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            min_importance: float = MIN_IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` (the blocks of the main text, a line each)
    and ``n_chars``."""
    tree = _tree(_tree_rows(pages, url, html), min_pages).where(F.col("pages") >= min_pages)
    # noise by presentation needs no list: the parser of the page tells it
    low = F.when((F.col("importance") < min_importance) & F.col("prior").isNull(), F.col("node"))
    # a block of the main part is weighed by its own content entropy on the host
    common = F.filter("common", lambda x: 1 - F.ln(x["d"]) / F.ln("pages") < MAIN_IMPORTANCE)
    low = tree.select("host", low.alias("node"), F.transform(common, lambda x: x["feature"]).alias("common")).where("node is not null or size(common) > 0") \
        .groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("low"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("common")))).alias("common")) \
        .select(F.col("host").alias("h"), "low", "common")
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    p = p.join(small_side(fixed(low), 50_000), F.col("host") == F.col("h"), "left")

    def run(rows):
        for i, u, x, nodes, blocks in rows:
            yield i, u, main_text(x, frozenset(nodes or ()), frozenset(blocks or ()))

    kind = p.schema["page_id"].dataType.simpleString()
    out = map_rows(p.select("page_id", "url", "html", "low", "common"), run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
