"""Main text of web pages by composite text density.

For every DOM node the link-adjusted characters per tag are computed, the densities of its children summed, and the
subtree of greatest sum taken. The least density on the path from it up to, not including, body is the threshold: the
result is widened along that path, and what stands beside the path below the threshold, or is mostly links, is left out.
Elements article and main never narrow the result; one that lies in such an element is widened to hold all of them.
Elements that are no article by their kind (scripts, menus, forms, adverts, comments, ...) are left out beforehand, but
no form that holds most of a page's text. Parsing and every measure take time in proportion to the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from covenant.llm.tables import free_name

VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike "
             "strong sub sup time tt u var wbr".split())
DROPPED = set("script style noscript template head nav header footer aside iframe object svg canvas button select "
              "textarea input menu dialog title".split())
CLOSES_P = set("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
               "hr main menu nav ol p pre section table ul li dd dt tr td th body".split())
SCOPES = {tag: (set(own.split()), set(stop.split())) for tag, own, stop in (
    ("li", "li", "ul ol menu"), ("dd", "dd dt", "dl"), ("dt", "dd dt", "dl"), ("tr", "tr td th", "table"),
    ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select"))}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# words of class and id that name what is no article; the ambiguous ones are also words of articles and their layout
PLAIN = re.compile(r"ads?|adv|advert\w*|sponsor\w*|cookies?|gdpr|popup|modal|newsletter|subscribe|sidebar|nav|navbar|navigation|"
                   r"breadcrumbs?|footer|masthead|comments?|disqus|pagination|pager")
AMBIGUOUS = re.compile(r"banner|promo\w*|consent|notice|side|widgets?|menu|header|respond|replies|share|sharing|social|related|"
                       r"recommend\w*|login")
NEUTRAL = re.compile(r"\d*|area|bar|block|box|buttons?|container|content|footer|form|inner|items?|left|links?|list|outer|posts?|"
                     r"right|row|section|site|top|wrap|wrapper")
LAYOUT = set("has no non not with without".split())      # has-sidebar, no-comments: the layout, not the thing
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar alertdialog".split())
KEEP = set("html body article main".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl figure table".split())   # kept beside the path whatever their length
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title iframe noembed noframes xmp".split()}
TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
TAG_END = re.compile(r"[\s/=]*>")
COMMENT_END = re.compile("--!?>")


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "names", "own", "inside", "article", "chars", "tags", "link_chars",
                 "link_tags", "density", "sums", "parts")

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False, names: tuple[int, int] = (0, 0)):
        self.tag, self.parent, self.kids, self.drop, self.names, self.own = tag, parent, [], drop, names, 0
        # within an element article or main
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


def _noise(value: str) -> int:
    """3: one of the names is a noise word, or made of such and neutral ones; 2: the same with ambiguous words only; 1: a
    noise word is but a part of a name; 0: none. Names like has-sidebar speak of the layout."""
    level = 0
    for name in value.lower().split():
        parts = re.split("[-_]+", name)
        if parts[0] in LAYOUT:
            continue
        plain = any(PLAIN.fullmatch(x) for x in parts)
        if plain or any(AMBIGUOUS.fullmatch(x) for x in parts):
            whole = all(PLAIN.fullmatch(x) or AMBIGUOUS.fullmatch(x) or NEUTRAL.fullmatch(x) for x in parts)
            level = max(level, (3 if plain else 2) if whole else 1)
    return level


class _Dom:
    """A forgiving tree: unknown end tags are ignored, blocks close an open paragraph, missing end tags are implied.

    ``open`` is the stack of open elements, ``depths`` the places of each tag in it, so that no search walks the stack.
    """

    def __init__(self, html: str):
        self.root = Node("#root", None)
        self.nodes, self.open, self.depths = [self.root], [self.root], {}
        self._parse(html)

    def _depth(self, tags) -> int:
        """Place of the innermost open element of one of ``tags``; 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def _close(self, depth: int) -> None:
        """Close the open element at ``depth`` and all within it."""
        while len(self.open) > depth > 0:
            self.depths[self.open.pop().tag].pop()

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        for own, stop in ([({"p"}, CLOSES_P - {"p"})] if tag in CLOSES_P else []) + ([SCOPES[tag]] if tag in SCOPES else []):
            depth = self._depth(own)
            if depth > self._depth(stop - own):
                self._close(depth)
        if tag == "body" and self.open[-1].tag == "head":
            self._close(len(self.open) - 1)
        at = self.open[-1]
        names = (0, 0) if tag in KEEP or tag in HEADINGS else (_noise(attrs.get("class", "")), _noise(attrs.get("id", "")))
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
        # the header of an article holds its title
        own_header = tag == "header" and (at.inside or at.tag in ("article", "main"))
        node = Node(tag, at, (tag in DROPPED and not own_header) or hidden or attrs.get("role", "") in ROLES, names)
        at.kids.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def _text(self, data: str) -> None:
        if data:
            self.open[-1].kids.append(data)
            self.open[-1].own += len("".join(data.split()))

    def _parse(self, html: str) -> None:
        """Every character is looked at a bounded number of times; what an unclosed tag, comment or script swallows is no text."""
        at, end = 0, len(html)
        while at < end:
            sign = html.find("<", at)
            while sign >= 0 and not (html[sign + 1:sign + 2].isascii() and (html[sign + 1:sign + 2].isalpha()
                                     or html[sign + 1:sign + 2] in ("/", "!", "?"))) or sign + 1 == end:
                sign = html.find("<", sign + 1)
            sign = end if sign < 0 else sign
            self._text(entities.unescape(html[at:sign]))
            if sign == end:
                return
            kind, at = html[sign + 1], sign + 2
            if html.startswith("!--", sign + 1):
                short = re.compile("-?>").match(html, sign + 4)
                close = short or COMMENT_END.search(html, sign + 4)
                at = close.end() if close else end
            elif kind in "!?" or (kind == "/" and not TAG_NAME.match(html, at)):
                close = html.find(">", at)
                at = close + 1 if close >= 0 else end
            elif kind == "/":
                tag = TAG_NAME.match(html, at).group().lower()
                close = html.find(">", at)
                at = close + 1 if close >= 0 else end
                self._close(self._depth((tag,)))
            else:
                tag = TAG_NAME.match(html, sign + 1)
                at, attrs = tag.end(), {}
                while (found := ATTRIBUTE.match(html, at)):
                    value = found.group(2) or ""
                    value = value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value
                    attrs.setdefault(found.group(1).lower(), entities.unescape(value))
                    at = found.end()
                close = TAG_END.match(html, at)
                if not close:
                    return                            # the page ends within the tag
                at = close.end()
                tag = tag.group().lower()
                self._start(tag, attrs)
                if tag in RAW:
                    close = RAW[tag].search(html, at)
                    self._text(html[at:close.start() if close else end])
                    at = close.start() if close else end


def _up(n: Node | None) -> Iterator[Node]:
    while n is not None:
        yield n
        n = n.parent


def _count(nodes: list[Node]) -> None:
    """Characters, tags, their share in links and the characters in article or main of every node, leaves first."""
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = n.article = 0
        if n.drop:
            continue
        n.chars = n.own
        for k in n.kids:
            if not isinstance(k, str) and not k.drop:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.chars if k.tag == "a" else k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
                n.article += k.article
        if n.tag in ("article", "main"):
            n.article = n.chars


def _drop_forms(nodes: list[Node]) -> None:
    """Forms go, but not one that holds most of the page's text."""
    forms = [n for n in nodes if n.tag == "form" and not n.drop]
    if forms:
        _count(nodes)
        for n in forms:
            n.drop = 2 * n.chars <= nodes[0].chars


def _drop_named(nodes: list[Node]) -> None:
    """Drop by class and id. Never headings, the greater part of the article elements' text, nor, on a page without such
    elements, of all text. A plain noise name drops its element; an ambiguous one (ids within an article too: they are
    anchors) drops it when half of its text is links or it stands beside the article; a part of a name needs the links and
    drops no section of an article and nothing that holds one."""
    if not any(n.names != (0, 0) for n in nodes):
        return
    _count(nodes)
    top = nodes[0]
    for n in nodes:
        if n.names == (0, 0) or n.drop:
            continue
        inside = n.inside
        level = max(n.names[0], min(n.names[1], 2) if inside else n.names[1])
        if 2 * n.article > top.article or (not top.article and 2 * n.chars > top.chars):
            continue
        links = n.chars > 0 and 2 * n.link_chars >= n.chars
        if level == 3 or (level == 2 and (links or (top.article and not inside and not n.article))):
            n.drop = True
        elif level == 1 and links and not n.article and not (inside and n.tag == "section"):
            n.drop = True


def _measure(nodes: list[Node]) -> None:
    """Counts, density and the children's density sum of every node, leaves first."""
    _count(nodes)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for n in reversed(nodes):
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * n.link_chars + ratio * c + math.e) if c else 1.0
        n.density = c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9, max(base, 1.0001)) if c else 0.0
        n.density = max(n.density, 0.0)
        n.sums = sum(k.density for k in n.kids if not isinstance(k, str) and not k.drop)


def _blocks(top: Node) -> list[str]:
    """The texts of the blocks below ``top`` in page order, white space collapsed."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = [top]
    while todo:
        n = todo.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            run.append(n)
        elif n.tag == "br":
            run.append(" ")
        elif not n.drop:
            if n.tag not in INLINE:
                end()
                todo.append(None)
            todo.extend(reversed(n.kids))
    end()
    return out


def _widened(best: Node, live: list[Node], nodes: list[Node]) -> Node:
    """The nearest element that holds ``best``, the article or main around it and all others that are not mostly links."""
    parts = 0
    for n in nodes:
        n.parts = 0
    for n in live:
        if n.tag in ("article", "main") and 2 * n.link_chars < n.chars:
            n.parts, parts = 1, parts + 1
    related = any(n.parts for n in _up(best))
    for n in reversed(nodes[1:]):             # parents come first: counts go up
        n.parent.parts += n.parts
    if not related and not best.parts:
        return best
    return next(n for n in _up(best) if n.parts == parts)


def _drop_beside(path: list[Node], threshold: float) -> None:
    """Leave out what stands beside ``path`` (from the best node upwards) and is no text of the article."""
    for child, n in zip(path, path[1:]):
        for k in n.kids:
            if not isinstance(k, str) and k is not child and not k.drop and k.tag not in INLINE and k.parts == 0 and k.chars:
                links = 2 * k.link_chars >= k.chars
                k.drop = k.density < threshold and (links or (k.tag not in PROSE and not _has_prose(k)))


def _has_prose(top: Node) -> bool:
    """Whether a paragraph, heading or other element of prose that is not mostly links stands below ``top``."""
    todo = [top]
    while todo:
        n = todo.pop()
        if n.tag in PROSE and n.chars and 2 * n.link_chars < n.chars:
            return True
        todo.extend(k for k in n.kids if not isinstance(k, str) and not k.drop)
    return False


def main_text(html: str | None) -> str:
    """The article's blocks joined by blank lines; empty if the page is null or has no text."""
    dom = _Dom(html or "")
    _drop_forms(dom.nodes)
    _drop_named(dom.nodes)
    _measure(dom.nodes)
    body = next((n for n in dom.nodes if n.tag == "body"), dom.root)
    live = []
    for n in dom.nodes:                       # parents come first: what is below a dropped element is dropped
        n.drop = n.drop or (n.parent is not None and n.parent.drop)
        if not n.drop and n.tag not in INLINE:
            live.append(n)
    if not live:
        return ""
    best = max(live, key=lambda n: n.sums)
    if not best.sums:
        best = body
    path = []
    for n in _up(best):                       # up to body, not including it
        if n in (body, dom.root) or n.tag == "html":
            break
        path.append(n)
    top = _widened(path[-1] if path else best, live, dom.nodes)
    _drop_beside(path, min((n.density for n in path), default=0.0))
    return "\n\n".join(_blocks(top))


def extract(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` and a column ``text``: the main text of the whole html. Null html gives an empty text; other columns pass
    through, repeated rows give the same text, an empty table gives none. Where ``pages`` has such a column already
    (names compare without case) the text goes under the next free name, ``text_``."""
    at = pages.columns.index("html")
    text = free_name(pages, text)
    out = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = pa.array([main_text(h.as_py()) for h in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, text])

    return pages.mapInArrow(batches, out)
