"""HTML extraction by tree scoring: the article's text without what surrounds it."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag up to its end: attributes with quoted values, or, if a quote has no partner, up to the next ">".
_REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]+)\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HIDDEN_FLAG = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.I)

#: Elements whose content is not markup and never article text.
RAW = frozenset("script style template noscript textarea title iframe svg noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br "
    "mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle semantics annotation".split()
)
#: Controls and embedded media: their own text is left out, the paragraph around them goes on.
CONTROLS = frozenset("button select datalist object applet audio video canvas map".split())
JUNK_TAGS = frozenset("nav header footer aside form menu dialog head fieldset".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words that name what is not the article, in a class or id.
JUNK_WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu "
    "header masthead topbar footer bottombar sidebar sidebars rail aside cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist disqus respond replies share sharing social related recommended newsletter subscribe subscription signup login "
    "breadcrumb breadcrumbs pagination pager toolbar widget widgets copyright disclaimer search skip tags toc hidden".split()
)
#: Words that may stand beside one of them in the same name without changing what it names.
BESIDE = frozenset(
    "site page global main primary secondary top bottom left right upper lower inner outer box bar list area wrap wrapper container content block section panel unit slot "
    "link links item items button buttons icon icons form title row col column group small large big sticky fixed js by with and more also entry reader user".split()
)
_GOOD = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
#: Elements that end an open one of these kinds, if no element of _SCOPE stands between.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPED = frozenset("p li td th tr dt dd option".split())
_SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article main body html blockquote td th aside nav header footer form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BASE = {"div": 5, "article": 10, "main": 8, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "form": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5}
#: Ancestors that a block gives points to, and what its points are divided by there.
_SHARES = (1, 2, 6, 9, 12)


def junk_name(label: str) -> bool:
    """Whether a class or id names page furniture: one of its names, cut at white space, has a word of JUNK_WORDS and
    besides only such words, words of BESIDE and numbers ("cookie-notice", "ad-slot-2"; not "share-price")."""
    for name in label.split():
        words = [w for w in re.split(r"[^A-Za-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name)) if w]
        low = [w.lower() for w in words]
        if any(w in JUNK_WORDS for w in low) and all(w in JUNK_WORDS or w in BESIDE for w in low):
            return True
    return False


class Node:
    """A block element. `hard`: no article by element, role or style; `soft`: by class or id."""

    __slots__ = ("parent", "tag", "label", "hard", "soft", "junk", "kids", "score", "chars", "linked", "main")

    def __init__(self, parent: Node | None, tag: str, label: str, hard: bool, soft: bool):
        self.parent, self.tag, self.label, self.hard, self.soft = parent, tag, label, hard, soft
        self.kids: list[Node] = []
        self.junk = self.main = False
        self.score = self.chars = self.linked = 0.0


def _tags(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, closing, tag, attributes) of each tag in order, in linear time; comments and raw elements yield an empty
    tag. The text after the last one comes with the tag "/"."""
    at = begin = 0
    last = page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        name = _NAME.match(page, start)
        if not name:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = len(page) if end < 0 else end + 3
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start) + 1 or len(page)
            else:  # a lone "<" is text
                at = start + 1
                continue
            yield page[begin:start], False, "", ""
            at = begin = end
            continue
        if name.end() > last:
            at = start + 1
            continue
        tag = name[1].lower()
        rest = _REST.match(page, name.end())
        end = rest.end() if rest else page.index(">", name.end()) + 1
        closing = page[start + 1] == "/"
        attrs = page[name.end() : end - 1]
        if tag in RAW and not closing and not attrs.endswith("/"):
            found = re.compile(rf"</{tag}\s*+>", re.I).search(page, end)
            yield page[begin:start], False, "", ""
            at = begin = found.end() if found else len(page)
            continue
        yield page[begin:start], closing, tag, attrs
        at = begin = end
    yield page[begin:], False, "/", ""


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, float]]]:
    """The block elements, parents first, and the blocks of text: (element, text, share of it in links), in page order.

    Linear in the page: open elements are found by name, and only those that close are walked over.
    """
    root = Node(None, "html", "", False, False)
    nodes, blocks = [root], []
    stack: list[tuple[str, Node]] = [("html", root)]
    places: dict[str, list[int]] = {"html": [0]}  # of each tag that is open, in the stack
    scopes = [0]
    text: list[str] = []
    linked = links = 0
    control: list[str] = []  # open controls, and what is open inside them

    def flush() -> None:
        nonlocal linked
        if text:
            value = " ".join("".join(text).split())
            if value:
                blocks.append((stack[-1][1], value, min(1.0, linked / len(value))))
            text.clear()
        linked = 0

    def open_at(tags: tuple[str, ...]) -> int:
        """The innermost open element with one of these names, unless a scope stands inside it; -1 if there is none."""
        k = max((places[t][-1] for t in tags if places.get(t)), default=-1)
        return k if k > 0 and not (scopes[-1] > k) else -1

    def close(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in _SCOPE:
                scopes.pop()

    for before, closing, tag, attrs in _tags(page):
        if before and not control:
            value = entities.unescape(before) if "&" in before else before
            text.append(value)
            if links:
                linked += len(value.strip())
        if tag in ("", "/"):
            continue
        if control:
            if tag not in CONTROLS:
                if not closing or tag in INLINE or not places.get(tag):
                    continue  # inside a control
                control.clear()  # what is open around it ends, and so does the control
            elif not closing:
                control.append(tag)
                continue
            else:
                if tag in control:
                    del control[len(control) - 1 - control[::-1].index(tag) :]
                continue
        elif tag in CONTROLS:
            if not closing and not attrs.endswith("/"):
                control.append(tag)
            continue
        if closing:
            if tag in INLINE:
                if tag == "a" and links:
                    links -= 1
                continue
            if places.get(tag):
                k = open_at((tag,)) if tag in _SCOPED and tag not in _SCOPE else places[tag][-1]
                if k > 0:
                    flush()
                    links = 0
                    close(k)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE or tag in VOID:
            if tag == "a":
                links = 1
            if tag == "hr":
                flush()
            continue
        flush()
        links = 0
        k = open_at(("p",))
        if k > 0:
            close(k)
        if tag in _ENDS:
            inner = scopes.pop() if tag in ("td", "th", "tr") and stack[-1][0] in ("td", "th") else None
            k = open_at(_ENDS[tag])
            if inner is not None:
                scopes.append(inner)
            if k > 0:
                close(k)
        if attrs.endswith("/") and tag not in ("p", "div"):
            continue
        given = {n.lower(): a or b or c for n, a, b, c in _ATTR.findall(attrs)} if "=" in attrs else {}
        label = f"{given.get('class', '')} {given.get('id', '')}"
        hard = tag in JUNK_TAGS or given.get("role", "").lower() in JUNK_ROLES or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", ""))) or bool(_HIDDEN_FLAG.search(attrs))
        node = Node(stack[-1][1], tag, label, hard, tag not in ("html", "body") and junk_name(label))
        node.parent.kids.append(node)
        nodes.append(node)
        places.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append((tag, node))
    flush()
    return nodes, blocks


def score(nodes: list[Node], blocks: list[tuple[Node, str, float]]) -> None:
    """Points, text and linked text of every element, from the blocks that lie in no junk.

    A block of 25 characters and more that is no heading gives 1 point, 1 for each comma and up to 3 for length (1 for each 100
    characters), discounted by its share of links, to its element (that of a paragraph, list item or caption to the one
    above) and ever smaller parts to the next four.
    """
    for node, value, density in blocks:
        node.chars += len(value)
        node.linked += len(value) * density
        if len(value) < 25 or node.tag in _HEADINGS:
            continue
        points = (1 + value.count(",") + value.count("，") + min(len(value) // 100, 3)) * (1 - density)
        up = node.parent if node.tag in ("p", "li", "dd", "dt", "figcaption") else node
        for share in _SHARES:
            if up is None:
                break
            up.score += points / share
            up = up.parent
    for node in reversed(nodes):  # children stand after their parents
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def rank(node: Node) -> float:
    """An element's points, with some for what it is and is called, discounted by the share of its text in links."""
    if node.score <= 0:
        return 0.0
    named = 25 if _GOOD.search(node.label) else 0
    return (node.score + _BASE.get(node.tag, 0) + named) * (1 - node.linked / max(node.chars, 1))


def _mark_junk(nodes: list[Node], blocks: list[tuple[Node, str, float]]) -> None:
    for node in reversed(nodes):
        # A page-wide form, or a wrapper named after its sidebar, is no junk if it holds the article.
        node.junk = (node.hard or node.soft) and not (node.main and node.tag not in ("nav", "footer", "aside", "head"))
        if not node.junk and (node.main or node.tag in ("article", "main")) and node.parent:
            node.parent.main = True
    inherit = lambda: [setattr(n, "junk", True) for n in nodes if n.parent and n.parent.junk]
    inherit()
    if all(n.junk for n, _, _ in blocks):
        # Nothing is left: names on the way to the element with the most prose were no help.
        size: dict[int, int] = {}
        for n, v, _ in blocks:
            size[id(n)] = size.get(id(n), 0) + (len(v) if len(v) >= 25 else 0)
        saved, up = set(), max((n for n, _, _ in blocks), key=lambda n: size[id(n)], default=None)
        while up:
            saved.add(id(up))
            up = up.parent
        for n in nodes:
            n.junk = n.hard or (n.soft and id(n) not in saved)
        inherit()


def extract(page: str | None) -> str:
    """The main text of a page: the blocks of the best container and its kept siblings, joined by two newlines.

    Elements are scored by `score` and `rank`; the best is the container. Its siblings are kept if they rank at least a fifth
    as high, or are paragraphs (short ones only without links); inside an <article> all siblings are kept, level by level
    up to it. Menus, headers, footers, asides, forms, adverts, notices and comments, by element, role, class or id, take
    no part, unless the article itself lies in one, or nothing would be left. Inside the container nothing else is left out;
    only where it is the whole page are lists, tables and divisions made of links taken for menus.
    """
    if not page:
        return ""
    nodes, blocks = parse(page)
    _mark_junk(nodes, blocks)
    kept = [b for b in blocks if not b[0].junk]
    score(nodes, kept)
    best = max((n for n in nodes if n.score > 0 and not n.junk), key=rank, default=None)
    if best is None:
        best = next((n for n in nodes if n.tag in ("article", "main") and not n.junk and n.chars), nodes[0])
    up = best
    while up and up.tag != "article":
        up = up.parent
    if up is None:
        up, cards = best, any(n.tag == "article" and n.score and not n.junk for n in nodes)
        while up and (up.tag != "main" or cards):
            up = up.parent
    best = up or best
    chosen = {id(best)}
    least = max(10.0, 0.2 * rank(best))
    for other in best.parent.kids if best.parent else ():
        density = other.linked / max(other.chars, 1)
        prose = other.tag == "p" and ((other.chars > 80 and density < 0.25) or (0 < other.chars <= 80 and not other.linked))
        if not other.junk and (rank(other) >= least if best.tag == "article" else rank(other) >= least or prose) and (other.tag == "article" or best.tag != "article"):
            chosen.add(id(other))
    whole_page = best.tag in ("html", "body")
    inside: dict[int, bool] = {}
    for n in nodes:  # parents first
        menu = whole_page and n.tag in ("ul", "ol", "dl", "table", "div", "section") and n.linked > 0.5 * n.chars
        inside[id(n)] = id(n) in chosen or (n.parent is not None and inside[id(n.parent)] and not menu)
    return "\n\n".join(value for node, value, _ in kept if inside[id(node)])


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of every row, `text` (its main text) and `n_chars` (its code points). No shuffle.

    A null or empty page gives an empty text; repeated rows each come back; other columns are ignored.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    source = pages.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(html).cast("string").alias("__html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__text", T.StringType()), T.StructField("__n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(v.as_py()) for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "__text", "__n"])

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.col("__text").alias("text"), F.col("__n").alias("n_chars"))
