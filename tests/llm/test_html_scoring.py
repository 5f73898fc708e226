"""HTML extraction: the score by its definition on random trees, what an article may hold, hostile pages in linear time."""

import html as entities
import random
import time
from html.parser import HTMLParser

import pytest

from corpuscle.llm import html


class Tree(HTMLParser):
    """A well-formed page as nested lists: [tag, class, members], members being such lists and texts."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["html", "", []]
        self.stack = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self.stack.append([tag, dict(attrs).get("class", ""), []])
            self.stack[-2][2].append(self.stack[-1])
        elif tag == "a":
            self.stack[-1][2].append(None)  # a link begins

    def handle_endtag(self, tag):
        if tag == "a":
            self.stack[-1][2].append(True)
        elif tag != "b":
            self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def blocks_of(node):
    """(path of nodes, text, characters in links) of each run of texts, in order."""
    out, run, linked, link = [], "", 0, False
    for m in [*node[2], []]:
        if m is None or m is True:
            link = m is None
        elif isinstance(m, str):
            run += m
            linked += len(m.strip()) if link else 0
        else:
            value = " ".join(run.split())
            if value:
                out.append(([node], value, min(1, linked / len(value))))
            run, linked = "", 0
            if m:
                out += [([node, *path], v, d) for path, v, d in blocks_of(m)]
    return out


def brute(page):
    root = Tree(page).root
    blocks = blocks_of(root)
    every, parent = [], {}

    def visit(node):
        every.append(node)
        for m in node[2]:
            if isinstance(m, list):
                parent[id(m)] = node
                visit(m)

    visit(root)
    total = {id(n): [0.0, 0, 0.0] for n in every}
    for path, v, d in blocks:
        for n in path:
            total[id(n)][1] += len(v)
            total[id(n)][2] += len(v) * d
        if len(v) >= 25 and not path[-1][0].startswith("h") or path[-1][0] == "html" and len(v) >= 25:
            points = (1 + v.count(",") + min(len(v) // 100, 3)) * (1 - d)
            up = path[::-1][1:] if path[-1][0] in ("p", "li") else path[::-1]
            for n, part in zip(up, (1, 2, 6, 9, 12), strict=False):
                total[id(n)][0] += points / part

    def rank(n):
        s, chars, linked = total[id(n)]
        return (s + html._BASE.get(n[0], 0) + 25 * bool(html._GOOD.search(n[1]))) * (1 - linked / max(chars, 1)) if s > 0 else 0

    scored = [n for n in every if total[id(n)][0] > 0]
    if not scored:
        return None
    best = max(scored, key=rank)
    kept = [best]
    for n in parent[id(best)][2] if id(best) in parent else ():
        if isinstance(n, list) and n is not best:
            s, chars, linked = total[id(n)]
            short = n[0] == "p" and (chars > 80 and linked / chars < 0.25 or 0 < chars <= 80 and not linked)
            if rank(n) >= max(10, rank(best) / 5) or short:
                kept.append(n)
    whole = best[0] in ("html", "body")
    out = []
    for path, v, _ in blocks:
        at = next((k for k, n in enumerate(path) if any(n is x for x in kept)), None)
        menu = lambda n: whole and n[0] in ("ul", "div", "section") and total[id(n)][2] > 0.5 * total[id(n)][1]
        if at is not None and not any(menu(n) for n in path[at + 1 :]):
            out.append(v)
    return "\n\n".join(out)


def random_page(rng, depth=0):
    words = lambda n: " ".join(rng.choice(["word", "other", "comma,", "some", "text,", "R&amp;D"]) for _ in range(n))
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.choice(["p", "p", "h2", "ul", "div", "section", "text"])
        if kind == "text":
            out.append(words(rng.randint(1, 30)))
        elif kind == "p":
            out.append(f"<p>{words(rng.randint(0, 40))}{f'<a href=x>{words(rng.randint(1, 9))}</a>' if rng.random() < 0.3 else ''} <b>{words(1)}</b></p>")
        elif kind == "h2":
            out.append(f"<h2>{words(4)}</h2>")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li><a href=y>{words(3)}</a></li>" if rng.random() < 0.5 else f"<li>{words(12)}</li>" for _ in range(3)) + "</ul>")
        elif depth < 4:
            label = rng.choice(["", ' class="entry"', ' class="plain"'])
            out.append(f"<{kind}{label}>{random_page(rng, depth + 1)}</{kind}>")
    return "".join(out)


def test_score_by_its_definition():
    rng, seen = random.Random(2), 0
    for _ in range(400):
        page = random_page(rng)
        want = brute(page)
        if want is not None:
            seen += 1
            assert html.extract(page) == want, page
    assert seen > 300


LONG = "<p>Long text, about, many things, that matter here.</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article>{LONG}<div class="share-price">Price is 5</div><p class="notice-board">Board</p><section class="related-work"><p>Related</p></section></article>', "{}\n\nPrice is 5\n\nBoard\n\nRelated"),
        (f"<article><h2>Sources</h2><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>{LONG}</article>", "Sources\n\none\n\ntwo\n\n{}"),
        (f"<article>{LONG}<p>With <math><mi>x</mi><mo>=</mo><mn>1</mn></math> inside.</p><p>A <button>press <div>me</div></button> button</p></article>", "{}\n\nWith x=1 inside.\n\nA button"),
        (f"<article>{LONG}<div><button>never closed</div><p>goes on</p></article>", "{}\n\ngoes on"),
        (f"<body class='has-sidebar'><div class='content no-comments'>{LONG}</div></body>", "{}"),
        (f"<body><div class='sidebar'>{LONG}</div></body>", "{}"),
        ("<div>" * 300 + "<nav>menu, menu, menu and so on</nav><div class='ad-slot-1'>buy, buy, now</div>" + LONG, "{}"),
        (f"<div class='siteFooter'>foot</div><div class='cookie-notice'>cookies, many</div><div class=post>{LONG}</div>", "{}"),
    ],
)
def test_what_an_article_holds(page, want):
    assert html.extract(page) == want.format(entities.unescape(LONG[3:-4]))


@pytest.mark.parametrize("part", [("<div>", "</section>"), ("<a ", ""), ("<ul><li><div><foo>", "</li>"), ("<a \"'", ""), ("<", ""), ("<button>", "</div>"), ("<div>text, of some size, with commas<div>", ""), ("<p ", "x>"), ("<p " + "a" * 50, ""), ("</script ", "")])
def test_hostile_pages_take_linear_time(part):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html.extract(part[0] * n + part[1] * n + ">")
        took.append(time.process_time() - began)
    assert took[1] < 1 or took[1] < 12 * took[0]


def test_a_very_long_page_is_whole():
    text = " ".join(f"word{k}," for k in range(300_000))
    assert html.extract(f"<article><p>{text}</p></article>") == text
