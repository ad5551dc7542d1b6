"""The main text of pages, against a slow second implementation, and what its steps decide."""

import math
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from marlstone.llm import html_text
from marlstone.llm.html_text import main_text, marked_name

BLOCKS = html_text._BLOCKS
CONTAINERS = html_text._CONTAINERS


class Slow(HTMLParser):
    """Events of a page whose elements are all closed, with the whole stack of open elements copied at the end of each line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.rows, self.text, self.tags, self.linked, self.made = [], [], "", 0, 0, 0

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.rows.append((text, self.tags, self.linked, list(self.stack)))
        self.text, self.tags, self.linked = "", 0, 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        attrs = {k: v or "" for k, v in attrs}
        if tag in ("article", "main") and not guessed(tag, attrs) and not hidden(attrs):
            for i, e in enumerate(self.stack):
                if skips(self.stack, i):
                    if e[1] not in ("article", "main"):
                        self.flush()
                        del self.stack[i:]
                    break
        if tag in BLOCKS:
            self.flush()
            self.tags = 1
        if tag in html_text._VOID:
            self.text += " " if tag in ("br", "hr") else ""
            return
        self.made += 1
        self.stack.append((self.made, tag, attrs))

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][1] == tag:
                if any(e[1] in BLOCKS for e in self.stack[i:]):
                    self.flush()
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not any(e[1] in html_text._UNREAD for e in self.stack):
            self.text += data
            self.linked += len(data) if any(e[1] == "a" for e in self.stack) else 0


def hidden(attrs):
    style = attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def guessed(tag, attrs):
    names = [attrs.get(k, "") for k in ("class", "id", "role", "aria-label")]
    if tag in ("html", "body"):
        return False
    if tag in ("article", "main"):
        return marked_name(" ".join(names), html_text._NOT_THE_MAIN)
    return tag == "form" or marked_name(" ".join(names), html_text._MARKS) or any(re.fullmatch("((site|page|top|global|main)[_-])?header", n.lower()) for x in names for n in x.split())


def is_main(e):
    return e[1] in CONTAINERS and (e[1] in ("article", "main") or e[2].get("role") == "main" or e[2].get("itemprop") == "articleBody")


def skips(stack, i):
    _, tag, attrs = stack[i]
    return tag in ("nav", "footer", "aside", "menu", "fieldset", "label") or hidden(attrs) or (tag == "header" and not any(map(is_main, stack[:i])))


def slow_text(html):
    events = Slow()
    events.feed(html)
    events.close()
    events.flush()
    rows = events.rows
    skipped = [any(skips(s, i) for i in range(len(s))) for *_, s in rows]
    plain = [max(0, len(t) - k) for t, _, k, _ in rows]
    page = sum(p for p, s in zip(plain, skipped) if not s)
    hard = list(skipped)
    for e in {e[0]: e for *_, s in rows for e in s if guessed(e[1], e[2])}.values():
        holds = [any(x[0] == e[0] for x in s) for *_, s in rows]
        own = sum(p for p, s, h in zip(plain, hard, holds) if h and not s)
        prose = sum(p for p, s, h, (_, t, _, _) in zip(plain, hard, holds, rows) if h and not s and p >= 20 * max(1, t))
        if not page or 2 * own < page or 2 * prose < own:
            skipped = [s or h for s, h in zip(skipped, holds)]
    ratio = [0 if s else p / max(1, t) for p, s, (_, t, _, _) in zip(plain, skipped, rows)]
    if not rows:
        return ""
    kernel = {d: math.exp(-d * d / 2) for d in range(-2, 3)}
    smooth = []
    for i in range(len(rows)):
        near = [(kernel[d], ratio[i + d]) for d in kernel if 0 <= i + d < len(rows)]
        smooth.append(sum(k * r for k, r in near) / sum(k for k, _ in near))
    mean = sum(smooth) / len(smooth)
    limit = min(mean, math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)))
    good = [any(ratio) and not s and (len(rows) == 1 or x >= limit) for x, s in zip(smooth, skipped)]
    outermost = [next((e[0] for e in s if is_main(e)), None) for *_, s in rows]
    if not any(good):
        return "\n".join(r[0] for r, m, s in zip(rows, outermost, skipped) if m and not s)
    regions = {m for m, g in zip(outermost, good) if g and m}
    if regions:
        inside = [i for i, m in enumerate(outermost) if m in regions]
    else:
        boxes = [[e[0] for e in s if e[1] in CONTAINERS] for *_, s in rows]
        weight = lambda box: sum(len(r[0]) for r, b, g in zip(rows, boxes, good) if g and (box is None or box in b))
        region, depth = None, 0
        while True:
            children = sorted({b[depth] for b in boxes if len(b) > depth and (region is None or b[depth - 1] == region)})
            best = max(children, key=lambda c: (weight(c), -c), default=None)
            if best is None or not weight(best) >= 0.75 * weight(region) > 0:
                break
            region, depth = best, depth + 1
        inside = [i for i, b in enumerate(boxes) if region is None or region in b]
        content = [i for i in inside if good[i]]
        inside = [i for i in inside if content[0] <= i <= content[-1]]
    links = [2 * k > len(t) for t, _, k, _ in rows]
    out = []
    for i in inside:
        a = b = i
        while a and links[a - 1] == links[i]:
            a -= 1
        while b + 1 < len(rows) and links[b + 1] == links[i]:
            b += 1
        menu = links[i] and sum(good[a : b + 1]) < 0.5 * (b + 1 - a)
        if not skipped[i] and not menu:
            out.append(rows[i][0])
    return "\n".join(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_match_the_slow_implementation(sf):
    pages = pq.read_table(f"/root/testdata/{sf}/pages.parquet", columns=["html"])["html"].to_pylist()
    assert [main_text(p) for p in pages] == [slow_text(p or "") for p in pages]


def generated(rng: random.Random, depth: int = 0) -> str:
    words = lambda n: " ".join(rng.choice(["word", "some", "&amp;", "text", "Ünï", "longerword", "a"]) for _ in range(n))
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.35 and depth < 4:
            tag = rng.choice(["div", "div", "div", "section", "blockquote", "article", "main", "form", "nav", "aside", "header", "footer"])
            names = rng.choice(["", "", "", ' class="post"', ' class="has-sidebar"', ' class="site-footer"', ' id="comments"', ' class="market-share"', ' style="display: none"', ' role="main"'])
            out.append(f"<{tag}{names}>{generated(rng, depth + 1)}</{tag}>")
        elif kind < 0.55:
            out.append("<ul>" + "".join(f'<li><a href="#">{words(rng.randint(1, 4))}</a></li>' for _ in range(rng.randint(1, 6))) + "</ul>")
        elif kind < 0.9:
            out.append(f"<p>{words(rng.randint(1, 60))} <b>{words(2)}</b> {words(rng.randint(0, 20))}</p>")
        else:
            out.append(rng.choice(["<script>var x = '<p>';</script>", "<!-- a <p> comment -->", f"<h2>{words(3)}</h2>", words(5), "<br>", "<img src='x'>"]))
    return "".join(out)


def test_generated_pages_match_the_slow_implementation():
    rng, texts = random.Random(1), 0
    for _ in range(1500):
        page = f"<html><body>{generated(rng)}</body></html>"
        assert main_text(page) == slow_text(page), page
        texts += bool(main_text(page))
    assert texts > 900


PROSE = "<p>" + "A sentence of the article that goes on for a while, with words. " * 4 + "</p>"
LINKS = "".join(f'<div><a href="/{i}">Link number {i}</a></div>' for i in range(12))
CODES = "".join(f"<div><i>item</i> <b>{i}</b> <i>kind</i> <u>code</u></div>" for i in range(150))
UNMARKED = f"<html><body><div>{LINKS}{CODES}</div><div>{PROSE}<p>Short.</p>{PROSE * 3}</div><div>{LINKS}<div>Small print</div></div></body></html>"


def test_ratio_smoothing_and_threshold_decide_unmarked_pages(monkeypatch):
    """A page without a telling tag or name: without one of the steps its text is another."""
    right = main_text(UNMARKED)
    assert right.count("A sentence") == 16 and "Short." in right and "Link" not in right and "print" not in right and "code" not in right
    every = lambda lines: np.array([not x.skipped for x in lines])
    with monkeypatch.context() as m:
        m.setattr(html_text, "content_lines", every)
        assert main_text(UNMARKED) != right
    with monkeypatch.context() as m:
        m.setattr(html_text.Line, "ratio", property(lambda self: 0.0 if self.skipped else 1.0))
        assert main_text(UNMARKED) != right
    scattered = f"<html><body><div>{PROSE}</div>" + "".join(f"<div><p>{'x' * 25}</p></div>" for _ in range(12)) + f"<div>{PROSE * 5}</div></body></html>"
    before = main_text(scattered)
    with monkeypatch.context() as m:
        m.setattr(html_text, "smoothed", lambda ratios, radius=2, sigma=1.0: ratios)
        plain = [bool(x) for x in html_text.content_lines(_lines(scattered))]
    assert plain != [bool(x) for x in html_text.content_lines(_lines(scattered))] and before


def _lines(html):
    parser = html_text._Lines()
    parser.feed(html)
    parser.close()
    return parser.lines


@pytest.mark.parametrize(
    "page",
    [f'<div class="layout has-sidebar">{PROSE * 4}</div>', f'<div class="post comments-open">{PROSE * 4}</div>', f"<form>{PROSE * 4}</form>", f'<div id="sidebar">{PROSE * 4}</div>', f'<div class="content">{PROSE * 4}<div class="post-comments">{PROSE}</div><div class="cookie-banner">We use cookies</div></div>'],
)
def test_names_never_empty_a_page(page):
    assert main_text(page).count("A sentence") == 16 and "cookies" not in main_text(page)


def test_whole_names_only():
    marks = html_text._MARKS
    for name in ("sidebar", "site-footer", "related_posts", "ad-slot-3", "post sidebar", "cookie-notice"):
        assert marked_name(name, marks), name
    for name in ("", "has-sidebar", "market-share", "comments-open", "adventure", "no-ads", "navy", "content"):
        assert not marked_name(name, marks), name


@pytest.mark.parametrize("unit", ["<!--", "<!-- >", "<![CDATA[", "<![CDATA[>", "<!x", "<?", "<a ", "</a", '<a href="', '<a href="x>', "&", "<div>", "<p>", "<b", "<script>", "<textarea>", "<a b='>"])
def test_time_is_linear_in_constructs_that_nothing_ends(unit):
    start = time.perf_counter()
    main_text("<p>hello there world</p>" + unit * 32_000 + ">")
    assert time.perf_counter() - start < 5


def test_dangling_constructs_keep_the_text():
    assert main_text("<p>hello there</p><!-- open <p>more words</p>") == "hello there\nopen\nmore words"
    assert main_text("<p>one</p><p>two <!-- x --> three</p> a < b <em") == "one\ntwo three\na < b"
    assert main_text("<p>one</p><a hre") == "one"
