"""Main text of pages: containers, hostile input, and a plain two-pass version on well-formed pages."""

import html.parser
import random
import time

import duckdb
import pytest

from riskgrid.llm import pages

BODY = "This is the text of the article and it has all of the words that one would look for in it when reading."
MORE = "There is also a second paragraph in the text and it is about the same length as the first of the two."
NAMES = (
    '<div class="content has-sidebar">', '<article class="post comments-open">', '<div class="layout no-banner">', '<div id="page" class="menu-open">',
    '<section id="search-for-meaning">', '<article class="related-research">', '<article class="share-price-news">', '<div class="story">',
)


@pytest.mark.parametrize("opening", NAMES)
def test_a_class_alone_does_not_condemn_the_article(opening):
    tag = opening[1:].split()[0]
    page = f"<html><body><nav><a href=x>Home page</a></nav>{opening}<p>{BODY}</p><p>{MORE}</p></{tag}><footer>f</footer></body></html>"
    assert pages.main_text(page) == f"{BODY} {MORE}"


def test_small_hinted_parts_inside_a_named_container_go():
    page = f'<body><div class="content has-sidebar"><p>{BODY}</p><div class="sidebar"><p>See what else we have for you here.</p></div><p>{MORE}</p><p>{BODY}</p><p>{MORE}</p></div></body>'
    assert pages.main_text(page) == f"{BODY} {MORE} {BODY} {MORE}"


@pytest.mark.parametrize("container", ["article", "div"])
def test_tables_lists_and_preformatted_text_stay(container):
    page = f"<{container}><h1>T</h1><p>{BODY}</p><pre>x  =  1</pre><table><tr><td>1</td><td>2</td></tr></table><ul><li><a href=1>one</a></li><li>no link at all here</li></ul><p>{MORE}</p></{container}>"
    assert pages.main_text(page) == f"T {BODY} x = 1 1 2 one no link at all here {MORE}"


def test_reader_comments_longer_than_the_article_go():
    page = f'<div><h1>T</h1><p>{BODY}</p><p>{MORE}</p></div><div id="comments">{f"<p>{BODY}</p>" * 9}</div>'
    assert pages.main_text(page) == f"T {BODY} {MORE}"


def test_hidden_states_and_roles_decide():
    page = f'<div><p>{BODY}</p><p hidden>{MORE}</p><div style="display: none">{MORE}</div><div role="banner">{MORE}</div><div aria-hidden="true">{MORE}</div><p data-hidden="x">{MORE}</p></div>'
    assert pages.main_text(page) == f"{BODY} {MORE}"


HOSTILE = {
    "spans": lambda n: "<span>" * n + "</div>" * n, "heads": lambda n: "<head>" * n, "inline": lambda n: "<b>" * n + "</i>" * n, "scoped": lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
    "scripts": lambda n: "<script ' " * n, "quotes": lambda n: "<a ' \" " * n + ">", "hints": lambda n: "<div class=ad>text of it " * n, "tables": lambda n: "<table><tr><td>" * n,
    "comments": lambda n: "<!--" * n, "brackets": lambda n: "<" * 5 * n, "classes": lambda n: "<a " + "class  " * n + ">", "templates": lambda n: "<template><svg>" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_linear_on_hostile_pages(name):
    def took(n):
        page, best = HOSTILE[name](n), 1e9
        for _ in range(2):
            began = time.perf_counter()
            pages.main_text(page)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(80_000) < 12 * took(20_000) + 0.2


class Plain(html.parser.HTMLParser):
    """Blocks of a well-formed page with all elements around them."""

    def __init__(self):
        super().__init__()
        self.around, self.found, self.piece, self.count = [], [], [], 0

    def flush(self):
        text, links = " ".join("".join(x for x, _ in self.piece).split()), " ".join("".join(x for x, a in self.piece if a).split())
        if text:
            self.found.append((text, len(links), list(self.around)))
        self.piece = []

    def handle_starttag(self, tag, attrs):
        if tag in pages._BLOCK:
            self.flush()
        self.count += 1
        self.around.append((self.count, tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if tag in pages._BLOCK:
            self.flush()
        assert self.around.pop()[1] == tag

    def handle_data(self, data):
        if not any(t in ("script", "style", "title") for _, t, _ in self.around):
            self.piece.append((data, any(t == "a" for _, t, _ in self.around)))


def plain_text(page):
    reader = Plain()
    reader.feed(page)
    reader.flush()
    rows = []
    for text, linked, around in reader.found:
        inside, boiler, hints, group = False, False, [], None
        for number, tag, given in around:
            boiler = boiler or pages._decisive(tag, given, inside)
            if not boiler and pages._hint(tag, given):
                hints.append((number, pages._hint(tag, given)))
            inside = inside or (tag in ("article", "main") and not boiler)
            group = group or (number if tag in pages._GROUP_TAGS else None)
        words = text.split()
        stops = sum(w in pages.STOP_WORDS for w in pages._LETTERS.findall(text.lower())) / len(words)
        heading = any(t in ("h1", "h2", "h3") for _, t, _ in around[-3:])
        rows.append(dict(text=text, n=len(words), links=linked, stops=stops, boiler=boiler, inside=inside, hints=hints, group=group, heading=heading))
    plain = [r for r in rows if not r["boiler"] and r["links"] <= len(r["text"]) / 2]
    total = sum(r["n"] for r in plain)
    free = sum(r["n"] for r in plain if not r["hints"])

    def small(number, strength):
        own = sum(r["n"] for r in plain if number in [h for h, _ in r["hints"]])
        return own < total / 4 or not total or (strength == 2 and free >= total / 20)

    for r in rows:
        r["out"] = r["boiler"] or any(small(*h) for h in r["hints"])
    own = sum(r["n"] for r in plain if r["inside"] and not r["out"])
    other = sum(r["n"] for r in plain if not r["inside"] and not r["out"] and r["n"] >= 10 and r["stops"] >= 0.15)
    trusted = own > 0 and 3 * own >= other
    for r in rows:
        same = [x for x in rows if r["group"] and x["group"] == r["group"] and not x["boiler"]] if r["n"] < 30 and r["group"] else [r]
        dense = sum(x["links"] for x in same) > sum(len(x["text"]) for x in same) / 2
        if r["out"] or (trusted and not r["inside"]) or (dense and not (trusted and r["n"] >= 30)):
            r["keep"] = False
        elif trusted or (r["n"] >= 10 and r["stops"] >= 0.25) or (r["n"] >= 30 and r["stops"] >= 0.15):
            r["keep"] = True
        else:
            r["keep"] = None
    out = []
    for k, r in enumerate(rows):
        keep = r["keep"]
        if keep is None:
            unit = [j for j, x in enumerate(rows) if x["group"] == r["group"] and x["keep"] is None] if r["group"] else [k]
            left = [(unit[0] - j, rows[j]["keep"]) for j in range(unit[0]) if rows[j]["keep"] is not None and not rows[j]["out"]][-1:]
            right = [(j - unit[-1], rows[j]["keep"]) for j in range(unit[-1] + 1, len(rows)) if rows[j]["keep"] is not None and not rows[j]["out"]][:1]
            near = right if r["heading"] and right else left + right
            keep = True if not near else near[0][1] and near[1][1] if len(near) == 2 and near[0][0] == near[1][0] else min(near)[1]
        if keep:
            out.append(r["text"])
    return " ".join(out)


def made_page(rng):
    words = "the of and in it plain word here tree house green walk is on".split()
    names = ["", "", ' class="ad"', ' class="sidebar left"', ' id="comments"', ' class="story"', ' role="search"', ' class="has-comments"', " hidden"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))

    def part(depth):
        kind = rng.choice(["p", "p", "p", "h2", "div", "div", "section", "article", "ul", "table", "nav", "aside", "pre"])
        if kind in ("p", "h2", "pre") or not depth:
            return f"<p>{text(45)} <a href='/x y'>{text(4)}</a></p>" if rng.random() < 0.5 else f"<{kind if kind in ('h2', 'pre') else 'p'}>{text(14)}</{kind if kind in ('h2', 'pre') else 'p'}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li><a>{text(4)}</a> {text(3) if rng.random() < 0.5 else ''}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind == "table":
            return "<table><tr>" + "".join(f"<td>{text(5)}</td>" for _ in range(rng.randint(1, 5))) + "</tr></table>"
        return f"<{kind}{rng.choice(names)}>" + "".join(part(depth - 1) for _ in range(rng.randint(1, 5))) + f"</{kind}>"

    return "<html><body>" + "".join(part(3) for _ in range(rng.randint(1, 8))) + "</body></html>"


def test_made_pages_by_the_plain_version():
    rng = random.Random(11)
    for _ in range(1500):
        page = made_page(rng)
        assert pages.main_text(page) == plain_text(page), page


def test_given_pages_hold_their_article(spark, small):
    given = dict(duckdb.sql(f"SELECT page_id, html FROM '{small}/pages.parquet' WHERE html IS NOT NULL").fetchall())
    for r in pages.op1_html_extraction(spark, small).collect():
        page = given.get(r.page_id) or ""
        article = page[page.find("<article>") + 9 : page.find("</article>")] if "<article>" in page else ""
        reader = Plain()
        reader.handle_endtag = lambda tag: reader.flush() if tag in pages._BLOCK else None
        reader.feed(article)
        reader.flush()
        assert r.text == " ".join(t for t, *_ in reader.found)
