from __future__ import annotations

import html
import json
import random
import re

import pytest
from pyspark.sql import Row

from stridelab.llm import htmlwrap, queries
from tests.oracle import compare, connect


def page(rng: random.Random, main: str = "article", menu: int = 3) -> tuple[str, str]:
    word = lambda n: " ".join(rng.choice(["stone", "river", "a &amp; b", "caf&eacute;", "<b>bold</b>", "x&nbsp;y"]) for _ in range(n))
    blocks = [word(rng.randint(3, 12)) for _ in range(rng.randint(1, 5))]
    title = word(3)
    text = " ".join(" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in [title, *blocks])
    links = "".join(f'<li><a href="/{i}">go {rng.randrange(99)}</a></li>' for i in range(menu))
    note = f"<aside>see {rng.randrange(99)}</aside>" if rng.random() < 0.5 else ""
    body = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>\n" for b in blocks)
    open_, close = (f"<{main}>", f"</{main}>") if main != "div" else ('<div class="post">', "</div>")
    return (
        f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>{links}</ul></nav><div class='ad'>buy {rng.randrange(99)}</div>{open_}{body}{note}"
        f"<section class='comments'><p>nice {rng.randrange(99)}</p></section>{close}<form><p>name</p></form><footer>&copy; {rng.randrange(99)}</footer></body></html>",
        text,
    )


@pytest.mark.parametrize("main", ["article", "main", "div"])
def test_main_text_along_an_inferred_wrapper(main):
    rng = random.Random(6)
    pages = [page(rng, main, rng.randint(1, 6)) for _ in range(30)]
    wrapper = json.loads(htmlwrap.infer([p for p, _ in pages[:8]]))
    for source, text in pages:
        assert htmlwrap.main_text(source, wrapper) == text


def neutral(rng: random.Random, template: int) -> tuple[str, str]:
    """Pages without telling tags or class names; two templates with the text in different places."""
    word = lambda n: " ".join(rng.choice(["stone", "river", "quiet", "lamp", "seven"]) + str(rng.randrange(50)) for _ in range(n))
    title, blocks = word(4), [word(rng.randint(15, 40)) for _ in range(rng.randint(2, 5))]
    text = " ".join([title, *blocks])
    body = f"<h2>{title}</h2>" + "".join(f"<p>{b}</p>" for b in blocks)
    menu = "".join(f"<div><a href='#'>{x}</a></div>" for x in ("Start", "Topics", "About us"))
    around = f"<div class='a'>{menu}</div>", f"<div class='z'>All rights kept <i>{rng.randrange(99)}</i></div>"
    middle = f"<div class='b'>{body}</div>" if template == 0 else f"<table class='t'><tr><td>Topics of the day</td></tr></table><div class='c'><div class='d'>{body}</div></div>"
    return f"<html><body>{around[0]}{middle}{around[1]}</body></html>", text


def test_wrappers_decide_where_names_tell_nothing(spark):
    """Menus and notes are template by what stays the same; a rare template and a page that fits none are read, too."""
    rng = random.Random(11)
    pages = [neutral(rng, 0) for _ in range(40)] + [neutral(rng, 1)]
    odd = "<html><body><span>Start</span><div class='q'><p>only here " + "word " * 30 + "</p></div></body></html>"
    rows = [(i, "http://one.org/x", p) for i, (p, _) in enumerate([*pages, (odd, "")])]
    got = {r.page_id: r.text for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(40)] == [t for _, t in pages[:40]]
    assert pages[40][1] in got[40]
    assert "only here" in got[41]
    bare = [htmlwrap.main_text(p, None) for p, _ in pages[:40]]
    assert all(b != got[i] and "About us" in b for i, b in enumerate(bare))


def test_a_host_that_mixes_templates_loses_no_text(spark):
    """Forty pages without an article and one with; menus stand where the others have their text."""
    rng = random.Random(12)
    pages = [neutral(rng, 0) for _ in range(40)]
    word = " ".join(f"only{rng.randrange(99)}" for _ in range(60))
    menu = "<div class='a'><div><a href='#'>Start</a></div><div><a href='#'>Topics</a></div></div>"
    for mixed in (f"<html><body>{menu}<article><h2>Own title</h2><p>{word}</p></article></body></html>", f"<html><body><main><p>Own title</p><p>{word}</p></main></body></html>"):
        rows = [(i, "http://one.org/x", p) for i, (p, _) in enumerate([*pages, (mixed, "")])]
        got = {r.page_id: r.text for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got[40] == f"Own title {word}"
        assert [got[i] for i in range(40)] == [t for _, t in pages]


def test_inference_finds_slots_repeats_and_options():
    a = "<ul><li>1</li><li>2</li></ul><p>same</p><i>x</i>"
    b = "<ul><li>3</li></ul><hr><p>same</p><i>y</i>"
    nodes = json.loads(htmlwrap.infer([a, b]))["nodes"]
    assert nodes[:3] == ["<ul>", ["+", ["<li>", nodes[1][1][1], "</li>"]], "</ul>"]
    long = "<section>" + "".join(f"<h{i % 5 + 1}>x</h{i % 5 + 1}><p>y</p>" for i in range(9)) + "</section>"
    assert [x[0] if isinstance(x, list) else x for x in json.loads(htmlwrap.infer([long * 3]))["nodes"]] == ["+"]
    assert ["?", ["<hr>"]] in nodes


def test_pages_follow_their_wrapper(spark, sf_dir):
    by_host: dict[str, list[str]] = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        by_host.setdefault(r.url.split("/")[2], []).append(r.html)
    shares = []
    for pages in by_host.values():
        wrapper = json.loads(htmlwrap.infer(pages[:8]))
        for p in pages:
            stream = [t for t in htmlwrap.tokens(p) if htmlwrap._significant(t)]
            shares.append(len(htmlwrap._along(wrapper, [htmlwrap._signature(t) for t in stream])) / sum(t[0] == "t" for t in stream))
    assert sum(shares) / len(shares) >= 0.9


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text only", "plain text only"),
        ("<article><p>one<p>two<br>three</article>", "one two three"),
        ("<article>a<!-- x --><!-- never closed", "a"),
        ("<article>1 < 2 &lt; 3 &#65;&amp;amp;</article>", "1 < 2 < 3 A&amp;"),
        ("<article>un<b>br</b>oken <a title='a>b'>link</a></article>", "unbroken link"),
        ("<article><script>if (a < b) { '</p>' }</script>x</article>", "x"),
        ("<article><p>x</p><div class='sidebar'>no</div><article class='comment'>no</article></article>", "x"),
        ("<article>cut off <p>here", "cut off here"),
        ("<article class='post alert has-sidebar'><div class='with-ads'>x</div><p class='notice'>no</p></article>", "x"),
        ("<article>" + "<b>" * 5000 + "deep" + "</article>", "deep"),
    ],
)
def test_odd_pages(source, text):
    assert htmlwrap.main_text(source, json.loads(htmlwrap.infer([source])) if source else None) == text
    assert htmlwrap.main_text(source, None) == text


def test_hostile_pages_take_linear_time():
    for source in ("<" * 200_000, "<!--" * 50_000, "<a " * 60_000, "<p>" * 60_000, "&" * 200_000, "<article>" + "x " * 500_000):
        htmlwrap.main_text(source, None)


def test_extract_with_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rng = random.Random(4)
    pages = [page(rng) for _ in range(6)]
    rows = [Row(page_id=i, url=f"http://h{i % 2}.org/{i}", html=p, host="mine", wrapper=1) for i, (p, _) in enumerate(pages)]
    rows += [rows[0], Row(page_id=None, url=None, html=pages[1][0], host=None, wrapper=None), Row(page_id=9, url="http://one.org/", html=None, host=None, wrapper=None), Row(page_id=10, url="http://one.org/", html="", host=None, wrapper=None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper int")
    out = htmlwrap.extract(df)
    assert out.columns == [*df.columns, "text"]
    got = sorted(((r.page_id if r.page_id is not None else -1, r.text, r.host) for r in out.collect()), key=str)
    want = [(i, t, "mine") for i, (_, t) in enumerate(pages)] + [(0, pages[0][1], "mine"), (-1, pages[1][1], None), (9, "", None), (10, "", None)]
    assert got == sorted(want, key=str)
    assert htmlwrap.extract(df.limit(0)).count() == 0


def test_wrappers_are_joined_alike_when_not_broadcast(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = lambda: sorted((r.page_id, r.text) for r in htmlwrap.extract(pages).collect())
    before = rows()
    monkeypatch.setattr(htmlwrap, "BROADCAST_CHARS", 0)
    monkeypatch.setattr(htmlwrap, "BROADCAST_MARKS", 0)
    assert rows() == before


def test_every_page_of_a_host_counts(spark):
    """A line that one page of sixty has otherwise is no template, wherever that page stands; a menu that never differs is."""
    rng = random.Random(21)
    rows, want = [], {}
    for h in range(6):
        for i in range(60):
            source, text = neutral(rng, 0)
            line = "Another first line" if i == 59 else "The same first line"
            title = source[source.index("<h2>") : source.index("</h2>") + 5]
            rows.append((100 * h + i, f"http://h{h}.org/{i}", source.replace(title, f"<p class='lead'>{line}</p>{title}")))
            want[100 * h + i] = f"{line} {text}"
    got = {r.page_id: r.text for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_many_structures_are_aligned_in_rounds_and_pages_may_be_stored_in_any_order(spark, monkeypatch):
    """Structures of 2 ** 6 kinds with copies, three at a time; each gives its wrapper, and order and parts change nothing."""
    monkeypatch.setattr(htmlwrap, "FAN", 3)
    rng = random.Random(22)
    tags = ("h3", "pre", "ul", "ol", "dl", "hr")
    sources = []
    for k in range(64):
        blocks = "".join(f"<{t}>{rng.randrange(10**6)}</{t}>" for j, t in enumerate(tags) if k >> j & 1)
        sources.append(f"<html><body><div class='a'>Menu</div><article><h1>{rng.randrange(10**6)}</h1>{blocks}</article></body></html>")
    rows = [(i, "http://one.org/", p) for i, p in enumerate(sources * 2)]
    make = lambda r, n: spark.createDataFrame(r, "page_id long, url string, html string").repartition(n)
    found = {(r.host, r.wrapper) for n, r in ((1, rows), (5, rows[::-1])) for r in htmlwrap.wrappers(make(r, n)).collect()}
    assert len(found) == 1
    wrapper = json.loads(found.pop()[1])
    assert wrapper["region"] == "html/body/article"
    for p in sources:
        stream = [t for t in htmlwrap.tokens(p) if htmlwrap._significant(t)]
        assert len(htmlwrap._along(wrapper, [htmlwrap._signature(t) for t in stream])) >= 2


def test_a_long_row_of_alignments_does_not_nest_without_end():
    rng = random.Random(23)
    pages = ["<article>" + "".join(f"<{t}>{rng.randrange(99)}</{t}>" for t in rng.choices(["p", "h2", "ul", "pre", "hr", "ol", "table"], k=rng.randint(1, 9))) + "</article>" for _ in range(400)]
    wrapper = json.loads(htmlwrap.infer(pages))
    for p in pages[:50]:
        assert htmlwrap.main_text(p, wrapper) == htmlwrap.main_text(p, None)


def test_query_against_the_articles(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.queries()["op9_html"](spark, sf_dir).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split()) and r.n_chars == len(r.text)


def test_query_matches_its_sql(spark, sf_dir):
    assert compare(queries.queries()["op9_html"](spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op9_html"]) is None
