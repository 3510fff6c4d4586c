import random
import time

import pytest

from gaugeboard.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></ul></nav><!-- ad 1 --><div class="ad">buy</div>
<div id="cookie-notice">We use cookies</div>%s<aside>side</aside><section class="comments"><p>first!</p></section>
<form><input name=q><button>Go</button></form><footer>&copy; site</footer></body></html>"""


def text(body, known=()):
    return pages.main_text(pages.parse(PAGE % body), set(known))


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><h1>A &lt; B</h1><p>One\n  two&nbsp;<b>bo</b>ld<br>next<p>three</article>", "A < B\nOne two bold next\nthree"),
        ("<article><p><b>bold.<br><p>b</p></article>", "bold.\nb"),
        ("<main><div>x<div>y</div>z</div></main>", "x\ny\nz"),
        ("<p>only body</p>text<span> here</span>", "only body\ntext here"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<article><header><h2>In</h2></header><p>p</p><div class='share-buttons'>tweet</div></article>", "In\np"),
        ("<article></article>", ""),
        ("<article><p>1 < 2 & 3 &#x41; &eacute;</article>", "1 < 2 & 3 A é"),
        ("<article><script>if (a<b) {}</script><p>s</p></article><article>t</article>", "s\nt"),
        ('<article data-x="a>b"><p title=\'"\'>q</article>', "q"),
    ],
)
def test_main_text(body, want):
    assert text(body) == want


def test_broken_markup():
    assert pages.main_text(pages.parse("<article>a</div>b</p>c <i>d"), set()) == "ab\nc d"
    assert pages.main_text(pages.parse("<p>a <!-- open"), set()) == "a"
    assert pages.main_text(pages.parse("<p>a<script>b"), set()) == "a"


def test_templates_of_a_host_are_cut(spark):
    rng, rows = random.Random(1), []
    for i in range(30):
        host = "a.example" if i < 20 else f"h{i % 3}.example"
        unique = " ".join(f"w{rng.randrange(10_000)}" for _ in range(30))
        body = f"<div class='box7'><p>Every page says so</p></div><article><p>{unique}</p><p>same words</p><div class='x1'>Read on!</div></article>"
        rows.append((i, f"http://user@{host.upper()}:80/{i}", PAGE % body, "extra"))
    rows += [(100 + i, "http://a.example/copy", rows[0][2], "extra") for i in range(40)]  # copies of a page
    rows += [(200, None, None, None), (201, "nonsense", "", ""), (202, "http://b.example", "<p>x" * 5000, ""), (None, "http://a.example/2", "plain", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(4)
    found = {r["page_id"]: r for r in pages.main_texts(df).collect()}
    assert len(found) == len(rows)
    lines = {i: found[i]["text"].split("\n") for i in found}
    assert all(lines[i][1:] == ["same words"] for i in range(20))
    assert all(lines[i][1:] == ["same words", "Read on!"] for i in range(20, 30))  # too few pages
    assert all(found[100 + i]["text"] == found[0]["text"] for i in range(40))
    assert found[200]["text"] == found[201]["text"] == "" and found[None]["text"] == "plain"
    assert len(lines[202]) == 5000
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert {r["url"] for r in found.values()} == {r[1] for r in rows}
    known = {r["host"]: r["templates"] for r in pages.templates(df.select("url", "html")).collect()}
    assert set(known) == {"a.example"}


def test_hash_depends_on_every_part():
    a = ["<p>x", "<p>y", "<div>x", "<p class=a>x", "<p><b>x", "<p>x<b>"]
    assert len({pages.hashed(r)[id(r)] for r in map(pages.parse, a)}) == len(a)
    same = [pages.parse(x) for x in ("<p>x  y</p>", "<p>x\ny", "<P >x y")]
    assert len({pages.hashed(r)[id(r)] for r in same}) == 1


def test_empty_table(spark):
    assert pages.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _searching_parse(page):
    """The tree as nested lists, by looking through all open elements at every tag."""
    root = ["", []]
    stack, at = [root], 0
    while found := pages._TOKEN.search(page, at):
        if page[at : found.start()]:
            stack[-1][1].append(page[at : found.start()])
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            same = [i for i, e in enumerate(stack) if i and e[0] == name]
            if same:
                del stack[same[-1] :]
            elif name == "p":
                stack[-1][1].append(["p", []])
            continue
        closed, scope = set(pages.CLOSES.get(name, ())), set(pages.SCOPES.get(name, ()))
        if name in pages.ENDS_P:
            closed, scope = closed | {"p"}, scope | {"td", "th", "table", "button"}
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in closed:
                del stack[i:]
            elif stack[i][0] in scope:
                break
        element = [name, []]
        stack[-1][1].append(element)
        if name not in pages.VOID and not found[3].endswith("/"):
            stack.append(element)
    if page[at:]:
        stack[-1][1].append(page[at:])
    return root


def _nested(element):
    return [element.name, [c if isinstance(c, str) else _nested(c) for c in element.children]]


def test_tag_soup_gives_the_tree_of_a_plain_search():
    rng = random.Random(11)
    names = ["p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "tbody", "dl", "dt", "dd", "b", "article", "button", "section", "option", "body", "head", "br"]
    for _ in range(400):
        soup = "".join(rng.choice([f"<{n}>", f"<{n}>", f"</{n}>", "x", f"<{n}/>"]) for n in rng.choices(names, k=60))
        assert _nested(pages.parse(soup)) == _searching_parse(soup)


@pytest.mark.parametrize("opening", ["<div>", "<div><p>", "<ul><li>", "<table><tr><td>", "<b>"])
def test_a_very_deep_page_takes_little_time(opening):
    start = time.perf_counter()
    page = "<article>" + opening * 60_000 + "deep</article><p>after"
    assert pages.main_text(pages.parse(page), set()).endswith("deep")
    assert time.perf_counter() - start < 20


def test_a_deep_page_in_spark(spark):
    rows = [(1, "http://a.b/c", "<article>" + "<div>" * 100_000 + "deep"), (2, None, None)]
    found = {r["page_id"]: r["text"] for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "deep", 2: ""}
