"""Page texts: known pages, alignment against a plain dynamic program, neighbours against brute force."""

import html
import random
import re

from sensorframe.llm import pages
from sensorframe.llm.html_lines import lines

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><header>Site</header><div id="cookie-notice">We use cookies</div>
<article><header><h1>Title&amp;more</h1></header><p><b>One   two<br>three<p>Fo<i>u</i>r &lt;b&gt;</p><div class="comments"><p>Nice!</p></div><p>Last</p></article>
<aside>Side</aside><form><p>Name</p></form><footer>&copy; x</footer></body></html>"""


def test_known_page():
    assert [x for x, p in lines(PAGE) if p == 1] == ["Title&more", "One two three", "Four <b>", "Last"]
    assert {x for x, p in lines(PAGE) if p == 2} == {"Home", "Buy", "Site", "We use cookies", "Nice!", "Side", "Name", "© x"}
    assert lines(None) == [] and lines("") == [] and lines("plain &amp; text") == [("plain & text", 0)]
    assert lines("<p>cut off <b") == [("cut off", 0)] and lines("a <script>var x = '<p>no</p>'") == [("a", 0)]


def test_names_of_ordinary_markup():
    def kept(page):
        return [x for x, p in lines(page) if p == 1]

    body = "<article><div class='entry-header'><h1>Title</h1></div><section id='social-history'><p>Past</p></section><h2 id='related-work'>Work</h2><div class='related'>Inner</div></article>"
    for around in ("{}", "<div class='layout has-sidebar'>{}</div>", "<div class='widget'><nav>Menu</nav>{}<p>After</p></div>", "<form>{}</form>"):
        assert kept(around.format(body)) == ["Title", "Past", "Work", "Inner"]
    assert lines("<div class='widget'><p>Before</p><nav>Menu</nav><article>Text</article></div><div class='x ad'>Buy</div>") == [("Before", 0), ("Menu", 2), ("Text", 1), ("Buy", 2)]
    assert lines("<article>Text<div class='comments'><article>Nice!</article></div></article>") == [("Text", 1), ("Nice!", 2)]


def test_no_text_is_lost_to_odd_markup():
    def kept(page, place=1):
        return [x for x, p in lines(page) if p == place]

    assert kept("<article><p title=it's>Hello</p><p>World</p><p>it's me</p></article>") == ["Hello", "World", "it's me"]
    assert kept('<article><p "odd>One</p><p title="a>b" data-x=\'c>d\'>Two</p><p title = "x>y" />Three</article>') == ["One", "Two", "Three"]
    assert kept("<article>1 < 2 and <3 <b>x</b></article>") == ["1 < 2 and <3 x"]
    assert kept('<p title="never closed>One</p><p>Two</p>', 0) == ["One", "Two"] and kept("<a <a text", 0) == ["<a"]
    assert kept("<article><b>x</b></ p></i>y<!-- gone > --><!doctype q>z</article>") == ["xyz"]


def test_adverts_and_comments_inside_articles():
    page = "<article><p class='ad'>A<p>One<ul><li class=advert>B<li>Two</ul><table><tr><td class='sidebar'>C<td>Three</table><div class='ad'>D</div><div class='newsletter'>E</div><ul id='comment-list'><li>F</ul><div class='user-comments'>G</div><p>Four</p></article>"
    assert [x for x, p in lines(page) if p == 1] == ["One", "Two", "Three", "Four"]
    assert [x for x, p in lines(page) if p == 2] == list("ABCDEFG")
    assert [x for x, p in lines("<p class='ad'>A</p><p>One</p><div><p class='ad'>B</div>Two") if p == 0] == ["One", "Two"]


def test_markup_of_any_size_is_read_in_one_pass():
    import time

    for page in ('<a "' * 750_000, "<a " * 1_000_000, "<div>x" * 200_000 + "</b>" * 300_000, "<nav>" * 300_000 + "<article>x", "<p class='ad'>" * 200_000, "<!--" * 700_000, '<p a="' * 400_000, "<p a = " * 400_000, "<script>" * 300_000, "</" * 1_000_000):
        begin = time.time()
        lines(page)
        assert time.time() - begin < 5, page[:20]


def test_common_is_a_longest_subsequence():
    pick = random.Random(3)
    for _ in range(400):
        a, b = ([pick.choice("abcd") for _ in range(pick.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        shared = [x for x, s in zip(a, pages.common(a, b)) if s]
        rest = iter(b)
        assert len(shared) == table[-1][-1] and all(x in rest for x in shared)


def test_long_pages_stay_fast():
    a = [f"line {i % 3000}" for i in range(6000)]
    assert sum(pages.common(a, a)) == 6000


def test_against_neighbours_in_order(spark):
    """Pages without article elements: lines shared with a neighbour go, the rest stays."""
    rows = []
    for h in range(4):
        for n in range(25):
            own = [f"h{h} page {n} par {k}" for k in range(n % 4 + 1)]
            rows.append((h * 100 + n, f"https://H{h}.example.org/a/{n}?q=1#top", f"<div>Menu of {h}</div>" + "".join(f"<p>{x}</p>" for x in own) + f"<div>Foot of {h}</div>", own))
    rows += [(900, None, None, []), (901, "https://alone.example.org/x", "<div>Only</div><p>page</p>", ["Only", "page"]), (None, "", "", []), (903, "https://copy.example.org/1", "<p>same</p><p>text</p>", ["same", "text"]), (904, "https://copy.example.org/2", "<p>same</p><p>text</p>", ["same", "text"])]
    df = spark.createDataFrame([(*r[:3], "clash", 1) for r in rows], "page_id bigint, url string, html string, text string, uid int").repartition(5)
    got = {r.page_id: r for r in pages.extract(df).collect()}
    assert len(got) == len(rows)
    for i, url, _, own in rows:
        assert got[i].text == "\n\n".join(own) and got[i].n_chars == len(got[i].text) and got[i].url == url
    assert pages.extract(df.limit(0)).count() == 0


def test_copies_get_the_same_text(spark):
    """A run of equal pages between others: all lose what the pages beside the run have too."""
    def page(own):
        return f"<div>Menu</div><p>{own}</p><div>Foot</div>"

    rows = [(0, "https://x.org/a/0", page("first"), "first")] + [(i, f"https://x.org/a/{5 if i < 6 else i}?v={i}", page("copied"), "copied") for i in range(1, 40)]
    rows += [(50, "https://x.org/a/50", page("last"), "last"), (60, "https://y.org/1", page("alone"), "Menu\n\nalone\n\nFoot")]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").repartition(4)).collect()}
    assert got == {i: t for i, _, _, t in rows}


def test_template_inside_articles(spark):
    """A line of all articles of a host goes, one that some of them quote stays, and copied articles stay whole."""
    def page(own, quote=""):
        return f"<article><h1>Title of {own}</h1><p>Text of {own}</p>{quote}<p>Share this</p></article>"

    rows = [(i, f"https://x.org/a/{i}", page(i, "<p>Quoted by three</p>" if i in (3, 4, 5) else ""), f"Title of {i}\n\nText of {i}" + ("\n\nQuoted by three" if i in (3, 4, 5) else "")) for i in range(10)]
    long = "<p>" + "a copied article " * 20 + "</p>"
    rows += [(20 + i, f"https://y.org/{i}", f"<article>{long}<p>Copy {i}</p></article>", "a copied article " * 19 + f"a copied article\n\nCopy {i}") for i in range(6)]
    rows += [(30 + i, f"https://z.org/{i}", page(i), f"Title of {i}\n\nText of {i}\n\nShare this") for i in range(2)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").repartition(4)).collect()}
    assert got == {i: t for i, _, _, t in rows}


def test_given_pages(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in pages.extract(given.union(given.limit(3))).collect()}
    for r in given.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n\n".join(x for x in blocks if x)


def test_hosts_and_paths():
    assert pages.host_and_path("HTTP://u@WWW.x.org:80/a/12.html?b#c") == ("www.x.org", "/a/000212")
    assert pages.host_and_path("https://x.org/a/9/") < pages.host_and_path("https://x.org/a/10#top")
    assert pages.host_and_path(None) == ("", "") and pages.host_and_path("just text?x") == ("", "just text")
