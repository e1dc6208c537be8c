"""Main text of pages: planted articles, hand-made pages, broken and hostile markup."""

import html as entities
import re
import time

import pytest

from foliant.llm import html
from foliant.llm import queries as registered

SF = "/root/testdata/sf0.001"
P = "<p>The first paragraph of the article has some words in it.</p><p>The second one, too, has words and says more.</p>"
T = "The first paragraph of the article has some words in it.\nThe second one, too, has words and says more."

KEPT = {
    "class with-sidebar": (f'<body><div class="site with-sidebar">{P}</div></body>', T),
    "class no-sidebar": (f'<body><div id="main" class="no-sidebar">{P}</div></body>', T),
    "class of a banner layout": (f'<body><div class="hero-banner-layout">{P}</div></body>', T),
    "class share-price-report": (f'<body><div class="share-price-report">{P}</div></body>', T),
    "page in one form": (f'<body><form action="x"><div>{P}</div><input name=a></form></body>', T),
    "page in one form, with menus": (
        f'<header>Site <a href=/>x</a></header><form id="f"><div class="menu"><a href=1>1</a></div><div>{P}</div></form>', T
    ),
    "label in a sentence": ("<p>Press the <label>Save</label> key to go on with it.</p>", "Press the Save key to go on with it."),
    "odd quote": ('<body><p class="x>Hello there, this is text.</p></body>', "Hello there, this is text."),
    "odd quote before another": (
        '<p class="x>Hello there, this is text.</p><p class="y">More text is here.</p>',
        "Hello there, this is text.\nMore text is here.",
    ),
    "article in two divs of a wrapper": (
        '<div class=w><div class="lead"><p>Lead text of it is here.</p></div><div class="rest"><p>The rest is here.</p></div></div>',
        "Lead text of it is here.\nThe rest is here.",
    ),
    "article in two sections of the body": (
        '<body><nav><a href=x>Home</a></nav><section class="lead"><p>Lead text.</p></section><section><p>The rest of it.</p></section>',
        "Lead text.\nThe rest of it.",
    ),
    "title above its article": (f'<body><h1>Title</h1><div class="c"><article>{P}</article></div></body>', "Title\n" + T),
    "title in the article's header": (
        f"<article><header><h1>Title</h1><div class=by>By me</div><p>A dek.</p></header>{P}</article>", "Title\nA dek.\n" + T
    ),
    "words in another attribute": (f'<article>{P}<p title="x hidden class=ad y > 3">seen text</p></article>', T + "\nseen text"),
    "unclosed elements": (f"<article>{P}<b>bold<br><p>more of it</article><footer>f</footer>", T + "\nbold\nmore of it"),
    "table layout": (f"<table><tr><td><a href=1>one</a><br><a href=2>two</a><td>{P}</table>", T),
    "signs and references": (
        "<p>1 < 2 and 3 <b>> 4</b> are numbers, AT&amp;T &lt;x&gt; &eacute;</p>", "1 < 2 and 3 > 4 are numbers, AT&T <x> é"
    ),
    "deep nesting": ("<div>" * 3000 + P + "</div>" * 3000, T),
    "white space": ("<pre>a\n  b\t c</pre>", "a b c"),
}
CUT = {
    "longer comments": (f'<article><h1>Title</h1><p>Short one.</p></article><div id="comments">{P * 5}</div>', "Title\nShort one."),
    "longer advert and footer": (
        f'<nav><ul><li><a href=a>A</a></ul></nav><div class="ad">Buy {P}</div><article><h1>Title</h1><p>W<footer>{P}</footer>',
        "Title\nW",
    ),
    "no article": ("<nav><ul><li><a href=a>A</a></ul></nav><footer>Copyright text of a site.</footer>", ""),
    "hidden text": (f'<article>{P}<p hidden>secret</p><div style="display:none">gone</div></article>', T),
    "form in an article": (f"<article>{P}<form><label>Name</label><input><p>Send us mail</p></form></article>", T),
    "site header": (f"<header><h1>Site</h1><nav><a href=x>y</a></nav></header><div>{P}</div>", T),
    "sidebar": (f'<div class="sidebar"><a href=1>one</a><p>about us text</p></div><div class="content">{P}</div>', T),
    "aside": (f"<article>{P}<aside><p>Aside text goes on here.</p></aside></article>", T),
    "notice": (f'<div class="cookie-notice"><p>We use cookies.</p></div><main>{P}</main>', T),
    "links to share": (f'<article>{P}<ul class="share-this-now"><li><a href=1>Mail</a></ul></article>', T),
    "scripts": (f'<article>{P}<script>var a = "<p>no</p>";</script><style>p{{}}</style></article>', T),
}


@pytest.mark.parametrize("name", [*KEPT])
def test_articles_stay(name):
    page, want = KEPT[name]
    assert html.page_text(page) == want


@pytest.mark.parametrize("name", [*CUT])
def test_what_is_no_article_goes(name):
    page, want = CUT[name]
    assert html.page_text(page) == want


@pytest.mark.parametrize(
    "unit",
    ["<a ", "<div>", '<x a=">" ', "<![CDATA[", "<!--", "</x>", "<div class=nav>", "<form>", '<p class="x>', "<title>", "<a href=x>",
     "<li>", "&amp", "<p a='", "<span><p></p>", "<b></i>", "<p><table><td><span>"],
)
def test_hostile_pages_take_linear_time(unit):
    """A page of 1 MB; a quadratic reader takes hours."""
    begun = time.process_time()
    html.page_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - begun < 20


def test_all_containers_vote_and_paths_keep_their_depth():
    page = "".join(f"<div class=c{chr(97 + k)}><p>words of part {k} here.</p></div>" for k in range(12))
    assert len(html.page_votes(f"<body>{page}</body>")) == 13
    deep = ["<div class=x>" * k + "<p>some words in it.</p>" for k in (250, 251)]
    assert html.page_votes(deep[0])[0][0] != html.page_votes(deep[1])[0][0]


def test_several_paths_of_a_host_win(spark):
    part = "<section class=a><p>first part {0} has these words.</p></section><nav>x</nav><section class=b><p>second part {0} too.</p></section>"
    pages = [(i, f"http://h/{i}", f"<body>{part.format(i)}</body>") for i in range(20)]
    got = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"first part {r['page_id']} has these words.\nsecond part {r['page_id']} too." for r in got) and len(got) == 20


def test_names_of_single_pages_do_not_win(spark):
    """Each page has classes of its own: no path of them wins, and what the pages share still does."""
    page = "<body class=post-{0}><div class=css-{0}><section class=shared><p>words of page {1} are here, and more.</p></section></div><nav>x</nav></body>"
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    pages = [(k, f"http://h/{k}", page.format(name(k), k)) for k in range(2000)]
    votes = [("h", html.EACH, 2000.0)]
    for _, _, p in pages:
        votes += [("h", path, share) for path, share in html.page_votes(p)]
    frame = spark.createDataFrame(votes, "host string, path string, votes double").groupBy("host", "path").agg({"votes": "sum"})
    (row,) = html.winning_paths(frame.toDF("host", "path", "votes")).collect() or [None]
    assert row is None or len(row["winners"]) < 50
    got = html.extract(spark.createDataFrame(pages[:200], "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"words of page {r['page_id']} are here, and more." for r in got) and len(got) == 200


def test_large_tables_take_linear_time():
    rows = "".join(f"<tr><td>Row {k} of the table says this.</td></tr>" for k in range(50_000))
    page = f"<body><table>{rows}</table></body>"
    winners = [*dict.fromkeys(path for path, _ in html.page_votes(page))]
    begun = time.process_time()
    read = html.Page(page)
    middle = time.process_time()
    text = read.text(winners[::-1])
    assert text.count("\n") == 49_999 and time.process_time() - middle < 2 and middle - begun < 20


def test_a_main_part_of_links_is_kept():
    items = "".join(f'<li><a href="/{k}">Source number {k}</a></li>' for k in range(5))
    page = f"<body><nav><a href=/>Home</a></nav><main><h1>Sources</h1><ul>{items}</ul></main><footer>f</footer></body>"
    assert html.page_text(page) == "Sources\n" + "\n".join(f"Source number {k}" for k in range(5))


def test_clashing_columns_nulls_and_repeated_rows(spark):
    rows = [(1, None, None, "w", 1), (2, "http://h/", "", "x", 2), (2, "http://h/", "", "x", 2), (None, "", f"<p>{'long ' * 40_000}</p>", "", 3)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, text int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 199_999), (1, 0), (2, 0), (2, 0)]
    assert all(len(r["text"]) == r["n_chars"] for r in got)


def planted(page):
    """The article by brute force: these pages have one article element of h1 and p."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = [re.sub(r"<br>", " ", p) for p in re.split(r"</?(?:h1|p)>", body)]
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_planted_articles_are_found_whole(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = registered.queries()["op4_html"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == planted(pages[r["page_id"]]["html"]) and r["url"] == pages[r["page_id"]]["url"]
