import random

import pytest

from burstlens.llm import page_text


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("cells", [1 << 28, 8])
def test_alignment_is_longest(monkeypatch, cells):
    monkeypatch.setattr(page_text, "ALIGN_CELLS", cells)
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        p = page_text.common_lines(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:])) and len(p) == longest(a, b)


def text_of(html):
    found = page_text.lines_of(html)
    return page_text.main_text([z for z, _ in found], [x for _, x in found], set())


def test_markup():
    assert text_of(None) == text_of("") == ""
    assert text_of("<article><h1>T &amp; x</h1><p>a<b>b</b> c<br>d\n e<p>f<aside>no</aside><div class='user-comments'><p>no</div>g</article><footer>no</footer>") == "T & x ab c d e f g"
    assert text_of("<nav>no</nav><div id=sidebar>no<div>no</div></div><p>yes &lt;b&gt;</p><form>no</form><script>if(a<b)'</p>'</script><style>no</style>") == "yes <b>"
    assert text_of("<main><header><h1>Title</h1></header>x</main><p>outside") == "Title x"
    assert text_of("<p>open <!-- never ends") == "open" and text_of("a<script>never ends") == "a"
    assert text_of("<p title='a>b'>x</p><p class=\"cookie-notice\">no</p><p>y") == "x y"
    assert text_of("<b>" * 20_000 + "x" + "</i>" * 20_000) == "x"


def restated(pages):
    """Neighbours by sorting each host whole."""
    rows = sorted(pages, key=lambda p: (p[1], p[2], p[0]))
    found = [[x for _, x in page_text.lines_of(p[3])] for p in rows]
    out = []
    for i, p in enumerate(rows):
        gone = set()
        for j in (i - 1, i + 1):
            if 0 <= j < len(rows) and rows[j][1] == p[1] and found[j] != found[i]:
                gone |= {a for a, _ in page_text.common_lines(found[i], found[j])}
        z = page_text.lines_of(p[3])
        out.append((p[0], page_text.main_text([x for x, _ in z], [x for _, x in z], gone)))
    return out


@pytest.mark.parametrize("size", [2_000, 3])
def test_differencing(spark, monkeypatch, size):
    monkeypatch.setattr(page_text, "SLICE_PAGES", size)
    r = random.Random(5)
    pages = []
    for i in range(60):
        host = f"h{min(r.randrange(6), 2)}.org"
        pages.append((i, host, f"/p/{r.randrange(40)}", f"<div>Site {host}</div><div>menu a</div><p>text {r.randrange(30)}</p><p>more {i}</p><div>end of {host}</div>"))
    rows = [(i, f"http://{h}{p}", t, "x", "y") for i, h, p, t in pages] + [(100, None, "<p>alone</p>", "x", "y"), (101, "http://one.org/", None, "x", "y")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, lines string, own string").repartition(3)
    got = {r.page_id: r.text for r in page_text.extract(table).collect()}
    assert len(got) == 62 and got[100] == "alone" and got[101] == ""
    assert {k: v for k, v in got.items() if k < 100} == dict(restated(pages))
    assert page_text.extract(table.limit(0)).count() == 0


def whole(spark, bodies):
    """Texts of pages of one host, in url order."""
    rows = [(i, f"http://a.org/{i:02}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [t for _, t in sorted((r.page_id, r.text) for r in got)]


def test_differencing_counts_on_marked_pages(spark):
    boiler = whole(spark, [f"<main><p>Support our work today</p><p>Story {i} as it was told</p><p>Read more below</p></main>" for i in range(3)])
    assert boiler == [f"Story {i} as it was told" for i in range(3)]
    cards = "".join(f"<article><h2>Card {k}</h2><p>teaser {k}</p></article>" for k in range(5))
    teased = whole(spark, [f"<div>Site</div><div><p>{f'Main text of {i}. ' * 2}</p></div>{cards}" for i in range(3)])
    assert teased == [" ".join(f"Main text of {i}. Main text of {i}.".split()) for i in range(3)]
    copies = whole(spark, [f"<p>Page {i}</p><article><p>The very same story</p><p>told twice</p></article>" for i in range(2)])
    assert copies == ["The very same story told twice"] * 2
    alone = whole(spark, [f"<p>{'Own text ' * 9}</p><article>card one</article><article>card two</article>"])
    assert alone == ["Own text " * 9 + "card one card two"]
    assert text_of("<article>One</article><article>Two</article><p>ad") == "One Two"


def test_wrappers_hold_the_article():
    for wrapped in ("<div class='content-sidebar-wrap'><main>{}</main><div class=sidebar>no</div></div>", "<div class='has-sidebar'><article>{}</article></div>",
                    "<article class='post comments-open'>{}</article>", "<div id='search-results'><nav>no</nav><article>{}</article></div>",
                    "<main class='widget'><article class='related-post'>{}</article></main>", "<div class='has-sidebar'><p>{}</p></div>",
                    "<main><div class='content-sidebar-wrap'><article>{}</article><p>no</p></div></main>"):
        assert text_of("<header>no</header>" + wrapped.format("<p>the whole</p><p>story</p>") + "<footer>no</footer>") == "the whole story", wrapped
    story = "<article><p>the whole story of it</p><div class='ad'>no</div></article>"
    assert text_of(story + "<div id=comments><article class=comment>a comment</article></div>") == "the whole story of it"
    assert text_of("<div class='has-sidebar' hidden><article>no</article></div><aside class=ad><article>no</article></aside><p>yes") == "yes"
    assert text_of("<p>yes</p><div class=ad>no</div>") == "yes"
    assert text_of("<p>the text</p><div id=comments><article class=comment>first</article></div>") == "the text"
    cards = "".join(f"<article>card {k}</article>" for k in range(5))
    assert text_of(f"<div class='has-sidebar'>{story}</div>{cards}").startswith("the whole story of it")


def test_comments_go_however_long(spark):
    long = "".join(f"<article class='comment even' id=comment-{k}><p>{'a long opinion of a reader ' * 20}</p></article>" for k in range(30))
    post = "<article class='post comments-open'><p>a short post</p></article>"
    for area in ("<div id=comments class='comments-area'>{}</div>", "<section class='comment-list'>{}</section>", "<div class=has-sidebar>{}</div>", "<ol class=commentlist><li>{}</ol>", "{}"):
        assert text_of(f"<header>no</header>{post}{area.format(long)}<footer>no</footer>") == "a short post", area
        assert text_of(f"<div class='has-sidebar'>{post}</div>{area.format(long)}") == "a short post", area
    assert text_of("<body class='comments'><main class='comments'><p>kept") == "kept"


@pytest.mark.parametrize("n", [20, 300])
def test_any_number_of_teasers(spark, n):
    cards = "".join(f"<article><h2>Card {k}</h2></article>" for k in range(n))
    text = "The one main text of this page, longer than any card"
    assert text_of(f"<div><p>{text}</p></div>{cards}") == " ".join([text, *[f"Card {k}" for k in range(n)]])
    held = "".join(f"<article>h{k}</article>" for k in range(n))
    assert text_of(f"<p>{text}</p><div class=has-sidebar>{held}</div>") == text
    assert whole(spark, [f"<div><p>{text} {i}</p></div>{cards}" for i in range(3)]) == [f"{text} {i}" for i in range(3)]
