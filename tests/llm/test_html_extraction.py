import html
import re
import time

from lakeloom.llm.html_extraction import extract, main_text, smooth, threshold

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, and we ask you to accept them all today.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   long paragraph of the
article &eacute; with <b>bold</b> words and plenty of text.</p><p>Short.<p>Third one, unclosed, also with plenty of text to read here.
<div class="ad">Buy now, a long advert text that goes on and on.</div><blockquote>Quoted words stay in.</blockquote>
<form><input><button>Send</button>Form text</form></article></main>
<aside>Side text that is long enough to look like an article of its own.</aside>
<section id="comments"><p>A reader writes a very long comment about all of this and more.</p></section>
<footer>&copy; 2024</footer></body></html>"""


def test_page():
    assert main_text(PAGE).split("\n") == ["Title & more", "First long paragraph of the article é with bold words and plenty of text.", "Short.", "Third one, unclosed, also with plenty of text to read here.", "Quoted words stay in."]


def test_no_article_element():
    page = "<div><div class=menu><a>x</a></div><div id=c><p>" + "Long text of the page. " * 5 + "</p><p>Short</p><p>" + "More text of it. " * 9 + "</p></div><ul><li><a>l1</a><li><a>l2</a><li><a>l3</a></ul></div>"
    assert [x[:5] for x in main_text(page).split("\n")] == ["Long ", "Short", "More "]


def test_cut_off_and_odd():
    assert main_text(None) == main_text("") == main_text("<nav>x") == main_text("<script>x") == ""
    assert main_text("plain words") == "plain words"
    assert main_text("<p>a<br>b&nbsp;c &#233;&lt;") == "a b c é<"
    assert main_text("<article><p>a</p></article") == "a"
    assert threshold(smooth(__import__("numpy").array([5.0]))) == 5.0


def test_table_matches_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def plain(page):
        body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        return "\n".join(b for b in blocks if b)

    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html)) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(1, "u", None, "x"), (1, None, "", "x"), (None, "u", "<p>y" * 20_000, "x")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in extract(odd).collect()) == [0, 0, 39_999]
    assert extract(odd.limit(0)).count() == 0


def test_whole_article():
    long = "<p>" + "Long text of the page with many words. " * 6 + "</p>"
    lead = main_text(f"<article><h1>Title</h1><p>lead</p><div class=body>{long * 20}</div></article>").split("\n")
    assert lead[:2] == ["Title", "lead"] and len(lead) == 22
    links = "<p><a href=x>one</a> <a href=y>two</a> <a href=z>three</a></p>"
    assert len(main_text(f"<body><article><section>{long * 9}</section><section>{links * 12}</section></article></body>").split("\n")) == 21
    for wrap in ("<div id=content class='with-sidebar'>", "<div class='no-comments'>", "<div class='sidebar'>"):
        assert len(main_text(f"<body>{wrap}<article>{long * 3}</article></div></body>").split("\n")) == 3
    assert len(main_text(f"<article>{long * 3}<section id='related-work'>{long}</section><div class=related>{long}</div></article>").split("\n")) == 4
    assert len(main_text(f"<head><title>T</title><body>{long * 3}").split("\n")) == 3


def test_time_grows_with_the_page_only():
    began = time.monotonic()
    assert main_text("<div>a" * 100_000).count("a") == 100_000
    assert main_text("<b>" * 50_000 + "<p>a</p>" * 50_000).count("a") == 50_000
    assert main_text("<div>" * 50_000 + "</x>" * 50_000 + "end") == "end"
    assert main_text("<article>" * 20_000 + "<header>h</header>" * 20_000).count("h") == 20_000
    assert len(main_text("word " * 2_000_000)) == 9_999_999
    assert time.monotonic() - began < 30


LONG = "<p>" + "Long text of the page with many words in it. " * 6 + "</p>"
LAYOUTS = {
    "entry": "<article><h1>Title</h1><p>lead</p><div class='entry-content'>{body}</div><p>closing</p></article>",
    "sections": "<article><section><p>one</p></section><section>{body}</section><section><p>three</p></section></article>",
    "notice": "<div class='page'><article class='notice-board'><h1>Title</h1>{body}</article></div>",
    "comment": "<main><div class='comment'><h2>Title</h2>{body}</div></main><div class='comments'>{long}</div>",
    "bare": "<div id='wrap'><div class='menu'><a href=x>m</a></div><div><h1>Title</h1>{body}</div><div class='footer'>f</div></div>",
    "table": "<table><tr><td class='sidebar'><a href=x>m</a><td><h1>Title</h1>{body}</table>",
}


def test_layouts():
    edges = {"entry": (["Title", "lead"], ["closing"]), "sections": (["one"], ["three"])}
    for name, layout in LAYOUTS.items():
        got = main_text("<html><head><title>T</title></head><body><nav><a href=x>n</a></nav>" + layout.replace("{body}", LONG * 6).replace("{long}", LONG) + "<footer>f</footer></body></html>").split("\n")
        first, last = edges.get(name, (["Title"], []))
        assert got == [*first, *[re.sub("<[^>]+>", "", LONG).strip()] * 6, *last], name


P = "<p>Words of the article that run on for a while, as text does, and end here.</p>"
WORD = re.sub("<[^>]+>", "", P)


def test_structure_decides_which_words_count():
    comment = "<p>" + "A reader's opinion at great length about nothing at all. " * 9 + "</p>"
    assert main_text(f"<body><div class=post><h1>Title</h1>{P}</div><div id=comments>{comment * 9}</div></body>") == f"Title\n{WORD}"
    assert main_text(f"<body><article><h1>Title</h1>{P}<div id=comments>{comment * 9}</div></article></body>") == f"Title\n{WORD}"
    assert main_text(f"<body><article>{P}</article><section id=responses>{comment * 9}</section></body>") == WORD
    assert main_text(f"<body><form id=aspnetForm><div class=menu><a href=x>m</a></div><h1>Title</h1>{P * 3}<input></form></body>") == "\n".join(["Title", *[WORD] * 3])
    assert main_text(f"<body><form><h2>Title</h2>{P * 3}<input></form></body>") == "\n".join(["Title", *[WORD] * 3])
    assert main_text(f"<article>{P}<form><h3>Sign in</h3><p>Name</p><input><input></form></article>") == WORD
    assert main_text(f"<article><div class='content notice-board'>{P * 4}</div><p>End</p></article>") == "\n".join([*[WORD] * 4, "End"])
    assert main_text(f"<article>{P}<div class='social-history'>{P}</div><div class='social-share'>{P}</div>{P}</article>") == "\n".join([WORD] * 3)
    assert main_text(f"<article><div class='widget'>{P * 4}</div><p>End</p></article>") == "\n".join([*[WORD] * 4, "End"])
    assert main_text(f"<body><div class='promo'>{P * 2}</div></body>") == "\n".join([WORD] * 2)  # nothing else is there
    assert main_text(f"<body><div class='comments'>{P * 2}</div></body>") == ""


def test_region_climbs_and_keeps_neighbours():
    assert main_text(f"<div id=page><h1>Title</h1><div class=entry>{P * 6}</div></div>") == "\n".join(["Title", *[WORD] * 6])
    assert main_text(f"<div><h1>Title</h1><p>Lead</p><div>{P * 6}</div><p>Closing</p></div><ul><li><a href=x>l</a></ul>").split("\n") == ["Title", "Lead", *[WORD] * 6, "Closing"]
    assert main_text(f"<main><article>{P * 6}</article><article><h2>Next</h2><p>Short.</p></article></main>").split("\n") == [*[WORD] * 6, "Next", "Short."]
    assert main_text(f"<div><article>{P * 6}</article><article><p>Short.</p></article><ul><li><a href=x>l</a></ul></div>").split("\n") == [*[WORD] * 6, "Short."]


TEMPLATES = {
    "blog": "<body class='single'><div id='page' class='site'><header id='masthead'><h1 class='site-title'>Site</h1></header><div id='content'><div id='primary'><main id='main'><article id='post-1'><header class='entry-header'><h1>{title}</h1></header><div class='entry-content'>{body}</div><footer class='entry-footer'>Posted in x</footer></article>"
    "<div id='comments' class='comments-area'><ol class='comment-list'><li class='comment'><article class='comment-body'><p>{other}</p></article></li></ol><div id='respond' class='comment-respond'><form><p>{other}</p></form></div></div></main></div><aside id='secondary' class='widget-area'><p>{other}</p></aside></div><footer id='colophon'>f</footer></div></body>",
    "portal": "<body><form method=post id=form1><div id=header><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><table><tr><td class=leftNav><a href=c>Three</a></td><td id=contentCell><h1>{title}</h1>{body}</td><td class=sidebar><p>{other}</p></td></tr></table><div id=footer>f</div><input type=hidden></form></body>",
    "plain": "<body><div class='nav-bar'><a href=a>One</a> | <a href=b>Two</a></div><h1>{title}</h1>{body}<div class='advert'><p>{other}</p></div><div class='page-footer'>f</div></body>",
}


def test_templates(spark):
    rows, want = [], {}
    for i, (name, page) in enumerate(TEMPLATES.items()):
        for j, n in enumerate((1, 2, 7, 40)):
            body = "".join(f"<p>Paragraph {k} &amp; its words, {'long ' * (k % 5 * 7)}told.</p>" if k % 6 else "<h2>Part</h2><ul><li>point</ul>" for k in range(1, n + 1))
            rows.append((i * 10 + j, name, page.replace("{title}", f"Title {j}").replace("{body}", body).replace("{other}", "Other words that are long enough for a block. " * 12), 1))
            lines = [x for k in range(1, n + 1) for x in ([" ".join(f"Paragraph {k} & its words, {'long ' * (k % 5 * 7)}told.".split())] if k % 6 else ["Part", "point"])]
            want[i * 10 + j] = "\n".join([f"Title {j}", *lines])
    got = {r.page_id: (r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}
