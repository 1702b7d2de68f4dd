from bazaar.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav><!-- ad -->
<div class="ad">Buy now, this advert is long enough to look like text, really it is.</div><div id="cookie-notice">We use cookies.</div>
<div class="layout">%s<div class="sidebar">More to read <a href=/c>one</a> <a href=/d>two</a></div></div>
<div class="comments"><p>First! I like this article so much that I write a long comment about it, on and on.</p></div>
<form><label>Mail</label><input name=m><button>Send</button></form><footer>&copy; 2024 Site</footer></body></html>"""
BODY = """<%s><h1>A &lt;title&gt;</h1><p>First para with <b>bold</b>, <a href=/x>a link</a>
and   white&nbsp;space that goes on for a while.<p>Second <i>para</i>, unclosed, also with quite a few words in it.<br>Broken line
<ul><li>item one</li><li>item two</ul><script>track(1)</script></%s>"""
WANT = ("A <title>\nFirst para with bold, a link and white space that goes on for a while.\n"
        "Second para, unclosed, also with quite a few words in it.\nBroken line\nitem one\nitem two")


def test_article_main_and_plain_div_give_the_same_text():
    for tag in ("article", "main", "div"):
        assert H.extract(PAGE % (BODY % (tag, tag))) == WANT, tag


def test_odd_pages():
    assert H.extract(None) == H.extract("") == H.extract("<html></html>") == H.extract("<script>x</script>") == ""
    assert H.extract("just text &amp; more") == "just text & more"
    assert H.extract("<p>one<p>two") == "one\ntwo"
    assert H.extract("<body><article><p><b>open<br><p>next one</article><footer>f</footer>") == "open\nnext one"
    assert H.extract("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    long = "<article><p>" + "word " * 200000 + "</p></article>"
    assert len(H.extract(long)) == 5 * 200000 - 1
    assert H.extract("<article><p>cut off in the mid<b") == "cut off in the mid"


def test_short_article_beside_long_boilerplate():
    page = PAGE % "<article><h1>Tiny</h1><p>Short.</p></article>"
    assert H.extract(page) == "Tiny\nShort."


def test_query_shape(spark):
    df = spark.createDataFrame([(1, "u", PAGE % (BODY % ("article", "article"))), (2, None, None), (None, "v", "")],
                               "page_id long, url string, html string")
    rows = {r.page_id: r for r in df.select("page_id", H.main_text(df.html).alias("text")).collect()}
    assert rows[1].text == WANT and rows[2].text == "" and rows[None].text == ""


def test_titles_in_article_headers_and_unnamed_layouts():
    body = "<p>" + "plain words of the article go on and on " * 6 + "</p>"
    want = "Title\n" + ("plain words of the article go on and on " * 6).strip()
    for head in ("<header><h1>Title</h1><span>By me, today</span></header>", "<div class='post-header'><h1>Title</h1><i>today</i></div>",
                 "<h1 class=header>Title</h1>"):
        assert H.extract(f"<body><article>{head}{body}<ul class=commentlist><li>a comment</li></ul></article></body>") == want, head


def test_heads_without_an_end_tag():
    body = "<article><h1>Title</h1><p>some words here</p></article>"
    for head in ("<html><head><title>t</title><body>", "<head><meta charset=utf-8><title>t</title>", "<head><style>p{}</style>", "<head></head><body>", ""):
        assert H.extract(head + body) == "Title\nsome words here", head
    assert H.extract("<head><title>t</title>plain words") == "plain words"


def test_several_articles_and_headings_come_in_page_order():
    one, two = "first article text with some words", "second article text with some words"
    assert H.extract(f"<body><article><p>{one}</p></article><article><p>{two}</p></article></body>") == one + "\n" + two
    assert H.extract(f"<article><header><h1>First</h1><h2>Second</h2></header><p>{one}</p></article>") == f"First\nSecond\n{one}"
    lead = "Lead paragraph beside the article, a full sentence."
    text = ("words of the article " * 9).strip()
    assert H.extract(f"<body><div><h1>Head line</h1><p>{lead}</p><article><p>{text}</p></article></div><nav><a href=x>menu</a></nav></body>") == \
        f"Head line\n{lead}\n{text}"


def test_densities_of_a_small_page_by_hand():
    root = H.parse("<body><div><p>aaaa <a href=x>bb</a></p><p>cccccc</p></div></body>")
    H.measure(root)
    body = root.items[0]
    div = body.items[0]
    first, second = div.items
    import math
    # p with a link: 6 characters (text pieces counted without outer blanks), one tag, 2 link characters, one link tag
    assert (first.chars, first.tags, first.link_chars, first.link_tags) == (6, 1, 2, 1)
    assert (div.chars, div.tags, div.link_chars, div.link_tags) == (12, 3, 2, 1)
    base = math.log(6 / 4 * 2 + 2 / 12 * 6 + math.e)
    assert abs(first.density - 6 / 1 * math.log(6 / 2 * 1 / 1) / math.log(base)) < 1e-9
    assert second.tags == 0 and abs(div.total - (first.density + second.density)) < 1e-9


def test_empty_table_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>")], "page_id long, url string, html string").selectExpr("*", "1 as parts", "2 as s")
    assert [r.text for r in df.select(H.main_text(df.html).alias("text")).collect()] == ["x", "x"]
    assert df.limit(0).select(H.main_text(df.html).alias("text")).count() == 0
