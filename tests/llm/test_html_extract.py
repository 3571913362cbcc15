from folio.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:"</p>"}</style><script>var t="</p><article>";</script></head>
<body><header>Site</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
<article><h1>Head&amp;line</h1><p><b>Bold<br>next
  line &lt;b&gt; caf&eacute;&#33;&nbsp;x<p>un<i>brok</i>en a < b<aside>side</aside><form><p>mail</p></form>
<div class="cookie-notice">accept</div><section id="comments"><article class="comment"><p>first!</p></article></section><p data-x="a > b">last</p></article>
<footer>&copy; me</footer></body></html>"""


def text(page):
    return " ".join(t for k, t in h.blocks_of(page) if k == h.IN)


def test_structure():
    assert text(PAGE) == "Head&line Bold next line <b> café! x unbroken a < b last"
    assert text("<article>a<script>x") == "a"
    assert text("<article>a<!-- b") == "a"
    assert text("<ARTICLE CLASS='post has-sidebar'>a<NAV>b</NAV>c</ARTICLE>d") == "a c"
    assert text("<main><div role=navigation>n</div><p style='display: none'>h</p><p>k</main>") == "k"
    assert text("<article><div class=comments><div>x</div>y</div>z") == "z"
    assert text("<article><p class='notice'>n<p>a<ul><li class=ad>x<li>b</ul><div class='post-comments'>c</div><div class='article-header'><h1>t</h1></div></article>") == "a b t"
    assert text("<article>a<div class='cookie-consent has-x'>n<p>m</div>b</article>") == "a b"
    assert h.blocks_of("") == [] and h.blocks_of("plain <b>te</b>xt") == [(h.OPEN, "plain text")]


def test_repeated_across_pages(spark):
    bar = "Subscribe to this very fine site for much more of the same every day"
    rows = [(i, f"http://h/{i}", f"<div>{bar}</div><p>{chr(97 + i) * 60} own words of page {i}</p>") for i in range(6)]
    rows += [(10, "http://other/1", f"<p>{bar}</p>"), (11, None, None), (12, "http://h/12", PAGE), (12, "http://h/12", PAGE), (13, "u", "")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, texts string")
    got = {r.page_id: r for r in h.main_texts(pages).collect()}
    assert all(got[i].text == f"{chr(97 + i) * 60} own words of page {i}" for i in range(6))
    assert got[10].text == bar and got[11].text == "" and got[11].n_chars == 0 and got[13].text == ""
    assert got[12].text == text(PAGE) and got[12].n_chars == len(text(PAGE))
    assert h.main_texts(pages).count() == len(rows)
    assert h.main_texts(pages.limit(0)).count() == 0
