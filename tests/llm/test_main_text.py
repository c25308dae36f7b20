import html
from html.parser import HTMLParser

from nodeloom.llm import main_text as mt
from nodeloom.llm.main_text import main_text

LONG = "This sentence is long enough to weigh in a window of lines, as sentences of an article are."
MORE = "Another sentence of the article, which goes on for a while so that it has some weight too."


class Article(HTMLParser):
    """The text of ``article`` by blocks, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.held = 0, [], []
        self.feed(page)
        self.end()

    def end(self):
        text = " ".join("".join(self.held).split())
        self.out += [text] if text else []
        self.held = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "article"):
            self.end()
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.end()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.held.append(data)


def test_all_pages_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in mt.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == "\n".join(Article(r.html or "").out) and got[r.page_id].url == r.url


def test_parts_that_are_not_main_text():
    article = f"<article><header><h1>Title &amp; more</h1></header><p>{LONG}</p><p>Short.</p><aside>See also</aside><ul><li>first <a href=x>point</a><li>second</ul><div class='ad-slot'>Buy!</div><p>{MORE}</p><section id='comments'><p>{LONG} says a reader</p></section></article>"
    frame = f"<html><head><title>T</title><style>p {{}}</style></head><body class='has-sidebar'><header><a href=/>Home</a> Site</header><nav><ul><li>A<li>B</ul></nav><div class='cookie-notice'>{LONG}</div><main>{article}<form><p>Subscribe {LONG}</p></form></main><div id=sidebar><p>{LONG} {LONG}</p></div><script>if (a < b) document.write('<p>x</p>')</script><footer>&copy; us</footer></body></html>"
    assert main_text(frame) == f"Title & more\n{LONG}\nShort.\nfirst point\nsecond\n{MORE}"


def test_without_an_article():
    body = f"<h2>Heading</h2><p>{LONG}</p><p>Brief.</p><p>{MORE} {MORE}</p><p>End.</p>"
    page = f"<body><div class=top><div>Home</div><div>News</div><div><a href=a>{LONG}</a></div></div><div id=story>{body}</div><div><a href=b>one</a></div><div>tiny</div></body>"
    assert main_text(page) == f"Heading\n{LONG}\nBrief.\n{MORE} {MORE}\nEnd."


def test_the_heaviest_article():
    card = "<article class=card><h3>Teaser</h3><p>Few words.</p></article>"
    assert main_text(f"{card}<article><h1>It</h1><p>{LONG}</p></article>{card}") == f"It\n{LONG}"
    assert main_text(f"<main>{card}<article><p>{LONG}</p></article>{card}</main>") == LONG
    assert main_text(f"<article><p>{LONG}</p><article class=comment><p>{LONG} {LONG}</p></article></article>") == LONG
    assert main_text("<article><h1>Tiny</h1><p>One.</p></article>") == "Tiny\nOne."


def test_broken_markup():
    assert main_text(f"<article><p><b>{LONG}<br><p>next<p>third</article><footer>x") == f"{LONG}\nnext\nthird"
    assert main_text(f"<article><p>{LONG}</p><script>var a = '<p>never") == LONG
    assert main_text(f"<article><p>{LONG}</p><!-- open <p>never</p>") == LONG
    assert main_text(f"<article><p>{LONG}</p><a href='never") == LONG
    assert main_text(f"<article><p>1 < 2 and 3 > 2; {LONG}</p></article>") == f"1 < 2 and 3 > 2; {LONG}"
    assert main_text(f"<ARTICLE><P title='a > b'>{LONG}</P><div>y<span class=ad>ad <span>more</span> ad</span> z</div></ARTICLE>") == f"{LONG}\ny z"
    assert main_text(f"<article><p>x<div class=ad>bad<p>worse</div>{LONG}</article>") == f"x\n{LONG}"


def test_characters_and_white_space():
    assert main_text(f"<article><p>\n a&nbsp;&eacute;&#233;&#x4e16;\t&amp;lt; <i>b</i>c\r\n{LONG}</p><p>d<br>e<br><br>f</p></article>") == f"a éé世 &lt; bc {LONG}\nd e\nf"
    assert html.unescape("&amp;lt;") == "&lt;"


def test_long_tags():
    for attribute in ("src=" + "A" * 400_000, f'src="{"A" * 400_000}"', " ".join(f"a{i}=b" for i in range(20_000)), f"alt='{'<p>' * 50_000}'"):
        assert main_text(f"<article><img {attribute}><p>{LONG}</p></article>") == LONG


def test_windows_and_runs():
    assert mt.windows([1, 2, 3, 4], 3) == [6, 9, 7, 4] and mt.windows([], 3) == []
    assert mt.runs([0, 100, 0, 90, 0, 0, 0, 0, 100]) == [(1, 4), (8, 9)]
    assert mt.runs([]) == [] and mt.runs([0, 0]) == []


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, name string"
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "no markup"), (4, "u", "<article></article>"), (5, "u", long), (6, "u", f"<p>{LONG}</p>"), (6, "u", f"<p>{LONG}</p>")]
    df = spark.createDataFrame([(*r, "clash", 7, "x") for r in rows], schema)
    got = sorted(((r.page_id, r.url, r.text) for r in mt.extract(df).collect()), key=str)
    want = [(1, "u", ""), (2, None, ""), (None, "u", "no markup"), (4, "u", ""), (5, "u", "\n".join([LONG] * 20_000)), (6, "u", LONG), (6, "u", LONG)]
    assert got == sorted(want, key=str)
    assert mt.extract(df.limit(0)).count() == 0
