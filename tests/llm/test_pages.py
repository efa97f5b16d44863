"""Main text of pages: probes of one page, of the tree, and a second reading of the tables' pages by another parser."""

import html.parser
import random

import pytest

from tidemark.llm import html_extract

SF = "/root/testdata/sf0.001"
LONG = "The real text of the page goes on for many words, as texts do."


@pytest.mark.parametrize(
    "source,text",
    [
        ("İ" * 30 + "<script>x()</script><p>Hello world after script stays</p>", "İ" * 30 + "\n\nHello world after script stays"),
        ("<SCRIPT>a</scripty>b</SCRIPT ><p>c</p>", "c"),
        ("<style>a</ſtyle>b</STYLE><p>c</p>", "c"),
        ("<p>a</p><script>cut off", "a"),
        (f"<div class=content><p>{LONG}</p></div><article class=teaser>Read more</article>", f"{LONG}\n\nRead more"),
        (f"<div>Also</div><article><p>{LONG}</p></article><div>here</div>", LONG),
        ("<article><p class=social>Social life.</p><section class=related><p>Related work.</p></section><div class=notice-text>Notice this.</div><h2 class=menu>Menu of the day</h2></article>", "Social life.\n\nRelated work.\n\nNotice this.\n\nMenu of the day"),
        ("<article><p>Code: <span class=comment>a remark</span> ends</p><div class=ad>buy</div><ul class=share-links><li>post</li></ul></article>", "Code: a remark ends"),
        ("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p><noscript><p>plain form</p></noscript><svg><text>logo</text></svg></article>", "If x=2 then\n\nplain form"),
        ("<p>a<span class=ad>b<b>c</b></span>d</p>", "ad"),
    ],
)
def test_one_page(source, text):
    assert html_extract.Page(source).main(lambda path: 1.0) == text


def test_the_tree_decides_on_doubtful_parts_of_articles(spark):
    words = lambda k, n: " ".join(random.Random(k).choices("one two three four five six seven eight nine ten".split(), k=n))
    page = lambda k, related: f"<article><p>{words(k, 20)}</p><section class=related><p>{related}</p></section><div class=box>{related}</div></article>"
    pages = [(k, f"http://same/{k}", page(k, "See also our other pages")) for k in range(9)] + [(20 + k, f"http://other/{k}", page(k, words(100 + k, 12))) for k in range(9)]
    # Half the pages say the same: of two like nodes the doubtful one goes.
    pages += [(40 + k, f"http://half/{k}", page(k, "See also our other pages" if k % 3 else words(200 + k, 9))) for k in range(18)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(9):
        assert got[k] == words(k, 20)
        assert got[20 + k] == f"{words(k, 20)}\n\n{words(100 + k, 12)}\n\n{words(100 + k, 12)}"
    own, _ = html_extract.style_tree(spark.createDataFrame([(u.split("/")[2], h) for _, u, h in pages if "half" in u], "host string, html string"))
    assert {0.3 < r.importance < 0.75 for r in own.collect() if r.path in {html_extract._path(("article", "section.related"))}} == {True}
    for k in range(18):
        other = "See also our other pages" if k % 3 else words(200 + k, 9)
        assert got[40 + k] == f"{words(k, 20)}\n\n{other}"


class Plain(html.parser.HTMLParser):
    """Blocks of the article alone, by the standard library's reading of tags."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks, self.now = False, 0, [], []
        self.feed(source)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.now).split())
        self.blocks += [text] if text else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.now += [" "] if tag == "br" else []
        if tag in ("p", "h1", "article"):
            self.end()
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag in ("p", "h1", "article"):
            self.end()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.now.append(data)


def test_another_parser_reads_the_same_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(rows) == len(got) > 20
    for r in rows:
        assert got[r.page_id] == "\n\n".join(Plain(r.html or "").blocks)


def test_letters_that_grow_in_lower_case_change_nothing_else(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect():
        plain = html_extract.Page(r.html).main(lambda path: 1.0)
        assert plain and html_extract.Page(f"<!-- {'İ' * 50} -->{r.html}").main(lambda path: 1.0) == plain
        assert html_extract.Page(r.html.replace("<nav>", f"<nav>{'İ' * 50}<script>x</script>", 1)).main(lambda path: 1.0) == plain
