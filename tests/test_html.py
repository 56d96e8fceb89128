"""Elements of stored pages, against a parser written with the standard library."""

from html.parser import HTMLParser

import pytest

from touchline.sources.html import html_elements


class _Elements(HTMLParser):
    """Texts of all elements of a tag (and class), in order of their opening tags."""

    def __init__(self, tag, css_class):
        super().__init__(convert_charrefs=False)
        self.tag, self.css_class, self.items, self.stack = tag, css_class, [], []

    def handle_starttag(self, tag, attrs):
        if tag == self.tag:
            wanted = self.css_class is None or self.css_class in (dict(attrs).get("class") or "").split()
            self.stack.append(len(self.items) if wanted else None)
            if wanted:
                self.items.append("")

    def handle_endtag(self, tag):
        if tag == self.tag and self.stack:
            self.stack.pop()

    def handle_data(self, data):
        for i in self.stack:
            if i is not None:
                self.items[i] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def brute(html, tag, css_class):
    p = _Elements(tag, css_class)
    p.feed(html or "")
    p.close()
    return [t.strip(" ") for t in p.items]


PAGES = [
    "<li>a<ul><li>b</li></ul></li>",
    "<div class=\"ad big\">x</div><div class='ad'>y</div><DIV CLASS=ad>z</DIV><div class=\"bad\">no</div><div data-class=\"ad\">no</div>",
    "<LI>One</LI><li id='3' title=\"a > b\">Two <b>bold</b> &amp; more</li><link href=x><list>no</list>",
    "<div class='x'><div class='ad'>in <div>deeper</div> out</div> rest</div>",
    "<script>var a = '<li>no</li>';</script><li>yes<!-- <li>no</li> --> still</li><style>li{}</style>",
    "<li>never closed <b>x", "</li><li>after a stray end</li>", "a < b <li>1 < 2</li>", "", None, "no tags at all",
]


@pytest.mark.parametrize("tag,css_class", [("li", None), ("div", "ad"), ("div", None), ("b", None)])
def test_elements(spark, tag, css_class):
    df = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")
    got = {}
    for r in html_elements(df, tag, css_class, keep=("page_id",)).orderBy("page_id", "element_index").collect():
        assert r.element_index == len(got.setdefault(r.page_id, []))
        got[r.page_id].append(r.text)
    want = {i: t for i, h in enumerate(PAGES) if (t := brute(h, tag, css_class))}
    assert got == want


HOSTILE = {
    "stray": "<li>one</li> <b" + "x" * 20_000 + " it's <li>two</li>",
    "many": "<b <i <u <" * 20_000 + "<li>ok</li>",
    "big tag": "<div title=\"" + "y" * 1_000_000 + "\"><li>in</li></div>",
    "quotes": "<a '" * 20_000 + "><li>q</li>",
    "nested": "<li>t" * 2000 + "</li>" * 2000,
    "comment": "<li>a</li><!-- never closed <li>no</li>" + "-" * 50_000,
    "closes": "</li>" * 5000 + "<li>z",
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_hostile_pages(spark, name):
    """No page ends the session, and time follows what is returned."""
    df = spark.createDataFrame([(1, HOSTILE[name]), (2, "<li>fine</li>")], "page_id long, html string")
    got = sorted((r.page_id, r.element_index, r.text) for r in html_elements(df, "li", keep=("page_id",)).collect())
    want = {"stray": ["one", "two"], "many": ["ok"], "big tag": ["in"], "quotes": ["q"], "comment": ["a"], "closes": ["z"],
            "nested": ["t" * (2000 - i) for i in range(2000)]}[name]
    assert got == [(1, i, t) for i, t in enumerate(want)] + [(2, 0, "fine")]


def test_repeated_pages_keep_their_elements(spark):
    df = spark.createDataFrame([(1, "<li>a<li>b</li></li>")] * 3 + [(None, "<li>c")], "page_id long, html string")
    got = sorted((str(r.page_id), r.element_index, r.text) for r in html_elements(df, "li", keep=("page_id",)).collect())
    assert got == sorted([("1", 0, "ab"), ("1", 1, "b")] * 3 + [("None", 0, "c")])
