"""Main text of pages: planted regions, block rules, the given pages."""

import html
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.html_extract import extract, extract_pages

GOOD = "The cat of the house is in the garden and it was there for a long time with the dog and the mouse, as it is for all of them. " * 2
SCHEMA = T.StructType([T.StructField(c, k) for c, k in (("page_id", T.LongType()), ("url", T.StringType()),
                                                        ("html", T.StringType()), ("text", T.StringType()))])


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bad = 0
    rows = extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        bad += r.text != "\n".join(b for b in blocks if b)
    assert len(rows) == 250 and bad == 0


def test_regions_that_are_not_the_article():
    page = f"""<html><head><title>t</title><style>p{{}}</style><script>var a="</p><p>{GOOD}";</script></head><body class="no-sidebar">
      <header><h1>Site of the year and more</h1><p>{GOOD}</p></header><nav><a href="/">Home</a> <a href="/b">About</a></nav>
      <div class="cookie-notice">{GOOD}</div><aside>{GOOD}</aside><div id="sidebar"><p>{GOOD}</p></div>
      <div class="ad-slot">{GOOD}</div><form><label>{GOOD}</label><textarea>{GOOD}</textarea></form>
      <main><article><h1>A&nbsp;title &amp; more</h1><p>{GOOD}<p>Yes.<br>No.<ul><li>one<li>two</ul>
      <ul><li><a href=x>Read more of the same kind here</a></ul><p hidden>{GOOD}</p></article></main>
      <section class="userComments"><article class="comment"><p>{GOOD}</p></article></section>
      <footer>{GOOD}</footer></body></html>"""
    good = re.sub(r"\s+", " ", GOOD).strip()
    assert extract(page) == ["A title & more", good, "Yes. No.", "one", "two"]


def test_pages_that_mark_no_article():
    good = re.sub(r"\s+", " ", GOOD).strip()
    page = f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><h2>Short heading</h2><div>{GOOD}</div><p>Ok.</p><div>{GOOD}</div>" \
           f"<p>{'buy cheap pills now ' * 12}</p><p><a href=z>{GOOD}</a></p></body>"
    assert extract(page) == ["Short heading", good, "Ok.", good]


def test_short_articles_stay_and_odd_input():
    assert extract("<article><h1>Hi</h1><p>Yes</article><p>no") == ["Hi", "Yes"]
    assert extract(None) == extract("") == extract("   ") == extract("<p></p>") == []
    assert extract("<article><p>a &lt;b&gt; &#233;&eacute; &unknown; <![CDATA[x]]><!-- c --> <b>d") == ["a <b> éé &unknown; d"]
    assert extract("</p></div></article><article>" + "<div>" * 3000 + "x" + "</div>" * 10) == ["x"]
    assert len(extract("<article><p>" + "the word of and " * 100_000)[0]) == 1_599_999


def test_marks_are_evidence_and_text_decides():
    good = re.sub(r"\s+", " ", GOOD).strip()
    pills = "buy cheap pills now " * 12
    assert extract(f"<main><p>{GOOD}</p><p>{pills}</p><p>Yes.</p></main>") == [good, "Yes."]
    cards = "".join(f"<article><a href=x>Teaser {i} of the day</a></article>" for i in range(4))
    assert extract(f"<body>{cards}<div><p>{GOOD}</p></div></body>") == [good]
    for name in ("has-sidebar", "comments-open", "search-page"):
        page = f"<body><div class='{name}'><div><p>{GOOD}</p><p>{GOOD}</p></div><div class=sidebar>{GOOD}</div></div></body>"
        assert extract(page) == [good, good]
    assert extract(f"<div id=related><main><p>Hi</p></main></div><p>{GOOD}</p>") == ["Hi", good]
    assert extract(f"<div role=search><p>{GOOD}</p></div>") == []


def test_stop_words_of_other_languages(spark):
    story = lambda i: " ".join(f"ka w{i}x{j} lo mi v{i}y{j}" for j in range(20))
    rows = [(i, "u", f"<html lang='xx-A'><body><div>{story(i)}</div><p>{' '.join(f'q{i}z{j}' for j in range(60))}</p></body></html>", "")
            for i in range(30)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: story(i) for i in range(30)}


def test_table(spark):
    rows = [(1, "u", f"<article><p>{GOOD}", "mine"), (1, "u", f"<article><p>{GOOD}", "mine"), (None, None, None, None), (3, None, "", "x")]
    got = extract_pages(spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.lit("x"))).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, len(GOOD) - 1, len(GOOD) - 1]
    assert extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0
