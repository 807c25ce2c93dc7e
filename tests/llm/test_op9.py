import html
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stranda.llm import op9_html as op


def want(page):
    """The article's headings and paragraphs, which the test pages mark."""
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    found = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(b for b in found if b)


def test_query_finds_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = op.op9_html(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == want(pages[r.page_id]) and r.n_chars == len(r.text)


def test_unmarked_pages_and_parts_amid_content():
    w = op.Weights({})
    page = "<body><nav>menu a b c</nav><script>var x='<p>no</p>';</script><h1>T &amp; x&nbsp;y</h1><p>one two three<p>four <b>five</b> six<aside>side bar words here</aside><p>seven  eight nine</p><div class='post comments'><p>reader says hi all of you</p></div><form>f</form><!-- no --><footer>f o o t</footer>"
    assert op.extract(page, w) == "T & x y\none two three\nfour five six\nseven eight nine"
    assert op.extract("plain words", w) == "plain words" and op.extract("<p>cut <b", w) == "cut"


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", ""), (2, "u", "<p>a b</p>"), (2, "u", "<p>a b</p>"), (3, "u", "<nav>x</nav>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in op.main_text(df).collect())
    assert got == [("1", "", 0), ("2", "a b", 3), ("2", "a b", 3), ("3", "", 0), ("None", "", 0)]
    assert op.main_text(df.limit(0)).count() == 0


def test_names_around_and_in_the_article_take_nothing_away():
    w = op.Weights({})
    text = "one two three four five six seven"
    for page in (f'<body class="single has-sidebar"><p>{text}</p></body>', f'<div class="post comments-open"><p>{text}</p></div>', f'<div class="sidebar"><article><p>{text}</p></article></div>', f'<article><p class="share-price">{text}</p></article>', f'<body class="sidebar"><p>{text}</p>'):
        assert op.extract(page, w) == text, page
    assert op.extract("<p>a <label>b</label> c</p>", w) == "a b c"
    long = " ".join(f"utility-{i}" for i in range(30))
    assert op.extract(f'<p>{text}</p><div class="{long} sidebar"><p>side words here</p></div><p>{text}</p>', w) == f"{text}\n{text}"
    assert len(op._key("div", f'class="{long}"')[0]) < 100 and op._key("div", f'class="{long}"') != op._key("div", f'class="{long} x"')


@given(st.lists(st.integers(-5, 5), max_size=30))
def test_the_scan_finds_the_best_of_all_regions(scores):
    a, b = op.best_region(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    assert sum(scores[a:b]) == max(best, 0)


def test_long_pages(spark):
    page = "<div>" * 2000 + "<p>" + "word " * 200_000 + "</p>" + "<b" * 10
    assert op.extract(page, op.Weights({})) == " ".join(["word"] * 200_000)
