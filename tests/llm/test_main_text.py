import re
import time
from html import unescape

from pyspark.sql import functions as F

from rillwater.llm import main_text, queries
from rillwater.llm.tables import table


def test_articles_of_the_given_pages(spark, sf_dir):
    """In these pages the article element holds the main text; a plain cut of it is the brute force."""
    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    rows = queries.QUERIES["op10_main_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header><a href=/>Site</a></header><div class="box">Latest: one, two, three</div>
<div id="cookie-notice">We use cookies</div><ul class="main-menu"><li>Home<li>About</ul>
<div class="story"><h2>Title {0}</h2><p>First &amp; <i>fore</i>most {0}<p>Second&nbsp;&lt;{0}&gt;<br>line</div>
<form><input value="x">Search</form><!-- note --><div class="comments"><p>I like it {0}</p></div>
<script>var a = "</p><p>no";</script><footer>&copy; 2024 {0}</footer></body></html>"""


def test_style_tree_removes_what_all_pages_repeat(spark):
    rows = [(i, f"https://One.example.org/{i}", PAGE.format(i)) for i in range(8)]
    rows += [(100, "http://two.example.org/", PAGE.format("x")), (101, None, PAGE.format("y")), (102, "http://one.example.org/n", None), (103, "http://one.example.org/e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    out = {r["page_id"]: r["text"] for r in main_text.main_text(pages, [F.col("page_id")]).collect()}
    for i in range(8):
        assert out[i] == f"Title {i} First & foremost {i} Second <{i}> line"
    # A host with one page, or none, has no tree: the box stays.
    assert out[100] == "Latest: one, two, three Title x First & foremost x Second <x> line"
    assert out[101].startswith("Latest") and out[102] == out[103] == ""
    assert main_text.main_text(pages.limit(0), [F.col("page_id")]).count() == 0


def test_pages_that_all_repeat_keep_their_text(spark):
    pages = spark.createDataFrame([(i, "http://m.example.org/", "<body><div>the same page</div></body>") for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in main_text.main_text(pages, [F.col("page_id")]).collect()} == {"the same page"}


def test_markup_cases():
    x = main_text.extract
    assert x("a<b>b</b>c <p>d<p>e</p></p>f") == "abc d e f"
    assert x("<article><header><h1>H</h1></header>t<aside>s</aside><footer>f</footer></article><p>out</p>") == "H t"
    assert x("<body><div class=comment-list>c</div><p title='a > b'>t</p>") == "t"
    assert x("<main><p>m</p></main><p>o</p>") == "m"
    assert x("<p>1 < 2 &amp &notit; &#65;&#x42;</p>") == "1 < 2 & ¬it; AB"
    assert x("<p>x<script>if (a<b) '</p>'</script>y</p><style>q</style>") == "xy"
    assert x("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert x("<p>open") == "open" and x("<p") == "" and x("") == ""
    assert x("<ul><li>a<ul><li>b</ul><li>c</ul>") == "a b c"
    assert x("<p>" + "long " * 300_000 + "</p>") == ("long " * 300_000).strip()


def texts(spark, rows):
    pages = spark.createDataFrame([(i, f"http://h.example.org/{i}", html) for i, html in enumerate(rows)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in main_text.main_text(pages, [F.col("page_id")]).collect()}


def test_repeated_boxes_inside_articles_go(spark):
    page = "<body><{1}><div class=kasten>Our app is new. Get it.</div><h1>Title {0}</h1><p>{2}</p></{1}></body>"
    story = [" ".join(f"word{i}x{k}" for k in range(20)) for i in range(8)]
    for tag in ("article", "main"):
        out = texts(spark, [page.format(i, tag, story[i]) for i in range(8)])
        assert out == {i: f"Title {i} {story[i]}" for i in range(8)}
    # Half of an article or more is never voted out.
    same = "<body><p>date {0}</p><article><p>" + story[0] + "</p></article></body>"
    assert texts(spark, [same.format(i) for i in range(8)]) == {i: story[0] for i in range(8)}


def test_story_beside_teaser_articles(spark):
    page = "<body><div class=x><p>{0}</p></div><article><h3>More {1}</h3></article><article><p>Nice {1}</p></article></body>"
    story = [" ".join(f"word{i}x{k}" for k in range(20)) for i in range(8)]
    out = texts(spark, [page.format(story[i], i) for i in range(8)])
    assert all(story[i] in out[i] for i in range(8))
    assert main_text.extract(page.format(story[0], 1)).startswith(story[0])
    assert main_text.extract(f"<main><p>m</p></main><div>{story[0]}</div>").endswith(story[0])


def test_copies_do_not_silence_the_story(spark):
    page = "<body><div class=kasten>Our app is new</div><div class=wrap><h1>Title {0}</h1><p>{1}</p></div><p>{2}</p></body>"
    story = [" ".join(f"word{i}x{k}" for k in range(20)) for i in range(12)]
    # Equal copies of one page, and pages unlike them.
    rows = [page.format("c", "copied text", "today")] * 190 + [page.format(i, story[i], "today") for i in range(10)]
    out = texts(spark, rows)
    assert all(out[190 + i].startswith(f"Title {i} {story[i]}") and "app" not in out[190 + i] for i in range(10))
    # Copies that differ in a date only: what repeats is judged low, but not what unlike pages have there.
    rows = [page.format("c", "copied text", f"day {i}") for i in range(190)] + [page.format(i, story[i], f"day 1{i}") for i in range(10)]
    out = texts(spark, rows)
    assert all(out[190 + i] == f"Title {i} {story[i]} day 1{i}" for i in range(10))
    # An article inside such a wrapper stays.
    marked = page.replace("<h1>", "<article><h1>").replace("</p></div>", "</p></article></div>")
    out = texts(spark, [marked.format("c", "copied text", f"day {i}") for i in range(190)])
    assert set(out.values()) == {"Title c copied text"}


def test_time_grows_with_the_page():
    """A megabyte of elements that are never closed, and of end tags without a start."""
    for piece in ("<b><div>x</div>", "<b>x</i>", "<b><option>x</option>", "<p><b>x", "<li><b>x", "<td><i>x</td>", "<div><p>x</b>"):
        began = time.perf_counter()
        text = main_text.extract(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 15, piece
        assert text.count("x") == 1_000_000 // len(piece), piece
