"""Pages to articles, on pages made here."""

import pytest

from lectern.operators import articles, rules

PAGE = """<html><head><title>A page &amp; more</title><style>p{}</style></head><body>
<nav><ul><li><a href=/a>Home of all</a><li><a href=/b>Other</a></ul></nav>
<article><h1>Title</h1><p>First paragraph of the text that is long enough to count, with a <b>bold word</b> in it.<p>Second one, unclosed
<div><p>Subscribe to our letter</p></div><img src=x.png><pre>line 1</pre><pre>line 2</pre>
<p>Third paragraph of the text that is also long enough to be counted among the main content.</p></article>
<footer><p>All rights reserved</p></footer><script>var t = "</p>";</script></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "http://a/b", PAGE), (2, "http://a/c", "<p>short</p>"), (3, "http://a/d", None), (4, "u", "</div><p>stray <b>x")], "page_id long, url string, html string")


def test_blocks(pages):
    rows = articles.html_blocks(pages).where("page_id = 1").orderBy("pos").collect()
    assert [(r.tag, r.text) for r in rows][2:6] == [("li", "Home of all"), ("li", "Other"), ("h1", "Title"), ("p", "First paragraph of the text that is long enough to count, with a bold word in it.")] or [r.text for r in rows if r.tag == "li"] == ["Home of all", "Other"]
    assert all("var t" not in r.text and "p{}" not in r.text for r in rows)
    assert [r.text for r in articles.html_blocks(pages).where("page_id = 4").collect()] == ["stray x"]


def test_main_content_leaves_the_rest(pages):
    rows = articles.main_content(articles.html_blocks(pages)).collect()
    text = " ".join(r.text for r in rows)
    assert {r.page_id for r in rows} == {1} and "First paragraph" in text and "Third" in text
    assert "Home" not in text and "rights" not in text


def test_articles(pages):
    got = articles.pages_to_articles(pages).collect()
    assert [(r.page_id, r.title, r.language) for r in got] == [(1, "A page &amp; more", "en")]
    assert "Subscribe" not in got[0].text
    blocks = articles.merge_code_lines(articles.html_blocks(pages)).where("tag = 'pre'").collect()
    assert [b.text for b in blocks] == ["line 1\nline 2"]
    images = articles.anchor_images(articles.html_blocks(pages)).collect()
    assert [(i.src, i.anchor[:5]) for i in images] == [("x.png", "Third")]


def test_choice_is_stable_and_follows_weights(spark):
    keys = spark.range(3000).withColumnRenamed("id", "key")
    got = {r.choice: r["count"] for r in rules.weighted_choice(keys, [("a", 3), ("b", 0), ("c", 1)], "key").groupBy("choice").count().collect()}
    assert set(got) == {"a", "c"} and 0.7 < got["a"] / 3000 < 0.8
    with pytest.raises(ValueError, match="weights"):
        rules.weighted_choice(keys, [("a", 0)], "key")


def test_guarded_restore_refuses_changed_bodies(spark):
    now = spark.createDataFrame([(1, "x", "t1"), (2, "y", "t2")], "id int, body string, title string")
    older = spark.createDataFrame([(1, "x", "old"), (2, "changed", "old")], now.schema)
    assert [r.title for r in rules.restore_guarded(now, older, "id", "body", ["title"]).orderBy("id").collect()] == ["t1", "t2"]
    assert [r.title for r in rules.restore_guarded(now, older.where("id = 1"), "id", "body", ["title"]).orderBy("id").collect()] == ["old", "t2"]


def test_notes_are_made_safe():
    from lectern.operators.sanitize import clean

    cases = {
        '<p onclick="x()">a</p>': "<p>a</p>",
        "<script>x<y</script>b": "b",
        "<unknown>kept <b>x</unknown>": "kept <b>x</b>",
        '<a href="javascript:x">l</a><a href="mailto:a@b.example">m</a>': '<a>l</a><a href="mailto:a@b.example" target="_blank" rel="noopener noreferrer">m</a>',
        '<img src="data:image/png;base64,AA==" alt="&quot;q"><img src="//x/y" alt="z">': '<img src="data:image/png;base64,AA==" loading="lazy" alt="&quot;q">z',
        '<span style="color: red; width: expression(x); COLOR: url(x)">s</span>': '<span style="color: red">s</span>',
        "<form><p>gone</p><input></form>c &lt;i&gt;": "c &lt;i&gt;",
        '<td colspan="0" rowspan="900" width="x">t': '<td rowspan="100">t</td>',
    }
    assert {k: clean(k) for k in cases} == cases
    assert clean(None) is None and clean("") == ""
    for html in cases:
        assert clean(clean(html)) == clean(html)


def test_local_images_and_word_notes():
    from lectern.operators import sanitize

    images = {
        '<img src="/api/files/1?x=2">': '<img src="/api/files/1?x=2" loading="lazy">',
        '<img src="http://LOCALHOST:8080/api/a.png?b=1#c" alt="t">': '<img src="/api/a.png?b=1" loading="lazy" alt="t">',
        '<img src="http://127.0.0.1/other.png">': "[图片已移除]",
        '<img src="http://x.example/api/a.png" alt="kept">': "kept",
        '<img src="http://[bad">': "[图片已移除]",
    }
    assert {k: sanitize.clean(k) for k in images} == images
    word = {
        '<p align="Right" style="margin-left:81px">a</p>': '<p data-align="right" data-indent="2">a</p>',
        '<h1 data-align="middle" data-indent="-3">a</h1>': "<h1>a</h1>",
        '<li data-indent="x" style="x:1; margin-left: 5em">a</li>': '<li data-indent="3">a</li>',
        '<div style="text-align:center" class="c"><img src="/api/x"><section><b>bold</b><script>no</script> text</section></div>': '<div data-align="center">bold text</div>',
        '<a href="javascript:x">j</a><a href=" HTTPS://x.example/?a&b">l</a>': '<a>j</a><a href="HTTPS://x.example/?a&amp;b">l</a>',
        "<table><tr><td>a</td><td><i>b</i></td></tr></table><i>c": "ab<i>c</i>",
    }
    assert {k: sanitize.clean_word(k) for k in word} == word
    assert sanitize.clean_word(None) is None and len(sanitize.clean_word("x" * 2_100_000)) == 2_000_000
    assert sanitize.clean("y" * 8_000_001) is None
