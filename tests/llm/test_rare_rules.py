"""Rules that few of the labelled urls show."""

from lectern.llm import url_filter


def test_rule_of_half_a_percent_is_mined(spark):
    urls = [f"https://www.shop.com/item/{n}" for n in range(995)] + [f"https://rare{n}.net/es/zz" for n in range(5)]
    urls += ["https://other.org/zz", "https://other.org/yy"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged_urls(pages).collect()}
    assert got[995] == ("net/es/", "block") and got[0] == ("com/", "allow")
    assert got[1000] == (None, "block") and got[1001] == (None, "allow")
