from wavemill.llm import url_filter


def test_host_rules_do_not_read_the_query(spark):
    urls = ["http://a.com?u=x.net/y", "http://a.net/y?u=x.org/fr/", "http://a.net?u=x.net/y", "http://b.example.net/en/?q"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got == {0: (None, "allow"), 1: ("net/", "block"), 2: (None, "allow"), 3: ("example.net/en/", "allow")}
