"""Urls of any length, and columns with the filter's own names."""

from pyspark.sql import functions as F

from msgloom.llm import url_filter
from msgloom.llm.queries import queries


def verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?", 1)[0].split("#", 1)[0]
    fits = [(h + p, a) for h, p, a in url_filter.QUERY_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, action = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, action


def test_long_hosts_and_paths(spark):
    urls = ["https://" + "a." * 30_000 + "example.com/en/x", "http://x." + "b" * 60_000 + ".net/es/", "http://example.com/" + "p/" * 500_000, "http://net/fr/" + "q" * 1_000_000, "http://example.com./en/", "http://.com/", "http://com", "://com/", None, "", "no", "http://EXAMPLE.com/en/", "http://www.example.com/en/", "http://notexample.com/en/", "http://é.net/es/", "http:///en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("mine") for c in ("host", "path", "keys", "hits", "row", "rule", "key", "best", "n")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, url_filter.query_rules(spark)).collect()}
    assert got == {i: verdict(u) for i, u in enumerate(urls)}
    assert "op4_url_bloom_filter" in queries()
