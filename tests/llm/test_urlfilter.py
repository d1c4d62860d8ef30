from quillspark.llm import urlfilter as U
from quillspark.llm.queries import RULES


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(r), r, v) for r, v in RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[1], max(fits)[2]) if fits else (None, None)))


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1", "https://a.example.org/es", "https://a.example.org/es/x?y#z", "http://example.org/en/12", "http://b.example.org/en/21#t",
    "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://xcom/de/", "http://ÄB.org/ü", "http://a.org?q=/fr/", "ftp://n.net/a.html", "http://www.n.net/a/", "x://y://z.com/de/", "http://n.net/b", "http://a\nb.net/c\nd?e",
]


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, "h")], "page_id bigint, url string, host string")
    listed = spark.createDataFrame([("https://N.net/a?x",), (None,), ("nothing",), ("http://n.net/a",), ("http://x.com/fr/1",)], "url string")
    got = U.filter_urls(pages, RULES, listed)
    rows = got.collect()
    assert len(rows) == len(URLS) + 1 and got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in rows:
        host, path, rule, says = plain(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (says or ("block" if r["url"] in ("ftp://n.net/a.html", "http://www.n.net/a/") else "allow"))


def test_list_is_exact_beyond_the_filter(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BLOCKS", 2)  # so full that nearly all pass
    pages = spark.range(4000).selectExpr("id as page_id", "concat('u', id % 3000) as canonical")
    listed = spark.range(0, 3000, 3).selectExpr("concat('u', id) as canonical")
    rows = U.listed_urls(pages, listed).collect()
    assert len(rows) == 4000 and all(r["listed"] == (r["page_id"] % 3000 % 3 == 0) for r in rows)
    assert U.listed_urls(pages, listed.where("false")).where("listed").count() == 0
    assert U.listed_urls(pages.where("false"), listed).count() == 0
