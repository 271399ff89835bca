from farelens.llm import url_reputation as urls
from farelens.llm.queries import URL_RULES

PAGES = "page_id long, url string, bad int, host string, verdict string"


def judged(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, u, b, "old", "old") for i, (u, b) in enumerate(rows)], PAGES)
    return sorted(urls.judge_urls(df, URL_RULES, **kwargs).collect(), key=lambda r: r.page_id)


def test_hosts_paths_and_rules(spark):
    cases = [
        (None, "", "", None),
        ("no scheme/at/all", "", "", None),
        ("http://", "", "", None),
        ("HTTP://WWW.Example.NET/en/x?y#z", "www.example.net", "/en/x", "example.net/en/"),
        ("http://example.net/de/", "example.net", "/de/", "net/"),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/"),
        ("http://example.net", "example.net", "", None),
        ("x://net/a://b", "net", "/a://b", "net/"),
        ("http://a.example.com/de/1#?", "a.example.com", "/de/1", "example.com/de/"),
        ("http://a.example.com/den", "a.example.com", "/den", None),
        ("http://ÄB.org/fr/\nx", "Äb.org", "/fr/\nx", "org/fr/"),
        ("http://h:80/p", "h:80", "/p", None),
        ("http://q?://x", "q", "", None),
    ]
    for r, (_, host, path, rule) in zip(judged(spark, [(c[0], None) for c in cases]), cases, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == ("block" if rule in ("net/", "example.com/de/") else "allow")


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows = [("http://bad.example.org/x", 1)] * 40 + [("http://good.example.org/x", 0)] * 40
    rows += [(f"http://h{i}.site{i}.com/x", i % 2) for i in range(60)]
    rows += [("http://new.example.org/x", None)]
    by_host = {r.host: r for r in judged(spark, rows)}
    assert by_host["bad.example.org"].verdict == "block" and by_host["good.example.org"].verdict == "allow"
    assert by_host["h1.site1.com"].verdict == "allow"  # one bad page says little
    assert 0.1 < by_host["new.example.org"].bad_mean < 0.9


def test_suffixes_and_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.com:8080", "com", "10.0.0.1", "", "[::1]:80"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [tuple(r) for r in df.select(urls.suffix_of(F.col("h")), urls.domain_of(F.col("h"))).collect()]
    assert got == [
        ("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("com", "y.com"), ("com", "com"),
        ("", "10.0.0.1"), ("", ""), ("", "[::1]"),
    ]


LIST = ["// comment", "", None, "com", "uk", "co.uk", "co.uk", "*.ck", "!www.ck", "  CO.ZA  note", "a.b.example.org", "*.kawasaki.jp", "!city.kawasaki.jp"]


def brute_domain(host):
    """Suffix and domain by trying every rule on every tail."""
    import re

    name = re.sub(r":\d*$", "", host)
    if re.search(r"^[0-9.]*$|^\[|\.$", name):
        return "", name
    rules = {line.split()[0].lower() for line in LIST if line and line.strip() and not line.startswith("//")}
    labels = name.split(".")
    n = 1
    for i in range(len(labels)):
        tail = ".".join(labels[i:])
        if tail in rules or (i + 1 < len(labels) and "*." + ".".join(labels[i + 1 :]) in rules):
            n = max(n, len(labels) - i)
    for i in range(len(labels)):
        if "!" + ".".join(labels[i:]) in rules:
            n = len(labels) - i - 1
    return ".".join(labels[-n:]), ".".join(labels[-n - 1 :])


def test_domains_by_a_list_of_suffixes(spark):
    hosts = [
        "a.b.co.uk", "co.uk", "uk", "x.uk", "a.b.ck", "x.a.b.ck", "b.ck", "ck", "www.ck", "z.www.ck", "shop.co.za", "co.za", "q.r.za",
        "s.a.b.example.org", "x.example.org", "city.kawasaki.jp", "h.city.kawasaki.jp", "o.x.kawasaki.jp", "com:80", "a.com:80",
        "10.0.0.1", "", "[::1]:80", "dot.com.", "..com", "Ä.co.uk", ".".join("l" * 3000) + ".co.uk",
    ]
    df = spark.createDataFrame([(h, "old") for h in hosts], "host string, __extra string")
    lines = spark.createDataFrame([(line,) for line in LIST], "suffix string")
    out = urls.with_domains(df, lines)
    assert out.columns == ["host", "__extra", "suffix", "domain"]
    assert {r.host: (r.suffix, r.domain) for r in out.collect()} == {h: brute_domain(h) for h in hosts}
    none = urls.with_domains(df, lines.limit(0)).filter("host = 'a.b.co.uk'").first()
    assert (none.suffix, none.domain) == ("uk", "co.uk")


def test_a_listed_suffix_parts_unrelated_sites(spark):
    """Below a listed suffix a site's new host stays near its own site; unlisted, all sites are one domain."""
    rows = [(f"http://{h}.{site}.co.za/x", bad) for h in "ab" for site, bad in (("bad", 1), ("good", 0)) for _ in range(40)]
    rows += [(f"http://new.{site}.co.za/x", None) for site in ("bad", "good")]
    lines = spark.createDataFrame([("co.za",), ("com",)], "suffix string")
    listed = {r.host: r.bad_mean for r in judged(spark, rows, suffixes=lines)}
    single = {r.host: r.bad_mean for r in judged(spark, rows)}
    assert listed["new.good.co.za"] < 0.1 and listed["new.bad.co.za"] > 0.9
    assert abs(single["new.good.co.za"] - 0.5) < 0.01 and abs(single["new.bad.co.za"] - 0.5) < 0.01


def test_labels_reach_pages_by_the_document_in_the_url(spark):
    pages = spark.createDataFrame(
        [(0, "http://a.b/en/7.html"), (1, "http://a.b/8?x"), (2, "http://a.b/"), (3, None)], "page_id long, url string"
    )
    labels = spark.createDataFrame([(7, 0, 0), (7, 1, 0), (8, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.bad for r in urls.label_pages(pages, labels).collect()}
    assert got == {0: 1, 1: 0, 2: None, 3: None}


def test_nothing(spark):
    assert judged(spark, []) == []
    assert [r.verdict for r in judged(spark, [("http://a.b/c", None)])] == ["allow"]
