import re

from passbook.llm import hosts
from passbook.llm.queries.hosts import RULES


def plain(url):
    """(host, path, rule, verdict by rule) in plain Python."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (d + s, k) for k, d, s in RULES if (host == d or host.endswith("." + d)) and path.startswith(s)
    ]
    name, kind = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, name, kind


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x=/a", "http://example.org", "http://example.org/en/12#t",
    "http://myexample.org/es/", "https://a.b.com/de/x", "https://b.com/fr/", "https://b.com?x=/fr/", "http://com/de/1",
    "x://y://z.org/en", "http://Ünï.ORG/\n/es/", "http://b.example.com/en/1", "http://a.net:80/en",
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i % 5, u, "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, bad string")
    got = hosts.judge(pages, spark.createDataFrame([], "host string, bad int"), RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, name, kind = plain(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, name, kind or "allow")


def test_reputation_shrinks_small_hosts(spark):
    rows = [(f"h{i}.good.net", int(j == 0)) for i in range(20) for j in range(20)]
    rows += [("spam.net", int(j > 1)) for j in range(40)] + [("new.good.net", 1), ("a.good.net", None)]
    labelled = spark.createDataFrame(rows, "host string, bad int")
    urls = [("http://spam.net/x",), ("http://new.good.net/x",), ("http://h1.good.net/",), ("http://other.net/",), (None,)]
    got = hosts.judge(spark.createDataFrame(urls, "url string"), labelled, [])
    assert {r.host: r.verdict for r in got.collect()} == {
        "spam.net": "block", "new.good.net": "allow", "h1.good.net": "allow", "other.net": "allow", "": "allow",
    }
    mean = {r.host: r["mean"] for r in hosts.reputations(labelled).collect()}
    assert mean["h1.good.net"] < mean["new.good.net"] < mean["spam.net"] > 0.8


def test_unseen_hosts_go_by_domain_then_suffix(spark):
    rows = [(f"h{i}.spam.net", 1) for i in range(30) for _ in range(5)]
    rows += [(f"h{i}.good{i % 7}.net", 0) for i in range(40) for _ in range(5)]
    rows += [(f"w{i}.site{i}.bad", 1) for i in range(30) for _ in range(5)]
    rows += [("fine.site1.bad", 0)] * 60 + [("localhost", 0), ("intranet", 1), (None, 1)]
    labelled = spark.createDataFrame(rows, "host string, bad int")
    expected = {
        "new.spam.net": "block", "new.spam.net:8080": "block", "spam.net": "block", "new.good1.net": "allow", "other.net": "allow",
        "a.never.bad": "block", "fine.site1.bad": "allow", "nothing.known": "allow", "localhost": "allow", "1.2.3.4": "allow",
    }
    pages = spark.createDataFrame([(f"http://{h}/x", "old", 1) for h in [*expected, *expected]], "url string, host string, bad int")
    got = hosts.judge(pages, labelled, []).collect()
    assert len(got) == 2 * len(expected)
    assert {r.host: r.verdict for r in got} == expected
    assert all(r.bad == 1 for r in got)


def test_levels(spark):
    cases = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "a.xco.uk": ("xco.uk", "uk"), "x.y.com:80": ("y.com", "com"), "localhost": ("localhost", "localhost"),
        "10.0.0.1": ("10.0.0.1", ""), "10.0.0.1:99": ("10.0.0.1", ""), "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    got = {r.host: (r.domain, r.suffix) for r in hosts.with_levels(df, ["co.uk"]).collect()}
    assert got == cases
