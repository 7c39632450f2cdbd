"""URL verdicts against SQL and by hand; the plan stays in the JVM."""

import random

from oracle import compare, connect

from rillflow.llm.urls import ALLOW, BLOCK, SQL, filed_under, judged, op6_url_filter, regex_of, tokens_of


def test_query_against_sql(spark, sf_dir):
    df = op6_url_filter(spark, sf_dir)
    assert compare(df, connect(sf_dir), SQL) is None
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")


def test_rules(spark):
    urls = ["http://A.EXAMPLE.com/en/x?q", "http://www.example.com/en/", "http://example.com/fr/", "http://net/es/1", "http://exnet/es/", "http://net?x", None, "", "nope/ads/",
            "http://x.org/ads/", "http://x.org/ads/about-our-ads.html", "http://x.org/search?q=site-map&a", "http://x.org/SEARCH?Q=1", "://", "http://x.org\n/cart/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(frame(spark, urls)).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("com/", "allow") and got[3][2:] == ("net/es/", "block") and got[4] == ("exnet", "/es/", None, "allow")
    assert got[5] == ("net", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][3] == "allow" and got[8][3] == "block"
    assert [got[i][3] for i in (9, 10, 11, 12, 13, 14)] == ["block", "allow", "allow", "block", "allow", "block"]
    assert judged(frame(spark, ["a"]).limit(0)).count() == 0


def test_rarest_token(spark):
    urls = frame(spark, [f"http://h/common/{i}" for i in range(20)] + ["http://h/rare/common/"])
    assert filed_under(urls, [("block", "/rare/common/"), ("block", "x*y")]) == {"rare": [("block", "/rare/common/")], "": [("block", "x*y")]}
    assert tokens_of("ab/cd/ef*/gh/*ij/") == ["cd", "gh"] and regex_of("/a*b.") == r"\/a.*b\."


def test_index_loses_nothing(spark):
    draw = random.Random(1)
    pick = lambda n, alphabet: "".join(draw.choice(alphabet) for _ in range(n))
    patterns = [(draw.choice(["allow", "block"]), pick(draw.randint(1, 6), "ab/.*")) for _ in range(40)]
    urls = ["http://" + pick(draw.randint(0, 12), "abAB/.?") for _ in range(300)]
    got = {r.page_id: r.verdict for r in judged(frame(spark, urls), host_rules=(), patterns=patterns).collect()}
    import re

    for i, url in enumerate(urls):
        fits = [v for v, p in patterns if re.search(regex_of(p), url.lower())]
        assert got[i] == ("allow" if "allow" in fits or not fits else "block")


def test_many_rules(spark):
    """Some hundreds of rules, several to a bucket and to a token, against trying each of them."""
    import random
    import re as regex

    draw = random.Random(9)
    names = [f"w{i}" for i in range(150)]
    patterns = tuple(dict.fromkeys((draw.choice((ALLOW, BLOCK)), draw.choice(("/{}/", "/{}/*{}.", "?{}=", "{}")).format(draw.choice(names), draw.choice(names))) for _ in range(400)))
    hosts = tuple({h: (draw.choice((ALLOW, BLOCK)), h, "/") for h in (f"{draw.choice(names)}.org" for _ in range(100))}.values())
    urls = [f"https://{draw.choice(names)}.{draw.choice(('org', 'com'))}/{draw.choice(names)}/x{draw.choice(names)}/{draw.choice(names)}.html?{draw.choice(names)}=1" for _ in range(300)]
    out = judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), host_rules=hosts, patterns=patterns).collect()
    for r in out:
        by_host = {h: v for v, h, _ in hosts}.get(r.host)
        fits = [(v == ALLOW, p) for v, p in patterns if regex.search(regex_of(p), urls[r.page_id].lower())]
        best = max(fits) if fits and by_host is None else None
        assert r.verdict == (by_host or ((ALLOW if best[0] else BLOCK) if best else ALLOW)) and r.pattern == (best[1] if best else None)
