import random
import re

from pyspark.sql import functions as F

from bazaar.llm import url_filter
from bazaar.llm.registry import URL_RULES

PAGES = "page_id long, url string"
OUT = "page_id long, bad int"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest).group()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host):]).group()


def brute_rule(host, path):
    best = None
    for verdict, rule in URL_RULES:
        h, p = rule[:rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


URLS = [None, "", "no scheme", "http://", "http://COM/x", "https://Example.com/en/1?x#y", "http://www.example.com/en/", "http://a.www.example.com/en",
        "http://notexample.com/en/", "http://com", "http://com?x=/", "http://net/es/", "http://x.net/ES/", "http://x.net/fr/#a", "a://b://c/d",
        "http://É.com/ü/", "http://user@x.com:80/p", "http://x.example.org/\n/q", "http://h.org/" + "p/" * 50_000, "http://1.2.3.4:80/x"]


def test_host_path_and_rules_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(None, "http://com/a"), (3, URLS[5]), (3, URLS[5])], PAGES)
    clash = df.selectExpr("*", "'x' as host", "1 as verdict", "2 as path", "3 as rule", "4 as __hit")
    got = url_filter.judge(clash, spark.createDataFrame([], OUT), URL_RULES).collect()
    assert got[0].__fields__ == ["page_id", "host", "path", "rule", "verdict"]
    want = []
    for k, u in list(enumerate(URLS)) + [(None, "http://com/a"), (3, URLS[5]), (3, URLS[5])]:
        host, path = brute_parts(u)
        rule = brute_rule(host, path)
        want.append((k, host, path, rule and rule[1], rule[0] if rule else "allow"))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_longer_host_wins_ties_of_length(spark):
    df = spark.createDataFrame([("b.ac", "/x/y")], "host string, path string")
    rules = [("allow", "ac/x/y"), ("block", "b.ac/x")]
    assert df.select(url_filter.matched_rule(F.col("host"), F.col("path"), rules)["verdict"]).first()[0] == "block"
    assert df.select(url_filter.matched_rule(F.col("host"), F.col("path"), []).alias("r")).first().r is None


def test_domains_and_suffixes(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.net": ("y.net", "net"),
             "localhost": ("localhost", "localhost"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "xco.uk": ("xco.uk", "uk")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    for r in df.select("host", url_filter.registered_domain(F.col("host")).alias("d"), url_filter.url_suffix(F.col("host")).alias("s")).collect():
        assert (r.d, r.s) == hosts[r.host]


def brute_level(groups):
    over = sum((b - n * p) ** 2 - n * p * (1 - p) for n, b, p in groups.values())
    scale = sum(n * (n - 1) * p * (1 - p) for n, b, p in groups.values())
    rho = min(max(over / scale if scale else 0.5, 0.0001), 0.5)
    m = 1 / rho - 1
    return {k: (b + m * p) / (n + m) for k, (n, b, p) in groups.items()}, m


def test_reputation_matches_a_plain_computation_and_blocks_bad_hosts(spark):
    rng = random.Random(3)
    rates = {"bad.farm.net": 0.9, "www.farm.net": 0.8, "good.site.net": 0.05, "www.shop.com": 0.1, "few.shop.com": 0.1, "one.lone.com": 1.0}
    rows, outs = [], []
    for host, rate in rates.items():
        for _ in range({"few.shop.com": 4, "one.lone.com": 1}.get(host, 300)):
            rows.append((len(rows), f"http://{host}/p{len(rows)}"))
            outs.append((rows[-1][0], int(rng.random() < rate)))
    rows += [(len(rows), "http://new.farm.net/"), (len(rows) + 1, "http://new.site.net/"), (len(rows) + 2, None)]
    outs += [(0, 0), (None, 1), (1, None), (999_999, 1)]
    pages, out = spark.createDataFrame(rows, PAGES), spark.createDataFrame(outs, OUT)
    worst = {}
    for k, b in outs:
        if k is not None and b is not None:
            worst[k] = max(worst.get(k, 0), b)
    counts = {}
    for k, u in rows:
        h = brute_parts(u)[0]
        if h and k in worst:
            n, b = counts.get(h, (0, 0))
            counts[h] = (n + 1, b + worst[k])
    total = (sum(b for _, b in counts.values()) + 1) / (sum(n for n, _ in counts.values()) + 2)

    def roll(of, parent):
        out_ = {}
        for h, (n, b) in counts.items():
            k = of(h)
            old = out_.get(k, (0, 0, 0))
            out_[k] = (old[0] + n, old[1] + b, parent(h))
        return out_

    suf, _ = brute_level(roll(lambda h: h.split(".")[-1], lambda h: total))
    dom, _ = brute_level(roll(lambda h: ".".join(h.split(".")[-2:]), lambda h: suf[h.split(".")[-1]]))
    want, m = brute_level(roll(lambda h: h, lambda h: dom[".".join(h.split(".")[-2:])]))
    got_counts = url_filter.host_outcomes(pages, out)
    hosts, _, _, overall, strengths = url_filter.reputation(got_counts)
    assert abs(overall - total) < 1e-12 and abs(strengths[0] - m) < 1e-6 * m
    assert {r.host: round(r["mean"], 9) for r in hosts.collect()} == {h: round(x, 9) for h, x in want.items()}
    verdicts = {r.host: r.verdict for r in url_filter.judge(pages, out, [], max_bad=0.4).collect()}
    assert {h for h, v in verdicts.items() if v == "block"} >= {"bad.farm.net", "www.farm.net"}
    assert all(verdicts[h] == "allow" for h in ("good.site.net", "www.shop.com", "few.shop.com", "new.site.net", ""))


def test_empty_pages(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES), spark.createDataFrame([(1, 1)], OUT), URL_RULES).count() == 0
