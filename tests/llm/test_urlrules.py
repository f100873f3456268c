import random

from tracewell.llm import urlrules as U


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host, path


def _plain(url, rules):
    host, path = _parts(url)
    fit = [(h, p, b) for h, p, b in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)] if host else []
    if not fit:
        return host, path, None, "allow"
    h, p, b = min(fit, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), not r[2], r[0] + r[1]))
    return host, path, h + p, "block" if b else "allow"


def test_against_every_rule(spark, monkeypatch):
    monkeypatch.setattr(U, "RANGE_ROWS", 50)
    rng = random.Random(6)
    hosts = ["a.org", "b.a.org", "c.b.a.org", "xa.org", "org", "ORG", "é.org", "a.org:80", "", ".", "a..org"]
    paths = ["", "/", "/x", "/x/y", "/x/yz/", "/X", "/x?q=/x/y", "/xé", "#/x"]
    rules = list({(rng.choice(hosts[:8]).lower(), rng.choice(paths[:6])): bool(rng.getrandbits(1))
                  for _ in range(40)}.items())
    rules = [(h, p, b) for (h, p), b in rules]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(700)]
    urls += ["http://b.a.org/x/yz/1"] * 300 + [None, "", "no scheme", "http:/a.org", "a://b://c/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(4)
    table = spark.createDataFrame([*rules, (None, "/", True), ("a.org", None, True), *rules[:3]],
                                  "host string, path string, block boolean")
    got = U.judge_urls(pages, table).collect()
    assert len(got) == len(urls)
    for r in got:
        url = r["row"]["url"]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == _plain(url, rules), url


def test_odd_tables(spark):
    rules = spark.createDataFrame([("a.org", "/", True)], "host string, path string, block boolean")
    pages = spark.createDataFrame([(1, "http://x.a.org/", "h", "p", "k")] * 2 + [(None, None, None, None, None)],
                                  "page_id bigint, url string, host string, path string, key string")
    got = U.judge_urls(pages, rules).collect()
    assert sorted((r["row"]["host"] or "", r["host"], r["verdict"]) for r in got) == [
        ("", "", "allow"), ("h", "x.a.org", "block"), ("h", "x.a.org", "block")]
    assert U.judge_urls(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in U.judge_urls(pages, rules.where("false"), default="block").collect()} == {"block"}
