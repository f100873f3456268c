import random
import re

from pyspark.sql import functions as F

from tracewell.llm import secrets as S

GIVEN = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                re.I | re.A), lambda m: len(m[2]) >= 8),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def test_queries_hold_for_every_match():
    rng = random.Random(3)
    pieces = ["PassWord", "passwd", "secret", "token", "API_KEY", "apikey", "=", ": ", '"', " ", "AKIA", "é", "\n",
              "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, "abcdefgh12", "ghp_" + "a" * 36, "xoxb-1234567890ab",
              "ſecret", "\u212aey", "-----BEGIN RSA PRIVATE KEY-----", "x" * 50, "eyJabcdefgh1.eyJabcdefgh2.abcdefgh3"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    got = S.scan([t.encode() for t in texts])
    for text, spans in zip(texts, got):
        want = sorted((m.start(), k, m.end()) for k, (p, keep) in enumerate(GIVEN)
                      for m in p.finditer(text) if keep(m))
        assert [s for s in spans if s[1] < 3] == want
        assert spans == sorted((a, k, b) for k, r in enumerate(S.RULES) for a, b in r.spans(text))


def test_derived_queries():
    assert S.trigram_query("AKIA[A-Z0-9]{12,}") == ("and", ("aki", "kia"))
    assert S.trigram_query("[0-9a-f]{32,}") is True
    assert S.trigram_query("(abc|xy)z") == ("or", (("and", ("abc", "bcz")), "xyz"))
    assert S.trigram_query("ab.cd") is True
    assert S.trigram_query("(?:abc)?def") == ("or", (("and", ("abc", "bcd", "cde", "def")), "def"))
    assert S.trigram_query("(?:abc)+x") == "abc"
    assert S.trigram_query("(?:abc|[^x]*)def") == "def"


def test_odd_rows(odd, nothing):
    rows = odd.select("doc_id", S.secret_spans(F.col("text")).alias("s")).collect()
    assert len(rows) == 12 and all(r["s"] == [] for r in rows)
    planted = odd.select(S.secret_spans(F.concat(F.lit("é token=abcdefgh12 "), "text")).alias("s")).collect()
    assert sum(r["s"] == [] for r in planted) == 1  # the null text
    assert all((x["kind"], x["start"], x["end"]) == ("assign", 2, 18) for r in planted for x in r["s"])
    assert nothing.select(S.secret_spans(F.col("text"))).count() == 0
