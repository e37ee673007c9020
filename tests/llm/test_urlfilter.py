"""The wildcard automaton against regular expressions, and the rules by hand."""

import random
import re

import pytest

from tidewatch.llm import urlfilter


@pytest.mark.parametrize("seed", range(4))
def test_automaton_like_regular_expressions(seed):
    rng = random.Random(seed)
    parts = ["a", "b", "/", "*", "**", "?", "é", "ab", "."]
    globs = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    urls = ["".join(rng.choice(["a", "b", "/", "é", ".", "ab"]) for _ in range(rng.randint(0, 12)))
            for _ in range(200)]
    got = urlfilter.Automaton(globs).matches(urls)
    # on bytes, since ? is one byte of the UTF-8 form
    want = [[bool(re.fullmatch(_regex(g.encode()), u.encode())) for g in globs] for u in urls]
    assert got.tolist() == want


def _regex(glob: bytes) -> re.Pattern:
    out, at = [], 0
    while at < len(glob):
        if glob[at:at + 2] == b"**":
            out.append(b"(?s:.*)")
            at += 1
        elif glob[at:at + 1] == b"*":
            out.append(b"[^/]*")
        elif glob[at:at + 1] == b"?":
            out.append(b"[^/]")
        else:
            out.append(re.escape(glob[at:at + 1]))
        at += 1
    return re.compile(b"".join(out))


def test_more_than_one_word_of_states():
    globs = [f"{'x' * k}*y" for k in range(1, 40)]
    auto = urlfilter.Automaton(globs)
    assert auto.step.shape[1] > 5
    assert auto.matches(["x" * 63 + "y"])[0].all()
    assert auto.matches(["x" * 5 + "y"])[0].tolist() == [k <= 5 for k in range(1, 40)]


def test_no_urls_and_long_urls():
    auto = urlfilter.Automaton(["**z"])
    assert auto.matches([]).shape == (0, 1)
    assert auto.matches(["", "a" * 100_000 + "z"])[:, 0].tolist() == [False, True]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://Example.NET/en/1?x#y", "example.net", "/en/1", "example.net/en/", "allow"),
    ("https://m.example.net/de/1", "m.example.net", "/de/1", "net/", "block"),
    ("http://a.example.com/de/", "a.example.com", "/de/", "example.com/de/", "block"),
    ("http://example.com/de", "example.com", "/de", None, "allow"),
    ("http://badexample.com/de/x", "badexample.com", "/de/x", None, "allow"),
    ("http://x.org/fr/y", "x.org", "/fr/y", "org/fr/", "allow"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://h?q=.net/", "h", "", None, "allow"),
    ("http://h#f", "h", "", None, "allow"),
    ("http://h/a.net/b", "h", "/a.net/b", None, "allow"),
    ("http://x.example.com/ads/1", "x.example.com", "/ads/1", None, "block"),
    ("http://x.org/a.PNG", "x.org", "/a.PNG", None, "allow"),
    ("http://x.org/a.png?s=1", "x.org", "/a.png", None, "block"),
    ("http://ÀB.net/é", "Àb.net", "/é", "net/", "block"),
    ("http://a://b.net/c", "a:", "//b.net/c", None, "allow"),
    ("no scheme.net/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
])
def test_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url)], "page_id long, url string") \
        .selectExpr("*", "'q' AS host", "'r' AS v", "'s' AS path")
    assert [tuple(r) for r in urlfilter.filter_urls(df).collect()] == [(1, host, path, rule, verdict)]


def test_equally_long_rules_and_globs_take_the_first():
    rules = (("allow", "a.b/x"), ("block", "a.b/x"))
    assert urlfilter.judge(["a.b/xy"], rules, ()) == [("a.b/x", "allow")]
    globs = (("block", "**a"), ("allow", "a**"))
    assert urlfilter.judge(["a"], (), globs) == [(None, "block")]


def test_awkward_tables(spark):
    schema = "page_id long, url string"
    assert urlfilter.filter_urls(spark.createDataFrame([], schema)).collect() == []
    rows = urlfilter.filter_urls(spark.createDataFrame(
        [(None, "http://a.net/"), (2, "http://a.net/"), (2, "http://a.net/")], schema)).collect()
    assert [r["verdict"] for r in rows] == ["block"] * 3
