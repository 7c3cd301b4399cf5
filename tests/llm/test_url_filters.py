import math
from collections import Counter

from folioquery.llm.url_filters import ALPHABET, END, ORDER, PRIOR, START, judge, language_model, with_rules


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "page_id long, url string, rule string, n int")


def test_rules_hosts_and_paths(spark):
    cases = {
        "http://a.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "https://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
        "https://other.net/de/": ("other.net", "/de/", "net/de/", "allow"),
        "x://org/es/1#top": ("org", "/es/1", "org/es/", "block"),
        "x://forg/es/1": ("forg", "/es/1", None, None),
        "http://É.com?x=://y.com/en/": ("É.com", "", None, None),
        "http://a.com:80/en/": ("a.com:80", "/en/", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        "http://": ("", "", None, None),
    }
    rows = list(enumerate(cases)) + [(None, None)]
    got = {r.page_id: tuple(r)[1:] for r in with_rules(frame(spark, rows)).collect()}
    assert got == {**{i: cases[u] for i, u in enumerate(cases)}, None: ("", "", None, None)}


def urls(n=400):
    out = []
    for i in range(n):
        good = i % 2
        out.append((i, f"http://site{i % 9}.example.{'net/de' if good else 'com/en'}/{'story' if good else 'casino'}-{i * 37 % 101 % 70}"))
    return out


def test_model_matches_brute_force(spark):
    judged = with_rules(frame(spark, urls(60)))
    got = {r.gram: r.llr for r in language_model(judged).collect()}
    import hashlib

    counts = {"allow": Counter(), "block": Counter()}
    grams = set()
    for r in judged.collect():
        text = r.host + r.path
        s = START * ORDER + text + END
        mine = [s[i : i + ORDER + 1] for i in range(len(text) + 1)]
        grams.update(mine)
        if r.ruling and int(hashlib.md5(text.encode()).hexdigest()[:7], 16) % 5:
            counts[r.ruling].update(mine)

    def p(c, gram, k):
        if k < 0:
            return 1 / ALPHABET
        tail = gram[len(gram) - k - 1 :]
        seen = sum(n for g, n in c.items() if g.endswith(tail))
        context = sum(n for g, n in c.items() if g[:-1].endswith(tail[:-1]))
        return (seen + PRIOR * p(c, gram, k - 1)) / (context + PRIOR)

    assert set(got) == grams
    for g in sorted(grams)[:80]:
        assert abs(got[g] - 1e6 * math.log(p(counts["allow"], g, ORDER) / p(counts["block"], g, ORDER))) <= 1


def test_unruled_pages_follow_the_models(spark):
    extra = [(1000, "http://new.example.org/xx/story-5"), (1001, "http://new.example.org/xx/casino-5"), (1001, "http://new.example.org/xx/casino-5"), (None, None)]
    got = [(r.page_id, r.verdict) for r in judge(frame(spark, urls() + extra)).where("rule is null").collect()]
    assert len(got) == 4
    assert (1000, "allow") in got and got.count((1001, "block")) == 2


def test_no_labels_and_empty(spark):
    assert judge(frame(spark, [])).count() == 0
    assert [r.verdict for r in judge(frame(spark, [(1, "http://a.b/c"), (1, "http://a.b/c" + "d" * 3000)])).collect()] == ["allow", "allow"]


def test_long_urls_cost_no_more_than_their_length(spark):
    rows = urls(100) + [(1, "http://long.example.org/" + "story-" * 150_000), (2, "http://long.example.org/" + "casino" * 50_000)]
    got = {r.page_id: (r.verdict, len(r.path)) for r in judge(frame(spark, rows)).where("rule is null").collect()}
    assert got == {1: ("allow", 900_001), 2: ("block", 300_001)}
