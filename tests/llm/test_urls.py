"""URL filters: parsing, fixed rules, and mined rules against exhaustive search."""

import itertools
import math
import random
import re

import pytest

from cohortspark.llm import urls
from cohortspark.llm.queries import op2_url_association

CASES = [
    (None, "", "", None), ("no scheme", "", "", None), ("http://A.NET/x?y#z", "a.net", "/x", "net/"), ("https://net/", "net", "/", "net/"),
    ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/"), ("http://www.example.net/EN/1", "www.example.net", "/EN/1", "net/"),
    ("x://m.Example.com/de/", "m.example.com", "/de/", "example.com/de/"), ("http://notexample.com/de/", "notexample.com", "/de/", None),
    ("http://a.org/fr/b", "a.org", "/fr/b", "org/fr/"), ("http://a.org", "a.org", "", None), ("http://a.net?q", "a.net", "", None),
    ("http://É.org/fr/", "É.org", "/fr/", "org/fr/"), ("a://b\nc/d\ne#f", "b\nc", "/d\ne", None), ("://h.net/", "h.net", "/", "net/"), ("a://b://c/d", "b:", "//c/d", None),
]


def test_parsing_and_fixed_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "v") for i, c in enumerate(CASES)], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = {r.page_id: r for r in urls.judge(pages, none).collect()}
    verdicts = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", None: "allow"}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdicts[rule])
    assert urls.judge(pages.limit(0), none).collect() == []


def tokens(url):
    m = re.match(r"(?s)([A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url)
    out = {f"scheme:{m[1].lower()}"} | {f"host:{x}" for x in m[2].lower().split(".") if x}
    out |= {f"path:{x}" for x in re.split("[/.]", m[3].lower()) if x and not x.isdigit()}
    return out | {f"query:{x.split('=')[0]}" for x in (m[4] or "").split("&") if x}


def brute_rules(rows, support, confidence, odds):
    """Every subset of every bad url's tokens; tokens of the same urls as one."""
    sets = [(tokens(u), b) for u, b in rows]
    bad, total = sum(b for _, b in sets), len(sets)
    least = max(urls.MIN_HITS, support * total)
    where = {}
    for i, (t, _) in enumerate(sets):
        for x in t:
            where.setdefault(x, set()).add(i)
    groups = {}
    for x, at in where.items():
        if sum(sets[i][1] for i in at) >= least:
            groups.setdefault(frozenset(at), []).append(x)
    groups = {min(g): sorted(g) for g in groups.values()}
    found = {}
    for size in range(1, 9):
        for combo in {c for t, b in sets if b for c in itertools.combinations(sorted(t & groups.keys()), size)}:
            if any(set(r) < set(combo) for r in found):
                continue
            at = set.intersection(*[where[x] for x in combo])
            hits, n = sum(sets[i][1] for i in at), len(at)
            p, z = hits / n, 1.96
            low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if hits >= least and p >= confidence and hits * (total - bad) >= (n - hits) * odds * bad and low >= bad / total:
                found[combo] = p
    return {tuple(sorted(x for t in r for x in groups[t])): p for r, p in found.items()}


def noisy_urls():
    rng = random.Random(6)
    for i in range(300):
        host, word = rng.choice(["good.org", "spam.com", "mix.org"]), rng.choice(["casino", "news", "a"])
        bad = rng.random() < (0.95 if host == "spam.com" else 0.9 if (host, word) == ("mix.org", "casino") else 0.05)
        yield f"http{'s' * rng.randrange(2)}://{host}/{word}/{i}?ref={i}", bad


def four_together():
    """Bad only where four words meet; every three of them stand in good urls."""
    words = ["w", "x", "y", "z"]
    for i in range(240):
        some = [w for k, w in enumerate(words) if i >> k & 1]
        yield f"http://h{i % 3}.org/{'/'.join(some)}/{i}", len(some) == 4


@pytest.mark.parametrize("limit", [0, 4 << 20])
@pytest.mark.parametrize("rows", [list(noisy_urls()), list(four_together())], ids=["noisy", "four"])
def test_mined_rules(spark, monkeypatch, rows, limit):
    """Rules and matches, with the index in the tasks and joined by a shuffle."""
    monkeypatch.setattr(urls, "INDEX_BYTES", limit)
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = urls.mine_rules(labelled, 0.01, 0.6, 2.0)
    got = {tuple(r.tokens): r.confidence for r in rules.collect()}
    want = brute_rules(rows, 0.01, 0.6, 2.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(got) >= 1
    if rows[0][0].startswith("http://h"):
        assert list(got) == [("path:w", "path:x", "path:y", "path:z")]
    pages = spark.createDataFrame([(u, "x") for u, _ in rows] + [(None, "y"), ("http://spam.com/", "z")] * 2, "url string, blocked_by string")
    found = urls.matches(pages, rules)
    assert sorted(found.columns) == ["blocked_by", "url"] and found.count() == len(rows) + 4
    for r in found.collect():
        met = [" ".join(k) for k in want if r.url and tokens(r.url) >= set(k)]
        assert r.blocked_by == min(met, default=None)


def test_long_urls_and_repeats(spark):
    """A url of many tokens that a third of all rows repeat, and a very long one."""
    hot, long_ = "http://spam.com/" + "/".join(f"a{i}x" for i in range(60)), "http://long.org/" + "/".join(f"b{i}x" for i in range(20_000))
    rows = [(hot, True)] * 40 + [(f"http://good.org/{i}", False) for i in range(80)] + [(long_, False)]
    rules = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    assert [set(r.tokens) for r in rules.collect()] == [tokens(hot) - {"scheme:http"}]
    pages = spark.createDataFrame([(1, hot, "h"), (2, long_, None), (3, hot[:-4], "")], "page_id long, url string, HOST string")
    got = urls.judge(pages, spark.createDataFrame(rows, "url string, bad boolean"), rules=())
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow", 3: "allow"} and got.columns.count("host") == 1


def test_query(spark):
    rows = op2_url_association(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 50 and any(r.blocked_by for r in rows)
    for r in rows:
        assert r.verdict == {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}.get(r.rule, "block" if r.blocked_by else "allow")


def test_labels_by_number(spark):
    pages = spark.createDataFrame([("http://a/en/12.html",), ("http://a/en/12/",), ("http://a/12/x",), (None,), ("http://a/9?z=12",)], "url string")
    labels = spark.createDataFrame([(12, 1, 0), (12, 0, 0), (9, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted((r.url, r.bad) for r in urls.labelled_urls(pages, labels).collect())
    assert got == [("http://a/9?z=12", False), ("http://a/en/12.html", True), ("http://a/en/12/", True)]


@pytest.mark.parametrize(("good_rows", "bad_rows"), [(30, 70), (50, 50), (60, 40)])
def test_rules_at_any_share_of_bad_labels(spark, good_rows, bad_rows):
    """A pure set becomes a rule, one as bad as all urls does not."""
    rows = [(f"http://good.org/a{i}/x", False) for i in range(good_rows)] + [(f"http://spam.com/b{i}/x", True) for i in range(bad_rows)]
    rules = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), 0.01)
    assert {tuple(r.tokens) for r in rules.collect()} == {("host:com", "host:spam")}
    less_pure = rows + [(f"http://spam.com/c{i}/x", False) for i in range(bad_rows // 14)]
    rules = urls.mine_rules(spark.createDataFrame(less_pure, "url string, bad boolean"), 0.01)
    assert {tuple(r.tokens) for r in rules.collect()} == {("host:com", "host:spam")}
    assert urls.mine_rules(spark.createDataFrame([(u, True) for u, _ in rows], "url string, bad boolean")).count() == 0
