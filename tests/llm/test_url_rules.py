from itertools import combinations

import pytest

from quern.llm import url_rules as U

from ..compare import DATA, same


def test_against_sql(spark):
    same(spark, lambda s, d: U.judge(s.read.parquet(f"{d}/pages.parquet"), s.read.parquet(f"{d}/labels.parquet")), U.ORACLE, DATA)


PAGES = [
    (1, "HTTP://Sub.Example.NET/en/x?q#f", ("sub.example.net", "/en/x", "example.net/en/", "allow")),
    (2, "http://example.net/enx", ("example.net", "/enx", "net/", "block")),
    (3, "https://a.example.com/de/", ("a.example.com", "/de/", "example.com/de/", "block")),
    (4, "https://badexample.com/de/", ("badexample.com", "/de/", None, "allow")),
    (5, "x://org/fr/?a", ("org", "/fr/", "org/fr/", "allow")),
    (6, "http://w.net", ("w.net", "", None, "allow")),
    (7, "no scheme.net/", ("", "", None, "allow")),
    (8, None, ("", "", None, "allow")),
    (9, "http://a.org#x/fr/", ("a.org", "", None, "allow")),
    (10, "http://a.net?/://b.net/", ("a.net", "", None, "allow")),
    (1, "HTTP://Sub.Example.NET/en/x?q#f", ("sub.example.net", "/en/x", "example.net/en/", "allow")),
    (11, "", ("", "", None, "allow")),
    (12, "http://" + "a." * 2000 + "net/" + "p/" * 5000, ("a." * 2000 + "net", "/" + "p/" * 5000, "net/", "block")),
]


def test_edge_cases(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u, _ in PAGES], "page_id bigint, url string, html string, rule string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = sorted((r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in U.judge(pages, none).collect())
    assert str(got) == str(sorted((i, w) for i, _, w in PAGES))
    assert U.judge(pages.limit(0), none).count() == 0


def counted(sets, letters, need, confidence=0.8):
    """The smallest rules among all sets of items, items being letters of the same rows by the least of them."""
    shown = {}
    for c in letters:
        shown.setdefault(tuple(i for i, (s, _) in enumerate(sets) if c in s), c)
    items = sorted(c for rows, c in shown.items() if len(rows) < len(sets) or sum(bad for _, bad in sets) >= confidence * len(sets))
    out = []
    for n in range(1, len(items) + 1):
        for c in combinations(items, n):
            met = [bad for s, bad in sets if set(c) <= s]
            if sum(met) >= need and sum(met) >= confidence * len(met) and not any(set(x) <= set(c) for x in out):
                out.append(c)
    return set(out)


def test_mined_rules_are_those_of_counting_all_sets(spark):
    import random

    rnd = random.Random(3)
    for extra in ("", "xyz"):
        sets = [({t for t in "abcdef" if rnd.random() < 0.5} | set(extra), rnd.random() < 0.2) for _ in range(300)]
        sets = [(s | ({"g"} if "a" in s else set()), bad or {"a", "b"} <= s or {"c", "d", "e"} <= s) for s, bad in sets]
        rows = spark.createDataFrame([(sorted(s), bad) for s, bad in sets], "terms array<string>, bad boolean")
        got = {tuple(r.terms) for r in U.mine(rows, support=0.05, least=5, confidence=0.8).collect()}
        assert got == counted(sets, "abcdefgxyz", 15) and ("a", "b") in got and ("c", "d", "e") in got


def test_shared_parameters_do_not_multiply(spark):
    import random
    import time

    rnd = random.Random(4)
    always = "&".join(f"utm{k}=v" for k in range(15))
    urls = [(f"http://shop.com/{'win' if i % 4 == 0 else 'read'}/{i}?{always}&{'&'.join(f'k{j}={rnd.randrange(3)}' for j in range(6) if rnd.random() < 0.9)}", i % 4 == 0) for i in range(200)]
    start = time.time()
    got = judged(spark, urls)
    assert time.time() - start < 60 and {m for v, m in got if v == "block"} == {"p=win"} and sum(v == "block" for v, _ in got) == 50


def test_a_mined_rule_blocks(spark):
    pages = spark.createDataFrame([(i, f"http://{'pills' if i % 2 else 'fine'}.shop.com/x/{i}") for i in range(60)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)] + [(3, 0, 0), (None, 0, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.mined) for r in U.judge(pages, labels).collect()}
    assert got[59] == ("block", "h=pills") and got[58] == ("allow", None)


def test_terms_of_the_query(spark):
    urls = ["http://a.b/x?page=2&ref=x+y&&flag&a[1]=Z#q=1", "http://a.b/x#?no=1", None]
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    got = [r[0] for r in u.select(U.terms_of(U.host_of(u.url), U.path_of(u.url), U.query_of(u.url))).collect()]
    assert got == [["h=a", "h=b", "p=x", "q=page", "q=page=n", "q=ref", "q=ref=x", "q=ref=y", "q=flag", "q=a_n", "q=a_n=Z"], ["h=a", "h=b", "p=x"], []]


def judged(spark, urls):
    """urls: (url, bad), every one labelled; (verdict, mined) of each."""
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(not bad), 0) for i, (_, bad) in enumerate(urls)], "doc_id bigint, quality int, toxic int")
    return [(r.verdict, r.mined) for r in U.judge(pages, labels).orderBy("page_id").collect()]


def test_a_rule_of_path_and_query(spark):
    urls = [("http://a.com/win?ref=bonus", True), ("http://a.com/win?ref=mail", False), ("http://a.com/news?ref=bonus", False), ("http://a.com/news", False)] * 10
    got = judged(spark, urls)
    assert got[0] == ("block", "p=win+q=ref=bonus") and {v for v, _ in got[1:4]} == {"allow"}


def test_a_rule_of_four_terms(spark):
    four = ["p1", "p2", "p3", "p4"]
    urls = [("http://a.com/" + "/".join(four), True)] * 10 + [("http://a.com/" + "/".join(x for x in four if x != y), False) for y in four for _ in range(10)]
    got = judged(spark, urls)
    assert got[0] == ("block", "p=p1+p=p2+p=p3+p=p4") and {v for v, _ in got[10:]} == {"allow"}


def test_planted_rules_against_sql(spark, tmp_path):
    """Hosts and paths of bad pages, alone and together, in a table where many verdicts are mined ones; its URLs have three terms, as many as the SQL counts."""
    import random

    rnd, rows, marks = random.Random(11), [], []
    for i in range(600):
        host, path = rnd.choice(["pills", "shop", "news", "farm"]), rnd.choice(["win", "read", "list"])
        bad = host == "pills" or (host == "shop" and path == "win") or rnd.random() < 0.05
        rows.append((i, f"http://{host}/{path}/{i}"))
        if i % 3:
            marks.append((i, int(not bad), 0))
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda s, d: U.judge(s.read.parquet(f"{d}/pages.parquet"), s.read.parquet(f"{d}/labels.parquet"))
    same(spark, run, U.ORACLE, str(tmp_path))
    got = run(spark, str(tmp_path)).groupBy("mined").count().collect()
    assert {r.mined for r in got} == {"h=pills", "h=shop+p=win", None} or sum(r["count"] for r in got if r.mined) > 150


@pytest.mark.parametrize("name", ["url_rules", "decontaminate"])
def test_no_python_on_the_main_path(name):
    import importlib
    import inspect

    text = inspect.getsource(importlib.import_module(f"quern.llm.{name}"))
    assert not any(w in text for w in ("pandas_udf", "arrow_udf", "mapIn", "applyIn", ".rdd", "import pandas", "F.udf"))
