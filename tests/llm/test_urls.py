"""URL filter: splitting, rules, templates, and SQL on odd rows."""

import duckdb
import pytest

from latticeloom.llm import urls
from latticeloom.llm.queries import RULES
from tools.check_queries import compare

SCHEMA = "page_id long, url string, host string, shape string, n int, key string"

ODD = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.com", "http://example.com/en", "http://example.com/en/", "x://a.COM/En/1",
       "http://www.example.com/en/7?x=http://net/es/", "http://a.net/es/1#f", "http://a.net?q", "http://a.net#es/", "http://Ünï.NET/fr/é",
       "a\nb://c.net/fr/\n1/2", "http://u@a.net:80/es/", "http://notexample.com/en/1", "://.com/", "http://net/es/1",
       "http://a.org/" + "/".join("abcdefgh"), "http://a.org/" + "z" * 100_000, "http://a.org//", "http://a.org/0123456789abcdef/x",
       "http://a.org/<n>/*", "http://a.org/don't/" + "9" * 50]


def judged(spark, rows, rules=RULES, **more):
    pages = spark.createDataFrame([(i, u, "h", "s", 1, "k") for i, u in rows], SCHEMA)
    return urls.judge_urls(pages, rules, **more)


def test_split_and_rules(spark):
    got = {r["page_id"]: r for r in judged(spark, enumerate(ODD)).collect()}
    assert len(got) == len(ODD)
    by_url = {u: got[i] for i, u in enumerate(ODD)}
    for u in (None, "", "no scheme", "://", "http://"):
        assert tuple(by_url[u])[1:5] == ("", "", None, "allow")
    want = {"HTTP://EXAMPLE.com": ("example.com", "", None), "http://example.com/en": ("example.com", "/en", "com/"),
            "http://example.com/en/": ("example.com", "/en/", "example.com/en/"), "x://a.COM/En/1": ("a.com", "/En/1", "com/"),
            "http://www.example.com/en/7?x=http://net/es/": ("www.example.com", "/en/7", "www.example.com/en/"),
            "http://a.net/es/1#f": ("a.net", "/es/1", "net/es/"), "http://a.net?q": ("a.net", "", None), "http://a.net#es/": ("a.net", "", None),
            "http://Ünï.NET/fr/é": ("Ünï.net", "/fr/é", "net/fr/"), "a\nb://c.net/fr/\n1/2": ("c.net", "/fr/\n1/2", "net/fr/"),
            "http://u@a.net:80/es/": ("u@a.net:80", "/es/", None), "http://notexample.com/en/1": ("notexample.com", "/en/1", "com/"),
            "://.com/": (".com", "/", "com/"), "http://net/es/1": ("net", "/es/1", "net/es/")}
    for u, (host, path, rule) in want.items():
        assert (by_url[u]["host"], by_url[u]["path"], by_url[u]["rule"]) == (host, path, rule), u
    assert [by_url[u]["verdict"] for u in ("http://example.com/en/", "http://example.com/en", "http://a.net/es/1#f")] == ["block", "allow", "block"]


def test_ties_of_rules():
    order = urls.ordered([("allow", "com/abc"), ("block", "b.com/a"), ("allow", "b.com/a")])
    assert order == [("block", "b.com", "/a"), ("allow", "b.com", "/a"), ("allow", "com", "/abc")]


def tree_rows():
    rows = [f"http://a.org/{lang}/{i}.html" for lang in ("good", "spam") for i in range(60)]
    rows += [f"http://a.org/blog/{a}{b}-story" for a in "abcdefghij" for b in "klmnopqr"]
    return list(enumerate(rows)) + [(1000 + i, f"http://b.org/post/{'xyz'[i % 3] * (i % 7 + 1)}/{i}") for i in range(50)]


def test_templates(spark):
    from pyspark.sql import functions as F
    label = F.when(F.col("page_id") % 2 == 0, F.col("url").contains("/spam/"))
    got = judged(spark, tree_rows(), rules=[], label=label).collect()
    of = {r["page_id"]: r for r in got}
    # half of the spam urls are labelled; the others share their template
    assert {of[i]["verdict"] for i in range(60, 120)} == {"block"} and of[61]["template"] == "/spam/<n>.html"
    assert {r["verdict"] for r in got if not 60 <= r["page_id"] < 120} == {"allow"}
    assert {of[i]["template"] for i in range(120, 200)} == {"/blog/*"}            # rare segments
    assert {of[i]["template"] for i in range(1000, 1050)} == {"/post/*/<n>"}      # alike branches


@pytest.mark.parametrize("rows", [list(enumerate(ODD)), tree_rows() + [(i % 3, f"http://s{i % 2}.net/{p}/{i}") for p in ("es", "en", "de")
                                                                        for i in range(40)] * 2, []])
def test_sql(spark, rows):
    got = judged(spark, rows).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    if rows:
        con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    if not rows:
        assert len(got) == 0
    else:
        assert compare(got, con.execute(urls.urls_sql(RULES)).df()) == ""


def test_no_python(spark):
    plan = judged(spark, [(1, "http://a.org/x")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
