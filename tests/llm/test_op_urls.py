import re

import brute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from moundflow.llm import url_filter as U

URLS = [None, "", "no scheme", "http://", "://", "HTTP://WWW.Example.ORG/es/1?x=1&y=2#f", "http://example.org/es", "http://example.org/es/", "http://a.example.org/en/12",
        "http://notexample.org/es/", "https://x.com/fr/a://b/de/", "https://com/de/9", "https://x.com/de/#q", "http://ÄÖ.org/", "http://x.org", "http://x.org?/fr/", "ftp://u@h.com:80/fr/x",
        "http://x.net/" + "a/" * 5000 + "?" + "&".join(["k=v"] * 2000), "http://a\nb.org/x\ny", "http://example.org/es/1", "http://example.org/es/1"]


def brute_parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def brute_rule(host, path):
    best = (None, None)
    for say, r in U.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(r) > len(best[1] or ""):
            best = (say, r)
    return best


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.1/pages.parquet")


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u, "x", 1.0, None) for i, u in enumerate(URLS)], "page_id long, url string, rule string, __p double, html string")
    out = U.filter_urls(df, U.UrlModel(None, {}, 0.0))
    assert out.columns == ["page_id", "url", "__p", "html", "host", "path", "rule", "verdict"]
    for r in out.collect():
        host, path = brute_parts(URLS[r["page_id"]])
        say, rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, say or "allow")


def test_trees_learn_held_out_urls(spark, pages):
    labelled = U.rule_labels(pages).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(3)))
    model = U.train(labelled.where("fold > 0"), trees=5)
    held = U.with_parts(labelled.where("fold = 0"), "url")
    out = model.score(held, "url").select("blocked", "__blocked").toPandas()
    assert (out.blocked == out.__blocked).mean() > 0.9 > max(out.blocked.mean(), 1 - out.blocked.mean()) - 0.05
    odd = U.filter_urls(spark.createDataFrame([(u,) for u in URLS], "url string"), model).collect()
    assert len(odd) == len(URLS) and {r["verdict"] for r in odd} <= {"allow", "block"}


def test_fit_repeats_and_has_no_python(spark, pages):
    a = U.train(U.rule_labels(pages), max_urls=300, trees=3)
    b = U.train(U.rule_labels(pages.repartition(6)), max_urls=300, trees=3)
    assert a.trees.toDebugString.split("\n", 1)[1] == b.trees.toDebugString.split("\n", 1)[1]
    plan = U.filter_urls(pages, a)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_features(spark):
    df = U.lexical(U.with_parts(spark.createDataFrame([("https://ab.org/x/1?a=1&b=2#z",), ("",), (None,)], "url string"), "url"), "url")
    r, empty, null = df.collect()
    u = "https://ab.org/x/1?a=1&b=2#z"
    import math
    from collections import Counter
    h = -sum(c / len(u) * math.log2(c / len(u)) for c in Counter(u).values())
    assert (r["__url_length"], r["__depth"], r["__n_params"], r["__is_https"], r["__has_fragment"]) == (len(u), 2, 2, 1, 1)
    assert r["__digit_ratio"] == pytest.approx(3 / len(u)) and r["__entropy"] == pytest.approx(h)
    assert empty["__entropy"] == null["__entropy"] == 0 and null["__url_length"] == 0


def test_no_labels_one_class_empty(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    assert U.train(U.rule_labels(df.where("false"))).trees is None
    blocked = U.train(spark.createDataFrame([("a", 1), ("b", 1), (None, 1), ("c", None)], "url string, blocked int"))
    assert {r["verdict"] for r in U.filter_urls(df, blocked).collect() if r["rule"] is None} == {"block"}
    assert U.filter_urls(df.where("false"), blocked).count() == 0


def test_columns_of_any_name_are_kept(spark):
    """Names the features and the trees use, dots, the four results' own."""
    from moundflow.llm import url_filter as U
    urls = [f"https://{h}/{p}/{i}" for i in range(30) for h, p in (("a.org", "x"), ("b.com", "de"), ("c.com", "fr"), ("d.net", "q"))] + [None, ""]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    model = U.train(U.rule_labels(pages))
    assert model.trees is not None
    names = ["url", "probability", "rawPrediction", "__host", "__url_length", "__rate_tld", "__blocked", "__features", "a.b", "c0", "Host"]
    odd = pages.select(*[F.col("url").alias(n) if n == "url" else F.concat(F.lit(n), F.coalesce("url", F.lit(""))).alias(n) for n in names])
    out = U.filter_urls(odd, model)
    assert out.columns == [*names[:-1], "host", "path", "rule", "verdict"]
    plain = {r.url: r.verdict for r in U.filter_urls(pages, model).collect()}
    for r in out.collect():
        d = r.asDict()
        assert all(d[n] == n + (d["url"] or "") for n in names[1:-1]) and d["verdict"] == plain[d["url"]]
