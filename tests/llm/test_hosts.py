from lodegrid.llm import hosts
from lodegrid.llm.queries import URL_RULES

PAGES, OUTCOMES = "page_id bigint, url string", "page_id bigint, bad int"


def judged(spark, urls, outcomes=(), rules=()):
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    out = hosts.judge(pages, spark.createDataFrame(list(outcomes), OUTCOMES), list(rules))
    return {r.page_id: r for r in out.collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "http://b.net/es/3", "http://net/fr/", "ftp://b.net/fr",
            "http://com", "no scheme", None, "http://notexample.com/en/", "x://h?a://b/", "http://u.example.com/EN/", ""]
    got = judged(spark, urls, rules=URL_RULES)
    assert [(got[i].host, got[i].path) for i in range(12)] == [
        ("a.example.com", "/en/1"), ("www.example.com", "/en/2"), ("b.net", "/es/3"), ("net", "/fr/"), ("b.net", "/fr"), ("com", ""),
        ("", ""), ("", ""), ("notexample.com", "/en/"), ("h", ""), ("u.example.com", "/EN/"), ("", "")]
    assert [got[i].rule for i in range(12)] == [
        "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, "com/", None, "com/", None]
    assert [got[i].verdict for i in range(5)] == ["block", "allow", "block", "block", "allow"]


def test_bad_hosts_are_blocked_and_small_ones_shrink_to_their_domain(spark):
    urls = [f"http://{h}/" for h, n in (("bad.one.org", 60), ("good.one.org", 60), ("new.bad.org", 1), ("a.bad.org", 40), ("b.bad.org", 40), ("fine.co.uk", 30)) for _ in range(n)]
    bad = [("bad.one.org" in u or "bad.org" in u) and "good" not in u for u in urls]
    got = judged(spark, urls, [(i, int(b)) for i, b in enumerate(bad) if "new." not in urls[i]])
    by_host = {r.host: r for r in got.values()}
    assert {h for h, r in by_host.items() if r.verdict == "block"} == {"bad.one.org", "a.bad.org", "b.bad.org", "new.bad.org"}
    assert by_host["good.one.org"].below_limit > by_host["new.bad.org"].below_limit > by_host["a.bad.org"].below_limit


def test_no_labels_and_empty_tables(spark):
    assert {r.verdict for r in judged(spark, ["http://a.b/", None], [(0, None)]).values()} == {"allow"}
    pages = spark.createDataFrame([], PAGES)
    assert hosts.judge(pages, spark.createDataFrame([], OUTCOMES), URL_RULES).count() == 0


def beta_below(a, b, n=400_000):
    """The same share by a fine sum over the rate itself, for a and b of at least one."""
    import numpy as np
    t = (np.arange(n) + 0.5) / n
    f = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t)
    f = np.exp(f - f.max())
    return f[: n // 2].sum() / f.sum()


def test_posterior_shares_match_a_fine_sum(spark):
    import math
    cases = [(1.0, 1.0), (2.0, 1.0), (9.5, 4.0), (60.0, 45.0), (500.0, 440.0), (1.0, 30.0), (3.0, 1.0), (25.0, 1.5), (5000.0, 1.0), (0.0, 3.0), (2.0, 0.0)]
    df = spark.createDataFrame(cases, "a double, b double")
    got = {(r.a, r.b): r.p for r in df.withColumn("p", hosts.below_limit(df.a, df.b)).collect()}
    for a, b in cases[:9]:
        assert abs(got[a, b] - beta_below(a, b)) < 2e-3 * max(0.05, beta_below(a, b)), (a, b)
    assert math.isclose(got[3.0, 1.0], 0.125, rel_tol=5e-3) and got[0.0, 3.0] == 1.0 and got[2.0, 0.0] == 0.0


def test_suffixes_from_a_table_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b.gov.xy/"), (1, "http://a.b.gov.xy/"), (2, "http://c.b.gov.xy/"), (3, "http://d.e.gov.xy/")], PAGES)
    table = spark.createDataFrame([("gov.xy",), ("gov.xy",)], "suffix string")
    found = {r.host: (r.suffix, r.domain) for r in hosts.with_domains(pages.selectExpr("substring_index(url, '/', -2) AS h").selectExpr("substring_index(h, '/', 1) AS host"), table).collect()}
    assert found == {"a.b.gov.xy": ("gov.xy", "b.gov.xy"), "c.b.gov.xy": ("gov.xy", "b.gov.xy"), "d.e.gov.xy": ("gov.xy", "e.gov.xy")}
    out = hosts.judge(pages, spark.createDataFrame([(1, 1), (1, 1), (3, 0)], OUTCOMES), [], table)
    assert sorted(r.page_id for r in out.collect()) == [1, 1, 2, 3]
    assert {r.host: r.n for r in hosts.reputations(pages, spark.createDataFrame([(1, 1), (3, None)], OUTCOMES), table).collect()} == {"a.b.gov.xy": 2, "c.b.gov.xy": 0, "d.e.gov.xy": 0}
