"""Learned verdicts of hosts."""


def test_truly_bad_hosts_are_blocked(spark):
    from trailframe.llm import urls

    pages = [(i, f"http://{h}/p{i}") for i, h in enumerate(h for h in ("bad.net", "good.org", "fair.com") for _ in range(40))]
    outcomes = [(i, int(u.startswith("http://bad") or ("fair" in u and i % 4 == 0))) for i, u in pages if i % 40 < 30]
    found = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), ()).collect()
    assert {(r.host, r.verdict) for r in found} == {("bad.net", "block"), ("good.org", "allow"), ("fair.com", "allow")}
