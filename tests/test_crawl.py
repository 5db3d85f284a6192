from __future__ import annotations

import random

import pytest

from pagemill.operators import crawl

# links by page, pages that failed, pages without content, limit, expected order; every path is on one host
CASES = [
    ({"0": "12", "1": "3", "2": "3"}, "", "", 9, "0123"),
    ({"0": "21", "1": "3", "2": "4"}, "", "", 9, "02143"),  # a parent's rank decides, not the child's name
    ({"0": "1", "1": "02", "2": "2"}, "", "", 9, "012"),  # circles and self-links
    ({"0": "12", "1": "3", "2": "4"}, "1", "", 9, "024"),  # a failed page leads nowhere
    ({"0": "12", "1": "3", "2": "4"}, "", "1", 9, "0234"),  # a page without content is passed through
    ({"0": "12", "1": "3", "2": "4"}, "", "12", 2, "03"),  # and takes no place in the limit
    ({"0": "1112", "2": "13"}, "", "", 3, "012"),
    ({"0": "1"}, "0", "", 5, ""),
    ({}, "", "", 1, "0"),
]


def order_of(spark, sites):
    targets = [(f"t{s}", f"http://h{s}/0", limit) for s, (_, _, _, limit) in enumerate(sites)]
    pages, links = [], []
    for s, (out, failed, empty, _) in enumerate(sites):
        names = {"0", *out, *(c for tos in out.values() for c in tos if len(c) == 1)}
        pages += [(f"http://h{s}/{n}", n not in failed, n not in empty) for n in names]
        links += [(f"http://h{s}/{n}", i, f"http://h{s}/{to}") for n, tos in out.items() for i, to in enumerate(tos)]
        links += [(f"http://h{s}/0", 98, "http://other/1"), (f"http://h{s}/0", 99, "mailto:x"), (f"http://h{s}/0", 97, f"http://h{s}:80/1")]
    rows = crawl.crawl_order(
        spark.createDataFrame(targets, "target string, url string, page_limit int"),
        spark.createDataFrame(pages, "url string, ok boolean, has_content boolean"),
        spark.createDataFrame(links, "src_url string, pos int, abs_url string"),
    ).orderBy("target", "doc_ord").collect()
    found: list[list[str]] = [[] for _ in sites]
    for r in rows:
        own = found[int(r.target[1:])]
        own.append(r.url.rsplit("/", 1)[1])
        assert r.doc_ord == len(own)
    return found


@pytest.mark.parametrize("rows", [2, 10**6])  # numbered across partitions, and in a window
def test_hand_made_sites(spark, monkeypatch, rows):
    monkeypatch.setattr(crawl, "_WINDOW_ROWS", rows)
    got = order_of(spark, [case[:4] for case in CASES])
    assert ["".join(g) for g in got] == [case[4] for case in CASES]


def test_random_sites_keep_the_rules(spark):
    rng = random.Random(5)
    sites = []
    for _ in range(12):
        names = "0123456789abcd"[: rng.randint(1, 14)]
        out = {n: "".join(rng.choice(names) for _ in range(rng.randint(0, 4))) for n in names}
        failed, empty = ("".join(n for n in names if rng.random() < share) for share in (0.15, 0.3))
        sites.append((out, failed, empty, rng.randint(1, 8)))
    for (out, failed, empty, limit), got in zip(sites, order_of(spark, sites)):
        far = {n: 99 for n in out} | {"0": 0}
        for _ in out:  # shortest distances over pages that were fetched
            far |= {to: min(far[to], far[n] + 1) for n in out if n not in failed for to in out[n] if far[n] < 99}
        fit = {n for n in out if far[n] < 99 and n not in failed and n not in empty}
        assert len(got) == len(set(got)) == min(limit, len(fit)) and set(got) <= fit
        assert [far[n] for n in got] == sorted(far[n] for n in fit)[: len(got)]


def test_levels_cost_the_same(spark):
    """Jobs grow by as many with each level, however many levels came before."""
    links = spark.createDataFrame([(f"http://h/{i}", 0, f"http://h/{i + 1}") for i in range(9)], "src_url string, pos int, abs_url string")
    pages = spark.createDataFrame([(f"http://h/{i}", True, True) for i in range(10)], "url string, ok boolean, has_content boolean")
    seeds = spark.createDataFrame([("t", "http://h/0", 99)], "target string, url string, page_limit int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else each shuffle and broadcast is a job of its own
    try:
        jobs = {}
        for depth in (1, 2, 4, 7):
            group = f"crawl-{depth}"
            spark.sparkContext.setJobGroup(group, group)
            assert crawl.crawl_order(seeds, pages, links, depth).count() == depth + 1
            jobs[depth] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[2] - jobs[1] == (jobs[7] - jobs[4]) // 3 == (jobs[4] - jobs[2]) // 2
