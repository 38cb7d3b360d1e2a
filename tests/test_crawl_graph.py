"""Crawls over a graph of links against a plain breadth-first search."""

import random

import pytest

from heartwood.operators import crawl


def plain(pages, start, depth, max_pages=None):
    """(url, level, found) of a breadth-first search over {url: links}."""
    out, frontier, seen, found = [], [start], {start}, 0
    for level in range(depth + 1):
        frontier = sorted(frontier)
        if max_pages is not None:
            there = [u for u in frontier if u in pages][: max_pages - found]
            if len(there) == max_pages - found:
                frontier = [u for u in frontier if u <= there[-1]]
        out += [(u, level, u in pages) for u in frontier]
        found += sum(u in pages for u in frontier)
        if max_pages is not None and found >= max_pages:
            break
        onward = {v for u in frontier if u in pages for v in pages[u]} - seen
        seen |= onward
        frontier = list(onward)
        if not frontier:
            break
    return sorted(out)


def web(rng, n):
    url = lambda k: f"http://h{k % 5}.test/p/{k}"
    return {url(k): [url(rng.randrange(n + 10)) for _ in range(rng.randrange(4))] for k in range(n)}


@pytest.mark.parametrize("most", [None, 1, 17])
def test_graph_crawls(spark, tmp_path, most):
    rng = random.Random(3)
    pages = web(rng, 60)
    html = lambda links: "".join(f'<a href="{u}#x">y</a>' for u in links)
    rows = [(u, html(v), 200) for u, v in pages.items()] + [(list(pages)[1], html(pages[list(pages)[1]]), 200), ("http://h0.test/p/61", html(["http://h0.test/p/1"]), 500)]
    df = spark.createDataFrame(rows, "url string, html string, status_code int")
    start = next(iter(pages))
    pages = {u: set(v) for u, v in pages.items()}
    graph = crawl.LinkGraph.build(df, str(tmp_path / "g"))
    want = plain(pages, start, 5, most)
    assert sorted(tuple(r) for r in graph.crawl(start, 5, most, same_domain=False).collect()) == want
    told = graph.statistics().first()
    assert (told["success_count"], told["failed_count"]) == (sum(f for *_, f in want), sum(not f for *_, f in want))
    graph.crawl(start, 1, most, same_domain=False, name="part")
    again = crawl.LinkGraph(spark, graph.path)
    assert sorted(tuple(r) for r in again.crawl(start, 5, most, same_domain=False, name="part").collect()) == want


def test_same_domain_reads_one_folder_and_unknown_starts(spark, tmp_path):
    rows = [("http://a.test/", '<a href="/x">x</a><a href="http://b.test/">b</a>'), ("http://a.test/x", None), ("http://b.test/", '<a href="http://a.test/x">')]
    graph = crawl.LinkGraph.build(spark.createDataFrame(rows, "url string, html string"), str(tmp_path / "g"))
    assert sorted(tuple(r) for r in graph.crawl("http://a.test/", 3).collect()) == [("http://a.test/", 0, True), ("http://a.test/x", 1, True)]
    assert [tuple(r) for r in graph.crawl("http://nowhere.test/", 3).collect()] == [("http://nowhere.test/", 0, False)]
