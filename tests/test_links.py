"""Links of pages with many anchors in one block: what is written grows with the page, not with its square."""

import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import discovery as op
from gleaner.sources.html import with_nodes

PAGE = """<html><head><title>t</title></head><body>
<ul class="news  list"><li id="one"><a href="/a.html">First</a> <span>2024-05-06</span></li>
<li>  <a href="b.html#x">Second  one</a>tail</li></ul>
<div class="box"><a href="/c">C</a> 2023-01-02 text <b>bold</b></div>
<div id="wide">{filler}<p><a href="/d">D</a></p><a href="/e">E</a></div>
<a href="#">none</a><a href="  ">blank</a>
</body></html>""".replace("{filler}", "word " * 60)


def pages(spark, *htmls):
    return spark.createDataFrame([(i, "http://h.example.com/x/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def found(spark):
    return op.extract_links(with_nodes(pages(spark, PAGE)))


def test_contexts_are_stretches_of_the_page_text(found, spark):
    text = {r.page_id: r.text for r in op.page_texts(with_nodes(pages(spark, PAGE))).collect()}
    rows = {r.url: r for r in found.collect()}
    around = {u.rsplit("/", 1)[1]: text[r.page_id][r.context_start : r.context_end] for u, r in rows.items()}
    assert around["a.html"] == "First 2024-05-06" and around["b.html"] == "Second  one tail" and around["c"] == "C 2023-01-02 text bold"
    assert around["d"] == "D"
    # no row tag around it, and a block too long to be a row: the parent itself
    assert around["e"].startswith("word word") and around["e"].endswith("D E")
    assert rows["http://h.example.com/a.html"].parent_id == "one"


def test_texts_are_cut_only_where_asked(found, spark):
    nodes = with_nodes(pages(spark, PAGE))
    whole = {r.url: r.surrounding_text for r in op.extract_links(nodes, context="whole").collect()}
    short = {r.url: r.surrounding_text for r in op.extract_links(nodes, context=10).collect()}
    assert "surrounding_text" not in found.columns
    assert whole["http://h.example.com/c"] == "C 2023-01-02 text bold" and len(whole["http://h.example.com/e"]) > 290
    assert short == {u: t[:10] for u, t in whole.items()}


def test_many_anchors_in_one_block(spark):
    def spent(n):
        html = "<div>" + "".join(f'<a href="/p/{i}.html">anchor number {i}</a> ' for i in range(n)) + "</div>"
        links = op.extract_links(with_nodes(pages(spark, html)))
        start = time.perf_counter()
        row = links.select(F.count("*").alias("n"), F.sum(F.length("url") + F.length("text")).alias("chars"), F.max("context_end").alias("upto")).first()
        return time.perf_counter() - start, row

    spent(100)
    (fast, small), (slow, large) = spent(2000), spent(4000)
    assert small.n == 2000 and large.n == 4000
    assert large.chars < 2.2 * small.chars and large.upto < 2.2 * small.upto
    assert slow < 4 * fast + 2
