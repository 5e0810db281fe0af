"""Boundary cases with fixed answers."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators import articles, chunks, crawl, health, pages, reports
from gleaner.sources import sitemaps
from gleaner.sources.html import with_nodes


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, day, grain",
    [
        ("/2023-05-06/a.html", "2023-05-06", "day"),
        ("/2023/05/06/a.html", "2023-05-06", "day"),
        ("/news/2023/5/a.html", "2023-05-01", "month"),
        ("/202305/a.html", "2023-05-01", "month"),
        ("/20260521_12345.html", "2026-05-01", "month"),
        ("/a/2023/b", "2023-01-01", "year"),
        ("/2026/13/x.html", None, None),
        ("/info/1234/20260515234567.htm", None, None),
        ("/1999/05/06/x", None, None),
        ("/2024/2/30/x", "2024-02-01", "month"),
        ("", None, None),
    ],
)
def test_url_date(spark, path, day, grain):
    got = one(spark, D.url_date(F.col("url")), url="https://h.example.com" + path)
    assert (got and str(got["d"]), got and got["g"]) == (day, grain)


@pytest.mark.parametrize(
    "path, inside", [("/2026/05/06/a", True), ("/2026/05/08/a", False), ("/2026/05/a", True), ("/2026/06/a", False), ("/2026/a", True), ("/x", None)]
)
def test_url_in_range(spark, path, inside):
    assert one(spark, D.url_in_range(F.col("url"), "2026-05-04", "2026-05-07"), url="http://h" + path) is inside


@pytest.mark.parametrize(
    "text, day",
    [
        ("5 分钟前", "2024-02-29"), ("昨天", "2024-02-28"), ("前天", "2024-02-27"), ("3天前", "2024-02-26"),
        ("2023年1月2日 2024-01-05", "2024-01-05"), ("见 5月8日", "2024-05-08"), ("版本 1.2", None), ("2024-02-30", None), ("", None),
    ],
)
def test_text_date(spark, text, day):
    got = one(spark, D.text_date(F.col("s"), "2024-02-29"), s=text)
    assert (got and str(got)) == day


def test_week(spark):
    assert str(one(spark, D.week_monday(F.col("w")), w="2026-W01")) == "2025-12-29"
    assert one(spark, D.iso_week(F.col("d").cast("date")), d="2026-01-04") == "2026-W01"


@pytest.mark.parametrize(
    "url, clean",
    [
        ("http://h/a?utm_source=x&b=1#t", "http://h/a?b=1#t"), ("http://h/a?utm_source=x", "http://h/a"),
        ("http://h/a?b=1&ref=2&c=3", "http://h/a?b=1&c=3"), ("http://h/a?reference=1", "http://h/a?reference=1"), ("http://h/a", "http://h/a"),
    ],
)
def test_without_tracking(spark, url, clean):
    assert one(spark, U.without_tracking(F.col("u")), u=url) == clean


def test_allow_rules(spark):
    rules = [U.AllowRule("example.com", "suffix"), U.AllowRule("a.org", "exact"), U.AllowRule("[", "regex"), U.AllowRule(r"^x\d+\.net$", "regex"), U.AllowRule("off.io", "exact", enabled=False)]
    want = {"example.com": True, "www.example.com": True, "notexample.com": False, "a.org": True, "b.a.org": False, "x12.net": True, "off.io": False}
    assert {h: one(spark, U.allowed(F.col("h"), rules), h=h) for h in want} == want


@pytest.mark.parametrize("ip, hit", [("127.0.0.1", True), ("172.31.255.255", True), ("172.32.0.0", False), ("8.8.8.8", False), ("::1", True), ("fd00::1", True), ("febf::1", True), ("fec0::1", False), ("2001:db8::1", False), ("0:0:0:0:0:0:0:1", True), ("::ffff:127.0.0.1", True), ("::FFFF:7f00:1", True), ("::ffff:8.8.8.8", False), ("FE80::1%eth0", True), ("0000:0000::0001", True), ("fd::1", False), ("1::2::3", False), (":::1", False), ("::", False), ("example.com", False), ("", False)])
def test_reserved_ip(spark, ip, hit):
    assert one(spark, U.is_reserved_ip(F.col("ip")), ip=ip) is hit


def test_promotion_boundaries(spark):
    stats = spark.createDataFrame([("a", 3, 2), ("b", 4, 0), ("c", 2, 3), ("d", 9, 1), ("e", None, None)], "domain string, ab_ok bigint, ab_fail bigint")
    assert [(r.domain, r.rate) for r in health.promotions(stats).collect()] == [("d", 0.9), ("a", 0.6)]


def test_health_summary(spark):
    shape = "domain string, " + ", ".join(f"{c} bigint" for c in health.COUNTERS)
    stats = spark.createDataFrame([("a.com", 8, 2, 1, 1, 0, 0), ("b.com", 0, 0, 0, 0, 0, 0), ("c.com", 1, 3, 0, 0, 0, 0)], shape)
    got = health.health_summary(stats).first()
    assert (got.total_attempts, got.fail_count, got.fail_rate) == (16, 6, 0.375)
    assert [(s.domain, s.attempts, s.fail_count, s.fail_rate) for s in got.degraded_sites] == [("a.com", 12, 3, 0.25), ("c.com", 4, 3, 0.75)]
    assert health.health_summary(stats.limit(0)).count() == 0


def test_proxy_score(spark):
    df = spark.createDataFrame([(3, 2, 5000.0), (0, 0, 0.0)], "success_count bigint, fail_count bigint, total_latency double")
    got = [round(r[0], 4) for r in df.select(health.proxy_score_of("success_count", "fail_count", "total_latency")).collect()]
    assert got == [0.66, 1.0]


@pytest.mark.parametrize("done, failed, filtered, status", [(0, 0, 3, "partial_failed"), (2, 0, 1, "completed"), (0, 2, 0, "failed"), (1, 1, 0, "partial_failed"), (0, 0, 0, "completed")])
def test_settle(spark, done, failed, filtered, status):
    assert one(spark, crawl.settle(F.lit(done), F.lit(failed), F.lit(filtered))) == status


def test_simhash(spark):
    import hashlib
    import re

    def expected(text):
        votes = [0] * 64
        for w in re.findall("[a-zA-Z]+|[一-龥]{2,}", text.lower()):
            h = int(hashlib.md5(w.encode()).hexdigest(), 16) & (1 << 64) - 1
            votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
        return sum(1 << i for i, v in enumerate(votes) if v > 0)

    texts = ["one two three", "学校发布通知 abc", " ".join(f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(700)), "same " * 300, "A"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.simhash64(F.col("t"))).collect()]
    assert sorted(g & (1 << 64) - 1 for g in got) == sorted(expected(t) for t in texts)
    assert one(spark, T.simhash64(F.col("t")), t="学") is None


@pytest.mark.parametrize(
    "body, title, verdict",
    [
        ("", "t", "empty_content"), ("one line", "t", "too_few_paragraphs(1)"), ("a\nb 阅读全文", "t", "truncation_marker(阅读全文)"),
        ("a\n\n\n\n\nb", "t", "excessive_newlines"), ("alpha\nbeta", "zzzzyyyy", "title_not_in_body"), ("alpha\nbeta", "abcdal", "ok"), ("alpha\nbeta", "xyz", "ok"),
    ],
)
def test_completeness(spark, body, title, verdict):
    assert one(spark, T.completeness(F.col("b"), F.col("t")), b=body, t=title) == verdict


def nodes_of(spark, html, url="http://h.example.com/a/b.html"):
    return with_nodes(spark.createDataFrame([(1, url, html)], "page_id int, url string, html string"))


def test_links_and_rows(spark):
    html = '<body><ul><li class="r x" id="k">2024 <a href="../n.html#f">News <b>one</b></a> tail<li><a>no</a></ul><div>short <a href=" //o.com/x ">o</a></div></body>'
    page = nodes_of(spark, html).select(H.links().alias("l"), H.page_text(" ").alias("text")).first()
    got = [(x["url"], x["text"], page["text"][x["context_start"] : x["context_end"]], x["parent_class"], x["parent_id"]) for x in page["l"]]
    assert got == [("http://h.example.com/n.html", "Newsone", "2024 News one tail", "r x", "k"), ("http://o.com/x", "o", "short o", "", "")]


def test_malformed_markup(spark):
    html = "<body><p><b>first paragraph text<br><p>second paragraph text<table><tr><td>cell one text<td>cell two text</table><pre>x</pre>"
    got = [(b["pos"], b["text"]) for b in nodes_of(spark, html).select(H.blocks().alias("b")).first()["b"]]
    assert got == [(0, "first paragraph text"), (1, "second paragraph text"), (2, "cell one text"), (3, "cell two text")]


def test_prune(spark):
    words = "<p>" + "plenty of real words here " * 30 + "</p>"
    html = f'<html><body><div class="left sidebar">menu</div>tail<div id="breadNav">kept</div>{words}<div class="a-very-long-class-name-without-meaning" style="{"x" * 300}">t</div></body></html>'
    got = nodes_of(spark, html).select(H.pruned(F.col("html")).alias("p")).first()["p"]
    assert "menu" not in got and "tail" not in got and "breadNav" in got and "plenty" in got and "xxxx" not in got
    assert nodes_of(spark, "<div class=ad>x</div>").select(H.pruned(F.col("html")).alias("p")).first()["p"] == "<div class=ad>x</div>"


def test_main_run(spark):
    def run(scores):
        arr = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(1).alias("size"), F.lit(float(s)).alias("score")) for i, s in enumerate(scores)])
        return [x["pos"] for x in one(spark, H.main_run(arr))]

    assert run([0, 5, 5, 0, 4, 4, 0]) == [1, 2]
    assert run([0, 5, 0, 4, 4, 4]) == [3, 4, 5]
    assert run([0, 5, 0]) == [0, 1, 2]
    assert run([0, 0]) == [0, 1]


def test_next_page(spark):
    page = nodes_of(spark, "<body>none</body>", "http://h/l?page=1")
    assert page.select(H.next_page(F.col("url"))).first()[0] == "http://h/l?page=2"
    story = nodes_of(spark, "<body>none</body>", "http://h/12/x/12.html")
    assert story.select(H.article_next_page(F.col("url"), F.array(F.lit("")))).first()[0] == "http://h/13/x/12.html"
    seen = F.array(F.lit("http://h/13/x/12.html"))
    assert story.select(H.article_next_page(F.col("url"), seen)).first()[0] is None


def test_pack_blocks(spark):
    def expected(blocks, budget, rate):
        done, cur, used = [], [], 0
        for b in blocks:
            if used + len(b) // 2 > budget and cur:
                done.append("\n".join(cur))
                cur = cur[-max(1, int(len(cur) * rate)):]
                used = sum(len(c) // 2 for c in cur)
            cur, used = cur + [b], used + len(b) // 2
        return done + (["\n".join(cur)] if cur else [])

    blocks = [chr(97 + i % 26) * (7 * i % 90 + 3) for i in range(60)]
    got = one(spark, chunks.pack_blocks(F.array(*[F.lit(b) for b in blocks]), budget=120, overlap=0.1))
    assert got == expected(blocks, 120, 0.1)
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.repeat(F.lit("x"), i * 7 % 90 + 3)).alias("b"))
    start = time.time()
    got = long.select(chunks.pack_blocks(F.col("b"), budget=300, overlap=0.1).alias("c")).first().c
    assert got == expected(["x" * (i * 7 % 90 + 3) for i in range(20_000)], 300, 0.1)
    assert time.time() - start < 20


def test_page_chunks(spark):
    blocks = F.array(F.lit("<p>aaaaaa</p>"), F.lit("<p>bbbbbb</p>"))
    cut = lambda html, b=blocks: one(spark, chunks.page_chunks(html, b, budget=10))
    assert cut(F.lit("<p>aaaaaa</p><p>bbbbbb</p>")) == ["<p>aaaaaa</p>", "<p>aaaaaa</p>\n<p>bbbbbb</p>"]
    assert cut(F.lit("<p>a</p>")) == ["<p>a</p>"]
    assert cut(F.lit("")) == cut(F.lit(None).cast("string")) == []
    assert cut(F.lit("x" * 40), F.expr("CAST(array() AS ARRAY<STRING>)")) == ["x" * 40]


def test_next_version(spark):
    base = spark.createDataFrame([(1,), (2,)], "article_id bigint")
    drafts = spark.createDataFrame([(1, 1), (1, 3)], "article_id bigint, version bigint")
    assert {tuple(r) for r in articles.next_version(base, drafts).collect()} == {(1, 4), (2, 1)}


def test_unknown_look():
    with pytest.raises(ValueError):
        reports.article_html("no-such-look", *[F.lit("x")] * 7)


def test_malformed_sitemap(spark):
    maps = spark.createDataFrame([("m", "h", "<urlset><url><loc>http://h/a"), ("n", "h", "<urlset><url><loc>http://h/b</loc></url></urlset>")], "sitemap string, host string, xml string")
    assert [r.url for r in sitemaps.sitemap_urls(maps).collect()] == ["http://h/b"]


def test_score_labels_fallback(spark):
    scores = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.9), (1, "c", 0.31), (1, "d", 0.5), (2, "a", 0.29), (3, "a", 7.0)], "article_id bigint, label string, score double")
    got = {r.article_id: [(c.label, c.confidence) for c in r.categories] for r in articles.score_labels(scores, ["a", "b", "c", "d"]).collect()}
    assert got == {1: [("a", 0.9), ("b", 0.9), ("d", 0.5)], 2: [("未分类", 0.0)], 3: [("a", 1.0)]}


def test_custom_scorer(spark):
    base = spark.createDataFrame([(1, "t", "b"), (2, "u", "b")], "article_id bigint, title string, raw_content string")

    def scorer(frames):
        for pdf in frames:
            yield pdf.assign(label="k", score=[0.8 if t == "t" else 0.1 for t in pdf["title"]])[["article_id", "label", "score"]]

    got = {r.article_id: r.categories[0].label for r in articles.label_articles(base, {"k": ("x",)}, scorer).collect()}
    assert got == {1: "k", 2: "未分类"}


def test_append_articles(spark, tmp_path):
    from gleaner.sources.sinks import append_articles

    path = str(tmp_path / "articles")
    rows = lambda *r: spark.createDataFrame(list(r), "article_id bigint, original_link string")
    append_articles(rows((1, "a"), (2, "a"), (3, "b")), path)
    append_articles(rows((4, "b"), (5, "c")), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b"), (5, "c")]


def test_missed_run_day(spark):
    from gleaner.operators.ordered import missed_run_day

    day = lambda s: F.lit(s).cast("date")
    got = lambda days, last: one(spark, missed_run_day(F.array(*[F.lit(d) for d in days]), day(last), day("2024-03-06")))  # a Wednesday
    assert got([3], None) == dt.date(2024, 3, 6) and got([1], None) is None
    assert got([1, 2], "2024-03-03") == dt.date(2024, 3, 5) and got([3], "2024-03-06") is None and got([0], "2023-01-01") == dt.date(2024, 3, 3)


def test_filter_choice(spark):
    from gleaner.operators.pages import filter_choice

    body = "".join(f"<p>budget report {i} " + "budget words " * 10 + "</p>" for i in range(6))
    noise = "".join(f"<p>unrelated stuff {i} entirely different</p>" for i in range(60))
    pages = spark.createDataFrame(
        [(1, "http://h/1", f"<html><head><title>budget report</title></head><body>{body}</body></html>"),
         (2, "http://h/2", "<p>short</p>"),
         (3, "http://h/3", f"<html><head><title>budget report</title></head><body>{body}{noise}</body></html>")],
        "page_id int, url string, html string",
    )
    got = {r.page_id: r for r in filter_choice(pages).collect()}
    assert got[1].choice == "pruned" and got[2].choice == "raw" and got[3].choice == "pruned"
    assert got[3].relevant_chars == len(body) < got[3].pruned_chars


def test_replace_partitions_and_lines(spark, tmp_path):
    from gleaner.sources.sinks import replace_partitions, write_lines

    path = str(tmp_path / "queue")
    rows = lambda *r: spark.createDataFrame(list(r), "task_id bigint, url string")
    replace_partitions(rows((1, "a"), (1, "b"), (2, "c")), path, "task_id")
    replace_partitions(rows((1, "d")), path, "task_id")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("task_id", "url").collect()) == [(1, "d"), (2, "c")]
    write_lines(spark.createDataFrame([(2, "y"), (1, "x")], "n int, s string").orderBy("n"), str(tmp_path / "text"), "s")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["x", "y"]


def test_long_card_is_cut(spark):
    from gleaner.operators import reports

    day = F.lit("2024-01-02").cast("date")
    digest = spark.range(30).select(
        F.lit("2024-W01").alias("year_week"), (F.col("id") % 15 + 1).cast("int").alias("group_no"), F.concat(F.lit("g"), F.col("id") % 15).alias("group_name"),
        F.lit(2).alias("group_size"), F.col("id").alias("article_id"), F.lit("t").alias("title"), F.lit("u").alias("original_link"), day.alias("publish_date"), F.lit("s").alias("summary"),
    )
    weeks = spark.range(1).select(F.lit("2024-W01").alias("year_week"), day.alias("monday"), day.alias("sunday"), F.lit(30).alias("total_articles"), F.lit(15).alias("total_categories"))
    health = spark.createDataFrame([], "year_week string, total_attempts bigint, total_fails bigint, degraded array<struct<no:int,domain:string,attempts:bigint,fail_count:bigint,fail_rate:double>>, fail_rate double")
    import json

    (row,) = reports.digest_cards(digest, weeks, health).collect()
    elements = json.loads(row.card)["card"]["elements"]
    assert len(elements) == 21 == row.elements and elements[1] == {"tag": "hr"} and elements[-1]["content"] == "… 共 30 篇，完整内容请查看邮件"


def test_edit_log_over_gaps(spark):
    from gleaner.operators.articles import edit_log

    drafts = spark.createDataFrame([(1, 1, "a", "x", "e"), (1, 3, "a", "y", "e"), (2, 5, "t", "b", "e")], "article_id long, version int, title string, body string, editor string")
    assert [tuple(r) for r in edit_log(drafts).collect()] == [(1, 3, "e", "body", "x", "y")]


def test_silent_scorer_leaves_articles_uncategorised(spark):
    from gleaner.operators.articles import label_articles

    articles = spark.createDataFrame([(1, "t", "b"), (2, "t", "b")], "article_id long, title string, raw_content string")
    one = lambda frames: (f[f.article_id == 1][["article_id"]].assign(label="x", score=0.9) for f in frames)
    got = {r.article_id: [tuple(c) for c in r.categories] for r in label_articles(articles, {"x": ["w"]}, one).collect()}
    assert got[1] == [("x", 0.9)] and got[2][0][1] == 0.0


def test_fingerprint_reads_whole_texts(spark):
    from pyspark.sql import functions as F

    from gleaner.functions.text import fingerprint

    rows = spark.createDataFrame([(None, "a" * 300 + "x"), (None, "a" * 300 + "y"), ("", "a" * 300 + "x")], "t string, b string")
    prints = [r.p for r in rows.select(fingerprint(F.col("t"), F.col("b")).alias("p")).collect()]
    assert prints[0] == prints[2] != prints[1]


def test_merge_of_chains_recrawls_and_circles(spark):
    """A chain of nine, crawled six times; a circle of two; one with a tail into it; a page without url, which is an article of its own."""
    link = lambda i: f"u{i}"
    rows = [(i + 100 * k, link(i), link(i + 1) if i < 9 else None, f"b{i}-{k}", [f"i{i % 2}"]) for k in range(6) for i in range(1, 10)]
    rows += [(20, "c0", "c1", "x", None), (21, "c1", "c0", "y", None), (30, "d0", "d1", "p", []), (31, "d1", "d2", "q", []), (32, "d2", "d1", "r", [])]
    rows += [(40, None, "u1", "lost", []), (41, "e", "e", "own", []), (42, "f", "gone", "end", ["z"])]
    pages_in = spark.createDataFrame(rows, "page_id bigint, url string, next_url string, body string, images array<string>")
    got = {r.page_id: (r.parts, r.body.split("\n\n"), r.images) for r in pages.multipage_merge(pages_in).collect()}
    assert got == {
        501: (9, [f"b{i}-5" for i in range(1, 10)], ["i1", "i0"]), 20: (2, ["x", "y"], []), 30: (3, ["p", "q", "r"], []),
        40: (1, ["lost"], []), 41: (1, ["own"], []), 42: (1, ["end"], ["z"]),
    }
    assert pages.multipage_merge(pages_in.limit(0)).count() == 0


def test_sitemaps_in_circles_and_long_lists(spark):
    index = lambda *to: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in to) + "</sitemapindex>"
    listed = "<urlset>" + "".join(f"<url><loc>http://h/{i}</loc></url>" for i in range(2500)) + "</urlset>"
    maps = spark.createDataFrame([("a", "h", index("b", "c")), ("b", "h", index("a", "d")), ("c", "h", None), ("d", "h", index("e")), ("e", "h", index("f")), ("f", "h", listed)], "sitemap string, host string, xml string")
    got = {(r.sitemap, r.depth) for r in sitemaps.expand(maps.filter("sitemap = 'a'"), maps).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3), ("f", 4)}
    assert sitemaps.sitemap_urls(maps).count() == 2500


@pytest.mark.parametrize(
    "json, day",
    [
        ('{"@graph":[{"@graph":[[{"datePublished":"2021-02-03"}]]}]}', dt.date(2021, 2, 3)), ('[[[[{"dateModified":"2020-01-02"}]]]]', dt.date(2020, 1, 2)),
        ('[{"@graph":{"datePublished":"2019-05-06"}},{"datePublished":"2018-01-01"}]', dt.date(2019, 5, 6)), ("[]", None), ("{", None), (None, None),
    ],
)
def test_nested_jsonld(spark, json, day):
    assert spark.createDataFrame([(json,)], "j string").select(D.jsonld_date(F.col("j"))).first()[0] == day


def test_dates_and_language_of_long_texts(spark):
    far = "x " * 20000
    assert one(spark, D.publish_date_guess(F.col("t"), F.lit(None).cast("date")), t=far + "2021-05-06") == dt.date(2021, 5, 6)
    assert one(spark, D.markup_date(F.col("t")), t=far + '<time datetime="2021-05-06">') == dt.date(2021, 5, 6)
    assert one(spark, D.has_publish_hint(F.col("t"), "2024-03-01"), t=far + "2024-01-05") is True
    assert one(spark, T.language(F.col("t")), t="q " * 1500 + "中文报道" * 1000) == "zh"
