"""The shape of plans: what must, and must not, be in them."""

import re

import pytest

from gleaner import plans

QUERIES = plans.load()
USES_PYTHON = {
    "html_text", "text_blocks", "block_doc_freq", "bm25_blocks", "main_content_run", "prune_html", "filter_choice", "images", "attachments",
    "source_unit", "next_page_url", "article_next_page", "article_date", "link_density", "page_routing", "text_density_filter", "chunk_overlap",
    "portal_page", "extract_chain", "allowlist_table",
    # link jobs read pages
    "extract_links", "link_score", "looks_like_article", "hub_links", "frontier_quota", "frontier_order", "topn_links", "listing_candidates", "ordered_distinct",
}
RUNS_ON_BUILD = {k for k in QUERIES if k.startswith("stream_")} | {"weekly_window", "extract_chain", "near_dup_titles", "near_dup_first", "exact_dup", "sitemap_expand", "multipage_merge", "login_lockout"}


def plan(tables, key):
    df = QUERIES[key].run(tables)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - RUNS_ON_BUILD))
def test_no_cross_joins_and_no_stray_python(tables, key):
    text = plan(tables, key)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert key in USES_PYTHON or not re.search(r"MapInArrow|MapInPandas|FlatMapGroups|ArrowEvalPython|BatchEvalPython", text)


def test_near_duplicates_meet_on_keys(spark, tables):
    for key in ("near_dup_titles", "near_dup_first"):
        text = plan(tables, key)
        assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_anti_joins(tables):
    for key in ("new_urls", "resume_remaining", "cache_misses", "promotion_insert", "undelivered"):
        assert "LeftAnti" in plan(tables, key), key


def test_first_k_of_a_group_is_cut_before_the_shuffle(tables):
    for key in ("frontier_quota", "topn_per_category", "listing_candidates"):
        assert "WindowGroupLimit" in plan(tables, key), key


def test_few_scans_and_a_shared_shuffle_for_ordered_work(tables):
    """One scan, or two where bucket sizes are counted first; what is cut into buckets is shuffled once for both uses."""
    for key, scans in (("fetch_fail_streak", 2), ("chain_breaker", 2), ("proxy_disable", 1), ("status_machine", 2), ("politeness_schedule", 1)):
        df = QUERIES[key].run(tables)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan") <= scans and "ReusedExchange" in final, key


def test_top_n_is_taken_not_sorted(tables):
    for key in ("article_page", "topn_links", "date_counts"):
        assert "TakeOrderedAndProject" in plan(tables, key), key


def test_filters_and_columns_reach_the_scan(tables):
    text = plan(tables, "article_search")
    assert re.search(r"PushedFilters: \[[^\]]*o_orderstatus", text)
    assert "o_totalprice" not in text
    assert "html" not in plan(tables, "url_domain") and "value" not in re.search(r"ReadSchema: [^\n]*", plan(tables, "site_failure_rank")).group(0)
