"""Headline queries, timed: prints one JSON line.

Every result is written to Spark's noop sink, so all rows and columns are produced.
BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_QUERIES (comma list or "all").
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "site_failure_rank,promotions,category_counts,article_page,article_search,weekly_digest,report_card_json,"
    "task_outcomes,url_date,normalize_url,tokenize,clean_noise,exact_dup,simhash64,near_dup_first,text_blocks,"
    "bm25_blocks,main_content_run,prune_html,extract_links,link_score,frontier_order,score_labels,edit_log,"
    "fetch_fail_streak,login_lockout,api_score,stream_site_stats"
)


def main() -> None:
    from gleaner import plans
    from gleaner.session import local_session
    from gleaner.sources.tables import Tables

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "4"))
    registry = plans.load()
    wanted = os.environ.get("BENCH_QUERIES", HEADLINE)
    keys = list(registry) if wanted == "all" else [k for k in wanted.split(",") if k]
    registry["url_domain"].run(Tables(spark, folder)).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    took = {}
    for key in keys:
        start = time.perf_counter()
        registry[key].run(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        took[key] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
