"""Pages without blocks, tables in folders, and rows whose results do not depend on how they are laid out."""

from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.sources.html import with_nodes

PAGES = [(1, "<title>solar power</title><p>solar power is here today</p><p>nothing else is said</p>"), (2, "<p>short</p>"), (3, ""), (4, None)]


def scored(spark):
    pages = with_nodes(spark.createDataFrame(PAGES, "page_id long, html string").withColumn("url", F.lit("http://a.b/")))
    return pages.select("page_id", H.bm25(H.blocks(), H.query_terms(F.col("html"))).alias("scored"))


def test_pages_without_blocks_have_no_scores(spark):
    got = scored(spark).select("page_id", F.explode("scored").alias("b")).select("page_id", "b.pos", F.col("b.score") > 0).collect()
    assert sorted(map(tuple, got)) == [(1, 0, True), (1, 1, False)]


def test_pages_without_blocks_have_no_main_run(spark):
    got = scored(spark).select("page_id", F.explode(H.main_run(F.col("scored"))).alias("b")).select("page_id", "b.pos").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 1)]


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from gleaner.plans import load, runner

    text = "CAST(id AS STRING) || '. same text'"
    made = spark.range(20).selectExpr("id AS doc_id", f"IF(id % 2 = 0, {text}, 'twin. text') AS text", "'s' AS source", "'en' AS lang")
    made.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert runner(load()["stream_dedup"])(spark, str(tmp_path)).count() == 11


def test_tasks_hold_a_bounded_number_of_rows(spark, tmp_path):
    from gleaner.functions.stage import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    made = spread(spark.read.parquet(str(tmp_path / "t")), 50)
    counts = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 1000 and len(counts) == 20 and max(counts) <= 60


def test_words_are_counted_before_they_become_rows(spark):
    from gleaner.operators import pages as op

    pages = [(1, "<p>green solar solar</p><p>solar power now</p>"), (1, "<p>solar park here</p>"), (None, "<p>solar again ok</p>"), (2, None)]
    df = with_nodes(spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit("http://a.b/")))
    got = op.block_doc_freq(df)
    assert {(r.page_id, r.token): r.df for r in got.collect()} == {
        (1, "green"): 1, (1, "solar"): 3, (1, "power"): 1, (1, "now"): 1, (1, "park"): 1, (1, "here"): 1, (None, "solar"): 1, (None, "again"): 1, (None, "ok"): 1
    }
    held = spark.createDataFrame([(["a", "b", "b", "c"],), ([],)], "w array<string>")
    assert [[tuple(t) for t in r[0]] for r in held.select(op.counted(F.col("w"))).collect()] == [[("a", 1), ("b", 2), ("c", 1)], []]


def test_lockouts_over_more_tasks(spark, monkeypatch):
    from gleaner.operators import ordered

    tries = spark.range(400).selectExpr("id % 2 AS ip", "(id * id % 977) * 20000000 AS moment", "id AS event_id", "IF(id % 7 = 0, 'success', 'failure') AS kind")
    want = sorted(map(tuple, ordered.login_verdicts(tries).collect()))
    assert ordered.enough_tasks(tries) is None
    monkeypatch.setattr(ordered, "ROWS_A_TASK", 20)
    assert ordered.enough_tasks(tries) == 20
    assert sorted(map(tuple, ordered.login_verdicts(tries).collect())) == want


def test_state_stores_reserve_no_disk(spark):
    from gleaner.streaming import state

    name = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
    before = spark.conf.get(name, None)
    with state.rocksdb(spark):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name, None) == before


def test_shuffles_of_one_write_are_deleted_with_it(spark, tmp_path):
    import os
    import time

    from gleaner.session import one_use_shuffles

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in folders for _, _, fs in os.walk(d) for f in fs if f.endswith(".data")}
    kept = spark.range(1000).repartition(8, "id").groupBy("id").count()
    kept.write.parquet(str(tmp_path / "kept"))
    first = held()
    with one_use_shuffles(spark):
        spark.range(1000).repartition(8, "id").write.parquet(str(tmp_path / "freed"))
    for _ in range(20):
        if not held() - first:
            break
        time.sleep(0.5)
    assert first and not held() - first
    assert spark.read.parquet(str(tmp_path / "freed")).count() == 1000
