"""Allow-list rules from a table."""

import pytest

from gleaner.operators import crawl

RULES = "pattern string, mode string, enabled boolean, deleted boolean"


def verdicts(spark, hosts, rules):
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "id long, host string")
    return [r.allowed for r in crawl.with_allowed(pages, "host", spark.createDataFrame(rules, RULES)).orderBy("id").collect()]


def test_modes_case_and_switches(spark):
    rules = [
        (" A.Example.com ", "exact", True, False), ("example.org", "suffix", True, False), (r"^blog\.[a-m]", "regex", True, False),
        ("([", "regex", True, False), ("off.net", "suffix", False, False), ("gone.net", "suffix", True, True),
        (None, "exact", True, False), ("odd.net", "prefix", True, False), ("null.net", "exact", None, False), ("kept.net", "exact", True, None),
    ]
    hosts = ["a.example.com", "b.a.example.com", "example.org", "X.Example.org", "notexample.org", "blog.met", "blog.zoo", "off.net", "gone.net", "odd.net", "null.net", "kept.net", "", None]
    assert verdicts(spark, hosts, rules) == [True, False, True, True, False, True, False, False, False, False, False, True, False, False]


def test_empty_tables(spark):
    assert verdicts(spark, ["a.b"], []) == [False]
    assert verdicts(spark, [], [("a.b", "exact", True, False)]) == []


def test_many_rules_meet_by_key(spark):
    rules = spark.range(100_000).selectExpr("concat('h', id, '.example.com') AS pattern", "IF(id % 2 = 0, 'exact', 'suffix') AS mode", "true AS enabled", "false AS deleted")
    pages = spark.range(20_000).selectExpr("id", "concat(IF(id % 4 > 1, 'www.', ''), 'h', IF(id % 3 = 0, 7, id), '.example.com') AS host")
    out = crawl.with_allowed(pages, "host", rules)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    for r in out.collect():
        assert r.allowed == (int(r.host.removeprefix("www.")[1:].split(".")[0]) % 2 == 1 or not r.host.startswith("www."))
