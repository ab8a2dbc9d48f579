"""Public-suffix split with a large rule list, with and without a broadcast."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from domlens.functions import domain as D

HOSTS = [("www.example.co.uk", "co.uk", "example", "www"), ("a.b.foo.ck", "foo.ck", "b", "a"),
         ("www.ck", "ck", "www", ""), ("x.city.kawasaki.jp", "kawasaki.jp", "city", "x"),
         ("shop.example.t1234", "t1234", "example", "shop"),
         ("b.a.example.t5", "example.t5", "a", "b"), ("q.unknown", "", "unknown", "q"),
         ("1.2.3.4", "", "1.2.3.4", "")]


@pytest.fixture(scope="module")
def big_rules(spark):
    d = tempfile.mkdtemp(prefix="domlens-psl-")
    path = os.path.join(d, "rules.txt")
    with open(path, "w") as fh:
        fh.write("// synthetic long list\n")
        for line in D.read_rule_lines():
            fh.write(line + "\n")
        for i in range(3000):
            fh.write(f"t{i}\nexample.t{i}\n" if i != 1234 else "t1234\n")
    return D.load_suffix_rules(spark, path)


def _split(spark, rules):
    df = spark.createDataFrame([(h,) for h, *_ in HOSTS], "domain_name string")
    out = D.with_domain_parts(df, "domain_name", rules)
    return {r.domain_name: (r.tmp_tld, r.tmp_sld, r.tmp_sub) for r in out.collect()}


def test_large_list(spark, big_rules):
    got = _split(spark, big_rules)
    for h, tld, sld, sub in HOSTS:
        assert got[h] == (tld, sld, sub), h


def test_no_broadcast(spark, big_rules):
    """Above Spark's own threshold the rules are joined, with the same rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = _split(spark, big_rules)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for h, tld, sld, sub in HOSTS:
        assert got[h] == (tld, sld, sub), h


def test_odd_names(spark, rules):
    df = spark.createDataFrame([(None,), ("",), (".",), ("com",), ("a..com",), ("A.CO.UK",)], "domain_name string")
    out = {r.domain_name: (r.tmp_tld, r.tmp_sld, r.tmp_sub) for r in D.with_domain_parts(df, "domain_name", rules).collect()}
    assert out[""] == ("", "", "") and out["com"] == ("com", "", "") and out["A.CO.UK"] == ("CO.UK", "A", "") and out[None][0] in ("", None)


def test_shipped_rules_are_broadcast(spark, rules):
    """The records aren't shuffled by their last label: the size of the shipped list is known when the join is planned."""
    df = spark.range(10).select(F.concat(F.lit("www.a"), F.col("id").cast("string"), F.lit(".com")).alias("domain_name"))
    plan = D.with_domain_parts(df, "domain_name", rules)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
