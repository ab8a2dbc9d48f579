"""What the findings of round 3 asked for: rows computed once, copies of a hot name spread, packed raw documents."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from domlens import session
from domlens.operators import profile as PR
from domlens.operators import setops as S
from domlens.plans import catalog_ml, catalog_profile, catalog_sources, records

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@tables
def test_feature_correlations_are_sums_of_products(spark, monkeypatch):
    def wide(*_):
        raise AssertionError("an aggregate a pair")

    df = catalog_profile._tls_table(spark, SF)
    want = {(r[0], r[1]): r[2] for r in PR.correlations(PR.label_codes(df, "label"), ["tls_chain_len", "tls_has_tls", "label_code"]).collect()}
    monkeypatch.setattr(PR, "correlations", wide)
    found = {(r["feature_a"], r["feature_b"]): r["corr"] for r in E.queries()["A6_feature_correlations"](spark, SF).collect()}
    for pair, v in want.items():
        assert (v is None and found[pair] is None) or (v != v and found[pair] != found[pair]) or found[pair] == pytest.approx(v, abs=1e-6)  # the query rounds



@tables
def test_raw_documents_are_written_packed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog_sources, "folder", lambda _: str(tmp_path / "raw"))
    assert E.queries()["S1_F1_P1_P4_raw_documents"](spark, SF).count() > 0
    assert glob.glob(str(tmp_path / "raw" / "*.json.gz")) and not glob.glob(str(tmp_path / "raw" / "*.json"))



def test_histograms_take_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        seen.add(1)
        return x

    rows = [(c, float(i % 7) if i % 5 else None, 3.0) for i in range(40) for c in ("a", "b", None)]
    df = spark.createDataFrame(rows, "label string, x double, same double").withColumn("x", value.asNondeterministic()("x"))
    found = PR.histograms(df, ["x", "same"], "label", bins=4).collect()
    assert seen.value == len(rows)
    assert len(found) == 2 * 3 * 4
    for c in ("a", "b"):
        values = [-1.0 if x is None else x for k, x, _ in rows if k == c]
        want = [0] * 4
        for v in values:
            want[min(math.floor((v + 1) / 7 * 4), 3)] += 1
        assert [r["count"] for r in sorted(found, key=lambda r: r["bin"]) if r["feature"] == "x" and r["class"] == c] == want
        assert [r["count"] for r in sorted(found, key=lambda r: r["bin"]) if r["feature"] == "same" and r["class"] == c] == [0, 0, 40, 0]
    assert all(r["count"] == 0 for r in found if r["class"] is None)



def test_copies_of_a_hot_name_are_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "SPAN", 64, raising=False)
    monkeypatch.setattr(S, "TASK_COPIES", 1_000, raising=False)
    names = spark.createDataFrame([("hot",)] * 2_500 + [("cold",), ("none",), (None,)], "domain_name string")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("hot", 2), ("cold", 3), ("other", 4), (None, 5)], "domain_name string, page_id int").coalesce(1)
    found = S.lookup_copy(names, table)
    assert {(r[0], r[1]): r[2] for r in found.groupBy("domain_name", "page_id").count().collect()} == {("hot", 1): 2_500, ("hot", 2): 5_000, ("cold", 3): 1}
    most = found.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most < 2_500
    assert S.lookup_copy(names.limit(0), table).count() == 0



def test_grid_search_reads_a_kept_table(spark, monkeypatch, tmp_path):
    rows = [(i, [float(i % 3), float(i % 5), float(i % 10)], i % 10) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    given, search = [], catalog_ml.ML.grid_search
    monkeypatch.setattr(catalog_ml.ML, "grid_search", lambda lr, grid, train, *a, **k: given.append(train) or search(lr, grid, train, *a, **k))
    assert catalog_ml.grid_search(spark, str(tmp_path)).count() == 3
    assert all("/grid-" in f for f in given[0].inputFiles())


def test_entropies_of_a_batch():
    import pandas as pd

    from domlens.functions import pyhelpers as H

    def want(t):
        return -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) / len(t) if t else 0.0

    texts = ["", "a", "aab", None, "", "žluťoučký\n", "aa", "\U0001f600a", "Supplier#000000001"]
    found = H.norm_entropy_udf.func(pd.Series(texts)).tolist()
    assert [None if pd.isna(x) else pytest.approx(x) for x in found] == [None if t is None else want(t) for t in texts]
    lists = [["ab", "", "abc"], None, [], ["aa"]]
    assert H.norm_entropy_sum_udf.func(pd.Series(lists)).tolist() == pytest.approx([sum(map(want, v or [])) for v in lists])
    assert H.norm_entropy_sum_udf.func(pd.Series([None, []])).tolist() == [0.0, 0.0] and H.norm_entropy_udf.func(pd.Series([None], dtype=object)).isna().all()


@tables
def test_orders_get_their_customer_before_the_lines(spark):
    plan = records.joined(spark, SF)._jdf.queryExecution().analyzed().toString().split("\n")
    depth = {k: next(line.index("Join") for line in plan if f"Join Inner, ({k}" in line) for k in ("o_custkey", "l_orderkey")}
    assert depth["o_custkey"] > depth["l_orderkey"]


def test_a_scan_with_a_piece_a_core_is_not_shuffled(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 100, 1, cores)
    assert session.ensure_parallelism(df) is df
    assert session.ensure_parallelism(df.coalesce(1)).rdd.getNumPartitions() == 2 * cores
